"""Named queries, and for each that SQL can express the SQL of another engine that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..tables import run

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """A query whose Spark SQL is ``text``; ``oracle`` where the dialects differ."""
    query(name, oracle or text)(lambda spark, sf_dir: run(spark, sf_dir, text))
