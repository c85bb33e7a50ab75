"""The tables of a data folder, each a Parquet file or folder, as DataFrames and as views for SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_schemas: dict[str, StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The schema is read once for each path; later reads start no job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def named_in(text: str) -> list[str]:
    return [n for n in NAMES if re.search(rf"\b{n}\b", text)]


def run(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the tables that it names. Views are resolved when a DataFrame is made, so later calls may rename them."""
    for n in named_in(text):
        load(spark, sf_dir, n).createOrReplaceTempView(n)
    return spark.sql(text)
