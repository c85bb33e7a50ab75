"""Upload sessions in blocks that become rows all at once, and downloads by ranges of rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from ..plans.lake import Lake


class Upload:
    """Blocks can be sent in any order and again; a commit names those that count and adds their rows in one step."""

    def __init__(self, lake: Lake, table: str) -> None:
        self.lake, self.table, self.session = lake, table, uuid.uuid4().hex

    def _path(self, block: int) -> str:
        return f"{self.lake.root}/.upload/{self.session}/{block}"

    def send(self, block: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(self._path(block))

    def commit(self, blocks: list[int]) -> None:
        self.lake.insert(self.table, self.lake.spark.read.parquet(*[self._path(b) for b in blocks]))
        self.lake.files.delete(f".upload/{self.session}")


def download(df: DataFrame, order: list[str], start: int, count: int) -> DataFrame:
    """``count`` rows from the ``start``-th on, in ``order``; no task sees all rows."""
    return ranked(df, order, name="__i").filter((F.col("__i") >= start) & (F.col("__i") < start + count)).select(*df.columns)
