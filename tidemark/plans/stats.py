"""Column statistics, equi-depth histograms, and the shares of rows that predicates keep by them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def column_stats(df: DataFrame, columns: list[str] | None = None, exact: bool = False) -> DataFrame:
    """(column, n, nulls, distinct, low, high): one pass over the rows, one row for each column."""
    names = columns or df.columns
    ndv = F.count_distinct if exact else F.approx_count_distinct
    one = df.agg(F.count("*").alias("n"), *[x for c in names for x in (F.count(c).alias(f"{c}__f"), ndv(c).alias(f"{c}__d"), F.min(c).cast("string").alias(f"{c}__l"), F.max(c).cast("string").alias(f"{c}__h"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), (F.col("n") - F.col(f"{c}__f")).alias("nulls"), F.col(f"{c}__d").alias("distinct"), F.col(f"{c}__l").alias("low"), F.col(f"{c}__h").alias("high")) for c in names])
    return one.select(F.inline(rows))


@dataclass
class Histogram:
    """bounds: the edges of buckets that hold about as many rows each."""

    bounds: list[float]

    @staticmethod
    def of(df: DataFrame, column: str, buckets: int = 16, accuracy: int = 10_000) -> Histogram:
        at = [i / buckets for i in range(buckets + 1)]
        return Histogram([float(x) for x in df.agg(F.percentile_approx(F.col(column).cast("double"), at, accuracy).alias("x")).first()["x"] or []])

    def share(self, low: float | None = None, high: float | None = None) -> float:
        """Of rows between ``low`` and ``high``, buckets counted in the part that overlaps; a third without bounds."""
        if len(self.bounds) < 2:
            return 1 / 3
        low = self.bounds[0] if low is None else low
        high = self.bounds[-1] if high is None else high
        total = 0.0
        for a, b in zip(self.bounds, self.bounds[1:], strict=False):
            total += (1.0 if low <= a <= high else 0.0) if a == b else max(0.0, min(b, high) - max(a, low)) / (b - a)
        return total / (len(self.bounds) - 1)


def equality_share(distinct: int) -> float:
    return 1 / distinct if distinct > 0 else 0.1
