"""Places in an order, for tables and keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_table


def ranked(df: DataFrame, order: list[str], key: str | None = None, name: str = "rank") -> DataFrame:
    """``df`` with each row's place (0 up) in ``order``, of all rows or of those with its ``key``; with a key also ``name`` + "_n", how many those are.

    Rows are dealt into ranges of (key, order), which are written once, numbered within their range, and the sizes of the ranges before
    are added. So no task sees all rows of a table or of a hot key.
    """
    by = [key] if key else []
    dealt = shared_table(df.repartitionByRange(*by, *order).withColumn("__p", F.spark_partition_id()))
    sizes = dealt.groupBy("__p", *by).agg(F.count(F.lit(1)).alias("__n"))  # a row for each range, and for each key of it
    whole = Window.partitionBy(*by)
    before = F.sum("__n").over(whole.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__{c}") for c in by], F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias(f"{name}_n"))
    same = F.col("__p") == F.col("__q")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    here = F.row_number().over(Window.partitionBy("__p", *by).orderBy(*order)) - 1
    out = dealt.withColumn("__i", here).join(sizes, same)
    return out.select(*df.columns, (F.col("__i") + F.col("__before")).alias(name), *([f"{name}_n"] if key else []))
