"""Operator 1: mixing sources to target weights, with DataFrame functions alone.

Each row gets a hash-random key. The top bits of the key deal the rows of a source into ranges, which are
sorted one by one; sums by range give each range the number of words before it, so that no task needs a whole source.
A source's budget is so many whole epochs, and the rest is cut from the front of its order at exactly that word.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

#: log2 of the ranges of each source. A range of a source with 10 billion rows then has 2.5 million small rows.
RANGE_BITS = 12


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, keep: bool) -> DataFrame:
    source = F.col(source_col).cast("string")
    made = {
        "__id": F.col(id_col),
        "__name": source,
        "__src": F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)),
        "__size": F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"),
        "__key": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)),
    }
    new = [c.alias(n) for n, c in made.items()]
    out = docs.select(*([F.struct("*").alias("__row")] if keep else []), *new)
    return out.withColumn("__range", F.shiftrightunsigned("__key", 64 - RANGE_BITS))


def _targets(sources: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """Water-filling in closed form: sorted by most * size / weight, the first source that its level does not fill ends the capped ones; later levels are lower."""
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("__name").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    up = Window.orderBy("__fill", "__src")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("__n") * F.lit(float(most))
    level = (F.sum("__n").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("__weight").over(up.rowsBetween(0, Window.unboundedFollowing))
    return (
        sources.select("__src", "__n", weight.alias("__weight"), cap.alias("__cap"))
        .withColumn("__fill", F.col("__cap") / F.col("__weight"))
        .withColumn("__level", level)
        .withColumn("__at", F.max(F.when(F.col("__fill") >= F.col("__level"), F.col("__level"))).over(every))
        .select("__src", F.col("__n").alias("source_size"), F.least("__cap", F.col("__weight") * F.coalesce("__at", F.lit(0.0))).alias("target"))
    )


def _cuts(keyed: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """For each range of each source: the words before it, and what its source has and shall give."""
    ranges = keyed.groupBy("__src", "__range").agg(F.sum("__size").alias("__n"), F.first("__name").alias("__name"))
    sources = ranges.groupBy("__src").agg(F.sum("__n").alias("__n"), F.first("__name").alias("__name"))
    before = Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranges.select("__src", "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
        .join(_targets(sources, weights, most), "__src")
        .withColumn("__budget", F.least(F.round("target").cast("long"), (F.col("source_size") * int(most)) if float(most).is_integer() else F.floor(F.col("source_size") * most)))
        .withColumn("__epochs", F.when(F.col("source_size") > 0, F.expr("__budget div source_size")).otherwise(0))
        .withColumn("__rest", F.col("__budget") - F.col("__epochs") * F.col("source_size"))
    )


def _decided(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    own = Window.partitionBy("__src", "__range").orderBy("__key", "__id").rowsBetween(Window.unboundedPreceding, -1)
    cuts = cuts.select(F.col("__src").alias("__s"), F.col("__range").alias("__r"), "__before", "source_size", "target", "__epochs", "__rest")
    return (
        keyed.join(cuts, (F.col("__src") == F.col("__s")) & (F.col("__range") == F.col("__r")))
        .withColumn("__left", F.col("__rest") - F.col("__before") - F.coalesce(F.sum("__size").over(own), F.lit(0)))
        .withColumn("__part", F.greatest(F.lit(0), F.least("__size", "__left")))
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 20) -> DataFrame:
    """What a mix of the sources takes of each row.

    ``weights`` go to the sources in code point order (null last), repeating. The sources' targets share the total
    of all sizes by weight; none is above ``most`` times its source's size, and the excess is reshared by weight.

    Returns doc_id, size (words), source_size, target, taken (words, repeats counted), source. In the order of the
    random keys a source gives whole epochs and then the words up to its budget, the rounded target; the one row at
    the cut gives a part of its words, so the sum of ``taken`` is the budget exactly.

    A null or empty text has size 0 and gives 0. Null sources are one source. Rows that are alike in id and text are
    rows of their own, with neighbouring places in the order. Null ids are allowed. Other columns are ignored, whatever
    their names. No rows give no rows.
    """
    keyed = written(_keyed(docs, id_col, text_col, source_col, seed, keep=False), "mix")
    out = _decided(keyed, _cuts(keyed, weights, most))
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), "source_size", "target", (F.col("__epochs") * F.col("__size") + F.col("__part")).alias("taken"), F.col("__name").alias("source"))


def mix_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = (5, 2, 1), most: float = 3, seed: int = 20) -> DataFrame:
    """The mix itself: the columns of ``docs``, each row as often as the mix takes it.

    As ``mix``, but in whole rows: the row at a source's cut comes in full once more, and a row without words comes
    as often as the whole epochs of its source say. Thus a row comes 0 to ``most`` times.
    """
    small = _keyed(docs, id_col, text_col, source_col, seed, keep=False).select("__src", "__name", "__range", "__size")
    out = _decided(_keyed(docs, id_col, text_col, source_col, seed, keep=True), _cuts(small, weights, most))
    times = (F.col("__epochs") + (F.col("__part") > 0).cast("long")).cast("int")
    return out.withColumn("__again", F.explode(F.array_repeat(F.lit(0), times))).select("__row.*")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


