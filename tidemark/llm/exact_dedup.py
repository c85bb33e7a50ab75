"""Operator 3: exact deduplication by composable polynomial fingerprints.

A text's fingerprint is the value of its UTF-8 bytes as a polynomial, modulo two primes, with the length. The hash
of a joined text is ``hash(a) * base ** len(b) + hash(b)``, so the chunks of a huge text are rows of their own, hashed by
many tasks and then combined by an aggregation. Rows with equal fingerprints are compared with one row of their group, chunk by chunk in
a join on the chunk's number; rows that differ from it (which takes a collision) form groups by their SHA-256.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, discard, table, written

CHUNK = 1 << 16
MODULI = (2_147_483_647, 2_147_483_629)
BASES = (1_103_515_245, 1_664_525_013)
#: Characters of a text that are hashed and compared at once; a longer one goes in parts of so many.
COMPARED = 1 << 20
#: Words of 64 bits of the filter by which texts that equal no other are left out of the comparison's shuffle: a power of two, and the most rows that it broadcasts.
FILTER_WORDS = 1 << 18


@functools.cache
def _powers(base: int, modulus: int) -> np.ndarray:
    """base ** (CHUNK - 1), ..., base, 1."""
    out, x = np.empty(CHUNK, np.uint64), 1
    for i in range(CHUNK - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


def combine(a: tuple[int, ...], b: tuple[int, ...], moduli: tuple[int, ...] = MODULI) -> tuple[int, ...]:
    """The fingerprint of a joined text from those of its two parts: (a hash for each modulus, then the length)."""
    n = b[-1]
    return (*((x * pow(base, n, m) + y) % m for x, y, base, m in zip(a[:-1], b[:-1], BASES, moduli, strict=True)), a[-1] + n)


def fingerprint(data: bytes, moduli: tuple[int, ...] = MODULI) -> tuple[int, ...]:
    """Full chunks are hashed as rows of a matrix, then combined with the rest. A sum of 2 ** 16 products of 39 bits fits 64 bits."""
    whole = len(data) // CHUNK
    out: tuple[int, ...] = (*(0 for _ in moduli), 0)
    if whole:
        rows = np.frombuffer(data, np.uint8, whole * CHUNK).reshape(whole, CHUNK)
        each = [[int((r.astype(np.uint64) * _powers(b, m)).sum()) % m for r in rows] for b, m in zip(BASES, moduli, strict=True)]
        for h in zip(*each, strict=True):
            out = combine(out, (*h, CHUNK), moduli)
    rest = np.frombuffer(data[whole * CHUNK :], np.uint8).astype(np.uint64)
    if n := len(rest):
        out = combine(out, (*(int(np.dot(rest, _powers(b, m)[-n:])) % m for b, m in zip(BASES, moduli, strict=True)), n), moduli)
    return out


FP = ("f1", "f2", "n")


def _norm() -> Column:
    return F.translate(F.coalesce(F.col("text"), F.lit("")), SPACES, "")


def _parts(norm: Column, size: int) -> Column:
    """The text in pieces of ``size`` characters; one piece at least."""
    return F.when(F.length(norm) <= size, F.array(norm)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.length(norm) - 1) / size).cast("int")), lambda i: F.substring(norm, i * size + 1, F.lit(size))))


def _chunk_hashes(moduli: tuple[int, ...]) -> Callable[[Column], Column]:
    """f1, f2, n of a chunk, and what the hash of the text before it is multiplied by."""

    @F.pandas_udf("f1 long, f2 long, n long, s1 long, s2 long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            each = [fingerprint(t.encode(), moduli) for t in texts]
            yield pd.DataFrame([(*x, *(pow(base, x[-1], m) for base, m in zip(BASES, moduli, strict=True))) for x in each], columns=[*FP, "s1", "s2"], dtype="int64")

    return of


def _text_hashes(moduli: tuple[int, ...], size: int) -> Callable[[Column], Column]:
    """f1, f2, n of a text without its white space (null if that has more than ``size`` characters), and its SHA-256."""
    gone = SPACES.encode()

    @F.pandas_udf("f1 long, f2 long, n long, text_sha256 string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                data = (t or "").encode()
                norm = data.translate(None, gone)
                huge = len(norm) > size and len(t) - (len(data) - len(norm)) > size
                rows.append((*((None,) * 3 if huge else fingerprint(norm, moduli)), hashlib.sha256(norm).hexdigest()))
            yield pd.DataFrame(rows, columns=[*FP, "text_sha256"]).astype(dict.fromkeys(FP, "Int64"))

    return of


def _fingerprints(docs: DataFrame, moduli: tuple[int, ...], size: int) -> DataFrame:
    """doc_id, key (of the original text), n_code (code points of it), f1, f2, n, text_sha256, m: rows alike in all are one, and m says how many."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_code"), _text_hashes(moduli, size)(F.col("text")).alias("f"))
    rows = written(rows.select("doc_id", "key", "n_code", "f.*"), "fingerprints")
    whole = rows.filter("f1 IS NOT NULL")
    huge = rows.filter("f1 IS NULL")
    if not huge.isEmpty():
        norm = F.col("norm")
        chunks = docs.filter(F.length("text") > size).select(_norm().alias("norm")).filter(F.length(norm) > size)
        chunks = chunks.select(F.sha2(norm, 256).alias("sha"), F.posexplode(_parts(norm, size)).alias("at", "part"))
        chunks = chunks.repartition("sha", "at").dropDuplicates(["sha", "at"]).select("sha", "at", _chunk_hashes(moduli)(F.col("part")).alias("f"))
        each = F.sort_array(F.collect_list(F.struct("at", *[F.col(f"f.{c}").alias(c) for c in (*FP, "s1", "s2")])))
        start = F.struct(*[F.lit(0).cast("long").alias(c) for c in FP])
        joined = F.aggregate(each, start, lambda a, x: F.struct(*[((a[f] * x[s] + x[f]) % m).alias(f) for f, s, m in (("f1", "s1", moduli[0]), ("f2", "s2", moduli[1]))], (a["n"] + x["n"]).alias("n")))
        of = written(chunks.groupBy("sha").agg(joined.alias("f")), "huge-texts")
        whole = whole.unionAll(huge.join(of, F.col("text_sha256") == F.col("sha")).select("doc_id", "key", "n_code", *[f"f.{c}" for c in FP], "text_sha256"))
    return whole.groupBy("doc_id", "key", "n_code", *FP, "text_sha256").agg(F.count("*").alias("m"))


def _first() -> Column:
    """Of equal texts: the most code points, then the smallest doc_id; a null id comes last."""
    return F.min(F.struct(-F.col("n_code"), F.col("doc_id").isNull(), "doc_id", "text_sha256"))


def _may_hold(docs: DataFrame, keys: DataFrame, words: int = FILTER_WORDS) -> DataFrame:
    """``docs`` (with a column key) without most rows whose key isn't in ``keys`` (__key); none whose key is there is lost.

    The keys set bits of a table of at most ``words`` rows, so what is broadcast is bounded. With far more keys than bits it lets all rows through.
    """

    def word(key: Column) -> Column:
        return F.shiftrightunsigned(key, 6).bitwiseAND(F.lit(words - 1).cast("long"))

    def bit(key: Column) -> Column:
        return F.expr("shiftleft(1L, cast(%s & 63 AS int))" % key)

    bits = keys.groupBy(word(F.col("__key")).alias("__word")).agg(F.bit_or(bit("__key")).alias("__bits"))
    held = docs.join(F.broadcast(bits), word(F.col("key")) == F.col("__word"))
    return held.filter(F.col("__bits").bitwiseAND(bit("key")) != 0).select(*docs.columns)


def _different(docs: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The rows (doc_id, n_code, fingerprint) whose text isn't that of the first row of their fingerprint, after all.

    Only texts with a fingerprint that others have too are read again; they are found by their key, which takes no second fingerprint.
    Rows that have no such key are mostly filtered out where they are read, so that their texts aren't shuffled.
    """
    groups = rows.groupBy(*FP).agg(F.sum("m").alias("__m"), _first().alias("__first")).filter("__m > 1")
    groups = groups.select(*[F.col(c).alias(f"__{c}") for c in FP], F.col("__first.doc_id").alias("keep"), (-F.col("__first.col1")).alias("keep_n"), F.col("__first.text_sha256").alias("keep_sha"))
    same_fp = F.lit(True)
    for c in FP:
        same_fp = same_fp & (F.col(c) == F.col(f"__{c}"))
    keys = written(rows.select("key", *FP).distinct().join(groups, same_fp).select(F.col("key").alias("__key"), *FP, "keep", "keep_n", "keep_sha"), "groups")
    here = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_code"), F.xxhash64("text").alias("key"), "text")
    is_first = F.col("doc_id").eqNullSafe(F.col("keep")) & (F.col("n_code") == F.col("keep_n"))
    is_first = F.when(is_first, F.sha2("norm", 256) == F.col("keep_sha")).otherwise(False)
    # A join of two plain shuffles, whose hot texts Spark can split.
    several = _may_hold(here, keys).join(keys, F.col("key") == F.col("__key")).withColumn("norm", _norm()).select("doc_id", "n_code", *FP, is_first.alias("is_first"), F.posexplode(_parts(F.col("norm"), size)).alias("at", "part"))
    several = written(several, "equal-fingerprints")
    first = several.filter("is_first").groupBy(*FP, "at").agg(F.first("part").alias("__part")).select(*[F.col(c).alias(f"__{c}") for c in FP], F.col("at").alias("__at"), "__part")
    first = written(first, "first-texts")
    out = written(several.join(first, same_fp & (F.col("at") == F.col("__at"))).filter(F.col("part") != F.col("__part")).select("doc_id", "n_code", *FP).distinct(), "different")
    discard(keys, several, first)
    return out


def deduplicate(docs: DataFrame, *, moduli: tuple[int, ...] = MODULI, size: int | None = None) -> DataFrame:
    """Groups texts that are identical after deleting ASCII white space. ``docs``: doc_id, text.

    Returns a row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts the row with the
    most code points, then with the smallest doc_id (null last), stays; of repeated rows of it just one does.
    A null text counts as empty; all empty texts are equal. Other columns are ignored, and no rows give no rows. A text of more than ``size``
    characters is hashed and compared in parts, none of which is left out.
    """
    size = size or COMPARED
    docs = docs.select("doc_id", "text")
    rows = _fingerprints(docs, moduli, size)
    other = _different(docs, rows, size)
    rows = rows.withColumn("cls", F.lit(""))
    if not other.isEmpty():  # a collision: these rows are told apart by SHA-256
        by = ["doc_id", "n_code", *FP]
        other = other.select(*[F.col(c).alias(f"__{c}") for c in by])
        same = F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        for c in by[1:]:
            same = same & (F.col(c) == F.col(f"__{c}"))
        rows = rows.join(other, same, "left").withColumn("cls", F.when(F.col("__n_code").isNull(), "").otherwise(F.col("text_sha256"))).select("doc_id", "n_code", *FP, "text_sha256", "m", "cls")
    key = [*FP, "cls"]
    groups = rows.groupBy(*key).agg(F.sum("m").alias("group_size"), _first().alias("__first"))
    groups = groups.select(*[F.col(c).alias(f"__{c}") for c in key], "group_size", F.col("__first.doc_id").alias("keep_id"), (-F.col("__first.col1")).alias("__keep_n"))
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col(f"__{c}"))
    is_first = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code") == F.col("__keep_n"))
    out = rows.join(groups, same).select("doc_id", "keep_id", "group_size", is_first.alias("__is"), "text_sha256", F.explode(F.sequence(F.lit(1), F.col("m").cast("int"))).alias("__i"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("__is") & (F.col("__i") == 1)).alias("kept"), "text_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
