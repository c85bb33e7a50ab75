"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, pieces, table

ORDERS = (1, 2, 3, 4)
BUCKETS = 1 << 15
#: Different texts of each language that are learned from, about, those with the smallest hashes; of a language with no more, all.
ROWS_A_LANGUAGE = 4000
#: Languages that a model can have: 128 KiB each, wherever it is broadcast. With more there is an error, for none is left out.
LANGUAGES = 1024
#: Characters that are worked on at once, so that a task's memory is bounded.
AT_ONCE = 400_000
#: Log probabilities that are added up at once, and languages that are counted at once.
NUMBERS, COUNTED = 1 << 25, 256
LETTER = regex.compile(r"\p{L}")
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def _features(block: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces of texts: each character's row of n-gram buckets (BUCKETS where the piece ends first), the first character of each piece, the texts' indices."""
    lowered = [text.lower() for _, text in block]
    sizes = np.array([len(t) for t in lowered], np.int64)
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    left = np.repeat(first + sizes, sizes) - np.arange(len(codes))
    out = np.full((len(ORDERS), len(codes)), BUCKETS, np.int32)
    h = np.zeros(len(codes), np.uint64)
    for k, n in enumerate(ORDERS):
        m = max(0, len(codes) - n + 1)
        with np.errstate(over="ignore"):
            h = (h[:m] ^ codes[n - 1 :]) * np.uint64(MIX[k])
            h ^= h >> np.uint64(29)
        fits = left[:m] >= n
        out[k, :m][fits] = ((h * np.uint64(MIX[-1 - k])) >> np.uint64(64 - 15))[fits].astype(np.int32)
    return out, first, np.array([i for i, _ in block], np.int64)


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[str, np.ndarray] = {}

    def told() -> Iterator[pd.DataFrame]:
        for lang, have in total.items():
            at = np.flatnonzero(have[:BUCKETS])
            yield pd.DataFrame({"lang": lang, "bucket": at, "n": have[at]})
        total.clear()

    for batch in batches:
        for lang, rows in batch.groupby("lang"):
            if len(total) >= COUNTED:
                yield from told()
            have = total.setdefault(str(lang), np.zeros(BUCKETS + 1, np.int64))
            for block in pieces(rows["text"].tolist(), AT_ONCE, max(ORDERS) - 1):
                have += np.bincount(_features(block)[0].ravel(), minlength=BUCKETS + 1)
    yield from told()


@dataclass
class LanguageModel:
    """log_prob: BUCKETS + 1 rows, the last all 0, and a column for each language."""

    langs: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray

    def scored(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Each text's language and the model's probability of it; ``und`` with 0 for a null or a text without letters."""
        sums = np.zeros((len(texts), len(self.langs))) + self.log_prior
        for block in pieces(texts, min(AT_ONCE, NUMBERS // max(1, len(self.langs))), max(ORDERS) - 1):
            buckets, first, rows = _features(block)
            full = np.flatnonzero(np.diff(np.append(first, buckets.shape[1])))
            if not len(full):
                continue
            each = self.log_prob[buckets[0]]
            for b in buckets[1:]:
                each += self.log_prob[b]
            np.add.at(sums, rows[full], np.add.reduceat(each, first[full], axis=0, dtype=np.float64))
        found = [t is not None and bool(LETTER.search(t)) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        best = sums.argmax(axis=1)
        p = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        return [self.langs[b] if f else "und" for b, f in zip(best, found, strict=True)], np.where(found, p, 0.0)


def fit(docs: DataFrame, *, rows_a_language: int = ROWS_A_LANGUAGE, text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from the different texts that have a language: all of a language, or about ``rows_a_language`` of them, those with the smallest hashes.

    A text counts once for a language however many copies it has; how likely a language is at first follows from all rows. Which rows may be
    learned from is the caller's choice. More than LANGUAGES languages are an error.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumn("key", F.xxhash64(F.lit(9), "text"))
    copies = rows.groupBy("lang", "key").agg(F.count("*").alias("n"))
    found = copies.groupBy("lang").agg(F.sum("n").alias("n"), F.count("*").alias("texts")).limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"there are more than {LANGUAGES} languages")
    n, texts = ({r["lang"]: r[c] for r in found} for c in ("n", "texts"))
    langs = sorted(n)
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), np.float32), np.zeros(0))
    share = F.element_at(F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, rows_a_language / texts[k])))]), F.col("lang"))
    sample = rows.filter((F.shiftrightunsigned("key", 11) / float(1 << 53)) < share).dropDuplicates(["lang", "key"])
    counts = sample.mapInPandas(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    have = np.zeros((BUCKETS + 1, len(langs)))
    if len(counts):
        have[counts["bucket"].to_numpy(), np.searchsorted(langs, counts["lang"].to_numpy(str))] = counts["n"]
    have[:BUCKETS] += 0.5
    log_prob = np.log(have[:BUCKETS] / have[:BUCKETS].sum(axis=0))
    prior = np.array([n[k] for k in langs], float)
    return LanguageModel(langs, np.vstack([log_prob, np.zeros((1, len(langs)))]).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: LanguageModel, *, text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as a struct ``row``, with ``lang_pred`` and ``score``. The matrix of log probabilities, of fixed size, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.scored(texts.where(texts.notna(), None).tolist())
        return pd.DataFrame({"lang": lang, "score": score})

    return docs.select(F.struct("*").alias("row"), of(F.col(text_col)).alias("p")).select("row", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def identify(docs: DataFrame, *, rows_a_language: int = ROWS_A_LANGUAGE) -> DataFrame:
    """Returns doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang).

    Rows whose crc32(doc_id as text) modulo 4 is 2 are held out from learning, and so are rows without text or lang;
    a null id counts as an empty text there. A null text or one without letters is ``und`` with score 0; with nothing to learn from every row is.
    The score is the model's probability of its language. Repeated rows stay, other columns are ignored, no rows give no rows.
    """
    held = fold(F.col("doc_id"), 4) == 2
    model = fit(docs.filter(~held), rows_a_language=rows_a_language)
    return predict(docs.select("doc_id", held.alias("held_out"), "text"), model).select("row.doc_id", "row.held_out", "lang_pred", "score")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
