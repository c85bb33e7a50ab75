"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over the character n-grams of its words, and the document's score is the
noisy-or of them: it is toxic unless every sentence is clean. Only documents are labelled; the gradient of the
document's loss reaches the sentences in proportion to their part in it, so that the offending ones are found.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold, table

SENTENCE = re.compile(r"[^.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")
#: Labelled documents that are learned from at most, those with the smallest hashes of the id, as whole texts of so many characters together.
ROWS = 5000
TRAIN_CHARS = 32_000_000
#: Training texts that a learned feature is in at least.
LEAST = 8
GRAMS = (4, 5, 6, 7)
#: Words whose weights a worker remembers.
CACHE = 400_000


def features(word: str) -> set[str]:
    """A lower-case word with its ends, and the character n-grams of that, for words made from others."""
    whole = f"^{word}$"
    return {whole, *(whole[i : i + n] for n in GRAMS for i in range(len(whole) - n + 1))}


class Weights(dict):
    """A word's weight: the sum over its features."""

    def __init__(self, learned: dict[str, float]) -> None:
        self.learned = learned

    def __missing__(self, word: str) -> float:
        out = sum(self.learned.get(x, 0.0) for x in features(word))
        if len(self) >= CACHE:
            self.clear()
        self[word] = out
        return out


@dataclass
class ToxicityModel:
    """learned: weights of features; one that isn't there weighs nothing."""

    learned: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self.words = Weights(self.learned)

    def __reduce__(self):
        return ToxicityModel, (self.learned, self.bias)

    def sentences(self, text: str | None) -> list[tuple[int, int, float]]:
        """(start, end, probability) of the sentences."""
        out = []
        for m in SENTENCE.finditer(text or ""):
            z = self.bias + sum(self.words[w] for w in LETTERS.findall(m[0].lower()))
            out.append((m.start(), m.end(), 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))))
        return out

    def score(self, text: str | None) -> float:
        """1 - prod(1 - p) over the sentences, 0 without any. Sentences without a known word differ in nothing, so they are counted."""
        get, bias = self.words.__getitem__, self.bias
        plain, total = 0, 0.0
        for s in SENTENCE.findall((text or "").lower()):
            z = sum(map(get, LETTERS.findall(s)))
            if z:
                z += bias
                total += z + math.log1p(math.exp(-z)) if z > 0 else math.log1p(math.exp(z))
            else:
                plain += 1
        return 1 - math.exp(-total - plain * math.log1p(math.exp(bias)))


def fit_bags(texts: list[str], labels: np.ndarray, *, rounds: int = 200, rate: float = 0.03, doubt: float = 1.0, least: int = LEAST) -> ToxicityModel:
    """Adam on the mean log loss of the documents' noisy-or, with an L1 penalty of ``doubt`` documents.

    The sentences are counts of words, and the words are sums of features, so that each round is two sparse products each way.
    """
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel({}, -20.0 if not len(labels) or not labels[0] else 20.0)
    index: dict[str, int] = {}
    seen: list[int] = []
    sentence, word, doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        own_words: set[int] = set()
        for s in SENTENCE.findall(text.lower()):
            own = [index.setdefault(w, len(index)) for w in LETTERS.findall(s)]
            word.extend(own)
            sentence.extend([len(doc)] * len(own))
            doc.append(d)
            own_words.update(own)
        seen += [0] * (len(index) - len(seen))
        for w in own_words:
            seen[w] += 1
    at, of, doc = (np.array(x, np.int32) for x in (sentence, word, doc))
    names: dict[str, int] = {}
    part, whole, in_docs = [], [], []
    for w, k in index.items():
        for x in features(w):
            f = names.setdefault(x, len(names))
            if f == len(in_docs):
                in_docs.append(0)
            in_docs[f] += seen[k]
            part.append(f)
            whole.append(k)
    common = np.array(in_docs) >= least
    part, whole = np.array(part, np.int32), np.array(whole, np.int32)
    part, whole = part[common[part]], whole[common[part]]
    n, size = len(labels), len(in_docs)
    w, b = np.zeros(size), -5.0
    m, v, mb, vb = np.zeros(size), np.zeros(size), 0.0, 0.0
    for t in range(1, rounds + 1):
        each = np.bincount(whole, weights=w[part], minlength=len(index))
        z = b + np.bincount(at, weights=each[of], minlength=len(doc))
        total = np.bincount(doc, weights=np.logaddexp(0, z), minlength=n)
        by_doc = np.where(labels == 1, -1 / np.expm1(np.clip(total, 1e-9, 500)), 1.0) / n
        g = by_doc[doc] / (1 + np.exp(-np.clip(z, -60, 60)))
        gw = np.bincount(part, weights=np.bincount(of, weights=g[at], minlength=len(index))[whole], minlength=size)
        gw = np.where(w != 0, gw + doubt / n * np.sign(w), np.sign(gw) * np.maximum(np.abs(gw) - doubt / n, 0))
        gb = float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
        c1, c2 = 1 - 0.9**t, 1 - 0.999**t
        step = rate / (1 + t / 100)
        w -= step * (m / c1) / (np.sqrt(v / c2) + 1e-4 / n)
        b -= step * (mb / c1) / (math.sqrt(vb / c2) + 1e-8)
    return ToxicityModel({x: float(w[f]) for x, f in names.items() if abs(w[f]) > 0.02}, float(b))


def fit(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, chars: int = TRAIN_CHARS) -> ToxicityModel:
    """Learns from a sample of the texts of ``docs`` that ``labels`` (doc_id, toxic) marks 0 or 1; an id that is marked twice is toxic if one mark says so.

    The sample are the first rows in a random order, at most ``rows`` and ``chars`` characters together, each with its whole text.
    The driver holds it, and gets the texts partition by partition.
    """
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    share = min(1.0, 1.1 * rows / max(1, n))
    marks = marks.filter((F.shiftrightunsigned(F.xxhash64(F.lit(6), "doc_id"), 11) / float(1 << 53)) < share)
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marks, "doc_id")
    order = [F.xxhash64(F.lit(7), "doc_id"), F.col("doc_id"), F.col("key")]
    sizes = known.select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("size")).orderBy(*order).limit(rows)
    sizes = sizes.withColumn("total", F.sum("size").over(Window.orderBy(*order))).filter(F.col("total") <= chars)  # of no more than ``rows`` rows
    sample = sizes.select("doc_id", "key").distinct().collect()  # no more than ``rows`` pairs of numbers
    schema = "doc_id long, key long"
    chosen = docs.sparkSession.createDataFrame([(r["doc_id"], r["key"]) for r in sample], schema)
    held = known.withColumn("key", F.xxhash64("text")).join(F.broadcast(chosen), ["doc_id", "key"]).select("doc_id", "key", "text", "toxic")
    found = sorted((r["doc_id"], r["key"], r["text"], r["toxic"]) for r in held.dropDuplicates(["doc_id", "key"]).toLocalIterator())
    return fit_bags([r[2] for r in found], np.array([r[3] for r in found], np.int64))


def detect(docs: DataFrame, labels: DataFrame, *, rows: int = ROWS, spans: bool = False) -> DataFrame:
    """Returns doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text), and with ``spans`` the sentences of at least 0.5.

    Learns from labelled rows whose crc32(doc_id as text) modulo 5 is not 0; the others are held out. A null text counts as
    empty, and a text without sentences has score 0. With labels of one kind only, or none, all rows get that kind (none: 0).
    Repeated rows stay, null ids too (not learned from); other columns are ignored; no rows give no rows.
    """
    held = fold(F.col("doc_id"), 5) == 0
    model = docs.sparkSession.sparkContext.broadcast(fit(docs.filter(~held), labels, rows=rows))

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,score:double>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            texts = texts.where(texts.notna(), None).tolist()
            yield pd.DataFrame({"score": [model.value.score(t) for t in texts], "spans": [[s for s in model.value.sentences(t) if s[2] >= 0.5] if spans else [] for t in texts]})

    out = docs.select("doc_id", held.alias("held_out"), of("text").alias("__s"))
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("__s.score")))
    return out.select("doc_id", "held_out", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), *([F.col("__s.spans").alias("spans")] if spans else []))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
