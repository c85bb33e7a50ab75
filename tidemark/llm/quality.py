"""Operator 8: quality rules by tokeniser fertility.

A public vocabulary that wasn't made from this corpus measures a text: characters per token, the share of tokens that
are single bytes for want of a piece, and the entropy of the tokens. Wide bands per script say what no text may exceed; within them
the quartiles of the corpus, by language and length and over its different texts, say what is far from the texts of its kind.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

MODEL = "piece_bpe_32k.model"
SYMBOLS = re.compile(rb"[#*$%&|<>]")
CACHE, CACHE_BYTES = 600_000, 64
#: A script's letters, as ranges of code points. Fixed values, from the Unicode blocks.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xE7F),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)),
}
LATIN = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]")
NOT_LATIN = re.compile("[^\x00-\u036f\u1e00-\u1eff\u2000-\u20cf]")
#: Per script: least and most characters per token, most byte fallback, least entropy as a share of what so many tokens can have.
BANDS = {"latin": (1.3, 8.0, 0.2, 0.35), "greek": (0.5, 8.0, 0.6, 0.3), "cyrillic": (0.9, 8.0, 0.5, 0.3), "none": (0.8, 8.0, 0.5, 0.35)}
OTHER_BAND = (0.2, 8.0, 1.0, 0.25)
#: A text is far off beyond so many deviations (estimated from the quartiles) from the median of its kind; a kind is widened until it has so many texts.
FAR, LEAST_TEXTS = 4.5, 50
#: How a kind widens: by a language's, then by a script's neighbouring powers of two of tokens (up to so many on both sides), then to all texts.
WIDENED = (("kind", 0), ("kind", 1), ("kind", 2), ("script", 1), ("script", 3), ("script", 30), ("all", 30))
#: The metrics are counted in steps so fine; quartiles are of the counts, and thus the same however the rows are dealt.
STEPS = {"chars_per_token": 0.002, "byte_share": 0.0005, "entropy": 0.005}
#: The least deviation that a kind of texts of one token would have, in characters per token, byte share and entropy; it falls with the root of the
#: tokens, as the deviations of sf0.1 do. Its texts have no byte tokens, so that the second is set, and never under LEAST_BYTES.
SPREAD, LEAST_BYTES = (0.8, 0.16, 2.0), 0.01


class Pieces(dict):
    """A word's ids as 16-bit integers; a word is encoded by itself, with the blank that starts it."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        if len(self.is_byte) > 1 << 16:
            raise ValueError("the vocabulary has more than 65,536 pieces")

    def __missing__(self, word: bytes) -> bytes:
        out = array("H", self.model.encode(word.decode("utf-8", "replace"))).tobytes()
        if len(word) <= CACHE_BYTES:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out


def script_of(text: str) -> str:
    """The script of most letters, ``none`` without any; the earlier of SCRIPTS if two have as many."""
    if not NOT_LATIN.search(text):
        return "latin" if LATIN.search(text) else "none"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = {name: sum(int(((codes >= a) & (codes <= b)).sum()) for a, b in ranges) for name, ranges in SCRIPTS.items()}
    best = max(n, key=n.__getitem__)
    return best if n[best] else "none"


def base_rules(text: str, window: int = 8) -> tuple[list[bytes], tuple[int, int, int, int, int]]:
    """The words, and (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at ASCII white space alone
    n = len(words)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeated = 0
    if n > window:
        ids: dict[bytes, int] = {}
        at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        with np.errstate(over="ignore"):
            quick = np.zeros(n - window + 1, np.int64)
            for k in range(window):
                quick = quick * 0x5851F42D4C957F2D + at[k : n - window + 1 + k]
        quick.sort()
        if (quick[1:] == quick[:-1]).any():  # equal windows have equal values; whether those that have are equal is told by names
            # Windows are named by pairs of names of their halves, so equal names mean equal words.
            span = 1
            while span < window:
                at = np.unique(at[:-span] * (int(at.max()) + 1) + at[span:], return_inverse=True)[1]
                span *= 2
            again = np.bincount(at)[at] > 1
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, np.flatnonzero(again), 1)
            np.add.at(edge, np.flatnonzero(again) + window, -1)
            repeated = int((np.cumsum(edge[:-1]) > 0).sum())
    return words, (n, chars, len(SYMBOLS.findall(data)), len(lines) - len(set(lines)), repeated)


def fertility(words: list[bytes], chars: int, pieces: Pieces) -> tuple[int, float, float, float]:
    """(tokens, characters per token, share of byte tokens, entropy in bits)."""
    ids = np.frombuffer(b"".join(map(pieces.__getitem__, words)), np.uint16)
    if not len(ids):
        return 0, 0.0, 0.0, 0.0
    counts = np.bincount(ids)
    p = counts[counts > 0] / len(ids)
    return len(ids), chars / len(ids), float(counts[pieces.is_byte[: len(counts)]].sum() / len(ids)), float(-(p * np.log2(p)).sum())


def within(script: str, tokens: int, fertile: float, fallback: float, entropy: float) -> bool:
    low, high, most, least = BANDS.get(script, OTHER_BAND)
    return low <= fertile <= high and fallback <= most and entropy >= least * math.log2(max(2, min(tokens, 4096)))


METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, in_band boolean, script string, n_tokens long, chars_per_token double, byte_share double, entropy double"


def measure(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` (doc_id, text, kind) with a hash in place of its text, and with the columns of METRICS."""

    @F.pandas_udf(METRICS)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(path)
        for texts in batches:
            rows = []
            for text in texts.where(texts.notna(), "").tolist():
                words, base = base_rules(text)
                own = fertility(words, base[1], pieces)
                script = script_of(text)
                rows.append((*base, base[0] < 20 or 100 * base[4] > 30 * base[0], within(script, *own), script, *own))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in METRICS.split(", ")])

    return docs.select("doc_id", "kind", F.xxhash64("text").alias("text_hash"), of("text").alias("__r")).select("doc_id", "kind", "text_hash", "__r.*")


def bands_of(texts: DataFrame, least_texts: int = LEAST_TEXTS) -> DataFrame:
    """(kind, script, cls, texts, and for each metric [quartile, median, quartile]) for what is in ``texts`` (kind, script, cls and the metrics).

    The quartiles are of the narrowest of WIDENED that has ``least_texts`` texts, or of all texts.
    """
    places = F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(c) / x).cast("long").alias("step")) for c, x in STEPS.items()])
    counts = texts.select("kind", "script", "cls", F.explode(places).alias("p")).groupBy("kind", "script", "cls", "p.metric", "p.step").agg(F.count("*").alias("n"))
    counts = written(counts.withColumn("all", F.lit("")), "counts")  # no more than there are steps, whatever the texts
    cells = counts.filter(F.col("metric") == "entropy").groupBy("kind", "script", "cls", "all").agg(F.sum("n").alias("n"))
    for level, (by, reach) in enumerate(WIDENED):
        near = Window.partitionBy(by).orderBy("cls").rangeBetween(-reach, reach)
        cells = cells.withColumn(f"n{level}", F.sum("n").over(near))
    level = F.coalesce(*[F.when(F.col(f"n{i}") >= least_texts, F.lit(i)) for i in range(len(WIDENED))], F.lit(len(WIDENED) - 1))
    cells = written(cells.select("kind", "script", "cls", "all", level.alias("level"), F.array(*[f"n{i}" for i in range(len(WIDENED))])[level].alias("texts")), "cells")
    pools = []
    for i, (by, reach) in enumerate(WIDENED):
        of = cells.filter(F.col("level") == i).select(F.col(by).alias("__by"), F.col("cls").alias("__cls")).distinct()
        mine = counts.select(F.col(by).alias("by"), "cls", "metric", "step", "n").join(of, (F.col("by") == F.col("__by")) & F.col("cls").between(F.col("__cls") - reach, F.col("__cls") + reach))
        pools.append(mine.select(F.lit(i).alias("level"), "by", F.col("__cls").alias("cls"), "metric", "step", "n"))
    steps = pools[0]
    for x in pools[1:]:
        steps = steps.unionAll(x)
    steps = steps.groupBy("level", "by", "cls", "metric", "step").agg(F.sum("n").alias("n"))
    own = Window.partitionBy("level", "by", "cls", "metric")
    up = F.sum("n").over(own.orderBy("step"))
    steps = steps.withColumns({"up": up, "whole": F.sum("n").over(own)})
    value = F.col("step") * F.coalesce(*[F.when(F.col("metric") == c, F.lit(x)) for c, x in STEPS.items()])
    at = F.array(*[F.min(F.when(F.col("up") >= q * F.col("whole"), value)) for q in (0.25, 0.5, 0.75)])
    each = steps.groupBy("level", "by", "cls", "metric").agg(at.alias("at"))
    each = each.groupBy("level", "by", "cls").agg(*[F.first(F.when(F.col("metric") == c, F.col("at")), ignorenulls=True).alias(f"__{c}") for c in STEPS])
    each = each.withColumnsRenamed({"level": "__level", "cls": "__c"})
    by = F.coalesce(*[F.when(F.col("level") == i, F.col(c)) for i, (c, _) in enumerate(WIDENED)])
    return cells.join(each, (F.col("level") == F.col("__level")) & (by == F.col("by")) & (F.col("cls") == F.col("__c"))).select("kind", "script", "cls", "texts", *[f"__{c}" for c in STEPS])


def rules(docs: DataFrame, *, path: str | None = None, lang_col: str | None = "lang", far: float = FAR) -> DataFrame:
    """Returns for each row of ``docs`` (doc_id, text, perhaps lang): doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, and script, n_tokens, chars_per_token, byte_share, entropy.

    A row is kept if the base rules, the bands of its script and those of its kind let it. A kind is a language (where that is null
    or isn't known, the script) and a power of two of tokens; its bands come from all different texts that pass the base rules, however
    many copies each has. With fewer than LEAST_TEXTS of them a kind takes in texts of neighbouring lengths, then of its script, then all, so
    that every row meets a band at every size. A null or empty text has no words and fails the base rules. Repeated rows and null
    ids stay, other columns are ignored, no rows give no rows. ``path``: a vocabulary file that every executor has.
    """
    kind = F.col(lang_col).cast("string") if lang_col and lang_col in docs.columns else F.lit(None).cast("string")
    rows = measure(docs.select("doc_id", "text", kind.alias("kind")), path or public_tokenizers.path(MODEL))
    rows = written(rows.withColumn("kind", F.coalesce("kind", F.concat(F.lit("*"), "script"))).withColumn("cls", F.floor(F.log2(F.greatest(F.lit(1), "n_tokens"))).cast("int")), "quality")
    names = ("chars_per_token", "byte_share", "entropy")
    texts = rows.filter(~F.col("base_failed") & F.col("in_band")).select("kind", "script", "cls", "text_hash", *names).distinct()  # equal texts measure the same
    bands = written(bands_of(texts).withColumnsRenamed({"kind": "__kind", "script": "__script", "cls": "__cls"}), "bands")  # its size is known to the join
    least = {c: F.lit(x) / F.sqrt(F.pow(F.lit(2.0), "cls")) for c, x in zip(names, SPREAD, strict=True)}
    least["byte_share"] = F.greatest(least["byte_share"], F.lit(LEAST_BYTES))
    off = {c: (F.col(c) - F.col(f"__{c}")[1]) / F.greatest((F.col(f"__{c}")[2] - F.col(f"__{c}")[0]) / 1.349, least[c]) for c in names}
    usual = (F.abs(off["chars_per_token"]) <= far) & (off["byte_share"] <= far) & (off["entropy"] >= -far)
    out = rows.join(bands, (F.col("kind") == F.col("__kind")) & (F.col("script") == F.col("__script")) & (F.col("cls") == F.col("__cls")), "left")
    kept = ~F.col("base_failed") & F.col("in_band") & F.coalesce(usual, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "script", "n_tokens", *names)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"))
