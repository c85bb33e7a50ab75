"""Operator 4: packing token sequences by a grouping genetic algorithm.

Documents are tokenised, and what is longer than a sequence is cut. Full pieces are sequences of their own. The others are
dealt by hash into blocks of bounded size, and several islands evolve packings of each block, from best fits in random orders: a child inherits whole
well-filled bins of one parent, the other parent's bins that share a document with those are dissolved, and their displaced
documents are best-fitted into what is left. Between epochs each island sends its best packing to the next one.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

CAPACITY = 2048
END = 0
TOKENIZER = "word_bpe_49k.json"
#: Pieces of a block, about.
BLOCK = 4096
ISLANDS = 3
EPOCHS = 2
POPULATION = 5
CHILDREN = 40
#: Of a parent's well-filled bins, the share that a child takes, and of the other's bins that which is dissolved; drawn for each child.
INJECTED, DISSOLVED = (0.05, 0.25, 0.6), (0.0, 0.03, 0.15)
#: Words whose ids a worker remembers, and their longest.
CACHE, CACHE_CHARS = 800_000, 64

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Characters whose lower case doesn't depend on others and that no normal form changes; white space but for the blank is left to the tokenizer.
PLAIN = re.compile("[\\x20-\\x7e\\xa1-\\u012f\\u0131-\\u024f]*")
#: What this tokenizer's file calls its pre-tokenizer: fixed value.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
#: Byte-level alphabet: a shown byte is its character, the others follow from 256 on.
BYTE_CHARS = {b: chr(b) for b in SHOWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(SHOWN))}


class WordIds(dict):
    """A word's ids as little-endian bytes.

    This tokenizer drops white space and never joins what stands on its two sides, so a text's ids are those of its words, one
    after another. (The words are split at blanks, tabs and line feeds; any other white space stays in them, for the tokenizer.)
    Words of plain characters are lowered and split here, and only their pieces go to the tokenizer's model; others go to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: str) -> bytes:
        if not PLAIN.fullmatch(word) or "<|" in word:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        else:
            pieces = PIECES.findall(word.lower())
            if len(pieces) > 1:
                return self.keep(word, b"".join(map(self.__getitem__, pieces)))
            shown = "".join(pieces)
            ids = [x.id for x in self.model.tokenize(shown if shown.isascii() else shown.encode().decode("latin-1").translate(BYTE_CHARS))]
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return self.keep(word, out.tobytes())

    def keep(self, word: str, out: bytes) -> bytes:
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[word] = out
        return out

    def of(self, text: str | None) -> bytes:
        text = (text or "").replace("\n", " ").replace("\t", " ")
        if PLAIN.fullmatch(text) and "<|" not in text:
            text = text.lower()
        return b"".join(map(self.__getitem__, text.split(" ")))


def token_pieces(docs: DataFrame, *, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """A row for each piece of each row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32. A document is its ids and then ``end``."""
    last = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = WordIds(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].tolist(), batch["text"].tolist(), strict=True):
                ids = words.of(text) + last
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(own) // 4, zlib.crc32(own)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(cut, PIECE)


def best_fit(lengths: np.ndarray, items: np.ndarray, bins: np.ndarray, fills: list[int], capacity: int) -> None:
    """Puts ``items`` in their order each into the fullest bin that has room, or a new one; ``bins`` and ``fills`` change."""
    least = int(lengths[items].min()) if len(items) else 0
    free = sorted((capacity - f, k) for k, f in enumerate(fills) if 0 < f <= capacity - least)
    for i, n in zip(items.tolist(), lengths[items].tolist(), strict=True):
        at = bisect_left(free, (n, -1))
        if at < len(free):
            room, k = free.pop(at)
        else:
            room, k = capacity, len(fills)
            fills.append(0)
        bins[i] = k
        fills[k] += n
        if room - n >= least:
            insort(free, (room - n, k))


class Packing:
    """bins: each item's bin, 0 up, without gaps."""

    def __init__(self, lengths: np.ndarray, bins: np.ndarray, capacity: int) -> None:
        self.bins = np.unique(bins, return_inverse=True)[1].astype(np.int64)
        self.fills = np.bincount(self.bins, weights=lengths).astype(np.int64)
        self.worth = (-len(self.fills), float(((self.fills / capacity) ** 2).sum()))


def random_fit(lengths: np.ndarray, rng: np.random.Generator, capacity: int) -> Packing:
    """Best fit in a random order: what a population starts from."""
    bins = np.full(len(lengths), -1, np.int64)
    best_fit(lengths, rng.permutation(len(lengths)), bins, [], capacity)
    return Packing(lengths, bins, capacity)


def sorted_fit(lengths: np.ndarray, capacity: int) -> Packing:
    """Best fit from long to short."""
    bins = np.full(len(lengths), -1, np.int64)
    best_fit(lengths, np.argsort(-lengths, kind="stable"), bins, [], capacity)
    return Packing(lengths, bins, capacity)


def crossover(a: Packing, b: Packing, lengths: np.ndarray, rng: np.random.Generator, capacity: int) -> Packing:
    """Injects well-filled bins of ``b`` into ``a``; a's bins that hold a document of those go, with its worst ones and some others (the mutation)."""
    order = np.argsort(-b.fills, kind="stable")
    good = order[: max(1, len(order) // 2)]
    taken = np.zeros(len(b.fills), bool)
    taken[rng.choice(good, max(1, int(len(good) * rng.choice(INJECTED))), replace=False)] = True
    inherited = taken[b.bins]
    gone = np.zeros(len(a.fills), bool)
    gone[a.bins[inherited]] = True
    gone[np.argsort(a.fills, kind="stable")[: 1 + len(a.fills) // 50]] = True
    gone[rng.random(len(gone)) < rng.choice(DISSOLVED)] = True
    displaced = np.flatnonzero(gone[a.bins] & ~inherited)
    bins = np.where(inherited, len(a.fills) + b.bins, a.bins)
    left = np.where(gone, 0, a.fills).tolist() + np.where(taken, b.fills, 0).tolist()
    best_fit(lengths, displaced[np.argsort(-lengths[displaced], kind="stable")], bins, left, capacity)
    return Packing(lengths, bins, capacity)


def evolve(lengths: np.ndarray, start: list[np.ndarray], rng: np.random.Generator, capacity: int, last: bool = False) -> tuple[Packing, int, int]:
    """An island's epoch: its best packing, the bins of the best that it began with, and how many children entered the population.

    It ends early at a packing that no other can beat. Only in the ``last`` epoch, and only if that isn't found, best fit from
    long to short joins the population, so that the result is never worse than that.
    """
    least = -(-int(lengths.sum()) // capacity)
    found = [Packing(lengths, x, capacity) for x in start]
    while len(found) < POPULATION:
        found.append(random_fit(lengths, rng, capacity))
    first, won = min(len(x.fills) for x in found), 0
    for k in range(CHILDREN):
        best = max(found, key=lambda x: x.worth)
        if -best.worth[0] <= least:
            break
        worst = min(range(len(found)), key=lambda k: found[k].worth)
        if last and k == CHILDREN // 2:
            found[worst] = max(found[worst], sorted_fit(lengths, capacity), key=lambda x: x.worth)
        a, b = rng.choice(len(found), 2, replace=False)
        child = crossover(*sorted((found[a], found[b]), key=lambda x: x.worth, reverse=bool(rng.integers(2))), lengths, rng, capacity)
        worst = min(range(len(found)), key=lambda k: found[k].worth)
        if child.worth >= found[worst].worth:
            found[worst] = child
            won += 1
    return max(found, key=lambda x: x.worth), first, won


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 4, report: bool = False) -> DataFrame:
    """``pieces`` (with a column length, 1 to ``capacity``) with sequence_id and offset: as few sequences as it finds, each filled from 0 without gaps.

    All columns of ``pieces`` stay. Blocks hold about ``block`` pieces whatever the input, so a task's memory is bounded. With ``report`` it
    tells instead how the islands fared: block, island, items, least (sequences that could do), first (of the last epoch's start), best, won
    (children that entered the population, of all epochs).
    """
    names = pieces.columns
    rows = written(pieces.withColumn("__uid", F.monotonically_increasing_id()), "pieces")
    full = rows.filter(F.col("length") == capacity).withColumn("sequence_id", F.col("__uid") * 2 + 1).withColumn("offset", F.lit(0).cast("long"))
    part = rows.filter(F.col("length") < capacity)
    blocks = max(1, round(part.count() / block))
    items = part.select(F.col("__uid").alias("uid"), "length", F.pmod(F.xxhash64(F.lit(seed), "__uid"), F.lit(blocks)).alias("block"))
    state = items.withColumn("island", F.explode(F.array(*[F.lit(k) for k in range(islands)]))).withColumn("bin", F.lit(-1).cast("long")).withColumn("came", F.lit(False)).withColumns({"first": F.lit(0), "won": F.lit(0)})

    def island(epoch: int):
        def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[~pdf["came"]].sort_values("uid")
            lengths = own["length"].to_numpy(np.int64)
            start = [] if epoch == 0 else [x.sort_values("uid")["bin"].to_numpy(np.int64) for _, x in pdf.groupby("came")]
            rng = np.random.default_rng([seed, epoch, int(key[0]), int(key[1])])
            best, first, won = evolve(lengths, start, rng, capacity, last=epoch == epochs - 1)
            return own.assign(bin=best.bins, first=first, won=won + own["won"].iloc[0])

        return step

    schema = "uid long, length long, block long, island int, bin long, came boolean, first int, won int"
    for epoch in range(epochs):
        if epoch:
            state = state.unionAll(state.withColumn("island", (F.col("island") + 1) % islands).withColumn("came", F.lit(True)))
        state = state.select("uid", "length", "block", "island", "bin", "came", "first", "won").groupBy("block", "island").applyInPandas(island(epoch), schema)
        if epochs > 1:
            state = written(state, "islands")
    if report:
        told = [F.count("*").alias("items"), F.ceil(F.sum("length") / capacity).alias("least"), F.first("first").alias("first"), (F.max("bin") + 1).alias("best"), F.first("won").alias("won")]
        return state.groupBy("block", "island").agg(*told)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        one = min((x for _, x in pdf.groupby("island")), key=lambda x: x["bin"].max()).sort_values(["bin", "uid"])
        before = one.groupby("bin")["length"].cumsum() - one["length"]
        return pd.DataFrame({"uid": one["uid"], "sequence_id": (one["block"] * (1 << 31) + one["bin"]) * 2, "offset": before})

    chosen = state.groupBy("block").applyInPandas(choose, "uid long, sequence_id long, offset long")
    rest = part.join(chosen, F.col("__uid") == F.col("uid")).select(*full.columns)
    return full.unionAll(rest).select(*[F.col(f"`{c}`") for c in names], "sequence_id", "offset")


def pack_documents(docs: DataFrame, *, path: str | None = None, capacity: int = CAPACITY, end: int = END, **how) -> DataFrame:
    """Tokenises and packs every row of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the id ``end`` alone. Repeated rows are packed each, null ids stay null. Other columns are
    ignored, and no rows give no rows. ``path``: a tokenizer file that every executor has, as the installed public one.
    """
    return pack(token_pieces(docs, path=path or public_tokenizers.path(TOKENIZER), capacity=capacity, end=end), capacity=capacity, **how)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
