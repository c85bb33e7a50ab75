"""Operator 7: the n-gram Jaccard join.

Documents are rows of a 0/1 matrix over hashed word n-grams; the product of that matrix with its transpose counts
the overlaps. Only blocks of the product that can hold a link are computed:

1. Two sets that reach the threshold differ in at most H n-grams, where H follows from their sizes. Split by hash into H + 1
   parts, they agree in one of them. The hash of each part of each row is a key; rows that share a key are tied into candidate
   groups. No pairs are made: each key ties its rows to one of them, within a batch first and then over all.
2. The rows of a candidate group, dealt into blocks of bounded size, are multiplied: the product of a block's matrix with its transpose
   is added up by slices of n-grams, from rare ones to frequent ones. After each slice the pairs whose count can't reach the bound that follows from
   their sizes any more are discarded, and so are those that are connected already; rows without a pair leave the product.
3. Where a group has several blocks, one row of each of its connected parts meets the others; the rows of all but
   the largest connected part, in chunks of bounded size, then meet every block. A link between two parts has an end outside the largest, so none is lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import cache
from itertools import groupby, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written

N = 4
THRESHOLD = (85, 100)
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Keys that a bucket of the key exchange holds, about.
BUCKET_KEYS = 1_000_000
#: Bytes of a key that are compared within its bucket. Four would tie rows by chance, long texts above all, into groups that hold ever more of a larger corpus.
KEY_BYTES = 5
#: Rows that a block of the product holds, about.
BLOCK_ROWS = 512
#: Bytes of copied text that are dealt at once where a group has several blocks: so many for each n-gram of the input, about half of its text, or so many at least.
COPIED_BYTES, COPIED_LEAST = 3, 1 << 26
#: N-grams that at most so many rows of a block have are multiplied pair by pair, with so many increments at once, others as so many columns of a matrix.
FEW, INCREMENTS, COLUMNS = 32, 1 << 20, 1024
#: Keys, or bytes of text, that are made at once.
AT_ONCE = 400_000
#: Counters of n-grams by their first bits, as a power of two, and the rows that they are sent in.
SKETCH_BITS, SKETCH_ROWS = 20, 64
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


@cache
def _byte_hashes() -> np.ndarray:
    return _mixed(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_powers: list[np.ndarray] = []


def _up_and_down(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        base = 0xD6E8FEB86659FD93
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, x, U)])) for x in (base, pow(base, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The first bytes and the 64-bit hashes of the words of ``data``: differences of one running sum over the bytes."""
    t = np.frombuffer(data, np.uint8)
    space = np.concatenate([[True], _SPACE[t], [True]])
    edge = np.flatnonzero(space[1:] != space[:-1])
    first, end = edge[::2], edge[1::2]
    up, down = _up_and_down(max(AT_ONCE, len(t)))
    with np.errstate(over="ignore"):
        sums = np.concatenate([[U(0)], np.cumsum(_byte_hashes()[t] * up[: len(t)])])
        return first, _mixed((sums[end] - sums[first]) * down[first] + (end - first).astype(U))


def _shingled(h: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(max(0, len(h) - n + 1), n, U)
        for k in range(n):
            out = _mixed(out * U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return out


def _long_text(data: bytes, n: int) -> np.ndarray:
    """A long text's words are hashed in parts that end between words."""
    held, at = [], 0
    while at < len(data):
        end = min(len(data), at + AT_ONCE)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        held.append(_words(data[at:end])[1])
        at = end
    h = np.concatenate(held)
    return np.unique(_shingled(h, min(n, len(h)))) if len(h) else h


def shingle_sets(texts: Iterable[str | None], n: int = N) -> list[np.ndarray]:
    """For each text the set of its hashed n-grams, sorted; with fewer words, of the whole sequence. Words are parted by ASCII white space, and A-Z are a-z."""
    out: list[np.ndarray] = []
    held: list[bytes] = []

    def run() -> None:
        first, h = _words(b"\n".join(held))
        cuts = np.searchsorted(first, np.cumsum([0, *(len(x) + 1 for x in held)]))
        grams = _shingled(h, n)
        for a, b in pairwise(cuts.tolist()):
            out.append(np.unique(grams[a : b - n + 1]) if b - a >= n else _shingled(h[a:b], b - a) if b > a else np.empty(0, U))
        held.clear()

    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        if held and size + len(data) > AT_ONCE:
            run()
            size = 0
        if len(data) > AT_ONCE:
            out.append(_long_text(data, n))
        else:
            held.append(data)
            size += len(data) + 1
    if held:
        run()
    return out


def set_hash(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    with np.errstate(over="ignore"):
        a, b = np.bitwise_xor.reduce(_mixed(s), initial=U(len(s))), np.add.reduce(_mixed(s ^ U(0x5851F42D4C957F2D)), dtype=U)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


class Bounds:
    """What a threshold num / den says of sizes."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den

    def least_size(self, n: int) -> int:
        """Of a partner of a set of ``n``."""
        return -(-self.num * n // self.den)

    def overlap(self, a, b):
        """How many members sets of these sizes share at least to reach the threshold."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def linked(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def most_apart(self, high: int) -> int:
        """How many members linked sets of at most ``high`` can differ in."""
        return max(t - 2 * self.overlap(t, 0) for t in range(max(2, 2 * high - 60), 2 * high + 1))

    def levels(self, most: int = 1 << 40) -> list[tuple[int, int, int]]:
        """(largest size, parts, spare) of the size classes. They grow by 1 / threshold, so linked sets are in one class or in neighbouring ones."""
        out, low = [], 1
        while low <= most:
            high = max(low, low * self.den // self.num)
            apart = self.most_apart(high)
            spare = 2 + apart * 2 // 5
            out.append((high, apart + 1 + spare, spare))
            low = high + 1
        return out


def keys_of(s: np.ndarray, levels: list[tuple[int, int, int]], common: np.ndarray | None = None) -> np.ndarray:
    """The keys under which a set meets its partners: those of its own class, and of the next for larger partners.

    With H members apart there are H + 1 + spare parts; a pair agrees in spare + 1 of them at least. Each set gives the keys of all
    but its ``spare`` weakest parts, in one order of parts by their content: the strongest part in which a pair agrees has spare others
    below it on both sides, so both give its key. A part is the stronger the more rare members it has, and then the more members, for few
    share those by chance. ``common`` marks, by their first bits, n-grams that many documents have; it decides what is strong, never what is right.
    """
    n = len(s)
    k = bisect_left(levels, (n,))
    out = []
    for at in (k, k + 1):
        _, parts, spare = levels[at]
        with np.errstate(over="ignore"):
            mixed = _mixed(s ^ U(0xA0761D6478BD642F + at))
            part = (mixed >> U(32)) * U(parts) >> U(32)
            order = np.argsort(part, kind="stable")
            part, mixed = part[order], _mixed(mixed[order])
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            keys = _mixed(np.add.reduceat(mixed, first) ^ _mixed(part[first] * U(128) + U(at)))
            sizes = np.diff(np.append(first, n))
            rare = np.add.reduceat((~common[(s >> U(64 - SKETCH_BITS)).astype(np.int64)])[order].astype(np.int64), first) if common is not None else sizes
            give = parts - spare
            if len(keys) < give:  # the rest are empty parts, of which all have the same content
                empty = np.setdiff1d(np.arange(parts, dtype=U), part[first])
                empty = np.sort(_mixed(_mixed(empty * U(128) + U(at)) ^ U(1 << 60)))
                keys = np.concatenate([keys, empty[len(empty) - (give - len(keys)) :]])
            else:
                keys = keys[np.lexsort((keys, sizes, rare))[len(keys) - give :]]
        out.append(keys)
    return np.concatenate(out)


def _stars(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, id) pairs: each key with one id, and the ties (id, that id) of its others."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    new = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.empty(0, bool)
    hub = ids[new][np.cumsum(new) - 1] if len(keys) else ids
    tied = hub != ids
    return keys[new], ids[new], ids[tied], hub[tied]


def _packed(keys: np.ndarray) -> bytes:
    """The lowest KEY_BYTES of each key."""
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEY_BYTES, 8), np.uint8)
    out[:, :KEY_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, KEY_BYTES)
    return out.view("<u8").ravel()


def ties(docs: DataFrame, levels: list[tuple[int, int, int]], buckets: int, common: np.ndarray, n: int = N) -> DataFrame:
    """Step 1: (a, b), set hashes of rows that share a key; no key is lost, and a hot key gives a row for each batch that has it."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def batch_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held_k: list[np.ndarray] = []
        held_i: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pd.DataFrame]:
            nonlocal size
            keys, ids, a, b = _stars(np.concatenate(held_k), np.concatenate(held_i))
            held_k.clear()
            held_i.clear()
            size = 0
            bucket = ((keys >> U(32)) * U(buckets) >> U(32)).astype(np.int64)  # keys are sorted, so buckets are
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            low = _packed(keys)
            rows = [(int(bucket[i]), low[i * KEY_BYTES : j * KEY_BYTES], ids[i:j].astype("<i8").tobytes()) for i, j in zip(cut, [*cut[1:], len(keys)], strict=True)]
            out = pd.DataFrame(rows, columns=["bucket", "keys", "ids"])
            if len(a):
                pairs = np.unique(np.stack([a, b], axis=1), axis=0)
                out = pd.concat([out, pd.DataFrame([(-1, pairs[:, 0].astype("<i8").tobytes(), pairs[:, 1].astype("<i8").tobytes())], columns=["bucket", "keys", "ids"])])
            yield out

        for batch in batches:
            for s in shingle_sets(batch["text"], n):
                if len(s):
                    own = keys_of(s, levels, shared.value)
                    held_k.append(own)
                    held_i.append(np.full(len(own), set_hash(s)[0], np.int64))
                    size += len(own)
                    if size >= AT_ONCE:
                        yield from flush()
        if size:
            yield from flush()

    def tie(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The blobs of whole buckets, sorted by bucket."""
        at, keys, ids = None, [], []

        def pairs() -> pd.DataFrame:
            if at == -1:
                a, b = np.frombuffer(b"".join(keys), "<i8"), np.frombuffer(b"".join(ids), "<i8")
            else:
                _, _, a, b = _stars(_unpacked(b"".join(keys)), np.frombuffer(b"".join(ids), "<i8"))
            one = np.unique(np.stack([a, b], axis=1), axis=0)
            return pd.DataFrame({"a": one[:, 0], "b": one[:, 1]})

        for batch in batches:
            for bucket, k, i in zip(batch["bucket"], batch["keys"], batch["ids"], strict=True):
                if (bucket != at or at == -1) and keys:
                    yield pairs()
                    keys, ids = [], []
                at = bucket
                keys.append(k)
                ids.append(i)
        if keys:
            yield pairs()

    blobs = docs.select("text").mapInPandas(batch_keys, "bucket long, keys binary, ids binary")
    # The ties of the batches (bucket -1) need no partner; they are dealt by their content.
    dealt = blobs.repartition(F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("keys"), F.lit(buckets))).otherwise(F.col("bucket"))).sortWithinPartitions("bucket")
    return dealt.mapInPandas(tie, "a long, b long").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is tied to one smaller node only, to which nothing smaller is tied."""
    center = edges.select(F.col("b").alias("__b")).distinct()
    return edges.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").isEmpty() and edges.join(center, F.col("a") == F.col("__b"), "left_semi").isEmpty()


def components(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """(node, label) for the nodes of ``edges`` (a, b): the label is the smallest node that can be reached.

    Large-star and small-star steps by turns, until stars are left. Each is a minimum by key, and partial minima come before the shuffle, so a hub isn't a burden.
    """
    edges = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _are_stars(edges):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("__a"), F.least("a", "m").alias("__m"))
        least = written(least, "least")  # a join of two plain shuffles, whose hubs Spark can split
        large = both.join(least, F.col("a") == F.col("__a")).filter("b > a").select(F.col("b").alias("a"), F.col("__m").alias("b")).filter("a <> b").distinct()
        large = written(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("__m")).withColumnRenamed("a", "__a")
        low = written(low, "low")
        joined = large.join(low, F.col("a") == F.col("__a"))
        small = joined.select(F.col("b").alias("a"), F.col("__m").alias("b")).unionAll(joined.select("a", F.col("__m").alias("b"))).filter("a <> b").distinct()
        small = written(small, "small")
        discard(edges, least, large, low)
        edges = small
    labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def _merged(root: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """The roots after the links of ``hit``, a symmetric matrix: the least one of what is connected."""
    m = len(root)
    while True:
        best = np.minimum(np.where(hit, root[None, :], m).min(axis=1), root)
        to = np.arange(m)
        np.minimum.at(to, root, best)
        out = to[root]
        if np.array_equal(out, root):
            return out
        root = out


def _slices(df: np.ndarray, gram: np.ndarray, row: np.ndarray, m: int) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """(whether they are few a gram, n-grams, rows) of postings that are sorted by how many rows their n-gram has, whole n-grams each time."""
    times = df[gram]
    at = 0
    for most in (2, 3, 4, 6, 8, 12, 16, 24, FEW):
        end = int(np.searchsorted(times, most, "right"))
        while at < end:  # so that no slice makes more than so many increments
            stop = min(end, at + max(most, INCREMENTS // most))
            while stop < end and gram[stop] == gram[stop - 1]:
                stop += 1
            yield True, gram[at:stop], row[at:stop]
            at = stop
    while at < len(gram):
        first = np.flatnonzero(np.concatenate([[True], gram[at + 1 :] != gram[at:-1]]))
        stop = at + int(first[COLUMNS]) if len(first) > COLUMNS else len(gram)
        yield False, gram[at:stop], row[at:stop]
        at = stop


def link(sets: list[np.ndarray], bounds: Bounds, root: np.ndarray | None = None, new: np.ndarray | None = None) -> np.ndarray:
    """Step 2 for a block: each row's root, equal for rows that links connect.

    ``root``: what is known to be connected already. ``new``: only pairs with one of these rows count.
    """
    m = len(sets)
    root = np.arange(m) if root is None else root.copy()
    sizes = np.array([len(s) for s in sets], np.int64)
    pending = root[:, None] != root[None, :]
    pending &= bounds.den * np.minimum(sizes[:, None], sizes[None, :]) >= bounds.num * np.maximum(sizes[:, None], sizes[None, :])
    if new is not None:
        pending &= new[:, None] | new[None, :]
    if not pending.any():
        return root
    need = bounds.overlap(sizes[:, None], sizes[None, :])
    ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    row = np.repeat(np.arange(m), sizes)
    shared = np.flatnonzero(df[ids] > 1)
    shared = shared[np.lexsort((ids[shared], df[ids[shared]]))]
    left = np.bincount(row[shared], minlength=m)
    counts = np.zeros((m, m), np.int32)
    pending &= np.minimum(left[:, None], left[None, :]) >= need
    active = pending.any(axis=1)
    for few, gram, of in _slices(df, ids[shared], row[shared], m):
        if not active.any():
            break
        if few:
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            times = np.diff(np.append(first, len(gram)))
            for d in np.unique(times).tolist():
                own = of[first[times == d][:, None] + np.arange(d)]
                counts += np.bincount((own[:, :, None] * m + own[:, None, :]).ravel(), minlength=m * m).reshape(m, m).astype(np.int32)
        else:
            here = np.flatnonzero(active)
            place = np.full(m, -1)
            place[here] = np.arange(len(here))
            column = np.cumsum(np.concatenate([[0], gram[1:] != gram[:-1]]))
            held = place[of] >= 0
            matrix = np.zeros((len(here), int(column[-1]) + 1), np.float32)
            matrix[place[of[held]], column[held]] = 1
            counts[np.ix_(here, here)] += (matrix @ matrix.T).astype(np.int32)
        left -= np.bincount(of, minlength=m)
        hit = pending & (counts >= need)
        if hit.any():
            root = _merged(root, hit)
            pending &= root[:, None] != root[None, :]
        pending &= counts + np.minimum(left[:, None], left[None, :]) >= need
        active = pending.any(axis=1)
    return root


def _name(h1, h2) -> str:
    return f"{int(h1) & (1 << 64) - 1:016x}{int(h2) & (1 << 64) - 1:016x}"


def _blocks(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of each key of a sorted partition together; only one key's rows are held."""
    at, held = None, []
    for batch in batches:
        k = list(zip(*(batch[c] for c in key), strict=True))
        i = 0
        for own, run in groupby(k):
            n = sum(1 for _ in run)
            if own != at and held:
                yield at, pd.concat(held)
                held = []
            at = own
            held.append(batch.iloc[i : i + n])
            i += n
    if held:
        yield at, pd.concat(held)


LINKED = "h1 long, h2 long, label long, block int, part string"


def _linked(cand: DataFrame, bounds: Bounds, n: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _blocks(batches, ["label", "block"]):
            root = link(shingle_sets(rows["text"], n), bounds)
            names = [_name(a, b) for a, b in zip(rows["h1"], rows["h2"], strict=True)]
            yield rows[["h1", "h2", "label", "block"]].assign(part=[names[k] for k in root])

    return cand.select("label", "block", "h1", "h2", "text").repartition("label", "block").sortWithinPartitions("label", "block").mapInPandas(run, LINKED)


def _across(cand: DataFrame, parts: DataFrame, bounds: Bounds, n: int, block_rows: int, copied: int) -> DataFrame:
    """Step 3: (node, label) of the parts of candidate groups with several blocks, after links between blocks.

    Chunks and blocks meet in rounds, each of which copies about ``copied`` bytes of text, so that the copies of a large group don't fill the disk.
    """
    several = written(parts.filter("block > 0").select(F.col("label").alias("__label")).distinct(), "several")
    parts = written(parts.join(several, F.col("label") == F.col("__label"), "left_semi"), "parts")
    texts = cand.join(several, F.col("label") == F.col("__label"), "left_semi").select("h1", "h2", "text")
    held = parts.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "label", "block", "part")
    rows = written(texts.join(held, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))).select("label", "block", "part", "h1", "h2", "text"), "rows")
    sizes = rows.groupBy("label", "block", "part").agg(F.count("*").alias("n"), F.min(F.struct("h1", "h2", "text")).alias("one"))
    largest = sizes.groupBy("label", "block").agg(F.max(F.struct("n", "part", "one")).alias("x")).select("label", "x.part", "x.n", "x.one")
    hub = largest.groupBy("label").agg(F.max(F.struct("n", "part", "one")).alias("x")).select(F.col("label").alias("__label"), F.col("x.part").alias("hub_part"), F.col("x.one.text").alias("hub_text"))

    @F.pandas_udf("boolean")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(a, b, strict=True):
            p, q = shingle_sets([x, y], n)
            out.append(bool(bounds.linked(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
        return pd.Series(out)

    main = written(largest.join(hub, F.col("label") == F.col("__label")).filter(alike("one.text", "hub_text")).select("label", "part", "hub_part"), "main")
    known = main.select(F.col("part").alias("__part"))
    others = written(rows.join(known, F.col("part") == F.col("__part"), "left_anti"), "others")
    fresh = others.groupBy("label").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"), F.sum(F.octet_length("text")).alias("new_bytes")).withColumnRenamed("label", "__label")
    chunks = fresh.select("__label", "chunks")
    blocks = parts.select(F.col("label").alias("__label"), F.col("block").alias("to")).distinct()
    each = others.join(chunks, F.col("label") == F.col("__label")).drop("__label").withColumn("chunk", F.pmod(F.xxhash64("h1", "h2"), F.col("chunks")).cast("int"))
    shape = rows.groupBy("label").agg(F.sum(F.octet_length("text")).alias("bytes"), F.countDistinct("block").alias("blocks")).join(fresh, F.col("label") == F.col("__label"))
    rounds = max(1, -(-(shape.agg(F.sum(F.expr("bytes * chunks + new_bytes * blocks"))).first()[0] or 0) // max(1, copied)))

    def met(k: int) -> DataFrame:
        """The rows of the blocks, and of the chunks of round ``k`` that meet them."""
        own = lambda chunk: F.pmod(F.pmod(F.xxhash64("label"), F.lit(rounds)) + chunk, F.lit(rounds)) == k
        out = each.filter(own(F.col("chunk"))).join(blocks, F.col("label") == F.col("__label")).filter("block <> to").select("label", F.col("to").alias("block"), "chunk", "part", "h1", "h2", "text", F.lit(True).alias("new"))
        here = rows.join(chunks, F.col("label") == F.col("__label")).withColumn("chunk", F.explode(F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), own)))
        return here.select("label", "block", "chunk", "part", "h1", "h2", "text", F.lit(False).alias("new")).unionAll(out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, own in _blocks(batches, ["label", "block", "chunk"]):
            new = own["new"].to_numpy(bool)
            if new.any():
                names, part = np.unique(own["part"].to_numpy(str), return_inverse=True)
                first = np.unique(part, return_index=True)[1]
                root = link(shingle_sets(own["text"], n), bounds, first[part], new)
                pairs = {(names[part[i]], names[part[root[i]]]) for i in first.tolist()}
                yield pd.DataFrame([p for p in pairs if p[0] != p[1]], columns=["a", "b"])

    links = written(main.select(F.col("part").alias("a"), F.col("hub_part").alias("b")), "links")
    for k in range(rounds):
        found = met(k).repartition("label", "block", "chunk").sortWithinPartitions("label", "block", "chunk").mapInPandas(run, "a string, b string")
        more = written(links.unionAll(found).distinct(), "links")
        del found
        discard(links)  # and the shuffles of the round
        links = more
    out = components(links, cand.sparkSession)
    discard(several, parts, rows, main, others, links)
    return out


def describe(docs: DataFrame, n: int = N) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n, h1, h2 of each row's set, and which counters of n-grams are far above their mean.

    The counters are of fixed size; each task adds up its own, and those are added up in pieces.
    """
    part = (1 << SKETCH_BITS) // SKETCH_ROWS

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            sets = shingle_sets(batch["text"], n)
            for s in sets:
                counts[(s >> U(64 - SKETCH_BITS)).astype(np.int64)] += 1
            yield pd.DataFrame([(len(s), *set_hash(s)) for s in sets], columns=["n", "h1", "h2"]).assign(doc_id=batch["doc_id"].astype("Int64").to_numpy(), counts=None)
        yield pd.DataFrame([(None, -1, k, 0, counts[k * part : (k + 1) * part].tobytes()) for k in range(SKETCH_ROWS)], columns=["doc_id", "n", "h1", "h2", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (k,), own in _streams(batches, "h1", "counts", lambda x: np.frombuffer(x, np.int32).astype(np.int64)):
            yield pd.DataFrame({"h1": [k], "counts": [own.tobytes()]})

    both = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(rows, "doc_id long, n long, h1 long, h2 long, counts binary"), "sets")
    total = np.zeros(1 << SKETCH_BITS, np.int64)
    pieces = both.filter("n < 0").select("h1", "counts").repartition("h1").sortWithinPartitions("h1").mapInPandas(add, "h1 long, counts binary")
    for r in pieces.collect():  # SKETCH_ROWS rows, whatever the input
        total[r["h1"] * part : (r["h1"] + 1) * part] += np.frombuffer(bytes(r["counts"]), np.int64)
    mean = total.mean()
    return both.filter("n >= 0").select("doc_id", "n", "h1", "h2"), total > 2 * mean + 6 * mean**0.5 + 8


def _streams(batches: Iterator[pd.DataFrame], key: str, column: str, value: Callable) -> Iterator[tuple[tuple, np.ndarray]]:
    """Sums of ``column`` for each key of a sorted partition; one sum is held."""
    at, own = None, None
    for batch in batches:
        for k, x in zip(batch[key].tolist(), batch[column], strict=True):
            if k != at and own is not None:
                yield (at,), own
                own = None
            at, own = k, value(x) if own is None else own + value(x)
    if own is not None:
        yield (at,), own


def join(docs: DataFrame, *, threshold: tuple[int, int] = THRESHOLD, n: int = N, block_rows: int = BLOCK_ROWS, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Links rows whose sets of word ``n``-grams have a Jaccard similarity of at least ``threshold`` (numerator, denominator).

    Returns for each row of ``docs`` (doc_id, text) doc_id, n_shingles (size of its set) and component_id, the smallest doc_id
    that links reach from it. A-Z count as a-z, and words are what ASCII white space parts. A text with fewer words has its whole sequence as
    its set; a null text or one without words has none and is linked with nothing, not with its like either. Rows with equal sets,
    repeated rows too, are linked. Ids may be null; a component of null ids alone has the component_id null.
    Other columns are ignored, and no rows give no rows. The sets are of 64-bit hashes.
    """
    spark = docs.sparkSession
    bounds = Bounds(*threshold)
    docs = docs.select("doc_id", "text")

    small, common = describe(docs, n)
    full = small.filter("n > 0")
    total = full.agg(F.sum("n")).first()[0] or 0
    buckets = max(1, int(total * 0.37 / bucket_keys) + spark.sparkContext.defaultParallelism)
    groups = components(ties(docs, bounds.levels(), buckets, common, n), spark)
    reps = full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    mine = written(reps.join(groups, F.col("h1") == F.col("node")).select("h1", "h2", "rep", "n", "label"), "candidates")
    shape = mine.groupBy("label").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("n") / (block_rows * 1000))).cast("int").alias("blocks")).withColumnRenamed("label", "__label")
    placed = mine.join(shape, F.col("label") == F.col("__label")).select("h1", "h2", "rep", "label", F.pmod("h2", F.col("blocks")).cast("int").alias("block"))
    cand = docs.join(placed.hint("merge"), F.col("doc_id").eqNullSafe(F.col("rep"))).select("h1", "h2", "label", "block", "text")

    def same_set(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """An id may stand for several texts; the set that is meant stays."""
        for batch in batches:
            yield batch[[set_hash(s) == (a, b) for s, a, b in zip(shingle_sets(batch["text"], n), batch["h1"], batch["h2"], strict=True)]]

    cand = written(cand.mapInPandas(same_set, cand.schema), "candidate-texts")
    parts = written(_linked(cand, bounds, n), "linked")
    if not parts.filter("block > 0").isEmpty():
        merged = _across(cand, parts, bounds, n, block_rows, max(COPIED_LEAST, COPIED_BYTES * total)).select(F.col("node").alias("__node"), F.col("label").alias("__to"))
        parts = parts.join(merged, F.col("part") == F.col("__node"), "left").withColumn("part", F.coalesce("__to", "part"))
    discard(cand)
    parts = parts.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "part").distinct()
    named = reps.join(parts, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "left").select("h1", "h2", "rep", "part")
    least = named.filter("part is not null").groupBy("part").agg(F.min("rep").alias("least")).withColumnRenamed("part", "__part")
    least = written(least, "least-ids")
    alone = named.filter("part is null").withColumn("least", F.col("rep"))  # they need no join, in which all of them would meet
    final = named.join(least, F.col("part") == F.col("__part")).select("h1", "h2", "least").unionAll(alone.select("h1", "h2", "least"))
    final = written(final.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), F.col("least").alias("component_id")), "components")
    out = full.join(final, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionAll(small.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
