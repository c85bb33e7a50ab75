"""Operator 5: removing repeated passages with sharded suffix arrays.

Every 400-byte string is named after its minimiser, the k-gram with the least hash, so equal strings have one name wherever
they stand. Neighbouring strings mostly share a minimiser, and together form a segment. Only segments whose name occurs
twice can repeat; alike ones are merged, and the rest is dealt by name into shards. A shard's suffix array comes from
induced sorting at every level, its permuted common prefixes from that, and each run of prefixes of 400 bytes or more is
a string that stands in several places. No string belongs to two segments, so a place is never held against itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written
from .ngram_join import U, _blocks, _mixed

LENGTH = 400
#: Bytes of a minimiser.
GRAM = 64
#: Bytes of text that are worked on at once; below 2 ** 24.
AT_ONCE = 1 << 20
#: Bytes of a shard, about. A name's segments stay together.
SHARD = 2 << 20
#: Shards' worth of different segments that a name has at most in a suffix array; strings of a name with more are counted one by one.
HOT = 8
#: Of each of the two hashes by which those are counted first.
HASH_BITS = 64
#: Not a byte of UTF-8.
SEPARATOR = 0xFF
#: Buckets of so many suffixes, on average, are induced one by one, smaller ones in batches of so many suffixes at least and in so many rounds.
BUCKET, BATCH, ROUNDS = 256, 2048, 3


# ---- suffix arrays


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one to its right. The end counts as smaller than any symbol."""
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    heads = t[first]
    up = np.append(heads[:-1] < heads[1:], False)
    return np.repeat(up, np.diff(np.append(first, len(t))))


def _induced(t: np.ndarray, small: np.ndarray, start: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that the leftmost-smaller suffixes ``lms``, in their order, induce: larger suffixes from left to right, then smaller ones from right to left.

    A bucket is worked on in waves: what its suffixes induce into itself is the next wave.
    """
    n, k = len(t), len(start) - 1
    if n < BUCKET * k:
        return _induced_in_batches(t, small, start, lms)
    sa = np.full(n, -1, np.int64)
    head, n_large = start[:-1].copy(), np.bincount(t[~small], minlength=k)
    middle = start[:-1] + n_large
    by = t[lms]
    own = np.searchsorted(by, np.arange(k + 1)) if np.all(by[1:] >= by[:-1]) else None
    if own is None:
        order = np.argsort(by, kind="stable")
        lms, own = lms[order], np.searchsorted(by[order], np.arange(k + 1))

    def put(j: np.ndarray) -> None:
        """To the heads of their buckets, in order."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.append(first, len(c)))
        at = np.repeat(head[c[first]] - first, sizes) + np.arange(len(c))
        sa[at] = j[order]
        head[c[first]] += sizes

    put(np.array([n - 1]))
    for c in range(k):
        at = start[c]
        while at < head[c]:
            wave = sa[at : head[c]]
            at = head[c]
            j = wave[wave > 0] - 1
            j = j[~small[j]]
            if len(j):
                put(j)
        wave = lms[own[c] : own[c + 1]]
        j = wave[wave > 0] - 1
        if len(j):
            put(j)
    tail = start[1:].copy()

    def put_back(j: np.ndarray) -> None:
        """To the tails of their buckets, the first of ``j`` last."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.append(first, len(c)))
        at = np.repeat(tail[c[first]] - 1 + first, sizes) - np.arange(len(c))
        sa[at] = j[order]
        tail[c[first]] -= sizes

    for c in range(k - 1, -1, -1):
        at = start[c + 1]
        while at > tail[c]:
            wave = sa[tail[c] : at][::-1]
            at = tail[c]
            j = wave[wave > 0] - 1
            j = j[small[j]]
            if len(j):
                put_back(j)
        wave = sa[start[c] : middle[c]][::-1]
        j = wave[wave > 0] - 1
        j = j[small[j]]
        if len(j):
            put_back(j)
    return sa


def _induced_in_batches(t: np.ndarray, small: np.ndarray, start: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for strings of many symbols, such as reduced ones, whose buckets hold a few suffixes each.

    Neighbouring buckets are one batch. What it induces into itself is put there in the order in which it is found, again until that order
    doesn't change; each round settles the first place that was wrong, and mostly far more. A batch that takes more than a few rounds (of
    periodic text) is gone through suffix by suffix. Then the other buckets get their part.
    """
    n, k = len(t), len(start) - 1
    by = t[lms]
    order = np.argsort(by, kind="stable")
    sizes = np.bincount(by, minlength=k)
    sa = np.full(n, -1, np.int64)
    sa[(start[1:] - np.cumsum(sizes))[by[order]] + np.arange(len(lms))] = lms[order]
    cuts = np.unique(np.append(np.searchsorted(start, np.arange(0, n, max(BATCH, n // 32)), "right") - 1, k))
    batches = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def put(j: np.ndarray, edge: np.ndarray, way: int) -> None:
        """In order, to the heads of their buckets (way 1) or to their tails (way -1)."""
        c = t[j]
        order = np.argsort(c, kind="stable")
        c = c[order]
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        sizes = np.diff(np.append(first, len(c)))
        sa[np.repeat(edge[c[first]] - (way < 0) - way * first, sizes) + way * np.arange(len(c))] = j[order]
        edge[c[first]] += way * sizes

    def one_by_one(a: int, b: int, own: np.ndarray, way: int) -> None:
        """What the batch induces into itself."""
        low = int(start[a])
        x, at = sa[low : start[b]].tolist(), (own - low - (way < 0)).tolist()
        side = before_of(way)
        for i in x if way > 0 else reversed(x):  # which grow ahead of the loop
            c = side[i]
            if a <= c < b:
                x[at[c - a]] = i - 1
                at[c - a] += way
        sa[low : start[b]] = x
        edge[a:b] = np.array(at) + low + (way < 0)

    @cache
    def before_of(way: int) -> list[int]:
        """The symbol to the left of each place where it is induced this way; place -1, of what isn't there yet, is the last."""
        return np.concatenate([[-1], np.where(small[:-1] == (way < 0), t[:-1].astype(np.int64), -1), [-1]]).tolist()

    head, tail = start[:-1].copy(), start[1:].copy()
    put(np.array([n - 1]), head, 1)
    for way, edge in ((1, head), (-1, tail)):
        if way < 0:
            sa[(sa >= 0) & small[sa]] = -1
        for a, b in batches[::way]:
            own, before = edge[a:b].copy(), None
            for left in range(ROUNDS, -1, -1):
                x = sa[start[a] : start[b]][::way]
                j = x[x > 0] - 1
                j = j[small[j] == (way < 0)]
                inside = (t[j] >= a) & (t[j] < b)
                again = j[inside]
                if not len(again) or before is not None and np.array_equal(again, before):
                    break
                if left == 0:
                    one_by_one(a, b, own, way)
                    x = sa[start[a] : start[b]][::way]
                    j = x[x > 0] - 1
                    j = j[small[j] == (way < 0)]
                    inside = (t[j] >= a) & (t[j] < b)
                    break
                edge[a:b] = own
                put(again, edge, way)
                before = again
            if not inside.all():
                put(j[~inside], edge, way)
    return sa


def _equal_substrings(t: np.ndarray, small_lms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For leftmost-smaller substrings in order: whether each is the same as the one before it."""
    a, b = small_lms[:-1], small_lms[1:]
    same = sizes[:-1] == sizes[1:]
    left, k = np.flatnonzero(same), 0
    while len(left):
        fits = k < sizes[1:][left]
        left = left[fits]
        off = t[a[left] + k] != t[b[left] + k]
        same[left[off]] = False
        left, k = left[~off], k + 1
    return np.concatenate([[False], same])


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Of a string of small non-negative integers, by induced sorting."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    t = t if t.dtype == np.uint8 else t.astype(np.int64)
    k = int(t.max()) + 1
    small = _types(t)
    start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=k))])
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(lms) < 2:
        return _induced(t, small, start, lms)
    # A substring goes up to the next one's first symbol; the last one to the end, which is smaller than any symbol.
    size = np.append(np.diff(lms) + 1, n - lms[-1])
    place = np.full(n, -1, np.int64)
    place[lms] = np.arange(len(lms))
    sa = _induced(t, small, start, lms)
    order = place[sa]
    order = order[order >= 0]
    same = _equal_substrings(t, lms[order], size[order])
    last = np.flatnonzero(order == len(lms) - 1)[0]  # it ends at the end, as no other does
    same[last] = False
    if last + 1 < len(same):
        same[last + 1] = False
    name = np.empty(len(lms), np.int64)
    name[order] = np.cumsum(~same) - 1
    inner = np.argsort(name, kind="stable") if int(name.max()) + 1 == len(lms) else suffix_array(name)
    return _induced(t, small, start, lms[inner])


def common_prefixes(t: np.ndarray, sa: np.ndarray, room: np.ndarray) -> np.ndarray:
    """PLCP: for each position the length it shares with the suffix before it in ``sa``, at most ``room`` (bytes left of its segment).

    Only where the symbols to the left differ, or a segment starts, a length is counted, by words of 8 bytes; elsewhere it is one less than
    the position's to the left. (What two suffixes share beyond a segment's end is never counted.)
    """
    n = len(t)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    irreducible = np.flatnonzero(np.concatenate([[True], (phi[1:] <= 0) | (t[:-1] != t[phi[1:] - 1]) | (room[1:] >= room[:-1])]))
    i = irreducible[phi[irreducible] >= 0]
    j = phi[i]
    padded = np.concatenate([t, np.zeros(8, np.uint8)])
    words = np.zeros(n + 1, np.uint64)
    for k in range(8):
        words[:n] |= padded[k : k + n].astype(np.uint64) << U(8 * k)
    found = np.zeros(len(i), np.int64)
    left = np.arange(len(i))
    most = int(room.max()) if n else 0
    at = 0
    while len(left) and at <= most:
        x = words[np.minimum(i[left] + at, n)] ^ words[np.minimum(j[left] + at, n)]
        stop = x != 0
        low = x[stop] & (~x[stop] + U(1))
        found[left[stop]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        left = left[~stop]
        at += 8
    found[left] = most
    found = np.minimum(found, n - j)
    out = np.zeros(n, np.int64)
    out[i] = found
    base = np.zeros(n, np.int64)
    base[irreducible] = irreducible
    base = np.maximum.accumulate(base)
    out = np.maximum(out[base] - (np.arange(n) - base), 0)
    return np.minimum(out, room)


def repeated_starts(segments: list[bytes], times: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """For each distinct segment, the starts of its strings of ``length`` bytes that occur twice, counting a segment as often as ``times`` says."""
    sizes = np.array([len(s) for s in segments], np.int64)
    t = np.frombuffer(bytes([SEPARATOR]).join(segments) + bytes([SEPARATOR]), np.uint8)
    first = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    room = (first + sizes)[owner] - np.arange(len(t))
    sa = suffix_array(t)
    plcp = common_prefixes(t, sa, room)
    group = np.cumsum(plcp[sa] < length)
    weight = np.where(room >= length, np.array(times)[owner], 0)[sa]
    hit = np.zeros(len(t), bool)
    hit[sa] = (np.bincount(group, weights=weight)[group] >= 2) & (weight > 0)
    return [np.flatnonzero(hit[a : a + n]) for a, n in zip(first, sizes, strict=True)]


# ---- segments


def minimisers(t: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each start of a string of ``length`` bytes the place of its minimiser (the leftmost of equals), and each place's k-gram hash."""
    n = len(t)
    with np.errstate(over="ignore"):
        base, inverse = U(0x9E3779B97F4A7C15), U(0xF1DE83E19937733D)
        powers = np.multiply.accumulate(np.full(n, base, U))
        sums = np.concatenate([[U(0)], np.cumsum((t.astype(U) + U(1)) * powers)])
        back = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n - gram, inverse, U)]))
        hashes = _mixed((sums[gram:] - sums[:-gram]) * back)
    w = length - gram + 1
    packed = (hashes >> U(24) << U(24)) | np.arange(len(hashes), dtype=U)
    full = -(-len(packed) // w) * w
    rows = np.concatenate([packed, np.full(full - len(packed), ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    m = len(packed) - w + 1
    least = np.minimum(behind[:m], ahead[w - 1 : w - 1 + m])
    return (least & U((1 << 24) - 1)).astype(np.int64), hashes


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


assert _inverse(0x9E3779B97F4A7C15) == 0xF1DE83E19937733D


def segments_of(data: list[bytes], length: int = LENGTH, gram: int = GRAM, at_once: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays of (index in ``data``, name, first start, last start) of the segments of every text of ``length`` bytes or more."""
    held: list[tuple[int, int, bytes]] = []
    size = 0

    def run():
        t = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
        sizes = np.array([len(x) for _, _, x in held], np.int64)
        ends = np.cumsum(sizes)
        at, hashes = minimisers(t, length, gram)
        owner = np.repeat(np.arange(len(held)), sizes)[: len(at)]
        s = np.flatnonzero(ends[owner] - np.arange(len(at)) >= length)
        own, place = owner[s], at[s]
        new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1])]))
        last = np.append(new[1:] - 1, len(s) - 1)
        k = own[new]
        shift = np.array([o for _, o, _ in held], np.int64)[k] - (ends - sizes)[k]
        return np.array([i for i, _, _ in held], np.int64)[k], hashes[place[new]].astype(np.int64), s[new] + shift, s[last] + shift

    for i, x in enumerate(data):
        for o in range(0, max(1, len(x) - length + 1), at_once) if len(x) >= length else ():
            part = x[o : o + at_once + length - 1]
            if held and size + len(part) > at_once + length:
                yield run()
                held, size = [], 0
            held.append((i, o, part))
            size += len(part)
    if held:
        yield run()


def string_hashes(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each string of ``length`` bytes of ``data``, as two arrays."""
    t = np.frombuffer(data, np.uint8)
    out = []
    with np.errstate(over="ignore"):
        for base in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
            up = np.multiply.accumulate(np.full(len(t) + 1, base, U))
            down = np.multiply.accumulate(np.full(len(t) + 1, pow(base, -1, 1 << 64), U))
            sums = np.concatenate([[U(0)], np.cumsum(_mixed(t.astype(U) + U(base)) * up[: len(t)])])
            out.append(_mixed((sums[length:] - sums[:-length]) * down[: len(t) - length + 1]).astype(np.int64))
    return out[0], out[1]


def _utf8(texts: pd.Series) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _same(*names: str):
    out = F.lit(True)
    for c in names:
        out = out & (F.col(c) == F.col(f"__{c}"))
    return out


def _other(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumnsRenamed({c: f"__{c}" for c in names})


def _counted_strings(parts: DataFrame, length: int, bits: int) -> DataFrame:
    """(name, h1, h2, runs) for segments of names that have too many for a suffix array.

    Each string goes by its hash (two of ``bits`` each) first, so that no name's strings meet in one task and equal ones are added up before the shuffle. What
    is found twice then goes by its bytes, so that a collision can't remove anything.
    """

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, h1, h2, times, part in zip(batch["name"], batch["h1"], batch["h2"], batch["times"], batch["part"], strict=True):
                w1, w2 = string_hashes(bytes(part), length)
                yield pd.DataFrame({"name": name, "h1": h1, "h2": h2, "times": times, "at": np.arange(len(w1)), "w1": w1 >> 64 - bits, "w2": w2 >> 64 - bits})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, h1, h2, times, part, own in zip(batch["name"], batch["h1"], batch["h2"], batch["times"], batch["part"], batch["own"], strict=True):
                data = bytes(part)
                yield pd.DataFrame({"name": name, "h1": h1, "h2": h2, "times": times, "at": own, "string": [data[a : a + length] for a in own]})

    one = parts.groupBy("name", "h1", "h2").agg(F.sum("times").alias("times"), F.first("part").alias("part"))
    one = written(one, "hot-segments")
    each = one.mapInPandas(strings, "name long, h1 long, h2 long, times long, at long, w1 long, w2 long")
    twice = written(each.groupBy("w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1").select(F.col("w1").alias("__w1"), F.col("w2").alias("__w2")), "twice")
    at = each.join(twice, _same("w1", "w2"), "left_semi").groupBy("name", "h1", "h2").agg(F.collect_set("at").alias("own"))
    held = written(one.join(_other(at, "name", "h1", "h2"), _same("name", "h1", "h2")).select("name", "h1", "h2", "times", "part", "own").mapInPandas(cut, "name long, h1 long, h2 long, times long, at long, string binary"), "hot-strings")
    alike = written(held.groupBy("string").agg(F.sum("times").alias("n")).filter("n > 1").select(F.col("string").alias("__string")), "hot-repeats")
    found = held.join(alike, _same("string"), "left_semi").groupBy("name", "h1", "h2").agg(F.collect_set("at").alias("at"))
    out = written(found.select("name", "h1", "h2", F.transform("at", lambda x: F.struct(x.alias("a"), x.alias("b"))).alias("runs")), "hot-hits")
    discard(one, twice, held, alike)
    return out


def _verdicts(docs: DataFrame, length: int, gram: int, shard: int) -> DataFrame:
    """(k1, k2, runs): for the rows of ``docs`` (k1, k2, text) with repeated strings, the first and last starts of runs of them."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            k1, k2 = batch["k1"].to_numpy(), batch["k2"].to_numpy()
            for i, name, a, b in segments_of(_utf8(batch["text"]), length, gram):
                yield pd.DataFrame({"k1": k1[i], "k2": k2[i], "name": name, "a": a, "b": b})

    placed = written(docs.mapInPandas(names, "k1 long, k2 long, name long, a long, b long"), "segments")
    twice = written(placed.groupBy("name").agg(F.count("*").alias("n")).filter("n > 1").select("name"), "names")
    found = placed.join(_other(twice, "name"), _same("name")).groupBy("k1", "k2").agg(F.collect_set(F.struct("name", "a", "b")).alias("own"))
    found = written(found, "found")
    discard(placed, twice)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each segment with the hash of its bytes; the bytes come with the first of those alike in a batch, and with how many there are, 2 at most."""
        for batch in batches:
            rows, at = [], {}
            for k1, k2, data, own in zip(batch["k1"], batch["k2"], _utf8(batch["text"]), batch["own"], strict=True):
                for x in own:
                    part = data[x["a"] : x["b"] + length]
                    h = hashlib.blake2b(part, digest_size=16).digest()
                    j = at.setdefault((x["name"], h), len(rows))
                    rows.append([k1, k2, x["name"], int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True), x["a"], len(part), 1 if j == len(rows) else 0, part if j == len(rows) else None])
                    if j < len(rows) - 1:
                        rows[j][7] = 2
            yield pd.DataFrame(rows, columns=["k1", "k2", "name", "h1", "h2", "a", "size", "times", "part"])

    one = docs.select("k1", "k2", "text").join(_other(found, "k1", "k2"), _same("k1", "k2")).select("k1", "k2", "text", "own")
    cuts = written(one.mapInPandas(cut, "k1 long, k2 long, name long, h1 long, h2 long, a long, size long, times int, part binary"), "cuts")
    discard(found)
    parts = cuts.filter("times > 0").select("name", "h1", "h2", "size", "times", "part")
    shards = max(1, (parts.agg(F.sum("size")).first()[0] or 0) // shard)
    hot = written(parts.groupBy("name").agg(F.sum("size").alias("size")).filter(F.col("size") > HOT * shard).select(F.col("name").alias("__name")), "hot-names")
    many = None
    if not hot.isEmpty():
        many = _counted_strings(parts.join(hot, F.col("name") == F.col("__name"), "left_semi"), length, HASH_BITS)
        parts = parts.join(hot, F.col("name") == F.col("__name"), "left_anti")

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, rows in _blocks(batches, ["shard"]):
            rows = rows.groupby(["name", "h1", "h2"], sort=True).agg(times=("times", "sum"), part=("part", "first")).reset_index()
            hits = repeated_starts([bytes(x) for x in rows["part"]], np.minimum(rows["times"], 2).tolist(), length)
            at = [i for i, h in enumerate(hits) if len(h)]
            runs = []
            for i in at:
                h = hits[i]
                gap = np.flatnonzero(np.diff(h) > 1)
                runs.append([{"a": int(x), "b": int(y)} for x, y in zip(h[np.append(0, gap + 1)], h[np.append(gap, len(h) - 1)], strict=True)])
            if at:
                yield rows.iloc[at][["name", "h1", "h2"]].assign(runs=runs)

    dealt = parts.select("name", "h1", "h2", "times", "part").withColumn("shard", F.pmod(F.xxhash64("name"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
    hits = dealt.mapInPandas(sort, "name long, h1 long, h2 long, runs array<struct<a:long,b:long>>")
    hits = written(hits.unionAll(many) if many is not None else hits, "hits")
    at = cuts.select("k1", "k2", "name", "h1", "h2", F.col("a").alias("off")).join(_other(hits, "name", "h1", "h2"), _same("name", "h1", "h2"))
    out = at.select("k1", "k2", F.explode(F.transform("runs", lambda x: F.struct((x["a"] + F.col("off")).alias("a"), (x["b"] + F.col("off")).alias("b")))).alias("run")).groupBy("k1", "k2").agg(F.collect_set("run").alias("runs"))
    out = written(out, "runs")
    discard(cuts, hits, hot)
    return out


def removed(size: int, runs: list, length: int = LENGTH) -> list[tuple[int, int]]:
    """The maximal spans (start, end) that strings starting at ``runs`` cover."""
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"] + length) for x in runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


def cleaned(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, shard: int = SHARD, spans: bool = False) -> DataFrame:
    """Removes from each text of ``docs`` (doc_id, text), as UTF-8, every byte that a string of ``length`` bytes covers which also starts elsewhere.

    Returns for each row doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes left, joined), and
    with ``spans`` the runs themselves as [start, end). Strings never cross rows; those that overlap count; all are judged on the input.
    Repeated rows are texts of their own and thus remove each other. A null text counts as empty. Ids may be null or stand
    for several texts; other columns are ignored; no rows give no rows.
    """
    key = [F.xxhash64(F.lit(5), "doc_id", "text").alias("k1"), F.xxhash64(F.lit(55), "text", "doc_id").alias("k2")]
    rows = docs.select("doc_id", "text", *key)
    runs = _verdicts(rows.select("k1", "k2", "text"), length, gram, shard)

    def clean(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for data, own in zip(_utf8(batch["text"]), batch["runs"], strict=True):
                gone = removed(len(data), own, length) if own is not None else []
                kept, at = hashlib.sha256(), 0
                for a, b in gone:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest(), [{"start": a, "end": b} for a, b in gone]))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]).assign(doc_id=batch["doc_id"].astype("Int64").to_numpy())

    out = rows.join(_other(runs, "k1", "k2"), _same("k1", "k2"), "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "runs")
    out = out.mapInPandas(clean, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>")
    return out if spans else out.drop("spans")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(table(spark, sf_dir, "documents"))
