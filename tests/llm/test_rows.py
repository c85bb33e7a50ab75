"""Operators 1, 3, 4, 5, 7, 8 and 10 against plain versions, on a small table and on odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import exact_dedup, mixing, ngram_join, packing, quality, sharding, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(df) -> list[tuple]:
    return [tuple(r) for r in df.select("doc_id", "text", "source").collect()]


def by_id(rows):
    return sorted(rows, key=repr)


# ---- 1


def targets(sizes: dict, weights=(5, 2, 1), most=3):
    """Shares by weight; the excess over the caps is dealt again until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_mix(request, which):
    df = request.getfixturevalue(which)
    rows = mixing.mix(df).collect()
    size = lambda t: len(WORD.findall(t or ""))
    want = Counter()
    for _, t, s in table(df):
        want[s] += size(t)
    goal = targets(dict(want))
    taken = Counter()
    for r in rows:
        assert r.source_size == want[r.source]
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert by_id((r.doc_id, r["size"]) for r in rows) == by_id((i, size(t)) for i, t, _ in table(df))
    assert by_id(map(tuple, rows)) == by_id(map(tuple, mixing.mix(df.repartition(5)).collect()))


def test_mix_rows(odd):
    whole = {(r.doc_id, r.source): r for r in mixing.mix(odd).collect()}
    out = mixing.mix_rows(odd)
    assert out.columns == odd.columns
    n = Counter((r.doc_id, r.source) for r in out.collect())
    had = Counter((r.doc_id, r.source) for r in odd.collect())
    for k, r in whole.items():
        if had[k] == 1 and r["size"]:
            assert n[k] == math.ceil(r.taken / r["size"])


# ---- 3


@pytest.mark.parametrize(("which", "moduli", "size"), [("documents", exact_dedup.MODULI, None), ("odd", exact_dedup.MODULI, 50), ("odd", (3, 2), None), ("odd", (3, 2), 7)])
def test_exact(request, which, moduli, size):
    """The small moduli make most fingerprints collide; with a small size nearly all texts go in parts."""
    df = request.getfixturevalue(which)
    groups = defaultdict(list)
    for i, t, _ in table(df):
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, len(t or "")))
    want = []
    for norm, held in groups.items():
        held.sort(key=lambda x: (-x[1], x[0] is None, x[0] or 0))
        digest = hashlib.sha256(norm.encode()).hexdigest()
        want += [(i, held[0][0], len(held), k == 0, digest) for k, (i, _) in enumerate(held)]
    assert by_id(map(tuple, exact_dedup.deduplicate(df, moduli=moduli, size=size).collect())) == by_id(want)


def test_huge_texts(spark):
    """Above the real size of a part: equal ones, one that differs in its last part only, and one with white space."""
    text = "".join(f"line {i} of a huge text\n" for i in range(70_000))
    texts = [text, text + "a", text.replace(" ", "\t"), text[:-1] + "b", text + "a", text + " a"]
    assert len(text.replace(" ", "")) > exact_dedup.COMPARED
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.deduplicate(df).collect()}
    assert got == {0: (0, 2, True), 2: (0, 2, False), 1: (5, 3, False), 4: (5, 3, False), 5: (5, 3, True), 3: (3, 1, True)}


@pytest.mark.parametrize("words", [1, 4, exact_dedup.FILTER_WORDS])
def test_the_filter_loses_no_key(spark, words):
    docs = spark.range(2000).select("id", F.xxhash64("id").alias("key"))
    keys = docs.filter("id % 40 = 0").select(F.col("key").alias("__key"))
    got = [r.id for r in exact_dedup._may_hold(docs, keys, words).collect()]
    assert len(set(got)) == len(got) and set(range(0, 2000, 40)) <= set(got)
    assert len(got) < 60 or words < exact_dedup.FILTER_WORDS


def test_the_sql_for_equal_texts(spark, tmp_path):
    """With every kind of white space that is deleted, and others that are not."""
    import duckdb

    texts = ["a b", "a\x0bb", "a\x0cb\r", "a\rb\n\t", "a\x1fb", "a\x85b", "a\xa0b", "ab", "a-b", "a\x08b", None, " "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    rows = [tuple(r) for r in exact_dedup.op3_exact_dedup(spark, str(tmp_path)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()]
    assert by_id(rows) == by_id(con.sql(exact_dedup.SQL).fetchall())


def test_fingerprints_compose():
    data = bytes(range(256)) * 900
    for cut in (0, 1, 70_000, len(data)):
        assert exact_dedup.combine(exact_dedup.fingerprint(data[:cut]), exact_dedup.fingerprint(data[cut:])) == exact_dedup.fingerprint(data)
    n, base, m = len(data), exact_dedup.BASES[0], exact_dedup.MODULI[0]
    assert exact_dedup.fingerprint(data)[0] == sum(c * pow(base, n - 1 - i, m) for i, c in enumerate(data)) % m


# ---- 4


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_packing(request, which):
    df = request.getfixturevalue(which)
    path = packing.public_tokenizers.path(packing.TOKENIZER)
    t = Tokenizer.from_file(path)
    want = Counter()
    for i, text, _ in table(df):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[i, k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    rows = packing.pack_documents(df).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for held in bins.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at
            at += n
        assert at <= 2048
    least = -(-sum(r.length for r in rows) // 2048)
    assert len(bins) <= least + max(1, least // 50)


def test_ids_of_words():
    path = packing.public_tokenizers.path(packing.TOKENIZER)
    t, w = Tokenizer.from_file(path), packing.WordIds(path)
    for text in ("I'll don't 'S", "ÀÉİıΣς end.", "a\x85b\xa0c\x0bd\x00e", "<|endoftext|>x<|startoftext|>", "12 ½² x__y--!!", "ﬁ é 日本語", "soft\xadhyphen​"):
        assert w.of(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_children_beat_best_fit():
    """Where best fit from long to short misses the bound, children do better; and they do without it."""
    rng = np.random.default_rng(1)
    lengths = rng.integers(500, 1000, 300)
    plain = packing.sorted_fit(lengths, 2048)
    best, first, won = packing.evolve(lengths, [], rng, 2048)
    assert -(-lengths.sum() // 2048) < len(best.fills) < len(plain.fills) < first
    assert won > 5
    assert (np.bincount(best.bins, weights=lengths) <= 2048).all()
    again = packing.evolve(lengths, [best.bins], rng, 2048, last=True)[0]
    assert again.worth >= best.worth


def test_children_reach_the_bound_from_random_orders():
    rng = np.random.default_rng(2)
    lengths = rng.gamma(1.6, 300, 4000).astype(int).clip(1, 2047)
    best, first, won = packing.evolve(lengths, [], rng, 2048)
    assert len(best.fills) == -(-lengths.sum() // 2048) < first
    assert won > 0


def test_the_report_of_the_islands(documents):
    pieces = packing.token_pieces(documents, path=packing.public_tokenizers.path(packing.TOKENIZER))
    rows = packing.pack(pieces, block=100, report=True).collect()
    n = documents.count()
    assert len(rows) % packing.ISLANDS == 0
    assert sum(r["items"] for r in rows) >= packing.ISLANDS * n * 0.9
    assert all(r.least <= r.best for r in rows)
    assert sum(r.won for r in rows) > 0


# ---- 5


def plain_removed(texts: list[bytes], length: int):
    n = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        hit = np.zeros(len(t) + 1, int)
        for i in range(len(t) - length + 1):
            if n[t[i : i + length]] > 1:
                hit[i] += 1
                hit[i + length] -= 1
        gone = np.cumsum(hit[:-1]) > 0
        yield int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(t) else 0, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()


@pytest.mark.parametrize(("which", "length", "gram", "shard"), [("odd", 400, 64, 1 << 21), ("odd", 60, 16, 900), ("documents", 400, 64, 1 << 21), ("odd", 5, 3, 500)])
def test_repeats(request, which, length, gram, shard):
    df = request.getfixturevalue(which)
    rows = table(df)
    texts = [(t or "").encode() for _, t, _ in rows]
    want = [(i, len(t), *x) for (i, _, _), t, x in zip(rows, texts, plain_removed(texts, length), strict=True)]
    assert by_id(map(tuple, suffix_dedup.cleaned(df, length=length, gram=gram, shard=shard).collect())) == by_id(want)


def test_the_query_for_repeats(spark):
    """All rows of a table of 1000 against every 400-byte string of it."""
    folder = "/root/testdata/sf0.01"
    rows = table(spark.read.parquet(f"{folder}/documents.parquet"))
    texts = [(t or "").encode() for _, t, _ in rows]
    want = [(i, len(t), *x) for (i, _, _), t, x in zip(rows, texts, plain_removed(texts, 400), strict=True)]
    assert by_id(map(tuple, suffix_dedup.op5_suffix_dedup(spark, folder).collect())) == by_id(want)
    assert sum(x[2] > 0 for x in want) > 50


@pytest.mark.parametrize("bits", [64, 2])
def test_names_with_many_segments(odd, monkeypatch, bits):
    """With hashes of two bits nearly all strings collide."""
    monkeypatch.setattr(suffix_dedup, "HOT", 0)
    monkeypatch.setattr(suffix_dedup, "HASH_BITS", bits)
    rows = table(odd)
    texts = [(t or "").encode() for _, t, _ in rows]
    want = [(i, len(t), *x) for (i, _, _), t, x in zip(rows, texts, plain_removed(texts, 60), strict=True)]
    assert by_id(map(tuple, suffix_dedup.cleaned(odd, length=60, gram=16, shard=900).collect())) == by_id(want)


@pytest.mark.parametrize("bucket", [0, 64, 1 << 40])
@pytest.mark.parametrize("symbols", [2, 3, 200])
def test_suffix_arrays(symbols, bucket, monkeypatch):
    """``bucket``: buckets are always induced one by one, by their size, and always in batches, here small ones."""
    monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
    monkeypatch.setattr(suffix_dedup, "BATCH", 3)
    rng = np.random.default_rng(symbols)
    for n in [0, 1, 2, 3, *rng.integers(4, 90, 120)]:
        t = rng.integers(0, symbols, n).astype(np.uint8)
        if n > 60:
            t[n // 3 : n // 3 + 40] = [1, 0] * 20
        data = t.tobytes()
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(n), key=lambda i: data[i:])
        plcp = suffix_dedup.common_prefixes(t, sa, n - np.arange(n)) if n else np.empty(0)
        for a, b in zip(sa[:-1].tolist(), sa[1:].tolist(), strict=True):
            same = next((k for k in range(n) if a + k >= n or b + k >= n or data[a + k] != data[b + k]), 0)
            assert plcp[b] == same


def test_long_texts_are_cut_for_work_only():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 100, 5000).astype(np.uint8).tobytes()
    whole = list(suffix_dedup.segments_of([text], 50, 10))
    parts = list(suffix_dedup.segments_of([text], 50, 10, at_once=700))
    starts = lambda x: [(n, s) for _, ns, a, b in x for n, p, q in zip(ns.tolist(), a.tolist(), b.tolist(), strict=True) for s in range(p, q + 1)]
    assert starts(whole) == starts(parts)


# ---- 7


def plain_components(rows, num, den, n):
    def grams(t):
        w = WORD.findall(re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()

    sets = [grams(t) for _, t, _ in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = part[i], part[j]
                part = [b if p == a else p for p in part]
    least = {p: min((rows[i][0] for i in range(len(rows)) if part[i] == p and rows[i][0] is not None), default=None) for p in set(part)}
    return [(rows[i][0], len(sets[i]), least[part[i]] if sets[i] else rows[i][0]) for i in range(len(rows))]


@pytest.mark.parametrize(("which", "how"), [("documents", {}), ("odd", {}), ("odd", {"block_rows": 2, "bucket_keys": 50}), ("odd", {"threshold": (80, 100), "n": 5}), ("odd", {"threshold": (50, 100), "n": 2, "block_rows": 3}), ("documents", {"threshold": (60, 100), "block_rows": 2})])
def test_links(request, which, how):
    df = request.getfixturevalue(which)
    num, den = how.get("threshold", (85, 100))
    assert by_id(map(tuple, ngram_join.join(df, **how).collect())) == by_id(plain_components(table(df), num, den, how.get("n", 4)))


@pytest.mark.parametrize(("few", "columns", "increments"), [(32, 1024, 1 << 20), (2, 3, 8), (5, 1, 64)])
def test_the_product_of_a_block(monkeypatch, few, columns, increments):
    """Roots against all pairs of small sets, near the threshold; with what is known already, and with new rows only."""
    for name, x in (("FEW", few), ("COLUMNS", columns), ("INCREMENTS", increments)):
        monkeypatch.setattr(ngram_join, name, x)
    rng = np.random.default_rng(7)
    for trial in range(60):
        base = [rng.choice(1000, rng.integers(4, 40), replace=False) for _ in range(3)]
        sets = [np.unique(np.concatenate([rng.permutation(x)[rng.integers(0, 4) :], rng.integers(0, 1000, rng.integers(0, 3))])).astype(np.uint64) for x in base for _ in range(rng.integers(1, 14))]
        bounds = ngram_join.Bounds(*((85, 100), (80, 100), (50, 100))[trial % 3])
        m = len(sets)
        known = np.arange(m) if trial % 2 else np.array([max(0, i - i % 2) for i in range(m)])
        new = None if trial % 4 < 2 else rng.random(m) < 0.4
        part = known.copy()
        for i in range(m):
            for j in range(i):
                common = len(np.intersect1d(sets[i], sets[j]))
                if (new is None or new[i] or new[j]) and bounds.linked(common, len(sets[i]), len(sets[j])):
                    part[part == part[i]] = part[j]
        got = ngram_join.link(sets, bounds, known, new)
        assert len({*zip(part.tolist(), got.tolist(), strict=True)}) == len(set(part.tolist())) == len(set(got.tolist()))


def test_linked_sets_share_a_key():
    """At the edge of the threshold, for all sizes."""
    rng = np.random.default_rng(5)
    for num, den in ((85, 100), (80, 100), (60, 100)):
        bounds = ngram_join.Bounds(num, den)
        levels = bounds.levels()
        for n in [*range(1, 60), 200, 777]:
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for m in range(bounds.least_size(n), n + 1):
                common = int(bounds.overlap(n, m))
                b = np.unique(np.concatenate([a[rng.permutation(n)[:common]], rng.integers(0, 1 << 63, m - common).astype(np.uint64)]))
                if bounds.linked(common, n, len(b)):
                    assert np.intersect1d(ngram_join.keys_of(a, levels), ngram_join.keys_of(b, levels)).size


def test_unrelated_texts_are_not_tied_by_chance(spark):
    """So many keys in one bucket that some 34 agree in 32 bits."""
    rng = random.Random(11)
    docs = spark.createDataFrame([(" ".join(f"w{rng.getrandbits(60)}" for _ in range(400)),) for _ in range(2500)], "text string").repartition(4)
    assert ngram_join.ties(docs, ngram_join.Bounds(80, 100).levels(), 1, np.zeros(1 << ngram_join.SKETCH_BITS, bool)).count() < 5


def test_chunks_meet_blocks_in_rounds(monkeypatch, odd):
    """Of bounded size each, with the same links; so many rounds that some have no chunk."""
    rounds, written = [], ngram_join.written
    monkeypatch.setattr(ngram_join, "written", lambda df, what: (rounds.append(what), written(df, what))[1])
    monkeypatch.setattr(ngram_join, "COPIED_LEAST", 20_000)
    monkeypatch.setattr(ngram_join, "COPIED_BYTES", 0)
    got = ngram_join.join(odd, threshold=(50, 100), n=2, block_rows=3)
    assert by_id(map(tuple, got.collect())) == by_id(plain_components(table(odd), 50, 100, 2))
    assert rounds.count("links") > 2


def test_a_long_text_in_parts(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(3000))
    whole = ngram_join.shingle_sets([text, "a b", None, "C D e F g"])
    monkeypatch.setattr(ngram_join, "AT_ONCE", 64)
    assert [x.tolist() for x in ngram_join.shingle_sets([text, "a b", None, "C D e F g"])] == [x.tolist() for x in whole]
    assert [len(x) for x in whole] == [91, 1, 0, 2]


# ---- 8


def plain_rules(text):
    text = text or ""
    w = WORD.findall(text)
    lines, dup, seen = text.split("\n"), 0, set()
    for x in lines:
        if WORD.search(x):
            dup += x in seen
            seen.add(x)
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    again = {k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(again), failed


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_base_rules(request, which):
    df = request.getfixturevalue(which)
    rows = quality.rules(df).collect()
    assert by_id((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == by_id((i, *plain_rules(t)) for i, t, _ in table(df))
    assert not any(r.base_failed and r.kept for r in rows)


def test_fertility():
    pieces = quality.Pieces(quality.public_tokenizers.path(quality.MODEL))
    n, per, share, entropy = quality.fertility(["the".encode(), "the".encode(), "\U00012345".encode()], 7, pieces)
    assert per == 7 / n
    assert share >= 4 / n
    assert entropy > 0
    assert quality.fertility([], 0, pieces) == (0, 0.0, 0.0, 0.0)
    assert [quality.script_of(t) for t in ("Straße", "привет мир x", "日本語", "123 !", "")] == ["latin", "cyrillic", "han", "none", "none"]


def plain_verdicts(rows, far=quality.FAR):
    """``kept`` of measured rows (dicts with text and lang), from lists of values."""
    names = list(quality.STEPS)
    step = lambda r, c: round(r[c] / quality.STEPS[c]) * quality.STEPS[c]
    for r in rows:
        r["kind"] = r["lang"] if r["lang"] is not None else "*" + r["script"]
        r["cls"] = int(math.log2(max(1, r["n_tokens"])))
        r["all"] = ""
        r["in"] = quality.within(r["script"], r["n_tokens"], *(r[c] for c in names))
    texts = list({(r["kind"], r["script"], r["cls"], r["text"]): r for r in rows if not r["base_failed"] and r["in"]}.values())
    for r in rows:
        ok = not r["base_failed"] and r["in"]
        if ok:
            for by, reach in quality.WIDENED:
                own = [x for x in texts if x[by] == r[by] and abs(x["cls"] - r["cls"]) <= reach]
                if len(own) >= quality.LEAST_TEXTS:
                    break
            for c, spread in zip(names, quality.SPREAD, strict=True):
                v = sorted(step(x, c) for x in own)
                low, mid, high = (v[math.ceil(q * len(v)) - 1] for q in (0.25, 0.5, 0.75))
                least = max(spread / 2 ** (r["cls"] / 2), quality.LEAST_BYTES if c == "byte_share" else 0)
                off = (r[c] - mid) / max((high - low) / 1.349, least)
                ok = ok and off <= (math.inf if c == "entropy" else far) and off >= (-math.inf if c == "byte_share" else -far)
        yield r["kept"], ok, r


@pytest.mark.parametrize("which", ["sf0.01", "odd", "two rows"])
def test_verdicts(request, spark, which):
    """Against bands from sorted lists; every row meets one, in a table of two rows too. How the rows are dealt changes nothing."""
    if which == "sf0.01":
        df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    else:
        df = request.getfixturevalue("odd")
        df = df if which == "odd" else df.filter("doc_id IN (7, 10)")
    texts = df.select("doc_id", "text", "lang").collect()
    own = Counter(r.doc_id for r in texts)
    known = {r.doc_id: r for r in texts}
    got = [r.asDict() for r in quality.rules(df).collect()]
    assert len(got) == len(texts)
    if which != "odd":  # where ids are their own
        rows = [g | {"text": known[g["doc_id"]].text, "lang": known[g["doc_id"]].lang} for g in got]
        assert max(own.values()) == 1
        assert all(a == b for a, b, _ in plain_verdicts(rows))
    again = quality.rules(df.repartition(7)).collect()
    assert by_id((r["doc_id"], r["n_words"], r["kept"]) for r in got) == by_id((r.doc_id, r.n_words, r.kept) for r in again)


def test_copies_do_not_narrow_the_bands(spark, documents):
    """A text with a third of all rows, half of its kind, changes nothing for the others."""
    rng = random.Random(8)
    vocabulary = sorted({w for r in documents.filter("lang = 'en'").collect() for w in re.findall("[a-z]{2,}", r.text or "")}, key=lambda w: (len(w), w))

    def text(n, i):
        return " ".join(rng.choices(vocabulary[i : len(vocabulary) - 120 + i], k=n))

    rows = [(k * 120 + i, text(n, i), "en") for k, n in enumerate((130, 500)) for i in range(120)]
    schema = "doc_id long, text string, lang string"
    without = {r.doc_id: r.kept for r in quality.rules(spark.createDataFrame(rows, schema)).collect()}
    assert sum(without.values()) > 230
    copies = [(1000 + i, rows[60][1], "en") for i in range(120)]
    got = {r.doc_id: r.kept for r in quality.rules(spark.createDataFrame(rows + copies, schema)).collect()}
    assert {i: got[i] for i in without} == without
    assert all(got[i] == without[60] for i, _, _ in copies)


# ---- 10


def plain_table(shards, slots):
    """Each shard's whole order of preference first, then turns."""
    number = lambda name, salt: int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8, key=salt.encode()).digest(), "little")
    orders = [[(number(s, "offset") + k * (number(s, "skip") % (slots - 1) + 1)) % slots for k in range(slots)] for s in shards]
    assert all(sorted(o) == list(range(slots)) for o in orders)
    owner = {}
    while len(owner) < slots:
        for k, order in enumerate(orders):
            if len(owner) < slots:
                owner[next(x for x in order if x not in owner)] = k
    return [owner[x] for x in range(slots)]


def test_the_table_is_filled_by_turns():
    for shards, slots in ((["a"], 2), (["a", "b", "c"], 101), ([f"s{i}" for i in range(20)], 211)):
        assert sharding.lookup_table(shards, slots) == plain_table(shards, slots)


def test_shards(odd):
    shards = [f"s{i}" for i in range(7)]
    owner = sharding.lookup_table(shards, 1009)
    n = Counter(owner)
    assert max(n.values()) - min(n.values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6) < 0.15 * 1009
    rows = sharding.place(odd, shards, slots=1009).collect()
    assert len(rows) == odd.count()
    assert all(r.shard == shards[owner[r.slot]] for r in rows)
    assert len({(r.doc_id, r.slot) for r in rows if r.doc_id is not None}) == len({r.doc_id for r in rows if r.doc_id is not None})
    with pytest.raises(ValueError, match="prime"):
        sharding.lookup_table(shards, 1000)


# ---- empty tables


def test_no_rows_give_no_rows(none):
    for f in (mixing.mix, mixing.mix_rows, exact_dedup.deduplicate, packing.pack_documents, suffix_dedup.cleaned, ngram_join.join, quality.rules, sharding.place):
        assert f(none).collect() == []
