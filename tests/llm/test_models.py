"""Operators 2, 6 and 9, which learn, and the pipeline."""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import html_text, labelled_pages, language, toxicity

# ---- 2


@pytest.fixture(scope="module")
def model():
    return html_text.default_model()


def test_messages_are_exact(model):
    """Against the sum over all labellings of small trees."""
    page = html_text.parse("<div><p>one<p>two</div><nav><ul><li>x<li>y</ul></nav>")
    index: dict[str, int] = {}
    forest = html_text.Forest.of_pages([page], index, grow=True)
    rng = np.random.default_rng(0)
    own, edge = rng.normal(size=len(page)), rng.normal(size=(2, 2, 2))
    p, _ = html_text.marginals(forest, own, edge)
    weight = np.zeros(len(page))
    total = 0.0
    for y in itertools.product((0, 1), repeat=len(page)):
        s = np.exp(sum(own[i] * y[i] for i in range(len(page))) + sum(edge[forest.kind[i], y[forest.parent[i]], y[i]] for i in range(1, len(page))))
        total += s
        weight += s * np.array(y)
    assert np.allclose(p, weight / total)


def test_unseen_labelled_pages(model):
    pages = labelled_pages.labelled_pages(120, seed=77)
    right = wrong = missed = 0
    for html, content in pages:
        got = {x for x in model.texts([html])[0].split("\n\n") if x}
        right, wrong, missed = right + len(got & content), wrong + len(got - content), missed + len(content - got)
    assert right / (right + wrong) > 0.97
    assert right / (right + missed) > 0.95


def test_pages_of_the_data(spark, sf):
    """These have the article in an element of its own."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|</[a-z]*\Z|<[a-z0-9]*\Z|\Z)", r.html, re.S)[1]
        blocks = [" ".join(html_text.charrefs.unescape(re.sub(r"<[^>]*(?:>|\Z)", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?p>|</?h1>", inner)]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text)


def test_parsing():
    runs = lambda h: [" ".join("".join(x.parts).split()) for x in html_text.parse(h) if x.tag == "#text"]
    assert runs("<p>a<br>b <b>c<p>d</b> e") == ["a b c", "d e"]
    assert runs("x<script>var a='<p>no</p>';</script>y<style>p{}</style>z") == ["xyz"]
    assert runs("<p title='a>b'>t &amp; u &#233;&nbsp;v</p><!-- <p>no --><p>w") == ["t & u é v", "w"]
    assert runs("<ul><li>a<li>b</ul>c<p>d</p") == ["a", "b", "c", "d"]
    assert runs("") == runs("<") [:0] == []
    assert runs("<textarea>no</textarea><select><option>no</select><p hidden>no</p><p>yes") == ["yes"]
    assert runs("<div>" * 3000 + "deep") == ["deep"]
    assert runs('<h1 class="hidden md:block">a</h1><p title="The hidden cost of sleep">b</p><p data-x=hidden>c</p>') == ["a", "b", "c"]
    assert runs("<p hidden=''>no</p><p aria-hidden=true>no</p><p style='color:red; display: none'>no</p><p HIDDEN>no</p><p>a") == ["a"]


#: Written by hand in layouts that neither the data nor the made pages have: what is marked [[so]] is the article.
BY_HAND = [
    """<!doctype html><html><head><title>T</title></head><body><table width=100%><tr><td colspan=2><a href=/>Home</a> | <a href=/n>News</a> | <a href=/s>Sports</a></td></tr>
    <tr><td class=left><b>Links</b><br><a href=1>One</a><br><a href=2>Two</a><br><a href=3>Three</a></td><td class=content><h1>[[Bridge over the river opens after ten years]]</h1>
    <p>[[The new bridge was opened on Monday, ten years after the first stone was laid, and the mayor spoke of a long road.]]</p>
    <p>[[Traffic had been sent through the old town until now, where people had complained about the noise, the dust and the delays.]]</p></td></tr>
    <tr><td colspan=2 class=footer><small>Copyright 2003</small></td></tr></table></body></html>""",
    """<body><div id="page"><div id="masthead"><a href="/">The Daily</a></div><ul class="menu"><li><a href="a">World</a></li><li><a href="b">Business</a></li></ul>
    <div class="post-content"><h2>[[How bread rises]]</h2><p>[[Yeast eats the sugar in the dough and gives off gas, which the gluten holds, so that the loaf grows.]]</p>
    <ul><li>[[Warm water helps the yeast, but hot water kills it, so it should be as warm as your hand.]]</li><li>[[Salt slows it down, and so it is added last, after the flour has been mixed in.]]</li></ul>
    <blockquote>[[A good loaf needs time more than it needs anything else, as my grandmother used to say.]]</blockquote></div>
    <div class="comments"><h3>Comments</h3><p>Great post, thank you so much for sharing this!</p></div><div id="footer"><p>All rights reserved.</p></div></div></body>""",
]


def test_pages_written_by_hand(model):
    for page in BY_HAND:
        want = {" ".join(x.split()) for x in re.findall(r"\[\[(.*?)\]\]", page, re.S)}
        got = {x for x in model.texts([page.replace("[[", "").replace("]]", "")])[0].split("\n\n") if x}
        assert got == want


def test_odd_pages(spark):
    df = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>"), (4, "u", "<article><h1>T</h1><p>" + "Long text. " * 40_000 + "</p></article>"), (4, "u", None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    rows = html_text.extract(df).collect()
    assert sorted(r.n_chars for r in rows) == [0, 0, 0, 0, 3 + 440_000 - 1]
    assert html_text.extract(df.limit(0)).collect() == []


# ---- 6


def test_toxic_words_are_found(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf[:-5]}0.01/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.detect(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.7
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_the_offending_sentence():
    texts = ["a fine day. you are vile. good bye" if i % 2 else "a fine day. you are kind. good bye" for i in range(80)]
    model = toxicity.fit_bags(texts, np.array([i % 2 for i in range(80)]), least=2)
    assert [texts[1][a:b].strip() for a, b, p in model.sentences(texts[1]) if p >= 0.5] == ["you are vile"]
    assert model.score(texts[1]) > 0.5 > model.score(texts[0])
    one = 1.0
    for _, _, p in model.sentences(texts[1]):
        one *= 1 - p
    assert abs(model.score(texts[1]) - (1 - one)) < 1e-9


def test_training_sees_whole_texts(spark):
    """The offending sentence of each toxic text stands behind its first 41,000 characters."""
    calm = ("a fine day with tea and cake by the river " * 82 + ". ") * 12
    assert len(calm) > 41_000
    rows = [(i, calm + ("you are vile." if i % 2 else "you are kind.")) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.detect(docs, marks).collect()
    assert all(r.predicted == r.doc_id % 2 for r in got if r.held_out)
    few = toxicity.fit(docs, marks, chars=100_000)  # two whole texts
    assert isinstance(few, toxicity.ToxicityModel)


def plain_score(model, text):
    """Noisy-or of the sentences, each a sum over the features of its words, one by one."""
    clean = 1.0
    for s in re.split(r"[.!?\n]+", (text or "").lower()):
        if s:
            z = model.bias
            for w in re.findall(r"[^\W\d_]+", s):
                whole = f"^{w}$"
                parts = {whole} | {whole[i : i + n] for n in (4, 5, 6, 7) for i in range(len(whole) - n + 1)}
                z += sum(model.learned.get(x, 0.0) for x in parts)
            clean *= 1 - 1 / (1 + np.exp(-z))
    return 1 - clean


def test_scores_against_a_plain_version(spark, sf, documents):
    labels = spark.read.parquet(f"{sf[:-5]}0.01/labels.parquet")
    train = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    held = language.fold(train.doc_id, 5) == 0
    model = toxicity.fit(train.filter(~held), labels)
    assert model.learned
    want = Counter((r.doc_id, round(plain_score(model, r.text), 6)) for r in train.limit(200).collect())
    got = Counter((r.doc_id, round(model.score(r.text), 6)) for r in train.limit(200).collect())
    assert got == want


def test_odd_toxicity(spark, odd, none):
    labels = spark.createDataFrame([(i, i % 2) for i in range(25)] + [(3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    rows = toxicity.detect(odd, labels, spans=True).collect()
    assert len(rows) == odd.count()
    assert all(r.predicted == 0 and r.score < 1e-4 for r in toxicity.detect(odd, labels.limit(0)).collect())
    assert toxicity.detect(none, labels).collect() == []


# ---- 9


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf[:-5]}0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.98


def plain_buckets(text):
    """Each n-gram of the lower-case text by the hash's definition, one by one."""
    codes, mask = [ord(c) for c in text.lower()], (1 << 64) - 1
    for i in range(len(codes)):
        h = 0
        for k, n in enumerate(language.ORDERS):
            if i + n > len(codes):
                break
            h = (h ^ codes[i + n - 1]) * language.MIX[k] & mask
            h ^= h >> 29
            yield (h * language.MIX[-1 - k] & mask) >> 49


def test_against_a_plain_naive_bayes(spark):
    """Counts, probabilities and predictions of all rows of a table of 200, without samples or matrices."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    seen, prior = {}, Counter()
    for r in rows:
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None:
            prior[r.lang] += 1
            seen.setdefault(r.lang, set()).add(r.text)
    counts = {k: Counter(b for t in ts for b in plain_buckets(t)) for k, ts in seen.items()}
    sums = {k: sum(c.values()) + 0.5 * language.BUCKETS for k, c in counts.items()}
    got = {r.doc_id: r for r in language.identify(docs).collect()}
    for r in rows[:60]:
        grams = Counter(plain_buckets(r.text or ""))
        z = {k: np.log(prior[k] / prior.total()) + sum(n * np.log((counts[k][b] + 0.5) / sums[k]) for b, n in grams.items()) for k in seen}
        best = max(z, key=z.get)
        if any(c.isalpha() for c in r.text or ""):
            assert got[r.doc_id].lang_pred == best
            assert abs(got[r.doc_id].score - 1 / sum(np.exp(x - z[best]) for x in z.values())) < 1e-3


def test_three_hundred_languages(spark):
    """All are learned, rare ones too, and copies of one text don't push out the others of its language."""
    rows = [(i, chr(0x4E00 + 7 * i) * 30 + f" {chr(0x4E01 + 7 * i)}" * 5, f"l{i:03d}") for i in range(300)]
    rows += [(1000 + k, rows[0][1], "l000") for k in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, rows_a_language=20)
    assert len(model.langs) == 300
    assert model.scored([t for _, t, _ in rows[:300]])[0] == [k for _, _, k in rows[:300]]


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "LANGUAGES", 2)
    docs = spark.createDataFrame([(i, "text", f"l{i}") for i in range(3)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs)


def test_odd_languages(odd, none):
    rows = language.identify(odd).collect()
    assert len(rows) == odd.count()
    texts = Counter((r.doc_id, r.text is None or not any(c.isalpha() for c in r.text)) for r in odd.collect())
    assert Counter((r.doc_id, r.lang_pred == "und") for r in rows) == texts
    assert all(0 <= r.score <= 1 for r in rows)
    assert language.identify(none).collect() == []
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", odd.lang.substr(9, 1))).collect()} <= {"und", ""}


def test_pieces_change_nothing(monkeypatch):
    model = language.LanguageModel(["a", "b"], np.random.default_rng(0).normal(size=(language.BUCKETS + 1, 2)).astype(np.float32), np.zeros(2))
    model.log_prob[-1] = 0
    texts = ["some text of a length " * 9, "x", None, "Ünïcode!"]
    whole = model.scored(texts)
    monkeypatch.setattr(language, "AT_ONCE", 30)
    parts = model.scored(texts)
    assert whole[0] == parts[0]


# ---- pipeline


def test_pipeline(spark, sf, documents):
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, docs, sf), "stage")
        assert out.columns == docs.columns
        seen[name] = out
        docs = out
    kept = {n: [r.doc_id for r in x.collect()] for n, x in seen.items()}
    ids = [r.doc_id for r in documents.collect()]
    assert set(kept["language identification"]) <= set(ids)
    norm = {re.sub(r"[\x20\x09-\x0D]", "", r.text) for r in seen["language identification"].collect()}
    assert len(kept["exact deduplication"]) == len(norm)
    from test_rows import plain_components

    held = [(r.doc_id, r.text, r.source) for r in seen["exact deduplication"].collect()]
    assert sorted(kept["n-gram Jaccard join"]) == sorted({c for _, _, c in plain_components(held, 80, 100, 5)})
    assert max(Counter(kept["mixing sources to target weights"]).values()) <= 3
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert Counter(r.doc_id for r in last if r.piece == 0) == Counter(kept["mixing sources to target weights"])
    assert {"sequence_id", "offset", "ids_crc32"} <= set(last[0].asDict())


def test_odd_rows_go_through_the_pipeline(spark, sf, odd, none):
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
    assert docs.count()
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf), "stage")
    assert docs.count() == 0


def test_rows_without_an_id_of_their_own_go_through_the_pipeline(spark, sf):
    """Null and shared ids: of different texts all rows stay, of equal or near ones just that which the operator keeps."""
    import random

    from conftest import words

    rng = random.Random(5)
    texts = [words(rng, 60) for _ in range(9)]
    schema = "doc_id long, text string, source string"
    run = lambda stage, rows: sorted((tuple(r) for r in stage(spark, spark.createDataFrame(rows, schema).repartition(3), sf).collect()), key=repr)
    stay = [(1, texts[0] + " b", "a"), (3, "z" + texts[1], "a"), (None, texts[2], "a"), (None, texts[3], "b"), (None, texts[4], None), (5, texts[5], "a"), (5, texts[6], "b"), (5, texts[7], "b"), (6, texts[8], "b")]
    same = [(3, texts[0] + "b", "a"), (5, texts[0] + "b", "a"), (None, texts[0] + "b", "a"), (None, texts[3], "b"), (5, texts[5], "a"), (None, texts[8], "b")]
    assert run(corpus_pipeline.exact, stay + same) == sorted(stay, key=repr)
    near = [(3, texts[0] + " c", "a"), (5, texts[0] + " d", "a"), (None, texts[0] + " e", "a"), (None, texts[8] + " c", "b")]
    assert run(corpus_pipeline.near, stay + near) == sorted(stay, key=repr)
    either = [(None, texts[2] + " c", "a"), (5, texts[6] + " c", "b")]
    got = run(corpus_pipeline.near, stay + near + either)
    assert sorted(((i, t.removesuffix(" c"), s) for i, t, s in got), key=repr) == sorted(stay, key=repr)
    blank = [(None, None, "a"), (None, "", "a"), (2, " ", "b"), (2, None, "b")]
    assert run(corpus_pipeline.near, blank) == sorted(blank, key=repr)
