from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `group` string, kept boolean, score double, __src string, size int"


def words(rng: random.Random, n: int, of: int = 400) -> str:
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and long texts, ties, repeated rows, near copies; and columns whose names clash with ours."""
    rng = random.Random(3)
    long = words(rng, 4000)
    base = [words(rng, 60) for _ in range(6)]
    near = [" ".join(w if i != 20 + k else f"x{k}" for i, w in enumerate(base[0].split())) for k in range(5)]
    texts = [None, "", " \n\t", "one", "ONE", "two words", "three short words", *base, *near, base[1], base[1].upper(), base[2].replace(" ", "  "), base[2].replace(" ", ""), long, long + " end", base[3] + " " + base[4], base[4] + " " + base[3], "aaaa" * 300, "é日本 😀\x85\xa0 x\x1cy", "Zm" * 50]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "b", "a", ""][i % 4]) for i, t in enumerate(texts)]
    rows += [rows[8], rows[8], (9, base[5], "en", "a"), (None, base[0], "en", None), (None, None, None, None), (10_000_000_000, base[2], "de", "b")]
    return [(*r, None, "g", True, 0.5, "s", 1) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
