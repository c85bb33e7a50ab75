from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import documents as doc
from tidemark.operators import stores
from tidemark.streaming import events as ev


def test_document_filters(spark):
    df = spark.createDataFrame([(1, {"a": 5}), (2, None)], "id int, d struct<a:int>")
    assert [r.id for r in doc.find(df, {"d.a": 5}).collect()] == [1]
    assert [r.id for r in doc.find(df, {"d.a": {"$ne": 5}}).collect()] == [2]
    assert [r.id for r in doc.find(df, {"d.a": {"$exists": False}}).collect()] == [2]
    assert [r.id for r in doc.find(df, {"d.a": {"$not": {"$gt": 3}}}).collect()] == [2]
    with pytest.raises(ValueError, match="no such operator"):
        doc.condition({"a": {"$near": 1}})


def test_nested_updates(spark):
    df = spark.createDataFrame([(1, {"a": 5})], "id int, d struct<a:int>")
    assert doc.changed(df, {"id": 1}, {"$inc": {"d.a": 2}}).first()["d"]["a"] == 7


def test_a_match_after_another_stage_sees_that_stage(spark):
    df = spark.range(10)
    assert doc.pipeline(df, [{"$match": {"id": {"$gt": 5}}}, {"$match": {"id": {"$lt": 8}}}, {"$count": "n"}]).first()["n"] == 2


def test_lines(spark):
    lines = spark.createDataFrame([('m,t=x f=1i,s="a b" 5',), ("# no",), ("m f=t",), ("nonsense",)], "value string")
    rows = stores.parse_lines(lines).collect()
    assert len(rows) == 2
    assert (rows[0].measurement, rows[0].tags, rows[0].ts) == ("m", {"t": "x"}, 5)
    assert (rows[1].tags, rows[1].ts) == ({}, None)


def test_cosine_without_length(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 0.0]), ([2.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(stores.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 0.0, 1.0]


def test_negative_ranks(spark):
    df = spark.createDataFrame([("k", str(i), float(i)) for i in range(5)], "key string, member string, score double")
    assert sorted(r.member for r in stores.zrange(df, -2, -1).collect()) == ["3", "4"]


def test_globs():
    assert stores.glob_pattern("a?c*") == "^a.c.*$"


def test_streams_give_the_rows_of_batches(spark, sf):
    path = f"{sf}/events.parquet"
    schema = spark.read.parquet(path).schema
    batch = {tuple(r) for r in ev.tumbling(spark.read.parquet(path)).collect()}
    rows = ev.drain(ev.tumbling(spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*")), "tumbling_test", "complete")
    assert {tuple(r) for r in rows.collect()} == batch


@pytest.mark.parametrize(("codes", "want"), [("%Y-%m-%d", "yyyy-MM-dd"), ("day %d", "'day 'dd"), ("%%", "%"), ("o'c", "'o''c'")])
def test_patterns(codes, want):
    assert S.pattern(codes) == want


def test_bad_dates_are_null(spark):
    df = spark.createDataFrame([("2024-02-30",), ("x",), ("2024/01/02",), ("20240102",)], "s string")
    assert [r[0] is None for r in df.select(S.to_day("s")).collect()] == [True, True, False, False]
