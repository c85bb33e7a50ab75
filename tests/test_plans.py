"""The plans that queries should get."""

from __future__ import annotations

from tidemark.queries import QUERIES


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, sf):
    text = plan(QUERIES["tpch_q6"](spark, sf))
    assert "PushedFilters: [IsNotNull" in text
    assert "l_comment" not in text
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate" in text


def test_top_k_does_not_sort_everything(spark, sf):
    assert "TakeOrderedAndProject" in plan(QUERIES["topk"](spark, sf))


def test_no_python_in_the_corpus(spark, sf):
    for name in ("vec_topk", "doc_pipeline", "ts_line_protocol", "fn_truncate", "kv_zrange"):
        assert "Python" not in plan(QUERIES[name](spark, sf))


def test_latest_is_combined_before_the_shuffle(spark, sf):
    text = plan(QUERIES["df_latest_by_key"](spark, sf))
    assert "partial_max" in text
    assert "Window" not in text
