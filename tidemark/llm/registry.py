"""The queries of this subpackage for ``__spark_entry__``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup
from .exact_dedup import op3_exact_dedup
from .html_text import op2_html_text
from .language import op9_language
from .mixing import op1_mix
from .ngram_join import op7_ngram_join
from .packing import op4_packing
from .quality import op8_quality
from .sharding import op10_shard
from .suffix_dedup import op5_suffix_dedup
from .toxicity import op6_toxicity


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_html_text, op3_exact_dedup, op4_packing, op5_suffix_dedup, op6_toxicity, op7_ngram_join, op8_quality, op9_language, op10_shard, pipeline)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    out = {"op3_exact_dedup": exact_dedup.SQL}
    if corpus_pipeline.ORACLE_SQL:
        out["pipeline"] = corpus_pipeline.ORACLE_SQL
    return out
