"""Registered queries of the training-data operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import best_position as _lexical
from . import embedding_dedup as _embedding
from . import exact_dedup as _exact
from . import kd_search as _kd
from . import line_dedup as _line
from . import spelling as _spelling
from . import substring_dedup as _substring
from .language_id import language_id
from .packing import pack
from .sentencepiece_codec import encode
from .simhash_dedup import simhash_groups
from .suffix_array_dedup import suffix_array_dedup
from .toxicity import toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embedding.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _line.line_dedup(table(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substring.substring_dedup(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kd.kd_topk(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spelling.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = (
    op1_suffix_array_dedup,
    op2_embedding_dedup,
    op3_language_id,
    op4_line_dedup,
    op5_simhash_dedup,
    op6_toxicity,
    op7_best_fit_packing,
    op8_substring_dedup,
    op9_exact_dedup,
    op10_sentencepiece,
    op11_ranked_search,
    op12_exact_topk,
    op13_spelling_variants,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_embedding_dedup": _embedding.ORACLE_SQL,
        "op4_line_dedup": _line.ORACLE_SQL,
        "op8_substring_dedup": _substring.ORACLE_SQL,
        "op9_exact_dedup": _exact.ORACLE_SQL,
        "op11_ranked_search": _lexical.ORACLE_SQL,
        "op12_exact_topk": _kd.ORACLE_SQL,
        "op13_spelling_variants": _spelling.ORACLE_SQL,
    }
