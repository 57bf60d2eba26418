"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

A stage takes (spark, docs, sf_dir) and returns documents with the same columns, the last one packed pieces. Other columns go
through unchanged. Null texts count as empty, are `und`, and so go in the first stage; an empty table gives an empty table;
very long texts are read whole. Of rows that tie or repeat in every column one stays where a stage keeps one of a group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import written
from tidemark.llm.exact_dedup import one_of_each_text
from tidemark.llm.language_id import fit, held_out, identify
from tidemark.llm.packing import pack
from tidemark.llm.simhash_dedup import one_of_each_group
from tidemark.llm.substring_dedup import substring_dedup

#: Documents whose best language has less than this share of the corrected counts are rejected, as are `und` ones.
LEAST_SHARE = 0.3


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    model = fit(docs.where(~held_out(2, 4)).select("text", "lang"))
    found = identify(docs.select("text", F.struct(*docs.columns).alias("row")), model, ("row",))
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE)).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each distinct text."""
    return one_of_each_text(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each_group(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without their repeated word windows; n_chars follows the text."""
    others = {c: f"x{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "n_chars")}
    inner = docs.select("doc_id", "text", *(F.col(c).alias(x) for c, x in others.items()))
    cut = substring_dedup(inner, texts=True, carry=tuple(others.values()))
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.char_length("kept").cast("bigint")} | {c: F.col(x) for c, x in others.items()}
    return cut.select(*(values[c].alias(c) for c in docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, placed in sequences."""
    return pack(docs)


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("substring_dedup", substrings),
    ("best_fit_packing", packed),
]

#: Language ID and packing are not SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
