"""Exact dedup in three combining steps, with DataFrame functions only.

Definition: null text counts as empty. Two texts are equal when they are identical after deleting every character of
[\\x20\\x09-\\x0D]. Of equal texts the row with the most code points in its original text stays, then the smallest
doc_id (null last).

Steps: (1) each task combines its own rows of equal digest and content, (2) groups of (digest, salt) are merged, (3) the
winners of the salts are combined. The content itself is part of the grouping key in every step, so a group never rests
on a digest alone, and no step sees more rows of a group than there are tasks or salts. Members then look up their
group by two digests.

Rows equal in doc_id and text are copies; one of them stays. An empty table gives an empty result. Extra columns are ignored.
A very long text is one value that every step carries whole. doc_id must be a number: text that is none ends the job in
ANSI mode.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 8
_WIDE = "decimal(38,0)"
_SHIFT = Decimal(10**20)
_NO_ID = Decimal(2**63)  # stands for a null doc_id, above any other


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\f\r", "")


def _place() -> Column:
    """Orders rows of a group: larger is better. Most code points first, then the smallest doc_id."""
    size = F.char_length(F.coalesce("text", F.lit(""))).cast(_WIDE)
    doc = F.coalesce(F.col("doc_id").cast(_WIDE), F.lit(_NO_ID).cast(_WIDE))
    return (size * F.lit(_SHIFT).cast("decimal(21,0)") - doc).cast(_WIDE)


def groups(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per distinct normalised text: digests d1 and d2, group_size and keep_id."""
    text = normalised(F.col("text"))
    size = F.char_length(F.coalesce("text", F.lit("")))
    rows = docs.select(
        F.sha2(text, 256).alias("d1"),
        text.alias("body"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("salt"),
        size.alias("size"),
        _place().alias("place"),
    )
    merge = [F.max("size").alias("size"), F.max("place").alias("place")]
    salted = rows.groupBy("d1", "body", "salt").agg(F.count(F.lit(1)).alias("members"), *merge)
    whole = salted.groupBy("d1", "body").agg(F.sum("members").alias("group_size"), *merge)
    keep = (F.col("size").cast(_WIDE) * F.lit(_SHIFT).cast("decimal(21,0)") - F.col("place")).cast(_WIDE)
    return whole.select("d1", F.xxhash64("body").alias("d2"), "group_size", "size", keep.alias("keep"))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    text = normalised(F.col("text"))
    rows = docs.select(
        "doc_id",
        F.sha2(text, 256).alias("d1"),
        F.xxhash64(text).alias("d2"),
        F.char_length(F.coalesce("text", F.lit(""))).alias("own_size"),
        F.coalesce(F.col("doc_id").cast(_WIDE), F.lit(_NO_ID).cast(_WIDE)).alias("own"),
    )
    # Rows alike in all of this have one result but for `kept`: they are counted, in their tasks first, and numbered at the end.
    alike = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("rows"))
    found = alike.join(groups(docs, salts).hint("merge"), ["d1", "d2"])
    first = (F.col("own") == F.col("keep")) & (F.col("own_size") == F.col("size"))
    found = found.withColumn("turn", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    id_type = dict(docs.dtypes)["doc_id"]
    return found.select(
        "doc_id",
        F.when(F.col("keep") < _NO_ID, F.col("keep").cast(id_type)).alias("keep_id"),
        "group_size",
        (first & (F.col("turn") == 1)).alias("kept"),
        F.col("d1").alias("text_sha256"),
    )


def one_of_each_text(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs, whole, that exact_dedup keeps."""
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("kept_id"), F.char_length(F.coalesce("text", F.lit(""))).alias("size")]
    whole = docs.select(*key, F.sha2(normalised(F.col("text")), 256).alias("d1"), F.struct("*").alias("row"))
    decided = exact_dedup(docs.select("doc_id", "text"), salts).where("kept")
    kept = decided.select(key[0], F.col("text_sha256").alias("d1"))
    # Of rows that share doc_id and content, one stays: the longest. Tasks combine their own such rows before anything moves.
    one = whole.groupBy("kept_id", "d1").agg(F.max_by("row", "size").alias("row"))
    return one.join(kept.hint("merge"), ["kept_id", "d1"], "left_semi").select("row.*")


ORACLE_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS size,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, body,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY size DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
