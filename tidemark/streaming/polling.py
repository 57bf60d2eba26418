"""The polling job: what a poll brings is normalised, claims are read from it, and what is stored already is left out.

A batch goes to two tables: articles with a time, and those without one, which no watermark could ever let go. Both are
KeyedTables under the batch's number, so a batch that is repeated, also one that ended between the two, changes nothing.
The stored keys are read anew in every batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import claims, text
from tidemark.operators.imports import ARTICLE_KEY, new_only, normalised_articles, with_article_key
from tidemark.storage import discard, written

from .keyed_table import KeyedTable

SCHEMA = "article_id string, published_at timestamp, source string, journalist string, title string, url string, normalized_url string, club string, player string, snippet string, stage string, transfer_type string, related boolean, fee_eur double, wage_eur double, title_key string, day string"


class Poll:
    """The two tables of a polling job below a folder, and the function for foreachBatch."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        table = lambda name: KeyedTable(spark, f"{path}/{name}", SCHEMA, ARTICLE_KEY, ["article_id"], buckets)
        self.articles, self.undated = table("articles"), table("undated")

    def __call__(self, batch: DataFrame, number: int) -> None:
        arrived = written(extracted(batch), "poll")
        for table, rows in ((self.undated, arrived.where("published_at is null")), (self.articles, arrived.where("published_at is not null"))):
            table.upsert(new_only(rows, table.read(), ARTICLE_KEY), number)
        discard(arrived)


def extracted(rows: DataFrame) -> DataFrame:
    """Landed rows (see normalised_articles) as articles with their key and the claim that they make."""
    a = with_article_key(normalised_articles(rows)).withColumn("player", F.coalesce(F.get("player_candidates", F.lit(0)), F.lit("")))
    said = F.concat_ws(" ", "title", "snippet")
    norm = text.alnum_folded(said)
    fee, wage = claims.fee_and_wage(said)
    a = a.withColumns({"_norm": norm, "fee_eur": fee, "wage_eur": wage})
    a = a.withColumn("_context", claims.has_context(F.col("_norm")))
    a = a.withColumns({"stage": claims.stage(F.col("_norm"), F.col("_context")), "transfer_type": claims.transfer_type(F.col("_norm"), F.col("_context"))})
    a = a.withColumn("related", claims.related(F.col("_norm"), F.col("stage"), F.col("player"), F.col("club"), F.col("_context")))
    return a.select(*(part.split()[0] for part in SCHEMA.split(", ")))
