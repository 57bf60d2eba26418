"""A temporal graph of reporters, sources, players, clubs, stages and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes(rows: DataFrame) -> DataFrame:
    """rows: journalist, source, player, club, stage, label, credibility, score, confidence. weight counts mentions, score is the largest."""
    one = lambda kind, column, score: F.struct(F.concat(F.lit(kind + ":"), F.col(column)).alias("id"), F.lit(kind).alias("type"), F.col(column).alias("label"), F.col(score).alias("score"))
    each = rows.select(F.inline(F.array(one("reporter", "journalist", "credibility"), one("source", "source", "credibility"), one("player", "player", "score"), one("club", "club", "score"), one("stage", "stage", "score"), one("market", "label", "confidence"))))
    return each.groupBy("id", "type", "label").agg(F.count(F.lit(1)).alias("weight"), F.max("score").alias("score"))


def edges(rows: DataFrame) -> DataFrame:
    """Five typed edges per row, summed: weight, largest score, first and last day, up to four texts of evidence."""
    end = lambda kind, column: F.concat(F.lit(kind + ":"), F.col(column))
    one = lambda a, b, kind, score: F.struct(a.alias("source_id"), b.alias("target_id"), kind.alias("type"), F.col(score).alias("score"))
    r, s, p, c = end("reporter", "journalist"), end("source", "source"), end("player", "player"), end("club", "club")
    each = rows.select(
        "day",
        "evidence",
        F.inline(
            F.array(
                one(r, s, F.lit("published_via"), "credibility"),
                one(s, p, F.lit("reported_player"), "credibility"),
                one(p, c, F.concat(F.lit("linked_to_"), F.coalesce("role", F.lit("club"))), "score"),
                one(p, end("stage", "stage"), F.lit("rumor_stage"), "score"),
                one(c, end("market", "label"), F.lit("market_read"), "confidence"),
            )
        ),
    )
    keys = ["source_id", "target_id", "type"]
    base = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("weight"), F.max("score").alias("score"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"))
    # Evidence is cut to four before it is gathered.
    few = each.groupBy(*keys, "evidence").agg(F.lit(1).alias("x")).withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("evidence"))).where("k <= 4")
    texts = few.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("evidence")), "|").alias("evidence"))
    return base.join(texts.hint("merge"), keys)


def timelines(rows: DataFrame, last: int = 8, limit: int = 20) -> DataFrame:
    """Players with clubs by last day and number of events; each with its last stages."""
    by = Window.partitionBy("player", "club").orderBy(F.desc("day"), F.desc("event_id"))
    late = rows.select("player", "club", "day", "event_id", "stage").withColumn("k", F.row_number().over(by)).where(F.col("k") <= last)
    tail = late.groupBy("player", "club").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("k"), "stage"))), lambda x: x["stage"]), "|").alias("stages"))
    base = rows.groupBy("player", "club").agg(F.count(F.lit(1)).alias("event_count"), F.min("day").alias("first_seen"), F.max("day").alias("last_seen"), F.avg("credibility").alias("avg_credibility"))
    return base.orderBy(F.desc("last_seen"), F.desc("event_count"), "player", "club").limit(limit).join(tail.hint("merge"), ["player", "club"])
