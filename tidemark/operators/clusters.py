"""Clusters of coverage by gaps, their consensus, timelines and the watchlist."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring, text

STAGES = ("linked", "talks", "bid", "advanced", "agreed", "medical", "official")


def gap_clusters(rows: DataFrame, days: int = 5) -> DataFrame:
    """rows (club, player, published_at, claim_id, prediction_scope, ...) with `cluster_no` from 1 in time order. A row joins
    the cluster before it when fewer than days + 1 days lie between. Clusters without a direct row are dropped."""
    by = Window.partitionBy("club", "player").orderBy("published_at", "claim_id")
    seconds = F.unix_micros("published_at")
    gap = seconds - F.lag(seconds).over(by)
    usable = rows.where("published_at is not null and coalesce(player, '') <> '' and coalesce(club, '') <> ''")
    new = F.when(gap.isNull() | (gap >= (days + 1) * 86_400_000_000), 1).otherwise(0)
    found = usable.withColumn("_new", new).withColumn("cluster_no", F.sum("_new").over(by)).drop("_new")
    direct = F.max((F.col("prediction_scope") == "direct").cast("int")).over(Window.partitionBy("club", "player", "cluster_no"))
    return found.withColumn("_direct", direct).where("_direct = 1").drop("_direct")


KEYS = ["club", "player", "cluster_no"]


def _votes(rows: DataFrame, column: str, extra=None) -> DataFrame:
    """Counts of a column's values per cluster, and an optional aggregate."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([extra.alias("x")] if extra is not None else [])
    return rows.where(f"coalesce({column}, '') <> ''").groupBy(*KEYS, column).agg(*aggs)


def consensus(clusters: DataFrame) -> DataFrame:
    """One row per cluster. clusters: KEYS, claim_id, published_at, title, source, direction, rumor_stage, prediction_scope,
    credibility, stage_score."""
    rows = clusters.withColumns({"fingerprint": text.fingerprint(F.col("title")), "direct": F.col("prediction_scope") == "direct"})
    base = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("articles"),
        F.count_if("direct").alias("direct_articles"),
        F.countDistinct("source").alias("sources"),
        F.countDistinct("fingerprint").alias("headlines"),
        F.max("credibility").alias("credibility"),
        F.max("stage_score").alias("stage_score"),
        F.min("published_at").alias("first_seen"),
        F.max("published_at").alias("last_seen"),
    )
    # Majority vote; of equal votes `unclear` loses, then the earlier name wins.
    d = _votes(rows, "direction").groupBy(*KEYS).agg(F.min_by("direction", F.struct(-F.col("n"), (F.col("direction") == "unclear"), "direction")).alias("direction"), (F.max("n") / F.sum("n")).alias("direction_share"))
    s = _votes(rows, "rumor_stage", F.max("stage_score")).groupBy(*KEYS).agg(F.min_by("rumor_stage", F.struct(-(F.col("n") + F.col("x")), "rumor_stage")).alias("stage"), (F.max("n") / F.sum("n")).alias("stage_share"))
    j = base.join(d, KEYS, "left").join(s, KEYS, "left")
    breadth = F.least(F.col("sources"), F.lit(6))  # the source mix lists six at most
    strength = scoring.rounded(scoring.event_strength(F.col("credibility"), F.col("stage_score"), breadth, F.col("headlines")))
    score = scoring.rounded(scoring.consensus(F.coalesce("direction_share", F.lit(0.0)), F.coalesce("stage_share", F.lit(0.0)), breadth, F.col("direct_articles") / F.col("articles"), F.col("headlines") / F.col("articles")))
    j = j.withColumns({"event_strength": strength, "consensus_score": score, "direction": F.coalesce("direction", F.lit("unclear")), "stage": F.coalesce("stage", F.lit("unclear"))})
    return j.withColumns({"tier": scoring.confidence_tier(F.col("event_strength"), F.col("headlines"), breadth, F.col("direct_articles")), "consensus_label": scoring.consensus_label(F.col("consensus_score")), "span_days": F.floor((F.unix_micros("last_seen") - F.unix_micros("first_seen")) / 86_400_000_000).cast("bigint")})


def stage_timeline(clusters: DataFrame) -> DataFrame:
    """Every stage of the fixed order for every cluster, with articles and sources (0 where it was not seen)."""
    seen = clusters.groupBy(*KEYS, F.col("rumor_stage").alias("stage")).agg(F.count(F.lit(1)).alias("articles"), F.countDistinct("source").alias("sources"), F.max("published_at").alias("last_seen"))
    frame = clusters.select(*KEYS).distinct().select(*KEYS, F.explode(F.array(*map(F.lit, STAGES))).alias("stage"))
    return frame.join(seen.hint("merge"), [*KEYS, "stage"], "left").withColumns({"articles": F.coalesce("articles", F.lit(0)), "sources": F.coalesce("sources", F.lit(0))})


def watchlist(summaries: DataFrame, as_of, days: int = 21, limit: int = 10) -> DataFrame:
    """The latest cluster of each club and player seen in the last `days` days (all clusters if none was), newest first."""
    recent = F.col("last_seen") >= as_of - F.make_dt_interval(F.lit(days))
    newest = summaries.groupBy("club", "player").agg(F.max_by(F.struct(*summaries.columns), "cluster_no").alias("s")).select("s.*").withColumn("recent", recent)
    any_recent = summaries.agg(F.max(recent.cast("int")).alias("any_recent"))
    kept = newest.join(F.broadcast(any_recent)).where(F.col("recent") | (F.col("any_recent") == 0))
    return kept.orderBy(F.desc("last_seen"), "club", "player").limit(limit)
