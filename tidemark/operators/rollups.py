"""Roll-ups of signals, moves and claims: histories with outcomes, extremes, freshness, reporters, trust edges, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import frames as fr
from tidemark.operators.cases import SAME_CLUB, closeness
from tidemark.operators.near_in_time import NEVER, candidates
from tidemark.storage import sided, written


def transfer_history(targets: DataFrame, points: DataFrame, outcomes: DataFrame, as_of: Column) -> DataFrame:
    """Moves of direct scope up to a day that are no returns of loans, with the trading day on or after them, the abnormal
    return from there and its label. targets: ticker, event_date, prediction_scope, transfer_type (if known) and others;
    points: ticker, date, idx; outcomes: ticker, idx, trading_date, car."""
    rows = targets.where((F.col("prediction_scope") == "direct") & (F.col("event_date") <= as_of))
    if "transfer_type" in rows.columns:
        rows = rows.where(F.coalesce("transfer_type", F.lit("")) != "loan_return")
    found = fr.as_of(rows, points).join(sided(written(outcomes, "history-outcomes")), ["ticker", "idx"], "left")
    return found.withColumn("label", fr.impact_label(F.col("car")))


def season_summary(rows: DataFrame) -> DataFrame:
    """Moves, moves with an outcome, mean abnormal return and share of positive outcomes by season."""
    return rows.groupBy("season").agg(
        F.count(F.lit(1)).alias("transfer_count"),
        F.count("label").alias("realized_count"),
        F.round(F.coalesce(F.avg("car"), F.lit(0.0)), 6).alias("avg_car"),
        F.round(F.coalesce(F.count_if(F.col("label") == "positive") / F.nullif(F.count("label"), F.lit(0)), F.lit(0.0)), 4).alias("positive_share"),
    )


def most_reactive(rows: DataFrame, value: str, least_rows: int = 12) -> DataFrame:
    """The club with the largest mean absolute value among those with enough rows."""
    g = rows.where(F.col(value).isNotNull()).groupBy("club").agg(F.round(F.avg(F.abs(value)), 6).alias(f"avg_abs_{value}"), F.count(F.lit(1)).alias("n_rows"))
    return g.where(F.col("n_rows") >= least_rows).orderBy(F.desc(f"avg_abs_{value}"), "club").limit(1)


def extremes(rows: DataFrame, keys: list[str], value: str, key: str) -> DataFrame:
    """The rows with the largest and smallest value of each group and of all (keys NULL); ties by the smaller key."""
    return rows.rollup(*keys).agg(
        F.max_by(key, F.struct(value, -F.col(key))).alias("best_case"), F.min_by(key, F.struct(value, key)).alias("worst_case"), F.max(value).alias("best"), F.min(value).alias("worst")
    )


def freshness(rows: DataFrame, as_of: Column, days: int) -> DataFrame:
    """One row: latest day, its age, whether it is older than the window, and the rows inside the window."""
    recent = F.col("published_at").cast("timestamp") >= as_of - F.make_dt_interval(F.lit(days))
    m = rows.agg(F.to_date(F.max("published_at")).alias("latest_day"), F.count_if(recent).alias("recent_count"))
    age = F.datediff(as_of, F.col("latest_day"))
    return m.select("latest_day", age.cast("bigint").alias("days_stale"), F.lit(days).alias("window_days"), (age > days).alias("is_stale"), "recent_count")


def listed_top(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """The k most frequent values of each key as one text, `value:n|...`."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), value))).where(F.col("r") <= k)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", value, "n"))), lambda x: F.concat_ws(":", x[value], x["n"])), "|")
    return top.groupBy(key).agg(texts.alias(f"{value}s"))


def reporter_pages(claims: DataFrame, clubs: int = 6, sources: int = 6, latest: int = 8) -> DataFrame:
    """Each reporter's claims, mean score, smoothed rate, most frequent clubs and outlets, and latest claims. claims:
    journalist, club, source, claim_id, published_at, matched, match_score."""
    base = claims.groupBy("journalist").agg(
        F.count(F.lit(1)).alias("n_claims"), F.round(F.avg("match_score"), 4).alias("avg_score"), F.round(scoring.smoothed(F.count_if("matched"), F.count(F.lit(1)), 0.5), 4).alias("smoothed_rate")
    )
    late = claims.select("journalist", "claim_id", "published_at").withColumn("r", F.row_number().over(Window.partitionBy("journalist").orderBy(F.desc("published_at"), F.desc("claim_id")))).where(F.col("r") <= latest)
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "claim_id"))), lambda x: x["claim_id"].cast("string")), "|")
    out = base
    for part in (listed_top(claims, "journalist", "club", clubs), listed_top(claims, "journalist", "source", sources), late.groupBy("journalist").agg(texts.alias("latest"))):
        out = out.join(part.hint("merge"), "journalist")
    return out


def trust_edges(claims: DataFrame, reporters: int = 8, sources: int = 2, clubs: int = 3) -> DataFrame:
    """Edges from the best reporters to their most frequent outlets, and from the first of these to the clubs they cover."""
    rate = scoring.smoothed(F.count_if("matched"), F.count(F.lit(1)), 0.5)
    best = claims.groupBy("journalist").agg(F.count(F.lit(1)).alias("n_claims"), rate.alias("score")).orderBy(F.desc("score"), F.desc("n_claims"), "journalist").limit(reporters)
    rows = claims.join(best.hint("merge"), "journalist", "left_semi")

    def ranked(value: str) -> DataFrame:
        n = rows.groupBy("journalist", value).agg(F.count(F.lit(1)).alias("weight"))
        return n.withColumn("r", F.row_number().over(Window.partitionBy("journalist").orderBy(F.desc("weight"), value)))

    via = best.join(ranked("source").hint("merge"), "journalist")
    node = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c))
    first = via.where("r = 1").select("journalist", "source")
    told = via.where(F.col("r") <= sources).select(node("reporter", "journalist").alias("source_id"), node("source", "source").alias("target_id"), F.lit("reported via").alias("kind"), "weight", "score")
    covered = best.join(ranked("club").where(F.col("r") <= clubs).hint("merge"), "journalist").join(first.hint("merge"), "journalist")
    return told.unionByName(covered.select(node("source", "source").alias("source_id"), node("club", "club").alias("target_id"), F.lit("covers").alias("kind"), "weight", "score"))


def counts_by(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Rows by each value of each dimension, in one pass: dimension, value, n."""
    sets = rows.groupingSets([[d] for d in dimensions], *dimensions).agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    size = len(dimensions)
    name = value = None
    for i, d in enumerate(dimensions):
        mask = (1 << size) - 1 - (1 << (size - 1 - i))  # a bit is set where a column is not grouped by
        test = F.col("_g") == mask
        name = F.when(test, d) if name is None else name.when(test, d)
        value = F.when(test, F.col(d).cast("string")) if value is None else value.when(test, F.col(d).cast("string"))
    return sets.select(name.alias("dimension"), value.alias("value"), "n")


def ranked_top(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows in an order, with their place. Spark cuts to k before it numbers them."""
    top = rows.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint"))


def view(signals: DataFrame, club: str | None, term: str, fields: list[str], sort: str, limit: int) -> DataFrame:
    """Signals of a club (all clubs if None) whose fields hold a term, the latest or the strongest first."""
    text = F.lower(F.concat_ws(" ", *fields))
    rows = signals.where(F.contains(text, F.lit(term.strip().lower())))
    if club is not None:
        rows = rows.where(F.col("club") == club)
    order = [F.desc("signal_date"), F.col("case_id")] if sort == "latest" else [F.desc(F.abs("blended")), F.desc("signal_date"), F.col("case_id")]
    return ranked_top(rows, order, limit)


def with_best_link(signals: DataFrame, moves: DataFrame) -> DataFrame:
    """Signals (club, player, day, ...) with the confirmed move (deal_id, line, date, market_value_eur) of their player that lies
    nearest; signals without one stay. Moves over a year away tie: of these the first by deal counts. Only the neighbours of
    a signal in its player's calendar and the player's first move are looked at."""
    tie = ["deal_id", "line", "market_value_eur"]
    m = moves.where("player is not null").select(F.col("player").alias("m_player"), F.coalesce("date", F.lit(NEVER).cast("date")).alias("m_day"), *tie)
    asked = written(signals.select("player", "day").where("player is not null and day is not null").distinct(), "watched")
    near = candidates(asked, m, [["player"]], 1, tie)
    first = m.groupBy("m_player").agg(F.min(F.struct(*tie, "m_day")).alias("f")).select("m_player", "f.*")
    far = asked.join(written(first, "first-moves").hint("merge"), F.col("player") == F.col("m_player")).select(*near.columns)
    scored = near.unionByName(far).withColumn("score", F.round(SAME_CLUB + closeness(F.col("m_day"), F.col("day")), 6))
    best = scored.groupBy("player", "day").agg(F.min_by(F.struct("deal_id", "score"), F.struct(-F.col("score"), *tie)).alias("b"))
    return signals.join(written(best.select("player", "day", "b.*"), "best-links").hint("merge"), ["player", "day"], "left")
