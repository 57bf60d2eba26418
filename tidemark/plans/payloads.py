"""Queries over nested payloads: signals written as documents of a season and club, and read back by paths."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import payload
from tidemark.sources import bindings as b
from tidemark.storage import shared_dir

from .registry import query
from .sql_bindings import PREDICTIONS


def landed(spark, sf_dir) -> DataFrame:
    """All predictions as landed payloads."""
    p = b.predictions(spark, sf_dir)
    rows = p.select("season", "club", "player", "case_id", F.col("signal_date").alias("day"), F.col("predicted_label").alias("label"), F.round("credibility_score", 4).alias("score"))
    path = f"{shared_dir(spark)}/payloads/{uuid.uuid4().hex}"
    payload.write(payload.documents(rows, b.LABELS, part=200), path)
    return payload.read(spark, path)


@query(
    "payload_signals",
    f"WITH {PREDICTIONS} SELECT season, club, player, case_id, signal_date AS day, predicted_label AS label, round(credibility_score, 4) AS score FROM predictions",
)
def payload_signals(spark, sf_dir):
    """Every signal, as it comes back from the payloads."""
    return payload.signals(landed(spark, sf_dir))


@query(
    "payload_stats",
    f"""WITH {PREDICTIONS} SELECT season, club, count(*) AS signals, round(avg(round(credibility_score, 4)), 6) AS avg_score, count_if(predicted_label = 'positive') AS positive, count(DISTINCT player) AS players
    FROM predictions GROUP BY 1, 2""",
)
def payload_stats(spark, sf_dir):
    """The numbers of each season and club, by their paths, and how many players its documents name."""
    docs = landed(spark, sf_dir)
    paths = {"club": ("$.club", "string"), "signals": ("$.stats.signals", "bigint"), "avg_score": ("$.stats.avg_score", "double"), "positive": ("$.stats.by_label.positive", "bigint"), "p": ("$.players", "variant")}
    top = payload.fields(docs, paths, keep=("season",))
    named = payload.entries(top, "$", ("player", "list"), ("season", "club", "signals", "avg_score", "positive"), of="p")
    return named.groupBy("season", "club", "signals", "avg_score", "positive").agg(F.countDistinct("player").alias("players"))
