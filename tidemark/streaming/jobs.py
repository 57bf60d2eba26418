"""Structured Streaming forms of the incremental steps: dedupe across polls, sessions, rolling and daily counts, running reputation, upserts.

Each takes a streaming (or static) table with `published_at` as TIMESTAMP and returns a table; sinks and triggers are the caller's.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring

DELAY = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None) -> DataFrame:
    """The events table, one file or a folder of them, as a stream. By default all files there are make one batch, so none of
    their rows is late, however the files are ordered; files_per_batch is for files that arrive in time order."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema)
    if files_per_batch:
        raw = raw.option("maxFilesPerTrigger", files_per_batch)
    # A pattern, since the stream's source takes a single file by pattern only.
    return raw.parquet(f"{sf_dir}/[e]vents.parquet").withColumn("published_at", F.col("ts").cast("timestamp"))


def dated(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with an event time, rows without): the latter go to a side table, they never expire in a watermark."""
    return rows.where("published_at is not null"), rows.where("published_at is null")


def first_seen(rows: DataFrame, keys: list[str], delay: str = DELAY) -> DataFrame:
    """Rows whose key was not seen before within the watermark."""
    return rows.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(keys)


def daily_counts(rows: DataFrame, key: str, delay: str = DELAY) -> DataFrame:
    day = F.window("published_at", "1 day")
    g = rows.withWatermark("published_at", delay).groupBy(day.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.to_date("w.start").alias("day"), key, "n", "total")


def rolling_coverage(rows: DataFrame, key: str, days: int = 21, delay: str = DELAY) -> DataFrame:
    """Counts over the last `days` days, every day."""
    w = F.window("published_at", f"{days} days", "1 day")
    g = rows.withWatermark("published_at", delay).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("latest"))
    return g.select(F.to_date("w.end").alias("day"), key, "n", "latest")


def sessions(rows: DataFrame, keys: list[str], gap: str = "6 days", delay: str = DELAY) -> DataFrame:
    """Clusters of arriving rows by gap. A session ends when a full gap has passed; rows exactly a gap apart stay together."""
    w = F.session_window("published_at", gap)
    g = rows.withWatermark("published_at", delay).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.min("published_at").alias("first_seen"), F.max("published_at").alias("last_seen"))
    return g.select(*keys, "first_seen", "last_seen", "n")


def running_reputation(rows: DataFrame, key: str, matched) -> DataFrame:
    """Smoothed match rate of each key so far (complete or update mode)."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n_claims"), F.count_if(matched).alias("n_matched"))
    return g.withColumn("smoothed_rate", scoring.smoothed(F.col("n_matched"), F.col("n_claims"), 0.5))


def to_memory(rows: DataFrame, name: str, mode: str, checkpoint: str, timeout: int = 300) -> DataFrame:
    """Run a stream over what is there now and return its result as a table (tests and small reports)."""
    q = rows.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(timeout)
    return rows.sparkSession.table(name)
