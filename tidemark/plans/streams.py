"""Stream jobs run over the events table: as streams (sinks are Parquet in the shared folder) and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import shared_dir
from tidemark.sources.tables import table
from tidemark.streaming import jobs, rings
from tidemark.streaming.keyed_table import KeyedTable, upsert_batches
from tidemark.streaming.polling import Poll

from .registry import query


def _shared(spark) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


def _finished(rows: DataFrame, spark, complete: bool) -> DataFrame:
    """The result of a stream over all files there are. complete: the last state of an aggregate; else appended rows."""
    path = _shared(spark)
    writer = rows.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    if complete:
        writer = writer.outputMode("complete").foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out"))
    else:
        writer = writer.outputMode("append").format("parquet").option("path", f"{path}/out")
    writer.start().awaitTermination()
    schema = rows.schema
    return spark.read.schema(schema).parquet(f"{path}/out")


@query("stream_daily_counts", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, sf_dir):
    return _finished(jobs.daily_counts(jobs.event_stream(spark, sf_dir), "event_type"), spark, True).withColumn("total", F.round("total", 2))


@query("stream_rolling_coverage", "WITH d AS (SELECT CAST(ts AS DATE) AS day, event_type FROM events) SELECT CAST(day + CAST(k AS INTEGER) AS DATE) AS day, event_type, count(*) AS n FROM d, (SELECT unnest(range(1, 22)) AS k) GROUP BY 1, 2")
def stream_rolling_coverage(spark, sf_dir):
    return _finished(jobs.rolling_coverage(jobs.event_stream(spark, sf_dir), "event_type"), spark, True).select("day", "event_type", "n")


@query("stream_reputation", "SELECT user_id, count(*) AS n_claims, count_if(event_type IN ('signup', 'purchase')) AS n_matched, round((count_if(event_type IN ('signup', 'purchase')) + 2.5) / (count(*) + 5), 6) AS smoothed_rate FROM events GROUP BY 1")
def stream_reputation(spark, sf_dir):
    e = jobs.event_stream(spark, sf_dir)
    return _finished(jobs.running_reputation(e, "user_id", F.col("event_type").isin("signup", "purchase")), spark, True).withColumn("smoothed_rate", F.round("smoothed_rate", 6))


@query("stream_first_seen", "SELECT user_id, event_type FROM events GROUP BY 1, 2")
def stream_first_seen(spark, sf_dir):
    """One row per user and type; one batch holds all files."""
    rows = jobs.first_seen(jobs.event_stream(spark, sf_dir), ["user_id", "event_type"], "60 days").select("user_id", "event_type")
    return _finished(rows, spark, False)


@query(
    "stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, count(*) AS n, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark, sf_dir):
    rows = jobs.sessions(jobs.event_stream(spark, sf_dir), ["user_id"], "6 hours")
    return _finished(rows, spark, True).select("user_id", "n", F.unix_micros("first_seen").alias("first_us"), F.unix_micros("last_seen").alias("last_us"))


def _arriving(rows: DataFrame, path: str, batches: int, *order: str) -> DataFrame:
    """Rows landed in `batches` ranges and read as a stream, one range a batch. A range has a file for each core, so that what
    a batch costs is shared. Files are written side by side: a batch can hold some of the range beside its own."""
    files = rows.sparkSession.sparkContext.defaultParallelism
    rows.repartitionByRange(batches * files, *order).write.parquet(f"{path}/landed")
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/landed")


def _run(rows: DataFrame, path: str, sink, mode: str = "append") -> None:
    rows.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()


@query("stream_upsert", "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, epoch_us(arg_max(ts, event_id)) AS at_us FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    """The latest event of each user, upserted batch by batch into a table that is written by buckets of users."""
    path = _shared(spark)
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    latest = KeyedTable(spark, f"{path}/latest", events.schema, ["user_id"], ["event_id"], buckets=16)
    _run(_arriving(events, path, 4, "event_id"), path, upsert_batches(latest))
    return latest.read().select("user_id", "event_id", "event_type", F.unix_micros("at").alias("at_us"))


@query(
    "stream_recent_runs",
    f"SELECT user_id, place, event_id AS run_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= {rings.SIZE}",
)
def stream_recent_runs(spark, sf_dir):
    """The last twenty events of each user, kept as state by a stream and upserted."""
    path = _shared(spark)
    runs = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("run_id"))
    places = KeyedTable(spark, f"{path}/places", f"user_id {dict(runs.dtypes)['user_id']}, place int, {rings.RUN}", ["user_id", "place"], [], buckets=8)
    _run(rings.last_runs(_arriving(runs, path, 2, "run_id"), "user_id"), path, upsert_batches(places), "update")
    return places.read().select("user_id", F.col("place").cast("bigint").alias("place"), "run_id")


@query(
    "polled_articles",
    """WITH h AS (SELECT o_orderkey AS k, o_orderkey % 5 = 0 AS undated, 'https://a.example/' || (o_orderkey % 4000) AS url, o_orderkey % 7 AS form, CAST(o_orderdate AS DATE) AS d FROM orders)
    SELECT normalized_url, title, dated, count(*) AS n FROM (SELECT DISTINCT url AS normalized_url, 'Town ' || (['agree fee for', 'in talks with', 'match report on'])[form % 3 + 1] || ' Player ' || form AS title, NOT undated AS dated, CASE WHEN undated THEN NULL ELSE d END AS day FROM h) GROUP BY 1, 2, 3""",
)
def polled_articles(spark, sf_dir):
    """Articles of three overlapping polls, those without a time in a table of their own: each is stored once."""
    path = _shared(spark)
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    form = k % 7
    said = F.element_at(F.array(*map(F.lit, ("agree fee for", "in talks with", "match report on"))), (form % 3 + 1).cast("int"))
    rows = o.select(
        k.alias("k"),
        F.concat(F.lit("Town "), said, F.lit(" Player "), form).alias("title"),
        F.concat(F.lit("https://a.example/"), k % 4000).alias("url"),
        F.when(k % 5 != 0, F.to_date("o_orderdate").cast("string")).alias("published_at"),
        F.lit("Desk").alias("source"),
        F.lit("Town").alias("club"),
    )
    # Each poll brings what is new and half of what the one before has brought.
    third = F.pmod(F.xxhash64("k"), F.lit(3))
    polls = rows.withColumn("poll", F.explode(F.when(F.col("k") % 2 == 0, F.array(third, third + 1)).otherwise(F.array(third))))
    job = Poll(spark, f"{path}/polls", buckets=8)
    _run(_arriving(polls, path, 4, "poll", "k"), path, job)
    both = job.articles.read().withColumn("dated", F.lit(True)).unionByName(job.undated.read().withColumn("dated", F.lit(False)))
    return both.groupBy("normalized_url", "title", "dated").agg(F.count(F.lit(1)).alias("n"))
