"""Readers: the given Parquet tables, and the landed file formats that the engine ingests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.storage import sided


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; TIMESTAMP_NTZ columns become TIMESTAMP (session time zone UTC), as watermarks need."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)})


def read_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header (gzip by extension, a folder reads all files); empty fields are NULL."""
    return spark.read.schema(schema).option("nullValue", "").csv(path, header=True)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, whatever the file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


BARS = "date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT"


def read_price_bars(spark: SparkSession, path: str) -> DataFrame:
    """Daily bars; `N/D` is missing, bars without a close are dropped, and a path with nothing there has no bars."""
    if not exists(spark, path):
        return spark.createDataFrame([], BARS)
    return spark.read.schema(BARS).option("nullValue", "N/D").csv(path, header=True).where("close IS NOT NULL")


def read_chart(spark: SparkSession, path: str) -> DataFrame:
    """Chart JSON with parallel arrays (timestamp, open, high, low, close, volume) to bars. Bars without a close are dropped;
    other missing prices take the close."""
    schema = "ticker STRING, timestamp ARRAY<BIGINT>, open ARRAY<DOUBLE>, high ARRAY<DOUBLE>, low ARRAY<DOUBLE>, close ARRAY<DOUBLE>, volume ARRAY<BIGINT>"
    raw = spark.read.schema(schema).json(path, multiLine=True)
    bars = raw.select("ticker", F.inline(F.arrays_zip("timestamp", "open", "high", "low", "close", "volume"))).where("close IS NOT NULL")
    price = {c: F.coalesce(c, "close") for c in ("open", "high", "low")}
    return bars.withColumns({**price, "date": F.to_date(F.timestamp_seconds("timestamp"))}).drop("timestamp")


def read_feed(spark: SparkSession, path: str, per_source: int | None = None, tag: str = "item", first: Column | None = None, last: Column | None = None, story: Callable[[Column], Column] | None = None) -> DataFrame:
    """Landed feed items with alternate tag names: title, url, published_at, source, snippet. tag: item or entry. first, last:
    a window of dates (items without a readable date stay); story: a test of title and snippet. per_source: the newest items
    kept of each source."""
    from tidemark.functions.dates import in_window, parse_timestamp

    kinds = "title STRING, link STRING, guid STRING, id STRING, pubDate STRING, published STRING, updated STRING, source STRING, description STRING, summary STRING"
    raw = spark.read.format("xml").option("rowTag", tag).schema(kinds).load(path)
    items = raw.select("title", F.coalesce("link", "guid", "id").alias("url"), parse_timestamp(F.coalesce("pubDate", "published", "updated")).alias("published_at"), "source", F.coalesce("description", "summary").alias("snippet"))
    if first is not None and last is not None:
        items = items.where(in_window(F.col("published_at"), first, last))
    if story is not None:
        items = items.where(story(F.concat_ws(" ", "title", "snippet")))
    if per_source is None:
        return items
    k = F.row_number().over(Window.partitionBy("source").orderBy(F.desc_nulls_last("published_at"), "url"))
    return items.withColumn("k", k).where(F.col("k") <= per_source).drop("k")


def read_news_json(spark: SparkSession, path: str, lines: bool = False, most: int = 300) -> DataFrame:
    """Landed news service pages (one JSON value a file, or one a line): `articles` unpacked, byline joined to the source, one
    row of a URL kept (the first by title), snippets of at most `most` characters."""
    schema = "articles ARRAY<STRUCT<url: STRING, title: STRING, seendate: STRING, domain: STRING, byline: STRING, body: STRING>>"
    rows = spark.read.schema(schema).json(path, multiLine=not lines).select(F.inline("articles"))
    shaped = rows.select("url", "title", "seendate", F.concat_ws(" / ", "domain", F.nullif("byline", F.lit(""))).alias("source"), F.left("body", F.lit(most)).alias("snippet"))
    return shaped.groupBy("url").agg(F.min(F.struct("title", "seendate", "source", "snippet")).alias("a")).select("url", "a.*")


def read_transfers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined) transfers from a CSV file or folder. direction must be in or out; season, type and loan flag are derived."""
    from tidemark.functions.dates import season

    schema = "date DATE, club STRING, player STRING, direction STRING, from_club STRING, to_club STRING, age DOUBLE, position STRING, market_value_eur DOUBLE, transfer_fee_eur DOUBLE, wage_eur_annual DOUBLE, source STRING, source_url STRING, season STRING, transfer_type STRING, is_loan BOOLEAN"
    rows = read_rows(spark, path, schema)
    kind = F.coalesce("transfer_type", F.when(F.col("is_loan"), "loan").otherwise("permanent"))
    rows = rows.withColumns({"season": F.coalesce("season", season("date")), "transfer_type": kind, "is_loan": F.coalesce("is_loan", kind.contains("loan"))})
    good = F.coalesce(F.col("direction").isin("in", "out") & F.col("date").isNotNull() & F.col("club").isNotNull() & F.col("player").isNotNull(), F.lit(False))
    return rows.where(good), rows.where(~good)


def league_results(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """League rows (Date, HomeTeam, AwayTeam, FTHG, FTAG) to one row per known club: date, club, opponent, venue, goals and result.
    aliases: alias_norm, club."""
    from tidemark.functions.dates import football_date
    from tidemark.functions.text import alnum_ascii

    side = lambda venue, club, other, own, against: F.struct(F.lit(venue).alias("venue"), F.col(club).alias("name"), F.col(other).alias("opponent"), F.col(own).cast("int").alias("goals_for"), F.col(against).cast("int").alias("goals_against"))
    each = rows.select(football_date(F.col("Date")).alias("date"), F.inline(F.array(side("home", "HomeTeam", "AwayTeam", "FTHG", "FTAG"), side("away", "AwayTeam", "HomeTeam", "FTAG", "FTHG"))))
    known = each.join(sided(aliases), alnum_ascii(F.col("name")) == F.col("alias_norm")).where("goals_for IS NOT NULL AND goals_against IS NOT NULL")
    result = F.when(F.col("goals_for") > F.col("goals_against"), "W").when(F.col("goals_for") < F.col("goals_against"), "L").otherwise("D")
    return known.select("date", "club", "opponent", "venue", "goals_for", "goals_against", result.alias("result"), F.format_string("%d-%d", "goals_for", "goals_against").alias("score"))
