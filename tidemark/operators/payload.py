"""Nested payloads: documents of maps of arrays of structs, written as JSON lines, and read back through VARIANT.

A document holds one season and club: numbers (`stats`), and the signals of each player as a list in order of day and id. A club
with more signals in a season than PART has several documents, numbered from 0, over which its signals are dealt by a digest of
their id, so that no group gathers in one row; its numbers are in each. Keys of a document and of its structs are in
alphabetical order, players too.

A scan takes out the paths that it is asked for and nothing else; what is absent is NULL, so payloads may have other fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import written

#: Signals of a document, about.
PART = 5_000


def documents(signals: DataFrame, labels: tuple[str, ...], part: int = PART) -> DataFrame:
    """signals: season, club, player, case_id, day, label, score. season, club, part and the document as `value`."""
    keys = ["season", "club"]
    counts = F.map_from_arrays(F.array(*(F.lit(x) for x in labels)), F.array(*(F.count_if(F.col("label") == x) for x in labels)))
    stats = signals.groupBy(*keys).agg(F.struct(F.round(F.avg("score"), 6).alias("avg_score"), counts.alias("by_label"), F.count(F.lit(1)).alias("signals")).alias("stats"))
    stats = written(stats, "payload-stats")  # its true size is known, and a very large group can be split
    entry = F.struct("case_id", F.col("day").cast("string").alias("day"), "label", "score")
    rows = _with_stats(signals.select(*keys, "player", "day", "case_id", entry.alias("e")), stats, keys)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("case_id"), F.ceil(F.col("stats.signals") / part)).cast("int"))
    lists = rows.groupBy(*keys, "part", "player").agg(F.array_sort(F.collect_list(F.struct("day", "case_id", "e"))).alias("x"))
    lists = lists.select(*keys, "part", F.coalesce("player", F.lit("")).alias("player"), F.transform("x", lambda x: x["e"]).alias("list"))
    maps = lists.groupBy(*keys, "part").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("player", "list")))).alias("players"))
    body = F.struct("club", "part", "players", "season", "stats")
    return _with_stats(maps, stats, keys).select(*keys, "part", F.to_json(body).alias("value"))


def _with_stats(maps: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    renamed = stats.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return maps.join(renamed.hint("merge"), same).drop(*(f"_{k}" for k in keys))


def write(docs: DataFrame, path: str) -> None:
    """JSON lines, a folder for each season."""
    docs.select("season", "value").write.mode("overwrite").partitionBy("season").text(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """season (of the folder) and the document as VARIANT. A line that is no JSON has none."""
    text = spark.read.schema("value string, season string").text(path)
    return text.select("season", F.try_parse_json("value").alias("doc"))


def fields(docs: DataFrame, paths: dict[str, tuple[str, str]], of: str = "doc", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns `keep`, and name: (path, type) taken out of a VARIANT."""
    return docs.select(*keep, *(F.try_variant_get(of, path, kind).alias(name) for name, (path, kind) in paths.items()))


def entries(docs: DataFrame, path: str, names: tuple[str, str], keep: tuple[str, ...], of: str = "doc") -> DataFrame:
    """A row for each entry of the map or list at a path: keep, its key (or place) and its value as VARIANT."""
    inner = docs.select(*keep, F.try_variant_get(of, path, "variant").alias("_inner"))
    out = inner.lateralJoin(inner.sparkSession.tvf.variant_explode(F.col("_inner").outer()))
    return out.select(*keep, F.coalesce("key", F.col("pos").cast("string")).alias(names[0]), F.col("value").alias(names[1]))


def signals(docs: DataFrame) -> DataFrame:
    """The signals of read payloads: season, club, player, case_id, day, label, score."""
    top = fields(docs, {"club": ("$.club", "string"), "players": ("$.players", "variant")}, keep=("season",))
    each = entries(top, "$", ("player", "list"), ("season", "club"), of="players")
    rows = entries(each, "$", ("place", "row"), ("season", "club", "player"), of="list")
    paths = {"case_id": ("$.case_id", "bigint"), "day": ("$.day", "date"), "label": ("$.label", "string"), "score": ("$.score", "double")}
    return fields(rows, paths, of="row", keep=("season", "club", "player"))
