"""Line dedup with overlapping windows of three lines.

Definition: lines are what `\\n` separates (null text: one empty line). Every three consecutive lines of a document are a
window (fewer lines: no window). Of equal windows in the corpus the first occurrence stays: smallest doc_id (null last),
then smallest row key, then smallest line number. The lines that any later occurrence covers go; covered positions are
merged before cutting, and windows are judged on the input. What is kept is joined by `\\n`.

Rows equal in doc_id and text count as one place and keep the same lines. An empty table gives an empty result. Other
columns are ignored. A document of very many lines is one row of arrays, walked once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, written

LINES = 3


def line_windows(rows: DataFrame, lines: int = LINES) -> DataFrame:
    """r1, r2, doc_id, at, h1, h2 of each window."""
    parts = rows.select("r1", "r2", "doc_id", F.split("text", "\n", -1).alias("l")).where(F.size("l") >= lines)
    texts = F.transform(F.sequence(F.lit(1), F.size("l") - (lines - 1)), lambda i: F.concat_ws("\n", F.slice("l", i, lines)))
    each = parts.select("r1", "r2", "doc_id", F.posexplode(texts).alias("at", "w"))
    return each.select("r1", "r2", "doc_id", "at", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"))


def line_dedup(docs: DataFrame, lines: int = LINES, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed, kept_sha256 and, if `texts`, kept."""
    rows = keyed(docs)
    windows = line_windows(rows, lines)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "at")
    first = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1")
    # Written out, so that the join reads it from an exchange of its own and Spark can split a very frequent window.
    first = written(first.select("h1", "h2", "first"), "line-firsts")
    later = windows.join(first.hint("merge"), ["h1", "h2"]).where(place != F.col("first"))
    cuts = written(later.groupBy("r1", "r2").agg(F.array_sort(F.collect_set("at")).alias("cuts")), "line-cuts")
    named = rows.join(cuts.hint("merge"), ["r1", "r2"], "left")
    named = named.withColumns({"l": F.split("text", "\n", -1), "cuts": F.coalesce("cuts", F.array().cast("array<int>"))})
    # The cut windows are sorted and equally wide, so what they cover up to the next one ends with the last of them: merged,
    # they leave the lines between the end of each window and the start of the next. One walk, whatever the number of cuts.
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("cuts", i - 1) + lines)
    until = lambda i: F.coalesce(F.get("cuts", i), F.size("l"))
    between = lambda i: F.slice("l", start(i) + 1, F.greatest(F.lit(0), until(i) - start(i)))
    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("cuts")), between))
    named = named.withColumn("k", F.when(F.size("cuts") == 0, F.col("l")).otherwise(kept))
    body = F.array_join("k", "\n")
    out = [F.col("doc_id"), F.size("l").cast("bigint").alias("n_lines"), (F.size("l") - F.size("k")).cast("bigint").alias("n_removed"), F.sha2(body, 256).alias("kept_sha256")]
    return named.select(*out, *([body.alias("kept")] if texts else []))


ORACLE_SQL = r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, i - 1 AS pos, array_to_string(l[i:i + 2], chr(10)) AS w
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS i FROM l WHERE len(l) >= 3)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY w ORDER BY doc_id, pos) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, pos + d AS line FROM later, (SELECT unnest([0, 1, 2]) AS d)),
lines AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS line FROM l),
kept AS (
  SELECT doc_id, count(*) AS n_lines, count(g.line) AS n_removed,
         sha256(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (WHERE g.line IS NULL), '')) AS kept_sha256
  FROM lines LEFT JOIN gone g USING (doc_id, line) GROUP BY doc_id)
SELECT doc_id, n_lines, n_removed, kept_sha256 FROM kept
"""
