"""Exact medians by distributed selection: counts per range of values, then one range. No task sees a group's values whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import discard, written

RANGES = 1024
#: Values of a range that are put in order, at most.
FEW = 50_000


def exact_median(rows: DataFrame, by: list[str], value: str, few: int = FEW, ranges: int = RANGES) -> DataFrame:
    """by and `median` (double) of each group's values that are not NULL or NaN; the mean of the middle two of an even number.

    Each step counts the values of the range that holds the median in `ranges` parts, per task first, and goes on with the
    part that holds it, from its smallest to its largest value, until that is one value or has at most `few`."""
    v = rows.select(*by, F.col(value).cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    span = (F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
    groups = v.groupBy(*by).agg(*span)
    middle = F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)))
    # A row for each of the (one or two) places looked for: its range, and its place among the range's values.
    sought = written(groups.select("*", F.explode(middle).alias("_target")).withColumn("_place", F.col("_target")), "median")
    same = lambda a, b, keys: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    keys = [*by, "_target"]
    while True:
        wide = sought.where((F.col("n") > few) & (F.col("lo") < F.col("hi")))
        if not wide.limit(1).count():
            break
        inside = v.alias("v").join(wide.hint("merge").alias("w"), [*same("v", "w", by), F.col("v._v").between(F.col("w.lo"), F.col("w.hi"))])
        part = F.least(F.floor((F.col("v._v") - F.col("w.lo")) / (F.col("w.hi") - F.col("w.lo")) * ranges), F.lit(ranges - 1))
        counts = inside.groupBy(*(F.col(f"w.{k}").alias(k) for k in keys), F.col("w._place").alias("_place"), part.alias("_part")).agg(*span)
        upto = Window.partitionBy(*keys).orderBy("_part")  # `ranges` rows
        counts = counts.withColumn("_upto", F.sum("n").over(upto))
        hit = counts.where((F.col("_place") <= F.col("_upto")) & (F.col("_place") > F.col("_upto") - F.col("n")))
        narrowed = hit.withColumn("_place", F.col("_place") - (F.col("_upto") - F.col("n"))).select(*sought.columns)
        done = sought.where(~((F.col("n") > few) & (F.col("lo") < F.col("hi"))))
        nxt = written(done.unionByName(narrowed), "median")
        discard(sought)
        sought = nxt
    one = sought.where("lo = hi").select(*keys, F.col("lo").alias("_v"))
    rest = sought.where("lo < hi")
    inside = v.alias("v").join(rest.hint("merge").alias("w"), [*same("v", "w", by), F.col("v._v").between(F.col("w.lo"), F.col("w.hi"))])
    placed = inside.select(*(F.col(f"w.{k}").alias(k) for k in keys), "w._place", "v._v").withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_v")))
    found = one.unionByName(placed.where("_k = _place").select(*keys, "_v"))
    return found.groupBy(*by).agg(F.avg("_v").alias("median"))
