"""The k rows nearest in time to each row, per key, from ordered windows with bounded lists: no pairs are made.

Both sides are reduced first: of the right rows with one key and day only the k first count, and left rows with one key and day
have one answer. A key's window so holds a few rows for each calendar day, however many rows the key has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days that stand for a missing one: of a row before all others, of a question after all others.
NEVER, ALWAYS = "0001-01-01", "9999-12-31"


def nearest_k(left: DataFrame, right: DataFrame, keys: list[str], k: int, tie: list[str]) -> DataFrame:
    """left: keys and `day`, one row each. right: keys, `day` and what else. Returns left with `near`, at most 3 k rows of right
    (structs) with equal keys (NULLs are equal): the k nearest of earlier days, the k nearest of the day itself or later, and
    the k latest of all. Rows of one day are taken in the order of `tie`."""
    others = [c for c in right.columns if c not in keys]
    first = F.row_number().over(Window.partitionBy(*keys, "day").orderBy(*tie))
    number = F.unix_date("day") * 2
    r = right.withColumn("_t", first).where(F.col("_t") <= k).select(*keys, F.struct(*others).alias("_r"), "_t", number.alias("_at"))
    # In both orders the first by tie stands last of its day, next to rows of other days.
    up, down = (Window.partitionBy(*keys).orderBy(way("_at"), F.desc("_t")) for way in (F.asc, F.desc))
    held = lambda order: F.array_compact(F.array("_r", *(F.lag("_r", i).over(order) for i in range(1, k))))
    r = r.withColumns({"_up": held(up), "_down": held(down)}).drop("_r")
    l = left.select(*keys, "day", F.lit(0).alias("_t"), (number - 1).alias("_at"))  # just before the rows of its day
    both = l.unionByName(r, allowMissingColumns=True)
    before = lambda c, order: F.last(c, True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    every = Window.partitionBy(*keys).orderBy("_at", F.desc("_t")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = both.withColumns({"_a": before("_up", up), "_b": before("_down", down), "_c": F.last("_up", True).over(every)}).where("day is not null")
    lists = [F.coalesce(c, F.array().cast(r.schema["_up"].dataType)) for c in ("_a", "_b", "_c")]
    return found.select(*keys, "day", F.array_distinct(F.concat(*lists)).alias("near"))


def candidates(signals: DataFrame, moves: DataFrame, groups: list[list[str]], k: int, tie: list[str]) -> DataFrame:
    """signals (distinct rows with the columns of `groups` and `day`) beside the moves (those columns, `day` and what else, all named
    m_*) that nearest_k finds for any of the groups of key columns; each pair once."""
    found = None
    for keys in groups:
        right = moves.withColumns({c: F.col(f"m_{c}") for c in (*keys, "day")})
        hits = nearest_k(signals.select(*keys, "day").distinct(), right, keys, k, tie)
        hits = hits.select(*(F.col(c).alias(f"_{c}") for c in (*keys, "day")), F.explode("near").alias("_m"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*keys, "day")]
        part = signals.join(hits.hint("merge"), same).select(*signals.columns, *(F.col(f"_m.{c}").alias(c) for c in moves.columns))
        found = part if found is None else found.unionByName(part)
    return found.distinct()
