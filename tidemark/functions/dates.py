"""Date columns: many text formats, seasons, ages and ladders of day distances. `as_of` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_timestamp(c: Column) -> Column:
    """ISO with or without offset, RFC-1123, compact `yyyyMMddTHHmmssZ`, 14 digits, or a date; NULL if none fits."""
    raw = F.trim(c)
    rfc = F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss z"))
    compact = F.try_to_timestamp(F.regexp_replace(raw, "[TZ]", ""), F.lit("yyyyMMddHHmmss"))
    return F.when(raw.rlike(r"^\d{8}T?\d{6}Z?$"), compact).when(raw.rlike("^[A-Za-z]{3},"), rfc).otherwise(F.try_to_timestamp(raw))


def football_date(c: Column) -> Column:
    """dd/MM/yyyy, dd/MM/yy or yyyy-MM-dd."""
    raw = F.trim(c)
    day = lambda f: F.try_to_timestamp(raw, F.lit(f)).cast("date")
    return F.when(raw.rlike(r"^\d{2}/\d{2}/\d{4}$"), day("dd/MM/yyyy")).when(raw.rlike(r"^\d{2}/\d{2}/\d{2}$"), day("dd/MM/yy")).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), day("yyyy-MM-dd"))


def season(d: Column) -> Column:
    """`2023-24` for July 2023 to June 2024."""
    start = F.year(d) - (F.month(d) < 7).cast("int")
    return F.concat(start.cast("string"), F.lit("-"), F.lpad(((start + 1) % 100).cast("string"), 2, "0"))


def season_start(label: Column) -> Column:
    return F.coalesce(F.split_part(label, F.lit("-"), F.lit(1)).try_cast("int"), F.lit(0))


def age_on(born: Column, d: Column) -> Column:
    return F.year(d) - F.year(born) - (F.date_format(d, "MMdd") < F.date_format(born, "MMdd")).cast("int")


def window_proxy(season_label: Column, window: Column) -> Column:
    """1 July of the season's start for summer, 1 January after it for winter."""
    y = season_start(season_label)
    return F.when(F.lower(window) == "winter", F.make_date(y + 1, F.lit(1), F.lit(1))).otherwise(F.make_date(y, F.lit(7), F.lit(1)))


def ladder(value: Column, steps: list[tuple[float, float]], beyond: float, missing: float | None = None) -> Column:
    """The score of the first step whose limit is not below the value."""
    out = None
    for limit, score in steps:
        out = (F.when if out is None else out.when)(value <= limit, score)
    out = out.when(value.isNotNull(), beyond)
    return out if missing is None else out.otherwise(missing)


def proximity(days: Column) -> Column:
    return ladder(days, [(7, 1.0), (30, 0.8), (90, 0.5), (180, 0.2)], 0.0, 0.0)


def confirmation(days: Column) -> Column:
    return ladder(days, [(3, 0.95), (7, 0.85), (30, 0.65), (90, 0.45)], 0.25, 0.5)


def freshness(days: Column) -> Column:
    return ladder(days, [(2, 1.0), (7, 0.76), (14, 0.52), (30, 0.28)], 0.12, 0.0)


def citation_freshness(days: Column) -> Column:
    return ladder(days, [(14, 1.0), (45, 0.76), (120, 0.55), (365, 0.34)], 0.18, 0.45)


def recency(days: Column) -> Column:
    return F.when(days < 0, 0.03).otherwise(ladder(days, [(14, 0.35), (60, 0.22), (365, 0.10)], 0.0, 0.0))


def in_window(ts: Column, first: Column, last: Column) -> Column:
    """Inside, or without a readable date."""
    return ts.isNull() | ts.between(first, last)


def canonical_season(label: Column, year: Column | None = None) -> Column:
    """`2023-24` from `2023/24`, `23/24`, `2023/2024` or `2023-24`; other labels take the season that starts in `year`, if given."""
    raw, pattern = F.trim(label), r"^(\d{2}|\d{4})[/-](\d{2}|\d{4})$"
    # A bound variable, so that each pattern is matched once for a row.
    years = F.struct(F.regexp_extract(raw, pattern, 1).alias("a"), F.regexp_extract(raw, pattern, 2).alias("b"))
    named = lambda y: F.when(y["a"] != "", F.concat(F.when(F.char_length(y["a"]) == 2, F.concat(F.lit("20"), y["a"])).otherwise(y["a"]), F.lit("-"), F.right(y["b"], F.lit(2))))
    found = F.get(F.transform(F.array(years), named), F.lit(0))
    if year is None:
        return F.coalesce(found, raw)
    start_of = year.try_cast("int")
    named = F.concat(start_of.cast("string"), F.lit("-"), F.lpad(((start_of + 1) % 100).cast("string"), 2, "0"))
    return F.coalesce(found, named, raw)


def season_in_range(label: Column, first: Column, last: Column) -> Column:
    low, high = season_start(first).cast("bigint"), season_start(last).cast("bigint")
    # Between the two; the label stands there once, as a filter that is pushed down repeats what makes it.
    return F.abs(2 * season_start(label).cast("bigint") - (low + high)) <= high - low


def league_code(label: Column) -> Column:
    """`2324` for `2023-24`."""
    return F.concat(F.substring(label, 3, 2), F.right(label, F.lit(2)))
