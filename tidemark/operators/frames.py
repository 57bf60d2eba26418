"""Time-series operators over daily bars: returns, complete and clamped frames, market model, as-of lookups.

Every frame is partitioned by ticker and ordered by date, so one shuffle and one sort serve all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import sided, written


def simple_returns(bars: DataFrame, key: str | None = "ticker", name: str = "ret") -> DataFrame:
    """close / previous close - 1; days whose previous close is missing or not positive are dropped. key None: one series,
    of a row per calendar day."""
    w = (Window.partitionBy(key) if key else Window.partitionBy(F.lit(0))).orderBy("date")
    rows = bars.withColumn("_prev", F.lag("close").over(w)).where("_prev > 0")
    return rows.withColumn(name, F.col("close") / F.col("_prev") - 1).drop("_prev")


def aligned(stock: DataFrame, market: DataFrame) -> DataFrame:
    """Days with a return on both sides: ticker, date, closes, volumes, r, m, idx (from 0) and total."""
    s = simple_returns(stock, "ticker", "r").withColumnsRenamed({"close": "stock_close", "volume": "stock_volume"})
    m = simple_returns(market, None, "m").withColumnsRenamed({"close": "market_close", "volume": "market_volume"})
    by = Window.partitionBy("ticker")
    both = s.join(m, "date")
    return both.withColumns({"idx": F.row_number().over(by.orderBy("date")) - 1, "total": F.count(F.lit(1)).over(by)})


def frame(first: int, last: int, order: str = "date"):
    return Window.partitionBy("ticker").orderBy(order).rowsBetween(first, last)


def complete(value: Column, first: int, last: int) -> Column:
    """A frame's value, NULL unless all its rows exist."""
    return F.when(F.count(F.lit(1)).over(frame(first, last)) == last - first + 1, value)


def compounded(column: str, first: int, last: int) -> Column:
    return complete(F.product(1 + F.col(column)).over(frame(first, last)) - 1, first, last)


def spread(column: str, first: int, last: int) -> Column:
    return complete(F.stddev_pop(column).over(frame(first, last)), first, last)


def trailing_z(column: str, back: int, ending: int = 0) -> Column:
    """Score of the value `ending` rows back against the `back` rows before it; 0 if those do not vary."""
    first, last = -back - ending, -1 - ending
    w = frame(first, last)
    now = F.lag(column, ending).over(Window.partitionBy("ticker").orderBy("date")) if ending else F.col(column)
    sd = F.stddev_pop(column).over(w)
    return complete(F.when(sd == 0, 0.0).otherwise((now - F.avg(column).over(w)) / sd), first, last)


def market_model(first: int, last: int, least: int = 20) -> tuple[Column, Column, Column]:
    """alpha, beta and rows of an ordinary regression of r on m over a clamped frame; NULL below `least` rows. A constant m
    gives the mean and 0."""
    w = frame(first, last)
    n = F.count(F.lit(1)).over(w)
    slope = F.coalesce(F.regr_slope("r", "m").over(w), F.lit(0.0))
    alpha = F.coalesce(F.regr_intercept("r", "m").over(w), F.avg("r").over(w))
    return F.when(n >= least, alpha), F.when(n >= least, slope), n


def sums(first: int, last: int) -> tuple[Column, Column, Column]:
    """Sum of r, sum of m and rows of a clamped frame."""
    w = frame(first, last)
    return F.sum("r").over(w), F.sum("m").over(w), F.count(F.lit(1)).over(w)


def abnormal(first: int, last: int, alpha: Column, beta: Column) -> Column:
    """Sum of r - alpha - beta m over a clamped frame, with the current row's alpha and beta."""
    r, m, n = sums(first, last)
    return r - n * alpha - beta * m


def as_of(events: DataFrame, bars: DataFrame, forward: bool = True, strict: bool = False) -> DataFrame:
    """events (ticker, event_date, ...) with `idx` of the first bar on or after the date (strict: after; not forward: the
    last bar before); no date, no bar. bars: ticker, date, idx. Each bar is spread over the calendar days that it answers for,
    up to its neighbour or the end of all bars, so events look their day up and are not gathered by ticker."""
    b = written(bars.select("ticker", "date", "idx"), "as-of-bars")
    ends = b.agg(F.date_sub(F.min("date"), 1).alias("_low"), F.date_add(F.max("date"), 1).alias("_high"))
    by = Window.partitionBy("ticker").orderBy("date")
    if forward:
        late = 1 if strict else 0
        first, last = F.coalesce(F.date_add(F.lag("date").over(by), 1 - late), F.col("_low")), F.date_sub("date", late)
        day = F.greatest("event_date", "_low")
    else:
        first, last = F.date_add("date", 1), F.coalesce(F.lead("date").over(by), F.col("_high"))
        day = F.least("event_date", "_high")
    spans = b.crossJoin(F.broadcast(ends)).select("ticker", "idx", first.alias("_a"), last.alias("_b")).where("_a <= _b")
    days = sided(written(spans.select("ticker", F.explode(F.sequence("_a", "_b")).alias("_day"), "idx"), "as-of-days"))
    e = events.crossJoin(F.broadcast(ends)).withColumn("_day", F.when(F.col("event_date").isNotNull(), day))
    return e.join(days, ["ticker", "_day"], "left").select(*events.columns, "idx")


def impact_label(value: Column, band: float = 0.02) -> Column:
    return F.when(value <= -band, "negative").when(value >= band, "positive").when(value.isNotNull(), "neutral")
