"""Queries over price bars: returns, market model, abnormal returns around events, paths and markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import frames as fr
from tidemark.sources import bindings as b
from tidemark.sources.tables import table
from tidemark.storage import sided

from .registry import query
from .sql_bindings import MARKET

PRE = (1, 3, 5, 10, 20, 30)
POST = (1, 3, 5, 10)


def points(spark, sf_dir) -> DataFrame:
    return fr.aligned(b.stock_bars(spark, sf_dir), b.market_bars(spark, sf_dir))


@query("daily_returns", f"WITH {MARKET} SELECT ticker, date, round(close / prev - 1, 6) AS ret FROM sr WHERE prev > 0")
def daily_returns(spark, sf_dir):
    return fr.simple_returns(b.stock_bars(spark, sf_dir)).select("ticker", "date", F.round("ret", 6).alias("ret"))


@query("aligned_points", f"WITH {MARKET} SELECT ticker, date, idx, total, stock_volume, market_volume, round(r, 6) AS r, round(m, 6) AS m FROM aligned")
def aligned_points(spark, sf_dir):
    return points(spark, sf_dir).select("ticker", "date", F.col("idx").cast("bigint").alias("idx"), "total", "stock_volume", "market_volume", F.round("r", 6).alias("r"), F.round("m", 6).alias("m"))


def _model_sql(first: int, last: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {-first} PRECEDING AND {-last} PRECEDING)"
    return f"""fit AS (SELECT *, CASE WHEN count(*) {w} >= 20 THEN coalesce(regr_intercept(r, m) {w}, avg(r) {w}) END AS alpha,
      CASE WHEN count(*) {w} >= 20 THEN coalesce(regr_slope(r, m) {w}, 0) END AS beta, count(*) {w} AS n FROM aligned)"""


@query("market_model", f"WITH {MARKET}, {_model_sql(-125, -6)} SELECT ticker, date, n, round(coalesce(alpha, 0), 6) AS alpha, round(coalesce(beta, 1), 6) AS beta, CASE WHEN alpha IS NULL THEN 'limited_history' ELSE 'ok' END AS status FROM fit")
def market_model(spark, sf_dir):
    alpha, beta, n = fr.market_model(-125, -6)
    return points(spark, sf_dir).select(
        "ticker", "date", n.alias("n"), F.round(F.coalesce(alpha, F.lit(0.0)), 6).alias("alpha"), F.round(F.coalesce(beta, F.lit(1.0)), 6).alias("beta"), F.when(alpha.isNull(), "limited_history").otherwise("ok").alias("status")
    )


CAR_WINDOWS = ((-1, 1), (0, 1), (0, 3), (0, 7))


def _rows(first: int, last: int) -> str:
    side = lambda n: "CURRENT ROW" if n == 0 else f"{-n} PRECEDING" if n < 0 else f"{n} FOLLOWING"
    return f"OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN {side(first)} AND {side(last)})"


def _car_name(first: int, last: int) -> str:
    return f"car_{'m' if first < 0 else ''}{abs(first)}_p{last}"


def _car_sql(first: int, last: int) -> str:
    w = _rows(first, last)
    return f"round(sum(r) {w} - count(*) {w} * alpha - beta * sum(m) {w}, 6) AS {_car_name(first, last)}"


ON_OR_AFTER = "ev ASOF JOIN {t} ON ev.ticker = {t}.ticker AND {t}.date >= ev.event_date"


@query(
    "event_car_windows",
    f"WITH {MARKET}, {_model_sql(-130, -11)}, c AS (SELECT ticker, date, {', '.join(_car_sql(*w) for w in CAR_WINDOWS)} FROM fit) "
    f"SELECT event_id, ev.ticker, c.date AS trading_date, {', '.join(_car_name(*w) for w in CAR_WINDOWS)}, "
    "CASE WHEN car_m1_p1 <= -0.02 THEN 'negative' WHEN car_m1_p1 >= 0.02 THEN 'positive' WHEN car_m1_p1 IS NOT NULL THEN 'neutral' END AS label "
    f"FROM {ON_OR_AFTER.format(t='c')}",
)
def event_car_windows(spark, sf_dir):
    p = points(spark, sf_dir)
    alpha, beta, _ = fr.market_model(-130, -11)
    fitted = p.withColumns({"alpha": alpha, "beta": beta})
    cars = fitted.select("ticker", "idx", F.col("date").alias("trading_date"), *(F.round(fr.abnormal(*w, F.col("alpha"), F.col("beta")), 6).alias(_car_name(*w)) for w in CAR_WINDOWS))
    found = fr.as_of(b.market_events(spark, sf_dir), p).where("idx IS NOT NULL")
    return found.join(cars, ["ticker", "idx"]).select("event_id", "ticker", "trading_date", *(_car_name(*w) for w in CAR_WINDOWS), fr.impact_label(F.col("car_m1_p1")).alias("label"))


def event_features(p: DataFrame) -> DataFrame:
    """The event feature vector of every bar, once: an event then looks its bar up."""
    alpha, beta, n = fr.market_model(-125, -6)
    p = p.withColumns({"n": n, "limited": alpha.isNull(), "alpha": F.coalesce(alpha, F.lit(0.0)), "beta": F.coalesce(beta, F.lit(1.0))})
    a, s = F.col("alpha"), F.col("beta")
    cols = {"pre_window_ok_30d": (F.col("idx") >= 30).cast("int"), "post_window_ok_10d": (F.col("idx") + 10 < F.col("total")).cast("int")}
    for w in PRE:
        cols[f"pre_raw_return_m{w}"] = fr.compounded("r", -w, -1)
        cols[f"pre_market_return_m{w}"] = fr.compounded("m", -w, -1)
        if w <= 10:
            cols[f"pre_abnormal_return_m{w}"] = fr.complete(fr.abnormal(-w, -1, a, s), -w, -1)
    for w in POST:
        cols[f"raw_return_0_p{w}"] = fr.compounded("r", 0, w)
        cols[f"market_return_0_p{w}"] = fr.compounded("m", 0, w)
        cols[f"abnormal_return_0_p{w}"] = fr.complete(fr.abnormal(0, w, a, s), 0, w)
    cols["pre_volatility_20d"], cols["post_volatility_20d"] = fr.spread("r", -20, -1), fr.spread("r", 0, 19)
    for side, ending in (("pre", 1), ("event", 0)):
        cols[f"{side}_close_zscore_20d"] = fr.trailing_z("stock_close", 20, ending)
        cols[f"{side}_volume_zscore_20d"] = fr.trailing_z("stock_volume", 20, ending)
    cols["relative_volume_20d"] = fr.complete(F.col("stock_volume") / F.avg("stock_volume").over(fr.frame(-20, -1)), -20, -1)
    out = p.select("ticker", "date", "idx", "n", "limited", "alpha", "beta", *(c.alias(k) for k, c in cols.items()))
    out = out.withColumn("volatility_shift_20d", F.col("post_volatility_20d") - F.col("pre_volatility_20d"))
    numbers = [f.name for f in out.schema if f.dataType.typeName() == "double"]
    return out.withColumns({c: F.round(c, 6) for c in numbers}).withColumn("target_label_p3", fr.impact_label(F.col("abnormal_return_0_p3")))


def _features_sql() -> str:
    cols = ["CAST(idx >= 30 AS INTEGER) AS pre_window_ok_30d", "CAST(idx + 10 < total AS INTEGER) AS post_window_ok_10d"]

    def whole(x: str, first: int, last: int, name: str) -> None:
        cols.append(f"CASE WHEN count(*) {_rows(first, last)} = {last - first + 1} THEN round({x}, 6) END AS {name}")

    for kind, first, last in [("pre", -w, -1) for w in PRE] + [("post", 0, w) for w in POST]:
        w = _rows(first, last)
        size, pre = (-first if kind == "pre" else last), kind == "pre"
        whole(f"product(1 + r) {w} - 1", first, last, f"pre_raw_return_m{size}" if pre else f"raw_return_0_p{size}")
        whole(f"product(1 + m) {w} - 1", first, last, f"pre_market_return_m{size}" if pre else f"market_return_0_p{size}")
        if size <= 10:
            whole(f"sum(r) {w} - count(*) {w} * a - s * sum(m) {w}", first, last, f"pre_abnormal_return_m{size}" if pre else f"abnormal_return_0_p{size}")
    for name, first, last in (("pre_volatility_20d", -20, -1), ("post_volatility_20d", 0, 19)):
        whole(f"stddev_pop(r) {_rows(first, last)}", first, last, name)
    for side, e in (("pre", 1), ("event", 0)):
        for kind, col in (("close", "stock_close"), ("volume", "stock_volume")):
            w = _rows(-20 - e, -1 - e)
            now = f"lag({col}, {e}) OVER (PARTITION BY ticker ORDER BY date)" if e else col
            whole(f"CASE WHEN stddev_pop({col}) {w} = 0 THEN 0 ELSE ({now} - avg({col}) {w}) / stddev_pop({col}) {w} END", -20 - e, -1 - e, f"{side}_{kind}_zscore_20d")
    whole(f"stock_volume / avg(stock_volume) {_rows(-20, -1)}", -20, -1, "relative_volume_20d")
    return f"""WITH {MARKET}, {_model_sql(-125, -6)}, g AS (SELECT *, coalesce(alpha, 0) AS a, coalesce(beta, 1) AS s FROM fit),
    f AS (SELECT ticker, date, n, alpha IS NULL AS limited, round(a, 6) AS alpha, round(s, 6) AS beta, {', '.join(cols)},
      CASE WHEN count(*) {_rows(-20, -1)} = 20 AND count(*) {_rows(0, 19)} = 20 THEN round(stddev_pop(r) {_rows(0, 19)} - stddev_pop(r) {_rows(-20, -1)}, 6) END AS volatility_shift_20d FROM g)
    SELECT event_id, date_diff('day', event_date, f.date) AS event_trading_offset_days, f.*,
      CASE WHEN abnormal_return_0_p3 <= -0.02 THEN 'negative' WHEN abnormal_return_0_p3 >= 0.02 THEN 'positive' WHEN abnormal_return_0_p3 IS NOT NULL THEN 'neutral' END AS target_label_p3
    FROM {ON_OR_AFTER.format(t='f')}"""


@query("event_feature_vector", _features_sql())
def event_feature_vector(spark, sf_dir):
    p = points(spark, sf_dir)
    found = fr.as_of(b.market_events(spark, sf_dir), p).where("idx IS NOT NULL")
    both = found.join(event_features(p), ["ticker", "idx"])
    return both.withColumn("event_trading_offset_days", F.datediff("date", "event_date").cast("bigint")).drop("idx", "event_date")


@query(
    "impact_labels",
    f"""WITH {MARKET}, {_model_sql(-125, -6)}, c AS (SELECT ticker, date,
      CASE WHEN count(*) {_rows(0, 3)} = 4 THEN sum(r) {_rows(0, 3)} - 4 * coalesce(alpha, 0) - coalesce(beta, 1) * sum(m) {_rows(0, 3)} END AS ar FROM fit),
    e AS (SELECT ev.ticker, ar, CASE WHEN ar <= -0.02 THEN 'negative' WHEN ar >= 0.02 THEN 'positive' ELSE 'neutral' END AS label FROM {ON_OR_AFTER.format(t='c')} WHERE ar IS NOT NULL)
    SELECT ticker, label, count(*) AS n_events, round(avg(ar), 6) AS avg_abnormal_return FROM e GROUP BY 1, 2""",
)
def impact_labels(spark, sf_dir):
    """What was the abnormal return around each event, by ticker and label?"""
    p = points(spark, sf_dir)
    alpha, beta, _ = fr.market_model(-125, -6)
    fitted = p.withColumns({"alpha": F.coalesce(alpha, F.lit(0.0)), "beta": F.coalesce(beta, F.lit(1.0))})
    ar = fitted.select("ticker", "idx", fr.complete(fr.abnormal(0, 3, F.col("alpha"), F.col("beta")), 0, 3).alias("ar"))
    found = fr.as_of(b.market_events(spark, sf_dir), p).where("idx IS NOT NULL")
    labelled = found.join(ar, ["ticker", "idx"]).where("ar IS NOT NULL").withColumn("label", fr.impact_label(F.col("ar")))
    return labelled.groupBy("ticker", "label").agg(F.count(F.lit(1)).alias("n_events"), F.round(F.avg("ar"), 6).alias("avg_abnormal_return"))


def context(bars: DataFrame) -> DataFrame:
    """Of each bar as the last one before an event: returns over up to 7 and 30 bars and the spread of up to 29 returns."""
    by = Window.partitionBy("ticker").orderBy("date")
    ret = F.col("close") / F.lag("close").over(by) - 1
    w = lambda k: by.rowsBetween(1 - k, 0)
    over = lambda k: F.when(F.count(F.lit(1)).over(w(k)) < 2, 0.0).otherwise(F.col("close") / F.first("close").over(w(k)) - 1)
    rows = bars.withColumns({"ret": ret, "idx": F.row_number().over(by) - 1})
    vol = F.when(F.count(F.lit(1)).over(w(30)) < 3, 0.0).otherwise(F.stddev_pop("ret").over(by.rowsBetween(-28, 0)))
    return rows.select("ticker", "date", "idx", over(7).alias("ret7"), over(30).alias("ret30"), vol.alias("vol30"))


def clamp(c):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def stock_context(ret7, ret30, vol30, market30):
    momentum, market, stability = clamp(0.5 + 3.0 * (0.65 * ret7 + 0.35 * ret30)), clamp(0.5 + 2.0 * market30), clamp(1.0 - 12.0 * vol30)
    return clamp(0.45 * momentum + 0.25 * market + 0.30 * stability)


def _context_sql(t: str, part: str) -> str:
    by = f"{part} ORDER BY date ROWS BETWEEN"
    over = lambda k: f"CASE WHEN count(*) OVER ({by} {k - 1} PRECEDING AND CURRENT ROW) < 2 THEN 0 ELSE close / first_value(close) OVER ({by} {k - 1} PRECEDING AND CURRENT ROW) - 1 END"
    return f"""SELECT *, {over(7)} AS ret7, {over(30)} AS ret30, CASE WHEN count(*) OVER ({by} 29 PRECEDING AND CURRENT ROW) < 3 THEN 0
      ELSE stddev_pop(close / prev - 1) OVER ({by} 28 PRECEDING AND CURRENT ROW) END AS vol30 FROM {t}"""


@query(
    "pre_event_context",
    f"""WITH {MARKET}, s AS ({_context_sql('sr', 'PARTITION BY ticker')}), k AS ({_context_sql('mr', '')}),
    e AS (SELECT event_id, ev.ticker, event_date, coalesce(ret7, 0) AS ret7, coalesce(ret30, 0) AS ret30, coalesce(vol30, 0) AS vol30 FROM ev ASOF LEFT JOIN s ON ev.ticker = s.ticker AND ev.event_date > s.date),
    g AS (SELECT e.*, coalesce(k.ret30, 0) AS mk FROM e ASOF LEFT JOIN k ON e.event_date > k.date)
    SELECT event_id, ticker, round(ret7, 6) AS pre_stock_return_7d, round(ret30, 6) AS pre_stock_return_30d, round(vol30, 6) AS pre_stock_volatility_30d, round(mk, 6) AS pre_market_return_30d,
      round(greatest(0, least(1, 0.45 * greatest(0, least(1, 0.5 + 3.0 * (0.65 * ret7 + 0.35 * ret30))) + 0.25 * greatest(0, least(1, 0.5 + 2.0 * mk)) + 0.30 * greatest(0, least(1, 1.0 - 12.0 * vol30)))), 4) AS stock_context FROM g""",
)
def pre_event_context(spark, sf_dir):
    events = b.market_events(spark, sf_dir)
    stock, market = context(b.stock_bars(spark, sf_dir)), context(b.market_bars(spark, sf_dir).withColumn("ticker", F.lit("*")))
    e = fr.as_of(events, stock, forward=False).join(stock.drop("date"), ["ticker", "idx"], "left")
    # The market series has a row per calendar day; each event day is looked up once.
    days = fr.as_of(events.select(F.lit("*").alias("ticker"), "event_date").distinct(), market, forward=False).join(market.select("idx", F.col("ret30").alias("mk")), "idx", "left").select("event_date", "mk")
    zero = {c: F.coalesce(c, F.lit(0.0)) for c in ("ret7", "ret30", "vol30", "mk")}
    e = e.join(days, "event_date", "left").withColumns(zero)
    score = stock_context(F.col("ret7"), F.col("ret30"), F.col("vol30"), F.col("mk"))
    names = {"pre_stock_return_7d": "ret7", "pre_stock_return_30d": "ret30", "pre_stock_volatility_30d": "vol30", "pre_market_return_30d": "mk"}
    return e.select("event_id", "ticker", *(F.round(c, 6).alias(k) for k, c in names.items()), F.round(score, 4).alias("stock_context"))


@query(
    "rebased_paths",
    f"""WITH {MARKET}, e AS (SELECT event_id, ev.ticker, a.idx, a.stock_close FROM ev ASOF JOIN aligned a ON ev.ticker = a.ticker AND a.date >= ev.event_date)
    SELECT e.event_id, p.ticker, p.idx - e.idx AS day, p.date, round(p.stock_close / e.stock_close * 100, 4) AS rebased FROM e JOIN aligned p ON p.ticker = e.ticker AND p.idx BETWEEN e.idx - 20 AND e.idx + 10""",
)
def rebased_paths(spark, sf_dir):
    p = points(spark, sf_dir)
    e = fr.as_of(b.market_events(spark, sf_dir), p).where("idx IS NOT NULL").join(p.select("ticker", "idx", F.col("stock_close").alias("base")), ["ticker", "idx"])
    days = e.select("event_id", "ticker", "base", F.col("idx").alias("at"), F.explode(F.sequence(F.col("idx") - 20, F.col("idx") + 10)).alias("idx"))
    return days.join(p.hint("merge"), ["ticker", "idx"]).select("event_id", "ticker", (F.col("idx") - F.col("at")).cast("bigint").alias("day"), "date", F.round(F.col("stock_close") / F.col("base") * 100, 4).alias("rebased"))


RESULTS = {"R": "L", "A": "W", "N": "D"}


def match_results(spark, sf_dir) -> DataFrame:
    """Per segment and shipping day, the result that most line items stand for (ties: the earlier flag)."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    counts = rows.groupBy(F.col("c_mktsegment").alias("ticker"), F.to_date("l_shipdate").alias("event_date"), "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy("ticker", "event_date").agg(F.min_by("l_returnflag", F.struct(-F.col("n"), "l_returnflag")).alias("flag"))
    return top.select("ticker", "event_date", F.element_at(F.create_map(*(F.lit(x) for kv in RESULTS.items() for x in kv)), F.col("flag")).alias("result"))


@query(
    "path_markers",
    f"""WITH {MARKET}, res AS (SELECT ticker, event_date, CASE flag WHEN 'R' THEN 'L' WHEN 'A' THEN 'W' ELSE 'D' END AS result FROM (
      SELECT c_mktsegment AS ticker, CAST(l_shipdate AS DATE) AS event_date, l_returnflag AS flag, row_number() OVER (PARTITION BY c_mktsegment, CAST(l_shipdate AS DATE) ORDER BY count(*) DESC, l_returnflag) AS k
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) WHERE k = 1),
    tail AS (SELECT ticker, date, idx, round(stock_close / first_value(stock_close) OVER (PARTITION BY ticker ORDER BY date) * 100, 4) AS rebased, min(date) OVER (PARTITION BY ticker) AS since FROM aligned WHERE idx >= total - 160),
    m AS (SELECT t.ticker, t.date, t.rebased, r.result FROM res r ASOF JOIN tail t ON r.ticker = t.ticker AND t.date >= r.event_date WHERE r.event_date >= t.since)
    SELECT ticker, date, rebased, count(*) AS n_markers, count_if(result = 'W') AS wins, count_if(result = 'D') AS draws, count_if(result = 'L') AS losses FROM m GROUP BY 1, 2, 3""",
)
def path_markers(spark, sf_dir):
    p = points(spark, sf_dir).where("idx >= total - 160")
    by = Window.partitionBy("ticker").orderBy("date")
    tail = p.select("ticker", "date", "idx", F.round(F.col("stock_close") / F.first("stock_close").over(by) * 100, 4).alias("rebased"))
    since = tail.groupBy("ticker").agg(F.min("date").alias("since"))
    results = match_results(spark, sf_dir).join(sided(since), "ticker").where("event_date >= since").drop("since")
    marked = fr.as_of(results, tail).where("idx IS NOT NULL").join(tail, ["ticker", "idx"])
    kinds = {"wins": "W", "draws": "D", "losses": "L"}
    return marked.groupBy("ticker", "date", "rebased").agg(F.count(F.lit(1)).alias("n_markers"), *(F.count_if(F.col("result") == v).alias(k) for k, v in kinds.items()))
