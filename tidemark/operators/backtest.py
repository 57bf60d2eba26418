"""Signals of strategies, simulated trades, and the figures of a portfolio."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.operators import frames as fr
from tidemark.operators.quantiles import exact_median
from tidemark.storage import written


def strategy_signals(rows: DataFrame, positive: float = 0.40, negative: float = 0.40, credible: float = 0.55) -> DataFrame:
    """Up to one signal per strategy for each row: strategy, side, strength, reason. rows: the fields of sources.bindings.predictions."""
    c = F.col
    score = scoring.blended(c("prob_positive"), c("prob_negative"), c("direction"), c("transfer_indicator"), c("credibility_score"), c("rumor_stage_score"), c("stock_context_indicator"))
    strong = c("rumor_stage").isin(*scoring.STRONG_STAGES)
    up, down = (c("predicted_label") == "positive") & (c("prob_positive") >= positive), (c("predicted_label") == "negative") & (c("prob_negative") >= negative)
    heuristic = 0.55 * c("credibility_score") + 0.30 * c("transfer_indicator") + 0.15 * c("rumor_stage_score")
    reporter = 0.45 * c("credibility_score") + 0.30 * c("journalist_rep") + 0.25 * c("conversion")
    signal = lambda test, strategy, side, strength, reason: F.when(test, F.struct(F.lit(strategy).alias("strategy"), F.lit(side).alias("side"), strength.alias("strength"), F.lit(reason).alias("reason")))
    sure, told = c("credibility_score") >= 0.55, (c("credibility_score") >= credible) & strong
    both = lambda name, long, short, a, b, ra, rb: [signal(long, name, "long", a, ra), signal(short, name, "short", b, rb)]
    r = rows.withColumn("_b", score)
    options = [
        *both("blended_long_short", sure & (c("_b") >= 12), sure & (c("_b") <= -12), c("_b") / 100, -c("_b") / 100, "blended_positive", "blended_negative"),
        signal(up, "model_long_positive", "long", c("prob_positive"), "model_positive"),
        signal(down, "model_short_negative", "short", c("prob_negative"), "model_negative"),
        *both("model_long_short", up, down, c("prob_positive"), c("prob_negative"), "model_positive", "model_negative"),
        *both("model_long_short_strong_stage", up & strong, down & strong, c("prob_positive"), c("prob_negative"), "model_positive_strong_stage", "model_negative_strong_stage"),
        *both("heuristic_long_short", told & (c("direction") == "in"), told & (c("direction") == "out"), heuristic, heuristic, "heuristic_incoming", "heuristic_outgoing"),
        *both("journalist_long_short", (reporter >= credible) & strong & (c("direction") == "in"), (reporter >= credible) & strong & (c("direction") == "out"), reporter, reporter, "journalist_incoming", "journalist_outgoing"),
    ]
    out = r.where("split = 'test'").select("case_id", "club", "player", "signal_date", F.inline(F.array_compact(F.array(*options))))
    return out.withColumn("strength", F.round("strength", 6))


def best_per_day(signals: DataFrame) -> DataFrame:
    """The strongest signal of a strategy, club and day (ties: smallest case_id)."""
    k = F.row_number().over(Window.partitionBy("strategy", "club", "signal_date").orderBy(F.desc("strength"), "case_id"))
    return signals.withColumn("k", k).where("k = 1").drop("k")


def trades(signals: DataFrame, points: DataFrame, hold: int = 3) -> DataFrame:
    """Entry on the first bar after the signal, held for `hold` bars; cut-off trades are dropped. Returns of the trade, the
    market and the abnormal return, with the model as of the entry."""
    alpha, beta, _ = fr.market_model(-120, -1)
    a = F.col("alpha"), F.col("beta")
    p = points.withColumns({"alpha": F.coalesce(alpha, F.lit(0.0)), "beta": F.coalesce(beta, F.lit(1.0)), "_fit": alpha.isNotNull()})
    end = F.lead("date", hold - 1).over(Window.partitionBy("ticker").orderBy("date"))
    held = p.select("ticker", "idx", F.col("date").alias("entry_date"), end.alias("exit_date"), "_fit", fr.compounded("r", 0, hold - 1).alias("_r"), fr.compounded("m", 0, hold - 1).alias("_m"), fr.complete(fr.abnormal(0, hold - 1, *a), 0, hold - 1).alias("_ar"))
    s = fr.as_of(signals.withColumnsRenamed({"club": "ticker", "signal_date": "event_date"}), points, strict=True).where("idx is not null")
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    t = s.join(held, ["ticker", "idx"]).where("_r is not null")
    return t.withColumns({"trade_return": sign * F.col("_r"), "market_return": F.col("_m"), "abnormal_return": sign * F.col("_ar"), "model": F.when(F.col("_fit"), "ols_market_model").otherwise("market_adjusted_fallback")}).drop("_r", "_m", "_ar", "_fit")


def daily(trade_rows: DataFrame, points: DataFrame, hold: int = 3) -> DataFrame:
    """Mean return of the open trades by strategy and day."""
    days = trade_rows.select("strategy", "side", "ticker", F.explode(F.sequence(F.col("idx"), F.col("idx") + hold - 1)).alias("idx"))
    sign = F.when(F.col("side") == "long", 1.0).otherwise(-1.0)
    return days.join(points.select("ticker", "idx", "date", "r").hint("merge"), ["ticker", "idx"]).groupBy("strategy", "date").agg(F.avg(sign * F.col("r")).alias("ret"))


def metrics(trade_rows: DataFrame, daily_rows: DataFrame) -> DataFrame:
    """Figures of each strategy. The Sharpe ratio takes the sample deviation and 365 days; the drawdown starts at the first value."""
    trade_rows = written(trade_rows.select("strategy", "side", "trade_return", "abnormal_return"), "trades")
    t = trade_rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n_trades"),
        F.count_if(F.col("side") == "long").alias("long_trades"),
        F.avg((F.col("trade_return") > 0).cast("int")).alias("win_rate"),
        F.avg("trade_return").alias("avg_trade_return"),
        F.avg("abnormal_return").alias("avg_abnormal_return"),
    )
    by = Window.partitionBy("strategy").orderBy("date")  # a row per strategy and calendar day
    d = daily_rows.withColumn("equity", F.product(1 + F.col("ret")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("down", F.col("equity") / F.max("equity").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    g = d.groupBy("strategy").agg(F.count(F.lit(1)).alias("days"), (F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.lit(365.0))).alias("sharpe"), F.min("down").alias("max_drawdown"), (F.max_by("equity", "date") - 1).alias("total_return"))
    median = exact_median(trade_rows, ["strategy"], "trade_return").withColumnRenamed("median", "median_trade_return")
    return t.join(g, "strategy").join(median.hint("merge"), "strategy", "left").withColumn("turnover", F.col("n_trades") / F.col("days"))
