"""Queries over scored cases: splits, classifiers, evaluation, back-tests."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import backtest as bt
from tidemark.operators import learning as ln
from tidemark.operators import neighbours as nb
from tidemark.sources import bindings as b
from tidemark.sources.tables import table

from .market import points
from .registry import query
from .sql_bindings import MARKET, PREDICTIONS


@query(
    "temporal_split_counts",
    f"""WITH {PREDICTIONS}, s AS (SELECT CASE WHEN case_id % 6 = 0 THEN 'intelligence_only' WHEN case_id % 5 <> 0 AND CAST(split_part(season, '-', 1) AS INTEGER) <= 1998 THEN 'train' WHEN case_id % 5 <> 0 THEN 'test' WHEN CAST(split_part(season, '-', 1) AS INTEGER) > 1998 THEN 'live_unlabeled' ELSE 'unlabeled' END AS split FROM predictions)
    SELECT split, count(*) AS n FROM s GROUP BY 1""",
)
def temporal_split_counts(spark, sf_dir):
    p = b.predictions(spark, sf_dir)
    rows = p.select(F.when(F.col("case_id") % 6 == 0, "none").otherwise("direct").alias("prediction_scope"), F.split_part("season", F.lit("-"), F.lit(1)).cast("int").alias("season_start"), F.when(F.col("case_id") % 5 != 0, F.col("actual_label")).otherwise("").alias("label"))
    return ln.split_of(rows, 1998).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query(
    "chronological_split",
    f"""WITH {PREDICTIONS}, k AS (SELECT case_id, signal_date, row_number() OVER (ORDER BY signal_date, case_id) AS k, count(*) OVER () AS total FROM predictions)
    SELECT part, count(*) AS n, min(signal_date) AS first_date, max(signal_date) AS last_date FROM (SELECT *, CASE WHEN total < 30 OR k <= least(greatest(floor(total * 0.8), total - 12), total - 12) THEN 'fit' ELSE 'validate' END AS part FROM k) GROUP BY 1""",
)
def chronological_split(spark, sf_dir):
    rows = ln.chronological(b.predictions(spark, sf_dir).select("case_id", "signal_date"), ["signal_date", "case_id"])
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("signal_date").alias("first_date"), F.max("signal_date").alias("last_date"))


@query("class_weights", f"WITH {PREDICTIONS} SELECT actual_label AS label, count(*) AS n, round(sum(count(*)) OVER () / (3 * count(*)), 6) AS weight FROM predictions WHERE split <> 'test' GROUP BY 1")
def class_weights(spark, sf_dir):
    rows = b.predictions(spark, sf_dir).where("split <> 'test'").select(F.col("actual_label").alias("label"))
    return ln.class_weights(rows).withColumn("weight", F.round("weight", 6))


_OWN = "CASE actual_label WHEN 'negative' THEN prob_negative WHEN 'neutral' THEN prob_neutral ELSE prob_positive END"


@query(
    "classifier_metrics",
    f"""WITH {PREDICTIONS}, l AS (SELECT unnest(['negative', 'neutral', 'positive']) AS lab), f AS (SELECT lab, 2 * count_if(actual_label = lab AND predicted_label = lab) / (count_if(actual_label = lab) + count_if(predicted_label = lab)) AS f1 FROM predictions, l WHERE split = 'test' GROUP BY lab)
    SELECT count(*) AS n, round(avg(CAST(actual_label = predicted_label AS INTEGER)), 4) AS accuracy, (SELECT round(avg(f1), 4) FROM f) AS macro_f1, round(avg(-ln(greatest({_OWN} / (prob_negative + prob_neutral + prob_positive), 1e-15))), 6) AS log_loss,
      round(avg(pow(prob_negative - CAST(actual_label = 'negative' AS INTEGER), 2) + pow(prob_neutral - CAST(actual_label = 'neutral' AS INTEGER), 2) + pow(prob_positive - CAST(actual_label = 'positive' AS INTEGER), 2)), 6) AS brier FROM predictions WHERE split = 'test'""",
)
def classifier_metrics(spark, sf_dir):
    e = ln.evaluation(b.predictions(spark, sf_dir).where("split = 'test'"))
    return e.select("n", *(F.round(c, d).alias(c) for c, d in (("accuracy", 4), ("macro_f1", 4), ("log_loss", 6), ("brier", 6))))


@query("confusion_matrix", f"WITH {PREDICTIONS} SELECT actual_label, count_if(predicted_label = 'negative') AS negative, count_if(predicted_label = 'neutral') AS neutral, count_if(predicted_label = 'positive') AS positive FROM predictions GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return ln.confusion(b.predictions(spark, sf_dir))


@query("calibration", f"WITH {PREDICTIONS} SELECT CAST(least(floor(prediction_confidence * 5), 4) AS BIGINT) AS bin, count(*) AS n, round(avg(prediction_confidence) + 1e-9, 4) AS avg_confidence, round(avg(CAST(actual_label = predicted_label AS INTEGER)) + 1e-9, 4) AS accuracy FROM predictions GROUP BY 1")
def calibration(spark, sf_dir):
    return ln.calibration(b.predictions(spark, sf_dir)).withColumns({c: F.round(F.col(c) + 1e-9, 4) for c in ("avg_confidence", "accuracy")})


def vectors(spark, sf_dir):
    """Labelled vectors with all their components."""
    e = table(spark, sf_dir, "embeddings").where("label is not null")
    return e.select("vec_id", F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 4).alias("g"))


_V = "vx AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS x, vec_id % 4 AS g FROM embeddings WHERE label IS NOT NULL)"
_PLACES = "SELECT {keep}, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM {rows}"


@query(
    "nb_predictions",
    f"""WITH {_V}, tr AS (SELECT * FROM vx WHERE vec_id % 5 <> 0), cn AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
    st AS (SELECT label, i, avg(v) AS m, greatest(stddev_pop(v), 1e-4) AS s FROM ({_PLACES.format(keep='label', rows='tr')}) GROUP BY label, i),
    gc AS (SELECT label, g, count(*) AS c FROM tr GROUP BY 1, 2), tot AS (SELECT sum(n) AS total, count(*) AS classes FROM cn),
    ll AS (SELECT p.vec_id, st.label, sum(-0.5 * ln(2 * pi() * s * s) - pow(v - m, 2) / (2 * s * s)) AS ll FROM ({_PLACES.format(keep='vec_id', rows='vx')}) p JOIN st USING (i) GROUP BY 1, 2),
    sc AS (SELECT ll.vec_id, ll.label, ln((n + 1) / (total + classes)) + ll + ln((coalesce(c, 0) + 1) / (n + (SELECT count(DISTINCT g) FROM tr))) AS score
      FROM ll JOIN cn ON cn.label = ll.label JOIN vx ON vx.vec_id = ll.vec_id CROSS JOIN tot LEFT JOIN gc ON gc.label = ll.label AND gc.g = vx.g),
    mx AS (SELECT vec_id, arg_max(label, score) AS predicted, max(score) AS top FROM sc GROUP BY 1)
    SELECT vec_id, predicted, round(1 / sum(exp(score - top)), 4) AS confidence FROM sc JOIN mx USING (vec_id) GROUP BY vec_id, predicted""",
)
def nb_predictions(spark, sf_dir):
    v = vectors(spark, sf_dir)
    out = ln.naive_bayes(v.where("vec_id % 5 <> 0"), v, "x", ["g"], "vec_id", "label")
    return out.withColumn("confidence", F.round("confidence", 4))


@query(
    "knn_predictions",
    f"""WITH {_V}, tr AS (SELECT * FROM vx WHERE vec_id % 5 <> 0),
    bd AS (SELECT list(w ORDER BY i) AS w FROM (SELECT i, max(v) - min(v) AS w FROM ({_PLACES.format(keep='vec_id', rows='tr')}) GROUP BY i)),
    d AS (SELECT q.vec_id AS q, t.vec_id, t.label, round(sqrt(list_sum(list_transform(list_zip(q.x, t.x, bd.w), lambda z: pow((z[1] - z[2]) / z[3], 2))) + CASE WHEN q.g = t.g THEN 0 ELSE 1 END), 8) AS dist FROM vx q, tr t, bd WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, vec_id) AS k FROM d), v AS (SELECT q, label, count(*) AS votes, min(k) AS best FROM r WHERE k <= 5 GROUP BY 1, 2)
    SELECT q AS vec_id, arg_min(label, (-votes, best)) AS predicted, round(max(votes) / 5, 4) AS confidence FROM v GROUP BY q""",
)
def knn_predictions(spark, sf_dir):
    """Votes of the five nearest vectors for a stated query set (ids divisible by 50)."""
    v = vectors(spark, sf_dir)
    train = v.where("vec_id % 5 <> 0")
    near, _ = nb.nearest(train, v.where("vec_id % 50 = 0"), "x", ["g"], "vec_id", 5)
    votes = near.join(train.select("vec_id", "label").hint("merge"), "vec_id").groupBy("q", "label").agg(F.count(F.lit(1)).alias("votes"), F.min("rank").alias("best"))
    return votes.groupBy(F.col("q").alias("vec_id")).agg(F.min_by("label", F.struct(-F.col("votes"), "best")).alias("predicted"), F.round(F.max("votes") / 5, 4).alias("confidence"))


def _fit(spark, sf_dir, classifier):
    v = vectors(spark, sf_dir).withColumn("label", F.col("label").cast("double"))
    weights = v.where("vec_id % 5 <> 0").groupBy("label").agg((1000.0 / F.count(F.lit(1))).alias("w"))
    train = v.where("vec_id % 5 <> 0").join(F.broadcast(weights), "label")
    raw = lambda rows: rows.withColumn("raw", array_to_vector("x"))
    stages = [StandardScaler(inputCol="raw", outputCol="features", withMean=True), classifier]
    scored = Pipeline(stages=stages).fit(raw(train)).transform(raw(v.where("vec_id % 5 = 0")))
    return scored.select("vec_id", F.col("label").cast("int").alias("actual"), F.col("prediction").cast("int").alias("predicted"), F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"))


@query("logistic_predictions")
def logistic_predictions(spark, sf_dir):
    """Scaled multinomial logistic regression with balanced weights, on held-out rows."""
    return _fit(spark, sf_dir, LogisticRegression(family="multinomial", weightCol="w", maxIter=20, regParam=0.01))


@query("forest_predictions")
def forest_predictions(spark, sf_dir):
    """A forest stands for boosted trees, which Spark has for two classes only."""
    return _fit(spark, sf_dir, RandomForestClassifier(weightCol="w", numTrees=20, maxDepth=5, seed=7))


_B = "round(greatest(-1, least(1, 0.45 * (prob_positive - prob_negative) + 0.20e0 * CASE direction WHEN 'in' THEN 1 WHEN 'out' THEN -1 ELSE 0 END * transfer_indicator + 0.15e0 * 2 * (credibility_score - 0.5) + 0.10e0 * 2 * (rumor_stage_score - 0.5) + 0.10e0 * 2 * (stock_context_indicator - 0.5))) * 100, 2)"
_STRONG = "rumor_stage IN ('advanced', 'agreed', 'medical', 'official')"
_UP, _DOWN = "predicted_label = 'positive' AND prob_positive >= 0.40", "predicted_label = 'negative' AND prob_negative >= 0.40"
_HEUR = "0.55 * credibility_score + 0.30 * transfer_indicator + 0.15 * rumor_stage_score"
_REPO = "0.45 * credibility_score + 0.30 * journalist_rep + 0.25 * conversion"


def _both(name, long, short, a, c, ra, rb):
    return [f"SELECT '{name}', case_id, club, signal_date, 'long', round({a}, 6), '{ra}' FROM te WHERE {long}", f"SELECT '{name}', case_id, club, signal_date, 'short', round({c}, 6), '{rb}' FROM te WHERE {short}"]


_SIGNALS = f"""{PREDICTIONS}, te AS (SELECT *, {_B} AS bl FROM predictions WHERE split = 'test'), sig(strategy, case_id, club, signal_date, side, strength, reason) AS (""" + " UNION ALL ".join(
    [
        *_both("blended_long_short", "credibility_score >= 0.55 AND bl >= 12", "credibility_score >= 0.55 AND bl <= -12", "bl / 100", "-bl / 100", "blended_positive", "blended_negative"),
        f"SELECT 'model_long_positive', case_id, club, signal_date, 'long', round(prob_positive, 6), 'model_positive' FROM te WHERE {_UP}",
        f"SELECT 'model_short_negative', case_id, club, signal_date, 'short', round(prob_negative, 6), 'model_negative' FROM te WHERE {_DOWN}",
        *_both("model_long_short", _UP, _DOWN, "prob_positive", "prob_negative", "model_positive", "model_negative"),
        *_both("model_long_short_strong_stage", f"{_UP} AND {_STRONG}", f"{_DOWN} AND {_STRONG}", "prob_positive", "prob_negative", "model_positive_strong_stage", "model_negative_strong_stage"),
        *_both("heuristic_long_short", f"credibility_score >= 0.55 AND {_STRONG} AND direction = 'in'", f"credibility_score >= 0.55 AND {_STRONG} AND direction = 'out'", _HEUR, _HEUR, "heuristic_incoming", "heuristic_outgoing"),
        *_both("journalist_long_short", f"{_REPO} >= 0.55 AND {_STRONG} AND direction = 'in'", f"{_REPO} >= 0.55 AND {_STRONG} AND direction = 'out'", _REPO, _REPO, "journalist_incoming", "journalist_outgoing"),
    ]
) + "), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY strategy, club, signal_date ORDER BY strength DESC, case_id) AS k FROM sig) WHERE k = 1)"


@query("strategy_signals", f"WITH {_SIGNALS} SELECT strategy, case_id, club, signal_date, side, strength, reason FROM best")
def strategy_signals(spark, sf_dir):
    s = bt.best_per_day(bt.strategy_signals(b.predictions(spark, sf_dir)))
    return s.select("strategy", "case_id", "club", "signal_date", "side", "strength", "reason")


def _trades(spark, sf_dir):
    p = points(spark, sf_dir)
    return bt.trades(bt.best_per_day(bt.strategy_signals(b.predictions(spark, sf_dir))), p), p


_W = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)"
_E = "OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)"
_TRADES = f"""{MARKET}, {_SIGNALS}, mo AS (SELECT *, CASE WHEN count(*) {_E} >= 20 THEN coalesce(regr_intercept(r, m) {_E}, avg(r) {_E}) ELSE 0 END AS alpha, CASE WHEN count(*) {_E} >= 20 THEN coalesce(regr_slope(r, m) {_E}, 0) ELSE 1 END AS beta FROM aligned),
he AS (SELECT ticker, date, idx, lead(date, 2) OVER (PARTITION BY ticker ORDER BY date) AS exit_date, product(1 + r) {_W} - 1 AS tr, product(1 + m) {_W} - 1 AS mk, sum(r) {_W} - 3 * alpha - beta * sum(m) {_W} AS ar FROM mo),
trades AS (SELECT s.*, h.ticker, h.idx, h.date AS entry_date, h.exit_date, CASE WHEN side = 'long' THEN 1 ELSE -1 END * tr AS trade_return, mk AS market_return, CASE WHEN side = 'long' THEN 1 ELSE -1 END * ar AS abnormal_return
  FROM best s ASOF JOIN he h ON s.club = h.ticker AND h.date > s.signal_date WHERE h.exit_date IS NOT NULL)"""


@query("backtest_trades", f"WITH {_TRADES} SELECT strategy, case_id, ticker, side, entry_date, exit_date, round(trade_return, 6) AS trade_return, round(market_return, 6) AS market_return, round(abnormal_return, 6) AS abnormal_return FROM trades")
def backtest_trades(spark, sf_dir):
    t, _ = _trades(spark, sf_dir)
    return t.select("strategy", "case_id", "ticker", "side", "entry_date", "exit_date", *(F.round(c, 6).alias(c) for c in ("trade_return", "market_return", "abnormal_return")))


@query(
    "backtest_metrics",
    f"""WITH {_TRADES}, dy AS (SELECT strategy, a.date, avg(CASE WHEN side = 'long' THEN 1 ELSE -1 END * a.r) AS ret FROM trades t JOIN aligned a ON a.ticker = t.ticker AND a.idx BETWEEN t.idx AND t.idx + 2 GROUP BY 1, 2),
    eq AS (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) AS equity FROM dy), dn AS (SELECT *, equity / max(equity) OVER (PARTITION BY strategy ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS down FROM eq),
    g AS (SELECT strategy, count(*) AS days, avg(ret) / stddev_samp(ret) * sqrt(365) AS sharpe, min(down) AS max_drawdown, arg_max(equity, date) - 1 AS total_return FROM dn GROUP BY 1),
    t AS (SELECT strategy, count(*) AS n_trades, count_if(side = 'long') AS long_trades, avg(CAST(trade_return > 0 AS INTEGER)) AS win_rate, avg(trade_return) AS avg_trade_return, median(trade_return) AS median_trade_return, avg(abnormal_return) AS avg_abnormal_return FROM trades GROUP BY 1)
    SELECT strategy, n_trades, long_trades, days, round(win_rate, 4) AS win_rate, round(avg_trade_return, 6) AS avg_trade_return, round(median_trade_return, 6) AS median_trade_return, round(avg_abnormal_return, 6) AS avg_abnormal_return, round(sharpe, 4) AS sharpe, round(max_drawdown, 6) AS max_drawdown, round(total_return, 4) AS total_return FROM t JOIN g USING (strategy)""",
)
def backtest_metrics(spark, sf_dir):
    t, p = _trades(spark, sf_dir)
    m = bt.metrics(t, bt.daily(t, p))
    digits = {"win_rate": 4, "avg_trade_return": 6, "median_trade_return": 6, "avg_abnormal_return": 6, "sharpe": 4, "max_drawdown": 6, "total_return": 4}
    return m.select("strategy", "n_trades", "long_trades", "days", *(F.round(c, d).alias(c) for c, d in digits.items()))
