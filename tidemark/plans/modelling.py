"""Queries of the model data path: dataset of claims, usable rows, features, baselines, model choice and gated predictions."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.stat import Summarizer
from pyspark.sql import functions as F

from tidemark.operators import learning as ln
from tidemark.operators import modelling as md
from tidemark.operators.boosting import SoftmaxBoosting
from tidemark.sources import bindings as b
from tidemark.sources.tables import table
from tidemark.storage import written

from .cases import _C, _SEASON, listed
from .registry import query
from .sql_bindings import PREDICTIONS, TRANSFERS

TRAIN_END = 1998
NUMERIC = ["credibility_score", "transfer_indicator", "rumor_stage_score", "stock_context_indicator", "journalist_rep", "conversion", "age", "market_value_eur"]
CORE = ["credibility_score", "transfer_indicator", "rumor_stage_score", "age"]
CATEGORICAL = ["club", "direction", "rumor_stage", "target_role"]


def claims_of_orders(spark, sf_dir):
    """Orders as claims about the first move of the order, with scores that follow from the key."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").join(F.broadcast(table(spark, sf_dir, "nation")), k % 25 == F.col("n_nationkey"))
    return o.select(
        k.alias("claim_id"),
        F.when(k % 11 != 0, F.to_date("o_orderdate")).alias("published"),
        (k % 5 != 4).alias("related"),
        F.when(k % 3 != 0, k.cast("string")).when(k % 6 == 0, F.lit("gone")).alias("move_id"),
        F.col("n_name").alias("club"),
        F.concat(F.lit("player "), F.col("o_custkey")).alias("player"),
        F.element_at(F.array(*map(F.lit, ("in", "out", "unclear"))), (k % 7 % 3 + 1).cast("int")).alias("direction"),
        ((k % 101) / 100.0).alias("credibility"),
        F.when(k % 4 != 0, (k % 41) / 40.0).alias("conversion"),
        ((k % 13) / 12.0).alias("stage_score"),
        F.lit(None).cast("double").alias("article_score"),
        ((k % 9) / 8.0).alias("timing_score"),
        ((k % 15) / 10.0).alias("match_score"),
        (k % 10 == 0).alias("ambiguous"),
    )


def first_moves(spark, sf_dir):
    t = b.transfers(spark, sf_dir)
    first = F.min(F.struct("line", "wage_eur_annual", "market_value_eur", "to_id", *(c for c in t.columns if c not in ("deal_id", "line", "wage_eur_annual", "market_value_eur", "to_id"))))
    m = t.groupBy("deal_id").agg(first.alias("m")).select(F.col("deal_id").cast("string").alias("move_id"), "m.*")
    return m.withColumnsRenamed({"market_value_eur": "market_value", "transfer_fee_eur": "fee", "wage_eur_annual": "wage"}).select("move_id", "date", "player", "from_id", "to_id", "direction", "fee", "market_value", "wage", "age", "is_loan")


_DATASET = f"""{TRANSFERS},
cl AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS published, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey WHEN o_orderkey % 6 = 0 THEN -1 END AS move_id, n_name AS club, 'player ' || o_custkey AS player,
    (['in', 'out', 'unclear'])[o_orderkey % 7 % 3 + 1] AS direction, (o_orderkey % 101) / 100.0e0 AS credibility, CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 41) / 40.0e0 ELSE 0.5e0 END AS conversion,
    (o_orderkey % 13) / 12.0e0 AS stage_score, (o_orderkey % 9) / 8.0e0 AS timing, (o_orderkey % 15) / 10.0e0 AS match_score
  FROM orders JOIN nation ON o_orderkey % 25 = n_nationkey WHERE o_orderkey % 11 <> 0 AND o_orderkey % 5 <> 4),
c2 AS (
  SELECT *, round(greatest(0, least(1, 0.40e0 * credibility + 0.20e0 * conversion + 0.20e0 * stage_score + 0.10e0 * 0.5e0 + 0.10e0 * timing)) + 1e-9, 4) AS rumor_indicator,
    round(greatest(0, least(1, match_score / 1.2e0)) * CASE WHEN k % 10 = 0 THEN 0.85e0 ELSE 1 END + 1e-9, 4) AS entity_match_indicator FROM cl),
mv0 AS (SELECT *, row_number() OVER (PARTITION BY deal_id ORDER BY line, wage_eur_annual, market_value_eur, to_id) AS r FROM transfers),
mv AS (SELECT *, {_SEASON} AS season,
    CASE WHEN market_value_eur > 0 THEN CASE WHEN direction = 'in' THEN market_value_eur - transfer_fee_eur ELSE transfer_fee_eur - market_value_eur END / market_value_eur ELSE 0 END AS gap,
    CASE WHEN market_value_eur > 0 AND transfer_fee_eur > 0 THEN round(transfer_fee_eur / market_value_eur, 4) ELSE 0 END AS ratio FROM mv0 WHERE r = 1),
mq AS (SELECT *, round(1e-9 + {_C(f"0.45 * {_C('0.5 + gap / 2')} + 0.30 * {_C('''CASE WHEN direction = 'in' THEN 1 - abs(age - 24) / 12 ELSE 0.65 + greatest(age - 27, 0) / 12 END''')} + 0.25 * (1 - 0.35 * {_C('wage_eur_annual / 25000000')})")}, 4) AS quality FROM mv),
mi AS (SELECT *, round(1e-9 + {_C(f'''0.50 * quality + 0.30 * CASE WHEN ratio <= 0 THEN 0.5 WHEN direction = 'in' THEN {_C('1.15 - ratio')} ELSE {_C('0.5 + (ratio - 1) / 2')} END + 0.20 * {_C("CASE WHEN direction = 'in' THEN 1 - abs(age - 24) / 12 ELSE 0.55 + greatest(age - 26, 0) / 14 END")} - CASE WHEN is_loan THEN 0.08 ELSE 0 END''')}, 4) AS indicator FROM mq),
li AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_regionkey % 2 = 0),
mt AS (
  SELECT c2.k AS claim_id, rumor_indicator, entity_match_indicator, mi.player, mi.direction, mi.season, b.name AS buyer, CASE WHEN s.id IS DISTINCT FROM b.id THEN s.name END AS seller, indicator
  FROM c2 JOIN mi ON c2.move_id = mi.deal_id LEFT JOIN li b ON b.id = mi.to_id LEFT JOIN li s ON s.id = mi.from_id),
un AS (
  SELECT k AS claim_id, rumor_indicator, entity_match_indicator, player, direction, li.name, year(published) - CAST(month(published) < 7 AS INTEGER) AS y FROM c2 LEFT JOIN li ON li.name = club
  WHERE move_id IS NULL OR move_id NOT IN (SELECT deal_id FROM mi)),
ds AS (
  SELECT claim_id, rumor_indicator, entity_match_indicator, player, direction, season, buyer AS target_club, 'buyer' AS target_role, 'direct' AS prediction_scope, indicator AS transfer_indicator, true AS matched FROM mt WHERE buyer IS NOT NULL
  UNION ALL SELECT claim_id, rumor_indicator, entity_match_indicator, player, direction, season, seller, 'seller', 'direct', indicator, true FROM mt WHERE seller IS NOT NULL
  UNION ALL SELECT claim_id, rumor_indicator, entity_match_indicator, player, direction, season, NULL, NULL, 'none', indicator, true FROM mt WHERE buyer IS NULL AND seller IS NULL
  UNION ALL SELECT claim_id, rumor_indicator, entity_match_indicator, player, direction, y || '-' || lpad(CAST((y + 1) % 100 AS VARCHAR), 2, '0'), CASE WHEN direction IN ('in', 'out') THEN name END,
    CASE WHEN name IS NULL THEN NULL WHEN direction = 'in' THEN 'buyer' WHEN direction = 'out' THEN 'seller' END, CASE WHEN name IS NOT NULL AND direction IN ('in', 'out') THEN 'direct' ELSE 'none' END, 0.0e0, false FROM un)"""
_DATASET_OUT = "claim_id, rumor_indicator, entity_match_indicator, player, direction, season, target_club, target_role, prediction_scope, transfer_indicator, matched"


@query("claim_targets", f"WITH {_DATASET} SELECT {_DATASET_OUT} FROM ds")
def claim_targets(spark, sf_dir):
    """Claims with their confirmed moves, or with their own club, as rows for prediction."""
    return md.claim_rows(claims_of_orders(spark, sf_dir), first_moves(spark, sf_dir), listed(spark, sf_dir)).select(*_DATASET_OUT.split(", "))


def dataset(spark, sf_dir):
    """Scored cases as the table that models learn from: some numbers are missing, and some columns would leak."""
    i = F.col("case_id")
    p = b.predictions(spark, sf_dir).drop("split", "predicted_label", "prediction_confidence", "prob_positive", "prob_negative", "prob_neutral")
    return p.withColumns(
        {
            "label": F.when(i % 5 != 0, F.col("actual_label")).otherwise(""),
            "prediction_scope": F.when(i % 6 == 0, "none").otherwise("direct"),
            "market_feature_status": F.when(i % 9 == 0, "missing_bars").when(i % 9 == 1, "limited_history").otherwise("ok"),
            "age": F.when(i % 7 != 0, F.col("age")),
            "direction": F.when(i % 8 == 0, F.lit(" ")).otherwise(F.col("direction")),
            "season_start": F.split_part("season", F.lit("-"), F.lit(1)).cast("int"),
            "abnormal_return_0_p3": (i % 3 - 1).cast("double"),
        }
    ).drop("actual_label")


_ROWS = f"""{PREDICTIONS}, ds AS (SELECT * EXCLUDE (age, direction), CASE WHEN case_id % 7 <> 0 THEN age END AS age, CASE WHEN case_id % 8 = 0 THEN ' ' ELSE direction END AS direction, CASE WHEN case_id % 5 <> 0 THEN actual_label ELSE '' END AS label,
  CAST(split_part(season, '-', 1) AS INTEGER) AS season_start FROM predictions),
us AS (SELECT * FROM ds WHERE case_id % 6 <> 0 AND case_id % 9 <> 0 AND label <> '')"""


@query("usable_rows", f"WITH {_ROWS} SELECT season_start, label, count(*) AS n, {len(NUMERIC)} AS n_numeric FROM us GROUP BY 1, 2")
def usable_rows(spark, sf_dir):
    """Rows to learn from by season and label, and how many of the numbers may be used."""
    d = dataset(spark, sf_dir)
    features = md.active(d, [*NUMERIC, "abnormal_return_0_p3", "not_there"])
    return md.usable(d).groupBy("season_start", "label").agg(F.count(F.lit(1)).alias("n")).withColumn("n_numeric", F.lit(len(features)))


_FEATURE_SUMS = " UNION ALL ".join(
    [f"SELECT '{n}' AS feature, round(coalesce(sum({n}), 0), 4) AS total FROM us UNION ALL SELECT '{n}__missing', count_if({n} IS NULL) FROM us" for n in NUMERIC]
    + [f"SELECT '{c}=' || coalesce(nullif(trim({c}), ''), 'unknown'), count(*) FROM us GROUP BY 1 UNION ALL SELECT '{c}=__unseen', 0" for c in CATEGORICAL]
)


@query("model_features", f"WITH {_ROWS}, f AS ({_FEATURE_SUMS}) SELECT feature, total FROM f")
def model_features(spark, sf_dir):
    """The sum of every place of the feature vectors: numbers, their missing flags, one place per category."""
    rows = md.prepared(md.usable(dataset(spark, sf_dir)), NUMERIC, CATEGORICAL)
    stages, _ = md.feature_stages(NUMERIC, CATEGORICAL)
    fitted = stages.fit(rows)
    sums = fitted.transform(rows).select(Summarizer.metrics("sum").summary(F.col("features")).alias("s")).select("s.sum").first()[0]
    names = md.feature_names(fitted, NUMERIC, CATEGORICAL)  # places of a vector: columns and categories
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, sums)], "feature string, total double").withColumn("total", F.round("total", 4))


@query(
    "majority_baseline",
    f"""WITH {_ROWS}, tr AS (SELECT * FROM us WHERE season_start <= {TRAIN_END}), te AS (SELECT * FROM us WHERE season_start > {TRAIN_END}),
    s AS (SELECT count_if(label = 'negative') / count(*) AS n, count_if(label = 'neutral') / count(*) AS u, count_if(label = 'positive') / count(*) AS p FROM tr),
    t AS (SELECT te.label, s.*, CASE WHEN n >= greatest(u, p) THEN 'negative' WHEN u >= p THEN 'neutral' ELSE 'positive' END AS predicted FROM te, s),
    f AS (SELECT avg(f1) AS f1 FROM (SELECT 2 * count_if(label = lab AND predicted = lab) / greatest(count_if(label = lab) + count_if(predicted = lab), 1) AS f1 FROM t, (SELECT unnest(['negative', 'neutral', 'positive']) AS lab) GROUP BY lab))
    SELECT count(*) AS n, round(avg(CAST(label = predicted AS INTEGER)), 4) AS accuracy, (SELECT round(f1, 4) FROM f) AS macro_f1, round(avg(-ln(CASE label WHEN 'negative' THEN n WHEN 'neutral' THEN u ELSE p END)), 6) AS log_loss FROM t""",
)
def majority_baseline(spark, sf_dir):
    """What predicting the most frequent label of the training seasons reaches on the later ones."""
    rows = md.usable(dataset(spark, sf_dir))
    train, test = rows.where(F.col("season_start") <= TRAIN_END), rows.where(F.col("season_start") > TRAIN_END)
    e = ln.evaluation(md.majority(train, test).withColumn("actual_label", F.col("label")))
    return e.select("n", *(F.round(c, d).alias(c) for c, d in (("accuracy", 4), ("macro_f1", 4), ("log_loss", 6))))


def _candidates() -> dict:
    common = {"featuresCol": "scaled", "labelCol": "_y", "weightCol": "_w"}
    return {
        "logistic": LogisticRegression(family="multinomial", maxIter=20, regParam=0.01, **common),
        "forest_small": RandomForestClassifier(numTrees=20, maxDepth=3, seed=7, **common),
        "forest_large": RandomForestClassifier(numTrees=40, maxDepth=5, seed=7, **common),
        "boosted": SoftmaxBoosting(len(ln.LABELS), rounds=3, depth=3, step=0.5),
    }


@query("model_selection")
def model_selection(spark, sf_dir):
    """Presets and candidates with their figures on the latest training rows, the one that is chosen, and the baseline and
    chosen model on the later seasons."""
    rows = written(md.usable(dataset(spark, sf_dir)), "model-dataset")  # read by every fit
    train, test = rows.where(F.col("season_start") <= TRAIN_END), rows.where(F.col("season_start") > TRAIN_END)
    presets = {"full": md.active(rows, NUMERIC), "core": md.active(rows, CORE)}
    best, figures = md.chosen(train, presets, CATEGORICAL, _candidates(), ["signal_date", "case_id"], TRAIN_END)
    out = [("validate", *k, k == best, *(round(x, 4) for x in v)) for k, v in figures.items()]
    model = md.fitted(train, presets[best[0]], CATEGORICAL, _candidates()[best[1]])
    for name, scored in ((best, md.predicted(model, test, presets[best[0]], CATEGORICAL, TRAIN_END)), (("none", "majority"), md.majority(train, test))):
        e = ln.evaluation(scored.withColumn("actual_label", F.col("label"))).first()
        out.append(("test", *name, name == best, round(e.macro_f1 or 0.0, 4), round(e.accuracy or 0.0, 4)))
    return spark.createDataFrame(out, "part string, preset string, model string, chosen boolean, macro_f1 double, accuracy double")


@query("gated_predictions")
def gated_predictions(spark, sf_dir):
    """All rows with their split and, in direct scope, a logistic model's label and probabilities."""
    d = dataset(spark, sf_dir)
    train = md.usable(d).where(F.col("season_start") <= TRAIN_END)
    numeric = md.active(d, NUMERIC)
    model = md.fitted(train, numeric, CATEGORICAL, _candidates()["logistic"])
    out = md.predicted(model, d, numeric, CATEGORICAL, TRAIN_END)
    return out.select("case_id", "split", "predicted_label", *(F.round(f"prob_{x}", 4).alias(f"prob_{x}") for x in ln.LABELS))


@query("feature_importance")
def feature_importance(spark, sf_dir):
    """The 25 places of the feature vector with the largest mean absolute coefficient."""
    d = dataset(spark, sf_dir)
    train, numeric = md.usable(d).where(F.col("season_start") <= TRAIN_END), md.active(d, NUMERIC)
    model = md.fitted(train, numeric, CATEGORICAL, _candidates()["logistic"])
    matrix = model.stages[-1].coefficientMatrix.toArray()
    rows = md.importance(md.feature_names(model, numeric, CATEGORICAL), list(abs(matrix).mean(axis=0)))
    return spark.createDataFrame(rows, "feature string, importance double")
