"""Splits, weights, simple classifiers and their evaluation as grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import written

LABELS = ("negative", "neutral", "positive")
#: Counts of categories by class that are broadcast, at most.
CATEGORY_ROWS = 200_000


def split_of(rows: DataFrame, train_end: int) -> DataFrame:
    """train, test, live_unlabeled, unlabeled or intelligence_only, by scope, label and season. rows: prediction_scope, season_start, label."""
    known, past = F.col("label").isin(*LABELS), F.col("season_start") <= train_end
    split = F.when(F.col("prediction_scope") != "direct", "intelligence_only").when(known & past, "train").when(known, "test").when(~past, "live_unlabeled").otherwise("unlabeled")
    return rows.withColumn("split", split)


def chronological(rows: DataFrame, order: list[str], share: float = 0.8, least: int = 12) -> DataFrame:
    """`part`: fit for the earliest rows, validate for the rest; all fit if there are fewer than max(2 least, 30). The cut is
    a row number, found from sorted ranks by two bounded aggregates (rows per day, then rows within the day of the cut)."""
    days = rows.groupBy(order[0]).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(F.lit(0)).orderBy(order[0])  # a row per day
    days = days.withColumns({"upto": F.sum("n").over(before) - F.col("n"), "total": F.sum("n").over(Window.partitionBy(F.lit(0)))})
    cut = F.least(F.greatest(F.floor(F.col("total") * share), F.col("total") - least), F.col("total") - least)
    cut = F.when(F.col("total") < max(2 * least, 30), F.col("total")).otherwise(cut)
    ranked = rows.join(days.select(order[0], "upto", cut.alias("cut")).hint("merge"), order[0]).withColumn("k", F.col("upto") + F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])))
    return ranked.withColumn("part", F.when(F.col("k") <= F.col("cut"), "fit").otherwise("validate")).drop("upto", "cut", "k")


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """label, n and total / (classes x n)."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row per class
    return n.withColumn("weight", total / (len(LABELS) * F.col("n")))


def evaluation(rows: DataFrame) -> DataFrame:
    """One row: n, accuracy, macro_f1, log_loss and brier. rows: actual_label, predicted_label, prob_*."""
    p = lambda x: F.col(f"prob_{x}")
    total = p("negative") + p("neutral") + p("positive")
    own = None
    for x in LABELS:
        own = F.when(F.col("actual_label") == x, p(x) / total) if own is None else own.when(F.col("actual_label") == x, p(x) / total)
    square = sum(((p(x) - (F.col("actual_label") == x).cast("int")) ** 2 for x in LABELS), F.lit(0.0))
    hit = F.col("actual_label") == F.col("predicted_label")
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(hit.cast("int")).alias("accuracy"), F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("log_loss"), F.avg(square).alias("brier")]
    for x in LABELS:
        aggs += [F.count_if(hit & (F.col("actual_label") == x)).alias(f"tp_{x}"), F.count_if(F.col("actual_label") == x).alias(f"a_{x}"), F.count_if(F.col("predicted_label") == x).alias(f"p_{x}")]
    out = rows.agg(*aggs)
    seen = lambda x: F.col(f"a_{x}") + F.col(f"p_{x}")
    f1 = sum((F.when(seen(x) > 0, 2 * F.col(f"tp_{x}") / seen(x)).otherwise(0.0) for x in LABELS), F.lit(0.0))
    classes = sum(((seen(x) > 0).cast("int") for x in LABELS), F.lit(0))
    return out.withColumn("macro_f1", f1 / classes).select("n", "accuracy", "macro_f1", "log_loss", "brier")


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("actual_label").pivot("predicted_label", list(LABELS)).agg(F.count(F.lit(1))).na.fill(0)


def calibration(rows: DataFrame, bins: int = 5) -> DataFrame:
    """Confidence against accuracy in equal bins; rows: prediction_confidence, actual_label, predicted_label."""
    at = F.least(F.floor(F.col("prediction_confidence") * bins), F.lit(bins - 1))
    hit = (F.col("actual_label") == F.col("predicted_label")).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("prediction_confidence").alias("avg_confidence"), F.avg(hit).alias("accuracy"))


def _vector(numeric: list[str] | str):
    """An array column, or numbers side by side as one."""
    return F.col(numeric) if isinstance(numeric, str) else F.array(*numeric)


def naive_bayes(train: DataFrame, rows: DataFrame, numeric: list[str] | str, categorical: list[str], key: str, label: str) -> DataFrame:
    """Gaussian numbers (spread at least 1e-4) and Laplace-smoothed categories: key, predicted and its probability. numeric:
    columns, or one array column of any length. Statistics are a row per class, so they are joined to every row as one small
    broadcast."""
    sizes = train.groupBy(F.col(label).alias("_label")).agg(F.count(F.lit(1)).alias("_n"))
    one = Window.partitionBy(F.lit(0))
    sizes = sizes.withColumns({"_total": F.sum("_n").over(one), "_classes": F.count(F.lit(1)).over(one)})
    parts = train.select(F.col(label).alias("_label"), F.posexplode(_vector(numeric)).alias("_i", "_x")).groupBy("_label", "_i")
    parts = parts.agg(F.avg("_x").alias("m"), F.greatest(F.when(F.count(F.lit(1)) > 1, F.stddev_pop("_x")).otherwise(1.0), F.lit(1e-4)).alias("s"))
    shapes = parts.groupBy("_label").agg(F.array_sort(F.collect_list(F.struct("_i", "m", "s"))).alias("_shape"))
    stats = sizes.join(shapes, "_label", "left")
    pairs = rows.select(key, _vector(numeric).alias("_x"), *categorical).join(F.broadcast(stats))  # rows x classes
    score = F.log((F.col("_n") + 1) / (F.col("_total") + F.col("_classes")))
    # Beside values, the class's mean and spread of their places; sums run over all places.
    var = lambda t: t["s"] * t["s"]
    terms = F.zip_with("_x", "_shape", lambda x, t: -0.5 * F.log(2 * math.pi * var(t)) - (x - t["m"]) ** 2 / (2 * var(t)))
    score = score + F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)
    for c in categorical:
        # (label, value) counts: as many rows as there are values and classes; how many is counted, and they are a map where few.
        counts = written(train.where(F.col(c).isNotNull()).groupBy(F.col(label).alias("_label"), F.col(c)).agg(F.count(F.lit(1)).alias(f"_c_{c}")), "category-counts")
        values = counts.agg(F.countDistinct(c).alias("v"), F.count(F.lit(1)).alias("n")).first()
        side = F.broadcast(counts) if values.n <= CATEGORY_ROWS else counts.hint("merge")
        pairs = pairs.join(side, ["_label", c], "left")
        score = score + F.log((F.coalesce(f"_c_{c}", F.lit(0)) + 1) / (F.col("_n") + values.v))
    scored = pairs.select(key, "_label", score.alias("_score"))
    top = scored.groupBy(key).agg(F.max_by("_label", "_score").alias("predicted"), F.max("_score").alias("_top"), F.collect_list("_score").alias("_all"))
    return top.select(key, "predicted", (1 / F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("_top")))).alias("confidence"))
