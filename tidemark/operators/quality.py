"""How far the data can be trusted: six dimensions from signals, clusters, price paths and a model's holdout.

signals: published_at, source, journalist, prediction_scope, match_score. clusters: articles and sources (numbers). clubs: club.
paths: club, latest_day, markers. holdout: actual_label, predicted_label and prob_* (see learning.evaluation). Each dimension is
one row of aggregates; no figure is assumed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import dates, scoring
from tidemark.operators import learning

#: The dimensions and their weights.
WEIGHTS = {"freshness": 0.24, "sources": 0.18, "market": 0.18, "matching": 0.16, "model": 0.14, "dates": 0.10}
#: Days after which a path or a signal is stale, and the match score below which a match is weak.
STALE_PATH, STALE_SIGNAL, WEAK = 14, 7, 0.65


def _measures(signals: DataFrame, clusters: DataFrame, clubs: DataFrame, paths: DataFrame, holdout: DataFrame, as_of: Column) -> DataFrame:
    """All aggregates, side by side in one row."""
    c, some = F.col, lambda x: F.nullif(F.trim(F.col(x)), F.lit(""))
    direct = F.coalesce(c("prediction_scope") == "direct", F.lit(False))
    score = F.when(direct, F.coalesce("match_score", F.lit(0.0)))
    s = signals.agg(
        F.datediff(as_of, F.max(F.to_date("published_at"))).alias("stale"),
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(some("source")).alias("outlets"),
        F.countDistinct(some("journalist")).alias("reporters"),
        F.count_if(direct).alias("direct"),
        F.avg(score).alias("fit"),
        F.count_if(score < WEAK).alias("weak"),
        F.count_if(F.to_date("published_at") > as_of).alias("future"),
    )
    thin = (c("sources") < 2) | (c("articles") < 2)
    k = clusters.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("articles"), F.lit(0)).alias("articles"), F.count_if(c("sources") >= 2).alias("several"), F.count_if(thin).alias("thin"))
    j = clubs.select("club").distinct().join(paths.hint("merge"), "club", "left")
    age = F.datediff(as_of, "latest_day")
    m = j.agg(F.count(F.lit(1)).alias("clubs"), F.count_if(c("latest_day").isNull()).alias("missing"), F.count_if(age > STALE_PATH).alias("old"), F.coalesce(F.sum("markers"), F.lit(0)).alias("markers"))
    e = learning.evaluation(holdout).select(c("n").alias("tested"), F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"), F.coalesce("macro_f1", F.lit(0.0)).alias("macro_f1"))
    p = holdout.agg(F.count_if(c("actual_label") == "positive").alias("positives"))
    return reduce(lambda a, b: a.join(F.broadcast(b)), (s, k, m, e, p))  # one row each


def audit(signals: DataFrame, clusters: DataFrame, clubs: DataFrame, paths: DataFrame, holdout: DataFrame, as_of: Column) -> DataFrame:
    """name, score, status and warnings of each dimension, and of their weighted sum (overall)."""
    c, up = F.col, lambda x: scoring.clamp(x)
    share = lambda a, b: F.when(c(b) > 0, c(a) / c(b)).otherwise(0.0)
    clubs_n = F.greatest(c("clubs"), F.lit(1))
    scores = {
        "freshness": dates.freshness(c("stale")),
        "sources": 0.35 * up(c("outlets") / 8) + 0.25 * up(c("articles") / 24) + 0.20 * up(c("reporters") / 6) + 0.20 * share("several", "clusters"),
        "market": 0.45 * (1 - c("missing") / clubs_n) + 0.35 * (1 - c("old") / clubs_n) + 0.20 * up(c("markers") / (clubs_n * 3)),
        "matching": 0.55 * up(F.coalesce("fit", F.lit(0.0))) + 0.30 * share("direct", "rows") + 0.15 * F.when(c("direct") > 0, 1 - c("weak") / c("direct")).otherwise(0.0),
        "model": 0.35 * up(c("accuracy")) + 0.35 * up(c("macro_f1")) + 0.20 * up(c("tested") / 120) + 0.10 * up(c("positives") / F.greatest(c("tested") * 0.12, F.lit(1))),
        "dates": F.when(c("future") == 0, 1.0).otherwise(F.greatest(F.lit(0.15), 1 - F.least(c("future"), F.lit(20)) / 20)),
    }
    warned = {
        "freshness": [(c("stale").isNull(), "no dates"), (c("stale") > STALE_SIGNAL, "stale signals")],
        "sources": [(c("clusters") == 0, "no clusters"), (c("thin") > 0, "thin clusters")],
        "market": [(c("missing") > 0, "missing paths"), (c("old") > 0, "stale paths"), (c("markers") == 0, "no markers")],
        "matching": [(c("weak") > 0, "weak matches"), ((c("rows") > 0) & (c("direct") / c("rows") < 0.5), "few direct signals")],
        "model": [(c("tested") < 50, "small holdout"), (c("positives") <= F.greatest(F.lit(2.0), c("tested") * 0.08), "sparse positives"), (c("macro_f1") < 0.4, "low macro F1")],
        "dates": [(c("future") > 0, "future dates")],
    }
    row = lambda name, score, warnings: F.struct(F.lit(name).alias("name"), scoring.rounded(scoring.clamp(score)).alias("score"), warnings.alias("warnings"))
    rows = [row(n, s, F.array_compact(F.array(*(F.when(t, w) for t, w in warned[n])))) for n, s in scores.items()]
    overall = sum((w * scoring.rounded(scoring.clamp(scores[n])) for n, w in WEIGHTS.items()), F.lit(0.0))
    rows.append(row("overall", overall, F.array().cast("array<string>")))
    out = _measures(signals, clusters, clubs, paths, holdout, as_of).select(F.inline(F.array(*rows)))
    return out.select("name", "score", scoring.score_status(F.col("score")).alias("status"), "warnings")
