"""The path from claims to predictions: dataset rows, usable rows, features without leaks, model choice, gated predictions."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import storage
from tidemark.functions import dates, scoring
from tidemark.operators import cases, learning

#: Columns that are known only after an event.
LEAKY = tuple(f"{kind}_0_p{n}" for kind in ("raw_return", "market_return", "abnormal_return") for n in (1, 3, 5, 10)) + (
    "post_volatility_20d", "volatility_shift_20d", "target_abnormal_return_p3", "target_label_p3", "actual_label", "label",
)
#: States of market features that a model may learn from.
USABLE = ("ok", "limited_history")
ROLES = {"in": "buyer", "out": "seller"}


def claim_rows(claims: DataFrame, moves: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows for prediction from claims about deals: a row per listed side of the confirmed move of a claim; claims without a
    move stand for their own club, if it is listed and their direction is known. Claims that are about no deal, or without a
    date, are left out. claims: claim_id, published, related, move_id, club, player, direction, credibility, conversion,
    stage_score, article_score, timing_score, match_score, ambiguous. moves: move_id, date, club, player, from_id, to_id,
    direction, fee, market_value, wage, age, is_loan. listed: club_id, club_name (a dimension)."""
    c = claims.where(F.col("related") & F.col("published").isNotNull())
    rumor = scoring.rounded(scoring.component_indicator(*(F.col(x) for x in ("credibility", "conversion", "stage_score", "article_score", "timing_score"))))
    c = c.withColumns({"rumor_indicator": rumor, "entity_match_indicator": scoring.rounded(scoring.entity_match(F.col("match_score"), F.col("ambiguous")))})
    keep = ["claim_id", "published", "credibility", "rumor_indicator", "entity_match_indicator"]
    found = c.select(*keep, "move_id").join(moves.hint("merge"), "move_id")
    fields = [F.col(x) for x in ("direction", "market_value", "fee", "wage", "age")]
    sided = cases.targets(found, listed).select(
        *keep,
        "player",
        "direction",
        dates.season(F.col("date")).alias("season"),
        "target_club",
        "target_role",
        "prediction_scope",
        scoring.rounded(scoring.transfer_indicator(*fields, F.col("is_loan"))).alias("transfer_indicator"),
        F.lit(True).alias("matched"),
    )
    rest = c.join(moves.select("move_id").hint("merge"), "move_id", "left_anti")
    own = rest.join(storage.sided(listed.select(F.col("club_name").alias("target_club"))), F.col("club") == F.col("target_club"), "left")
    role = scoring.lookup(F.col("direction"), ROLES, "")
    direct = F.col("target_club").isNotNull() & (role != "")
    alone = own.select(
        *keep,
        "player",
        "direction",
        dates.season(F.col("published")).alias("season"),
        F.when(direct, F.col("target_club")).alias("target_club"),
        F.when(direct, role).alias("target_role"),
        F.when(direct, "direct").otherwise("none").alias("prediction_scope"),
        F.lit(0.0).alias("transfer_indicator"),
        F.lit(False).alias("matched"),
    )
    return sided.unionByName(alone)


def usable(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows to learn from: direct scope, market features there, a known label."""
    good = (F.coalesce("prediction_scope", F.lit("direct")) == "direct") & F.col("market_feature_status").isin(*USABLE) & F.col(label).isin(*learning.LABELS)
    return rows.where(good)


def active(rows: DataFrame, features: list[str]) -> list[str]:
    """The features that a table has, without those known only after the event."""
    return [f for f in features if f in rows.columns and f not in LEAKY]


def feature_stages(numeric: list[str], categorical: list[str], output: str = "features") -> tuple[Pipeline, list[str]]:
    """Pipeline from prepared() rows to one vector: numbers, whether each was missing, one place per category (unseen ones
    have a place of their own); and the columns that go into the vector."""
    indexer = StringIndexer(inputCols=categorical, outputCols=[f"{c}__i" for c in categorical], handleInvalid="keep", stringOrderType="alphabetAsc")
    encoder = OneHotEncoder(inputCols=[f"{c}__i" for c in categorical], outputCols=[f"{c}__v" for c in categorical], dropLast=False)
    inputs = [x for n in numeric for x in (n, f"{n}__missing")] + [f"{c}__v" for c in categorical]
    return Pipeline(stages=[indexer, encoder, VectorAssembler(inputCols=inputs, outputCol=output)]), inputs


def prepared(rows: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Missing numbers are 0 with a flag beside them, blank categories are `unknown`."""
    flags = {f"{n}__missing": F.col(n).isNull().cast("double") for n in numeric}
    values = {n: F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in numeric}
    names = {c: F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("unknown")) for c in categorical}
    return rows.withColumns(flags).withColumns({**values, **names})


def feature_names(fitted: PipelineModel, numeric: list[str], categorical: list[str]) -> list[str]:
    """Name of each place of the vector."""
    labels = fitted.stages[0].labelsArray
    return [x for n in numeric for x in (n, f"{n}__missing")] + [f"{c}={v}" for c, seen in zip(categorical, labels) for v in (*seen, "__unseen")]


def majority(train: DataFrame, rows: DataFrame, label: str = "label") -> DataFrame:
    """Every row gets the most frequent label (ties: by name) and the shares of all labels."""
    counts = train.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(label) == x).alias(x) for x in learning.LABELS))
    top = F.array_max(F.array(*(F.struct(F.col(x).alias("n"), F.lit(-i).alias("i"), F.lit(x).alias("label")) for i, x in enumerate(learning.LABELS))))["label"]
    shares = counts.select(top.alias("predicted_label"), *((F.col(x) / F.col("n")).alias(f"prob_{x}") for x in learning.LABELS))
    return rows.join(F.broadcast(shares)).withColumn("prediction_confidence", F.greatest(*(f"prob_{x}" for x in learning.LABELS)))


def _numbered(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumn("_y", scoring.lookup(F.col(label), {x: float(i) for i, x in enumerate(learning.LABELS)}, -1.0))


def scaled(train: DataFrame, numeric: list[str], categorical: list[str], label: str = "label") -> tuple[PipelineModel, DataFrame]:
    """Features and scaling, fitted, and the training rows that classifiers learn from: `scaled`, `_y` and `_w` (balanced classes).
    Both steps are written out, since every fit reads its rows many times."""
    stages, inputs = feature_stages(numeric, categorical)
    weights = learning.class_weights(train, label).select(label, F.col("weight").alias("_w"))
    rows = _numbered(prepared(train, numeric, categorical).join(F.broadcast(weights), label), label)
    rows = storage.written(rows.select(*(c for c in inputs if c in rows.columns), *categorical, "_y", "_w"), "model-rows")
    features = Pipeline(stages=[*stages.getStages(), StandardScaler(inputCol="features", outputCol="scaled", withMean=True)]).fit(rows)
    out = storage.written(features.transform(rows).select("scaled", "_y", "_w"), "model-scaled")
    storage.discard(rows)
    return features, out


def fitted(train: DataFrame, numeric: list[str], categorical: list[str], classifier, label: str = "label") -> PipelineModel:
    """Features, scaling and a classifier (weightCol `_w`, labelCol `_y`, featuresCol `scaled`) with balanced classes."""
    features, rows = scaled(train, numeric, categorical, label)
    model = PipelineModel([*features.stages, classifier.fit(rows)])
    storage.discard(rows)
    return model


def predicted(model: PipelineModel, rows: DataFrame, numeric: list[str], categorical: list[str], train_end: int, label: str = "label") -> DataFrame:
    """Rows with split, predicted_label, prob_* and prediction_confidence. Rows of other than direct scope get none of them but
    the split."""
    scoped = learning.split_of(rows.withColumnRenamed(label, "label") if label != "label" else rows, train_end)
    direct = scoped.where(F.col("prediction_scope") == "direct")
    whole = direct.withColumn("_row", F.struct(*scoped.columns))
    out = model.transform(prepared(whole, numeric, categorical).withColumn("_w", F.lit(1.0)))
    p = vector_to_array("probability")
    probs = {f"prob_{x}": F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i, x in enumerate(learning.LABELS)}
    named = F.element_at(F.array(*map(F.lit, learning.LABELS)), (F.col("prediction") + 1).cast("int"))
    out = out.withColumns({**probs, "predicted_label": named, "prediction_confidence": F.array_max(p)})
    extra = ["predicted_label", *probs, "prediction_confidence"]
    scored = out.select("_row.*", *extra)
    rest = scoped.where(~F.coalesce(F.col("prediction_scope") == "direct", F.lit(False)))
    return scored.select(*scoped.columns, *extra).unionByName(rest, allowMissingColumns=True)


def chosen(train: DataFrame, numeric: dict[str, list[str]], categorical: list[str], candidates: dict, order: list[str], train_end: int) -> tuple[tuple[str, str], dict[tuple[str, str], tuple[float, float]]]:
    """The feature preset and candidate with the best macro-F1 (then accuracy) on the latest fifth of the training rows, and the
    figures of all. numeric: features by preset; candidates: classifiers by name, both few."""
    # Written, and features are made once for a preset: candidates don't order the rows and make their features again.
    parts = storage.written(learning.chronological(train, order), "model-parts")
    fit, validate = (parts.where(F.col("part") == x).drop("part") for x in ("fit", "validate"))
    found = {}
    for preset, features in numeric.items():
        made, learned = scaled(fit, features, categorical)
        for name, classifier in candidates.items():
            rows = predicted(PipelineModel([*made.stages, classifier.fit(learned)]), validate, features, categorical, train_end)
            e = learning.evaluation(rows.withColumn("actual_label", F.col("label"))).first()
            found[preset, name] = (e.macro_f1 or 0.0, e.accuracy or 0.0)
        storage.discard(learned)
    storage.discard(parts)
    return max(found, key=lambda k: found[k]), found


def importance(names: list[str], values: list[float], limit: int = 25) -> list[tuple[str, float]]:
    """The features with the largest absolute values. names and values: one per place of the feature vector."""
    pairs = sorted(zip(names, values), key=lambda x: (-abs(x[1]), x[0]))
    return [(n, round(float(v), 6)) for n, v in pairs[:limit]]


def event_news(events: DataFrame, news: DataFrame, keys: list[str]) -> DataFrame:
    """Events with the number of related news and the largest and mean of their credibility and strength (NULL without news)."""
    stats = news.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rumor_count"),
        *(f(x).alias(f"{n}_{y}") for x, y in (("credibility_score", "credibility"), ("rumor_strength", "rumor_strength")) for n, f in (("max", F.max), ("avg", F.avg))),
    )
    return events.join(stats.hint("merge"), keys, "left").withColumn("rumor_count", F.coalesce("rumor_count", F.lit(0)))


def latest_signals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per group: its latest row, whole, with counts of rows, sources and reporters and the mix of predicted labels.
    rows: keys, order, source, journalist, predicted_label and whatever else."""
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in rows.columns if c not in keys)), F.struct(*order)).alias("_latest"), F.count(F.lit(1)).alias("article_count"), F.countDistinct("source").alias("source_count"), F.countDistinct("journalist").alias("reporter_count"))
    votes = rows.groupBy(*keys, "predicted_label").agg(F.count(F.lit(1)).alias("n"))  # a row per label
    mix = votes.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("predicted_label", "n"))), lambda x: F.concat_ws(":", x["predicted_label"], x["n"])), "|").alias("label_mix"))
    return latest.join(mix.hint("merge"), keys).select(*keys, "_latest.*", "article_count", "source_count", "reporter_count", "label_mix")


def most(rows: DataFrame, keys: list[str], value: str, k: int, ordered: list | None = None) -> DataFrame:
    """The k most frequent values of each group: keys, value, n, rank (ties by value)."""
    n = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    by = Window.partitionBy(*keys).orderBy(*(ordered or [F.desc("n"), F.col(value)]))
    return n.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
