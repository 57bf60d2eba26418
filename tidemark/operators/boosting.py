"""Boosted regression trees for several classes: softmax, a tree per class and round, with `pyspark.ml` trees."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.storage import discard, written


def softmax(scores: Column) -> Column:
    """Shares of the exponentials of an array."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


class SoftmaxBoosting(Estimator):
    """Each round fits a tree per class to what the class's share lacks (1 or 0, less the share so far), and adds `step` times
    its answer to the class's score. Scores are written every round, so plans stay short."""

    def __init__(self, classes: int, rounds: int, depth: int, step: float = 0.3, features: str = "scaled", label: str = "_y", weight: str = "_w", seed: int = 7):
        super().__init__()
        self.classes, self.rounds, self.depth, self.step = classes, rounds, depth, step
        self.features, self.label, self.weight, self.seed = features, label, weight, seed

    def _fit(self, rows: DataFrame) -> SoftmaxBoostingModel:
        zero = F.array(*(F.lit(0.0) for _ in range(self.classes)))
        now = written(rows.select(self.features, self.label, self.weight, zero.alias("_f")), "boost")
        trees = []
        for r in range(self.rounds):
            lacking = now
            for k in range(self.classes):
                lacking = lacking.withColumn(f"_r{k}", (F.col(self.label) == k).cast("double") - softmax(F.col("_f"))[k])
            fitted = [
                DecisionTreeRegressor(featuresCol=self.features, labelCol=f"_r{k}", weightCol=self.weight, maxDepth=self.depth, seed=self.seed, predictionCol=f"_t{k}").fit(lacking)
                for k in range(self.classes)
            ]
            trees.append(fitted)
            if r + 1 < self.rounds:
                nxt = written(_added(now, fitted, self.step).select(*now.columns), "boost")
                discard(now)
                now = nxt
        discard(now)
        return SoftmaxBoostingModel(trees, self.classes, self.step)


def _added(rows: DataFrame, trees: list, step: float) -> DataFrame:
    """Rows with the answers of one round's trees added to their scores."""
    out = rows
    for tree in trees:
        out = tree.transform(out)
    total = F.array(*(F.get("_f", F.lit(k)) + step * F.col(f"_t{k}") for k in range(len(trees))))
    return out.withColumn("_f", total).drop(*(f"_t{k}" for k in range(len(trees))))


class SoftmaxBoostingModel(Model):
    """Adds `probability` (a vector of shares) and `prediction` (the number of the largest, the first of equals)."""

    def __init__(self, trees: list[list], classes: int, step: float):
        super().__init__()
        self.trees, self.classes, self.step = trees, classes, step

    def _transform(self, rows: DataFrame) -> DataFrame:
        out = rows.withColumn("_f", F.array(*(F.lit(0.0) for _ in range(self.classes))))
        for fitted in self.trees:
            out = _added(out, fitted, self.step)
        share = softmax(F.col("_f"))
        out = out.withColumn("_p", share)
        best = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumns({"probability": array_to_vector("_p"), "prediction": best.cast("double")}).drop("_f", "_p")
