"""Embedding near-dedup: spherical k-means cells, and blocked cosine products inside cells.

Definition: vectors are compared only when labels are equal and not null; vectors that are null, zero or hold null or
non-finite components link with nothing. Two vectors link if their cosine in double precision is `threshold` or more.

Equal vectors of a label are joined first and carry a weight. Spherical k-means (fitted on a bounded sample of at most
about `sample` vectors) assigns every distinct vector to its nearest centre; there is a centre for every `cell` vectors,
eight at least, and at most as many as fit in CENTRE_BYTES, which is what the broadcast is bounded by. A vector whose
partners may lie across a border also visits that cell: unit vectors within the threshold are at most
r = sqrt(2 - 2 threshold) apart, so a partner can only be in a cell whose bisecting plane is within r. Each cell's home
vectors are multiplied with all its members in blocks of at most `block` rows a side, so neither a cell nor a task is
unbounded, and no pair is lost. A usual cell is one block, whose rows are shipped once; a cell of m blocks ships its rows
m times. A block sends on sums of links and a spanning forest, never pairs. `cell_visits` tells how many cells vectors visit.

Vectors are scaled by their largest component before their length is taken, so no square overflows or vanishes.
Vectors of different lengths link with nothing (their cosine is not defined). Repeated vec_ids are separate rows, each
counted; the smallest id stays. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.shipping import ship

from .common import discard, written
from .components import components, forest

THRESHOLD = 0.98
SAMPLE = 100_000
CELL = 4096
BLOCK = 8192
CENTRE_BYTES = 16 << 20
SLICE = 128  # rows multiplied at a time


def _centres(units: DataFrame, total: int, size: int, sample: int, cell: int) -> np.ndarray:
    """Unit centres of spherical k-means."""
    k = min(max(8, math.ceil(total / cell)), total, max(1, sample // 8), max(1, CENTRE_BYTES // (8 * size)))
    if k == 1:
        return np.full((1, size), size**-0.5)
    part = units.select(array_to_vector("unit").alias("features"))
    if total > sample:
        part = part.sample(fraction=sample / total, seed=7)
    fitted = KMeans(k=k, distanceMeasure="cosine", initMode="random", maxIter=8, seed=7).fit(part)
    found = np.array(fitted.clusterCenters())
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def _cells(shared, reach: float):
    """Each vector's home cell, and the cells that it visits."""

    def rows(batches):
        centres = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, SLICE):
                batch = whole.slice(start, SLICE)
                unit = np.stack(batch.column("unit").to_numpy(zero_copy_only=False))
                dot = unit @ centres.T
                home = dot.argmax(axis=1)
                apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres[home] @ centres.T)))
                near = dot[np.arange(len(unit)), home][:, None] - dot <= (reach + 1e-9) * apart + 1e-12
                near[np.arange(len(unit)), home] = True
                who, cell = np.nonzero(near)
                columns = [batch.column(c).take(pa.array(who)) for c in ("label", "node", "weight", "unit")]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cell), pa.array(home[who] == cell)], names=["label", "node", "weight", "unit", "cell", "home"])

    return rows


def _block_links(threshold: float):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        home, members = pdf[pdf["left"]], pdf[~pdf["left"]]
        if not len(home) or not len(members):
            return pd.DataFrame({"node": [], "links": [], "root": []}).astype("int64")
        a, b = np.stack(home["unit"].to_numpy()), np.stack(members["unit"].to_numpy()).T
        an, bn, weight = home["node"].to_numpy(), members["node"].to_numpy(), members["weight"].to_numpy()
        links, us, vs = np.zeros(len(an), np.int64), [], []
        for at in range(0, len(an), SLICE):
            near = a[at : at + SLICE] @ b >= threshold
            near &= an[at : at + SLICE, None] != bn
            links[at : at + SLICE] = near @ weight
            i, j = np.nonzero(near)
            u, v = forest(an[at + i], bn[j]) if len(i) else (np.zeros(0, np.int64),) * 2
            us.append(u), vs.append(v)
        node, root = forest(np.concatenate(us), np.concatenate(vs))
        some = links > 0
        none = np.zeros(len(node), np.int64)
        return pd.DataFrame({"node": np.concatenate([an[some], node]), "links": np.concatenate([links[some], none]), "root": np.concatenate([an[some], root])})

    return solve


def _usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v (NULL if the vector links with nothing) and unit, the vector of length one."""
    wide = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select("vec_id", "label", F.when(F.coalesce(finite, F.lit(False)), wide).alias("v"))
    rows = rows.withColumn("top", F.array_max(F.transform("v", lambda x: F.abs(x))))
    usable = F.coalesce(F.col("label").isNotNull() & (F.col("top") > 0), F.lit(False))
    # -0.0 and 0.0 are one value.
    rows = rows.withColumn("v", F.when(usable, F.transform("v", lambda x: x + 0.0)))
    rows = rows.withColumn("scaled", F.transform("v", lambda x: x / F.col("top")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda a, x: a + x * x)))
    return rows.select("vec_id", "label", "v", F.transform("scaled", lambda x: x / F.col("norm")).alias("unit"))


def _groups(rows: DataFrame) -> DataFrame:
    """One row per distinct vector of a label."""
    one = rows.where("v is not null").groupBy("label", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"), F.first("unit").alias("unit"))
    return one.withColumn("node", F.xxhash64("label", "v", F.lit(5)))


def _by_size(groups: DataFrame) -> list[tuple[int, int, DataFrame]]:
    """(length, vectors, rows) for each length of vectors; lengths are few."""
    sizes = groups.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy("d").collect()
    return [(r.d, r.n, groups.where(F.size("v") == r.d) if len(sizes) > 1 else groups) for r in sizes]


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """vectors: vec_id, embedding, label. One row per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    ship(spark)
    rows = _usable(vectors)
    groups = written(_groups(rows), "vectors")
    found, used = spark.createDataFrame([], "node bigint, links bigint, root bigint"), []
    for size, total, some in _by_size(groups):
        found = found.unionByName(_links(some, total, size, threshold, sample, block, cell, used))
    found = written(found, "vector-links")
    discard(*used)
    links = found.groupBy("node").agg(F.sum("links").alias("others"))
    roots = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    labelled = groups.select("label", "v", "node", "least", "weight").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = written(labelled.join(links.hint("merge"), "node", "left"), "vector-groups")
    # Written out, so that the join with it can split a very large component.
    names = written(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "vector-names")
    named = labelled.join(names.hint("merge"), "root").select("label", "v", "component_id", (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    linked = rows.where("v is not null").select("vec_id", "label", "v").join(written(named, "vector-named").hint("merge"), ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    discard(groups, found, labelled, names)
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _placed(groups: DataFrame, total: int, size: int, threshold: float, sample: int, cell: int) -> DataFrame:
    """label, node, weight, unit, cell and home: a row for each cell that a vector visits."""
    shared = groups.sparkSession.sparkContext.broadcast(_centres(groups, total, size, sample, cell))  # CENTRE_BYTES at most
    reach = math.sqrt(max(0.0, 2 - 2 * threshold))
    label = dict(groups.dtypes)["label"]
    return groups.select("label", "node", "weight", "unit").mapInArrow(_cells(shared, reach), f"label {label}, node bigint, weight bigint, unit array<double>, cell bigint, home boolean")


def cell_visits(vectors: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """size, cells, vectors, visits: how many cells the distinct vectors of each length visit in all."""
    ship(vectors.sparkSession)
    found = None
    for size, total, some in _by_size(written(_groups(_usable(vectors)), "vectors")):
        placed = _placed(some, total, size, threshold, sample, cell)
        one = placed.agg(F.lit(size).alias("size"), F.countDistinct("cell").alias("cells"), F.count_if("home").alias("vectors"), F.count(F.lit(1)).alias("visits"))
        found = one if found is None else found.unionByName(one)
    return found if found is not None else vectors.sparkSession.createDataFrame([], "size int, cells bigint, vectors bigint, visits bigint")


def _links(groups: DataFrame, total: int, size: int, threshold: float, sample: int, block: int, cell: int, used: list[DataFrame]) -> DataFrame:
    """node, links (weights of the vectors linked with it, in parts) and root (a forest of the links). used: takes the tables
    that the result reads."""
    placed = written(_placed(groups, total, size, threshold, sample, cell), "placed")
    block = max(1, min(block, (64 << 20) // (8 * size)))  # bytes of a block are bounded too
    sizes = placed.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("members"), F.count_if("home").alias("homes"))
    sizes = sizes.where("homes > 0").select("label", "cell", F.ceil(F.col("members") / block).cast("int").alias("mb"), F.ceil(F.col("homes") / block).cast("int").alias("hb"))
    sizes = written(sizes, "cells")
    used += [placed, sizes]
    cells = placed.join(sizes.hint("merge"), ["label", "cell"])
    part = F.xxhash64("node", F.lit(11))
    right = cells.select("label", "cell", "node", "weight", "unit", F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("a"), F.pmod(part, F.col("mb")).cast("int").alias("b"), F.lit(False).alias("left"))
    left = cells.where("home").select("label", "cell", "node", "weight", "unit", F.pmod(part, F.col("hb")).cast("int").alias("a"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("b"), F.lit(True).alias("left"))
    both = left.unionByName(right)
    return both.groupBy("label", "cell", "a", "b").applyInPandas(_block_links(threshold), "node bigint, links bigint, root bigint")


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CASE WHEN label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) > 0
    THEN list_transform(embedding, lambda x: x::DOUBLE) END AS e FROM embeddings),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r AS (SELECT vec_id, vec_id AS far FROM v UNION SELECT r.vec_id, l.y FROM r JOIN l ON l.x = r.far)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT vec_id, min(far) AS component_id FROM r GROUP BY vec_id) c USING (vec_id)
LEFT JOIN (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x) n USING (vec_id)
"""
