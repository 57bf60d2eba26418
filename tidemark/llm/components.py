"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is one aggregate and one join, so a node with very many edges is combined before the shuffle and its join
partition can be split. Edges are first contracted inside each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, written

_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of every node that is not itself the smallest."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    root = np.arange(len(nodes))
    while True:
        ra, rb = root[a], root[b]
        differs = ra != rb
        if not differs.any():
            break
        a, b = a[differs], b[differs]
        high, low = np.maximum(ra, rb)[differs], np.minimum(ra, rb)[differs]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        u, v = forest(batch.column("u").to_numpy(), batch.column("v").to_numpy())
        if len(u):
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], schema=_EDGE)


def _stars(edges: DataFrame) -> DataFrame:
    """(node, root) pairs in which no root is a node with a smaller root, step by step."""
    current = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # Large star: larger neighbours of a node point to the smallest neighbour of that node. Both sides of the join are
        # written tables, so a node with very many neighbours is split.
        both = written(current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        large = both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours point to the smallest of them.
        large = written(large, "large")
        small = written(large.groupBy("u").agg(F.min("v").alias("m")), "small")
        moved = large.join(small.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(moved.unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        # Done when every node has one root and no root has a root. The roots are the right side of the semi join: on the left
        # Spark would move the join below their distinct, and all rows of a root would meet in one task.
        roots = nxt.select(F.col("v").alias("u")).distinct()
        several = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        open_nodes = several.limit(1).count() or nxt.select("u").join(roots.hint("merge"), "u", "left_semi").limit(1).count()
        discard(current, both, least, large, small)
        current = nxt
        if not open_nodes:
            return current


def components(edges: DataFrame, contract: bool = True) -> DataFrame:
    """edges (u, v: bigint, any order, repeats allowed) to (node, root): the smallest node that each node with an edge reaches.
    Roots themselves are not listed; loops are ignored; an empty table gives an empty table."""
    if contract:
        edges = edges.select("u", "v").mapInArrow(_contract, "u bigint, v bigint")
    return _stars(edges).select(F.col("u").alias("node"), F.col("v").alias("root"))
