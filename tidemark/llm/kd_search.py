"""Exact top-k by inner product: KD-trees per shard, best-first traversal, a k-th score carried from shard to shard.

Definition: a component x becomes floor(1024 x), x as double. The score of two vectors of one length is the inner product
of these whole numbers. Each query row gets the k best scores of all rows but itself, ties to the smaller vec_id. Vectors
that are null or hold null or non-finite components take no part.

Index: rows are cut into shards of at most SHARD_BYTES. A shard is split at the median of its widest component, again and
again, down to leaves of about `leaf` vectors; every node has a tight bounding box. A shard is one row of the written index.

Search: a query enters each tree at its root and always opens the node with the best bound (the largest inner product that
any point of its box could have), until the best bound is strictly below its k-th score. Shards are searched in rounds of
growing size; each round starts with the k-th scores of the rounds before, so later shards are left early and send little.
Queries go out in blocks of at most BLOCK_BYTES, which is what a broadcast is bounded by; what a task sends is k rows a
query and shard at most. A query block meets whole shards, never single rows.

Values: components are held within +-2^62 and scores within a long. A vec_id may be null (last of a tie; never a query) or
repeat: rows are told apart by a number, each query row gets an answer, and a row that repeats another is a candidate.
Vectors of different lengths don't meet; vectors of length zero score zero. Fewer rows than k: all of them. An empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shipping import ship

from .common import discard, written

K = 10
EVERY = 100
LEAF = 256
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20
SLICE = 1024  # queries that walk a tree side by side
#: Shards of the first round, and how many times as many each further round has.
FIRST, GROWTH = 16, 16
_MOST = float(1 << 62)
_LONG = (1 << 63) - 1


def scaled(embedding: Column) -> Column:
    """floor(1024 x) of each component; null where the vector takes no part."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(wide, lambda x: F.floor(F.least(F.greatest(x * 1024.0, F.lit(-_MOST)), F.lit(_MOST))).cast("bigint"))
    return F.when(F.coalesce(finite, F.lit(False)), whole)


def median_order(v: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which every node of a perfect binary tree of median splits is a stretch, and the bounds of the
    leaves in it."""
    depth = max(0, math.ceil(math.log2(max(1, len(v)) / leaf)))
    order, bounds = np.arange(len(v)), np.array([0, len(v)])
    for _ in range(depth):
        cuts = [0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            own = order[a:b]
            mid = (b - a) // 2
            if b - a > 1:
                part = v[own]
                axis = int((part.max(axis=0).astype(float) - part.min(axis=0)).argmax()) if v.shape[1] else 0
                if v.shape[1]:
                    order[a:b] = own[np.argpartition(part[:, axis], mid)]
            cuts += [a + mid, b]
        bounds = np.array(cuts)
    return order, bounds


SHARD = pa.schema([("u", pa.float64()), ("n", pa.int64()), ("rows", pa.list_(pa.int64())), ("ids", pa.list_(pa.int64())), ("leaves", pa.list_(pa.int64())), ("v", pa.list_(pa.int64()))])


def _built(size: int, leaf: int):
    """Shards of the rows of a task, with their trees."""
    limit = max(1, SHARD_BYTES // (8 * max(1, size)))

    def shard(row: np.ndarray, ids: list, v: np.ndarray) -> pa.RecordBatch:
        order, bounds = median_order(v, leaf)
        # Within a leaf by vec_id, null last.
        key = np.array([_LONG if x is None else x for x in ids], np.int64)[order]
        none = np.array([x is None for x in ids], bool)[order]
        own = np.lexsort((none, key, np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))))
        order = order[own]
        u = np.random.default_rng(int(row[0])).random()  # the same each time the task runs
        columns = [u, len(row), row[order].tolist(), [ids[i] for i in order], bounds.tolist(), pa.array(v[order].ravel())]
        flat = pa.ListArray.from_arrays(pa.array([0, len(columns[5])], pa.int32()), columns[5])
        return pa.RecordBatch.from_arrays([*(pa.array([c], f.type) for c, f in zip(columns[:5], SHARD)), flat], schema=SHARD)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, ids, v, held = [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, limit):
                part = batch.slice(at, limit)
                row.append(part.column("row").to_numpy()), ids.extend(part.column("vec_id").to_pylist())
                v.append(part.column("v").flatten().to_numpy().reshape(part.num_rows, size))
                held += part.num_rows
                if held >= limit:
                    r, w = np.concatenate(row), np.concatenate(v)
                    yield shard(r[:limit], ids[:limit], w[:limit])
                    row, ids, v, held = [r[limit:]], ids[limit:], [w[limit:]], held - limit
        if held:
            yield shard(np.concatenate(row), ids, np.concatenate(v))

    return rows


@dataclass
class Tree:
    """A shard's tree. Node i has the children 2 i + 1 and 2 i + 2; the leaves come last."""

    rows: np.ndarray
    ids: np.ndarray  # a null id as the largest long
    none: np.ndarray
    v: np.ndarray
    leaves: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray, ids: list, v: np.ndarray, leaves: np.ndarray) -> Tree:
        count = len(leaves) - 1
        low, high = np.zeros((2, 2 * count - 1, v.shape[1]))
        for i in range(count):
            part = v[leaves[i] : leaves[i + 1]]
            if len(part) and v.shape[1]:
                low[count - 1 + i], high[count - 1 + i] = part.min(axis=0), part.max(axis=0)
        for i in range(count - 2, -1, -1):
            low[i], high[i] = np.minimum(low[2 * i + 1], low[2 * i + 2]), np.maximum(high[2 * i + 1], high[2 * i + 2])
        none = np.array([x is None for x in ids], bool)
        return cls(rows, np.array([_LONG if x is None else x for x in ids], np.int64), none, v, leaves, low, high)


class Best:
    """The k best (score, id) of several queries so far; `floor` is a score that the k-th surely has elsewhere."""

    def __init__(self, count: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor
        self.query, self.score, self.place = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.kth = floor.copy()

    def add(self, query: np.ndarray, score: np.ndarray, place: np.ndarray, tie: np.ndarray) -> None:
        """place: rows of the tree; tie: their rank by id."""
        query, score, place = np.concatenate([self.query, query]), np.concatenate([self.score, score]), np.concatenate([self.place, place])
        order = np.lexsort((tie[place], -score, query))
        query, score, place = query[order], score[order], place[order]
        nth = np.arange(len(query)) - np.searchsorted(query, query)
        keep = nth < self.k
        self.query, self.score, self.place = query[keep], score[keep], place[keep]
        full = nth == self.k - 1
        self.kth[query[full]] = np.maximum(self.floor[query[full]], score[full])


def walk(tree: Tree, q: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray) -> Best:
    """Best-first search of a tree by queries side by side (q: whole numbers as doubles, small enough for exact sums)."""
    count, best = len(tree.leaves) - 1, Best(len(q), k, floor)
    tie = np.empty(len(tree.ids), np.int64)
    tie[np.lexsort((tree.none, tree.ids))] = np.arange(len(tree.ids))
    bound = np.maximum(q, 0) @ tree.high.T + np.minimum(q, 0) @ tree.low.T
    front = np.full(bound.shape, -np.inf)
    front[:, 0] = bound[:, 0]
    active = np.arange(len(q))
    while len(active):
        node = front[active].argmax(axis=1)
        top = front[active, node]
        # A box whose bound equals the k-th score may hold a smaller id: only a bound strictly below it ends a search.
        live = (top > -np.inf) & (top >= best.kth[active])
        active, node = active[live], node[live]
        front[active, node] = -np.inf
        inner = node < count - 1
        a, n = active[inner], node[inner]
        front[a, 2 * n + 1], front[a, 2 * n + 2] = bound[a, 2 * n + 1], bound[a, 2 * n + 2]
        a, n = active[~inner], node[~inner] - (count - 1)
        for leaf in np.unique(n):
            who = a[n == leaf]
            first, last = tree.leaves[leaf], tree.leaves[leaf + 1]
            if first == last:
                continue
            score = q[who] @ tree.v[first:last].T
            score[own[who][:, None] == tree.rows[first:last]] = -np.inf
            least = best.kth[who]
            if last - first > k:
                least = np.maximum(least, np.partition(score, -k, axis=1)[:, -k])
            i, j = np.nonzero((score >= least[:, None]) & (score > -np.inf))
            if len(i):
                best.add(who[i], score[i, j], first + j, tie)
    return best


HIT = pa.schema([("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of any whole numbers, held within a long."""
    found = q.astype(object) @ v.astype(object).T if v.shape[1] else np.zeros((len(q), len(v)), object)
    return np.array([[min(max(int(x), -_LONG - 1), _LONG) for x in line] for line in found], np.int64).reshape(len(q), len(v))


def _searched(shared, size: int, k: int):
    """The k best of each shard for each query that reach the query's k-th score so far."""
    # Sums of products of numbers up to this are exact in doubles.
    small = math.isqrt((1 << 53) // max(1, size)) - 1

    def hits(q: np.ndarray, place: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(ids[place], mask=none[place]), pa.array(score.astype(np.int64))], schema=HIT)

    def slow(rows: np.ndarray, ids: np.ndarray, none: np.ndarray, v: np.ndarray, q: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Vectors with components too large for doubles, query by query."""
        for one, me in zip(q, own):
            score = exact_scores(one[None], v)[0]
            at = np.flatnonzero(rows != me)
            at = at[np.lexsort((none[at], ids[at], -score[at].astype(object)))][:k]
            yield hits(np.full(len(at), me), at, score[at], ids, none)

    def shard(row: dict, queries: dict) -> Iterator[pa.RecordBatch]:
        rows, leaves = np.array(row["rows"], np.int64), np.array(row["leaves"], np.int64)
        v = row["v"].reshape(row["n"], size)
        fits = (np.abs(v) <= small).all(axis=1)
        easy = (np.abs(queries["v"]) <= small).all(axis=1)
        keep = np.concatenate([[0], np.cumsum(fits)])
        ids = [x for x, f in zip(row["ids"], fits) if f]
        tree = Tree.of(rows[fits], ids, v[fits].astype(float), keep[leaves])
        for at in range(0, len(easy), SLICE):
            own = queries["row"][at : at + SLICE][easy[at : at + SLICE]]
            q = queries["v"][at : at + SLICE][easy[at : at + SLICE]].astype(float)
            if len(q) and len(ids):
                best = walk(tree, q, own, k, queries["floor"][at : at + SLICE][easy[at : at + SLICE]])
                yield hits(own[best.query], best.place, best.score, tree.ids, tree.none)
        if not easy.all() or not fits.all():
            all_ids = np.array([_LONG if x is None else x for x in row["ids"]], np.int64)
            none = np.array([x is None for x in row["ids"]], bool)
            yield from slow(rows, all_ids, none, v, queries["v"][~easy], queries["row"][~easy])
            yield from slow(rows[~fits], all_ids[~fits], none[~fits], v[~fits], queries["v"][easy], queries["row"][easy])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                row = {c: one.column(c)[0].as_py() for c in ("n", "rows", "ids", "leaves")}
                yield from shard(row | {"v": one.column("v").flatten().to_numpy()}, shared.value)

    return run


def rounds(total: int, first: int, growth: int) -> list[tuple[float, float]]:
    """Ranges of u in [0, 1): about `first` shards, then `growth` times as many each time."""
    edges, at = [0.0], float(first)
    while at < total:
        edges.append(at / total)
        at *= growth
    return list(zip(edges, [*edges[1:], 1.0]))


def best_of(hits: DataFrame, k: int, by: str, *order) -> DataFrame:
    """The k first rows of each `by`, with their rank."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def kd_topk(vectors: DataFrame, is_query: Column | None = None, k: int = K, leaf: int = LEAF, block_bytes: int = BLOCK_BYTES, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """vectors: vec_id, embedding. is_query: which rows are queries (those whose vec_id is divisible by EVERY). Returns
    query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    ship(spark)
    asks = F.coalesce(is_query if is_query is not None else F.col("vec_id") % EVERY == 0, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), scaled(F.col("embedding")).alias("v"), asks.alias("asks")).where("v is not null")
    rows = written(rows.withColumns({"row": F.monotonically_increasing_id(), "size": F.size("v")}), "kd-rows")
    sizes = rows.groupBy("size").agg(F.count_if("asks").alias("asked")).where("asked > 0").orderBy("size").collect()  # lengths are few
    found = None
    for size, asked in sizes:
        one = _of_size(rows.where(F.col("size") == size), size, asked, k, leaf, block_bytes, first, growth)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    return found


def _of_size(rows: DataFrame, size: int, asked: int, k: int, leaf: int, block_bytes: int, first: int, growth: int) -> DataFrame:
    """The search among vectors of one length."""
    spark = rows.sparkSession
    ddl = "u double, n bigint, rows array<bigint>, ids array<bigint>, leaves array<bigint>, v array<bigint>"
    index = written(rows.select("row", "vec_id", "v").mapInArrow(_built(size, leaf), ddl), "kd-index", **{"parquet.block.size": str(2 * SHARD_BYTES)})
    shards = index.count()
    per_block = max(1, block_bytes // (8 * max(1, size)))
    blocks = -(-asked // per_block)
    queries = rows.where("asks").withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    found = None
    for b in range(blocks):
        # About per_block rows: what the driver and a broadcast hold.
        mine = queries.where(F.col("block") == b).select("row", "v").toArrow()
        row = mine.column("row").to_numpy()
        v = mine.column("v").combine_chunks().flatten().to_numpy().reshape(len(row), size) if len(row) else np.zeros((0, size), np.int64)
        best, floor = None, np.full(len(row), -np.inf)
        place = {r: i for i, r in enumerate(row.tolist())}
        for low, high in rounds(shards, first, growth):
            shared = spark.sparkContext.broadcast({"row": row, "v": v, "floor": floor})
            hits = index.where((F.col("u") >= low) & (F.col("u") < high)).mapInArrow(_searched(shared, size, k), "q bigint, vec_id bigint, score bigint")
            hits = hits if best is None else hits.unionByName(best.select("q", "vec_id", "score"))
            now = written(best_of(hits, k, "q", F.desc("score"), F.asc_nulls_last("vec_id")), "kd-hits")
            discard(*[best] * (best is not None))
            best = now
            if high < 1.0:
                floor = np.full(len(row), -np.inf)
                for q, score in best.where(F.col("rank") == k).select("q", "score").collect():  # one a query of the block
                    floor[place[q]] = np.nextafter(float(score), -np.inf) if abs(score) > 1 << 53 else float(score)
        found = best if found is None else found.unionByName(best)
    discard(index)
    return found.join(written(queries.select("row", F.col("vec_id").alias("query_id")), "kd-queries").hint("merge"), F.col("q") == F.col("row")).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, q.r, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v q JOIN v ON q.r <> v.r AND len(q.e) = len(v.e)
  WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
