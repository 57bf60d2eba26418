"""Exact nearest neighbours of stated queries: pivots, and lower bounds from the triangle inequality.

Rows are points: numbers scaled to the width of their range, and categories that add 1 to the squared distance where they
differ (as points on a simplex would), so distances obey the triangle inequality. Pivots are a few of the rows. A task takes
its rows in parts of at most PART_ROWS, puts rows with the same nearest pivot side by side by their distance from it, and
cuts them into chunks with the span of the distances to every pivot. A query, whose distances to the pivots are known too, is
as far from a chunk as the widest gap between these, and from a chunk whose categories all differ from its own by at least
that; it opens chunks from the nearest on until the next is further than its k-th neighbour.

Queries are the small side, broadcast in blocks; rows stay where they lie. What leaves a task are k rows a query and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.shipping import ship
from tidemark.storage import written

PIVOTS = 12
PART_ROWS, CHUNK = 16_384, 64
#: Queries of a block, which the driver and every task hold.
BLOCK = 20_000
SLICE = 256
#: Distances are compared as they are shown.
DIGITS = 8


def codes(columns: list[list], seen: list[dict]) -> np.ndarray:
    """Categories as numbers, the same in rows and queries; a missing one equals nothing."""
    out = np.zeros((len(columns[0]) if columns else 0, len(columns)), np.int64)
    for c, values in enumerate(columns):
        out[:, c] = [-1 if v is None else seen[c].setdefault(v, len(seen[c])) for v in values]
    return out


def distances(x: np.ndarray, cx: np.ndarray, y: np.ndarray, cy: np.ndarray) -> np.ndarray:
    """Distances of rows x and y, all with all; -1 is no category."""
    square = np.zeros((len(x), len(y)))
    for a in range(0, len(x), 64):
        d = x[a : a + 64, None, :] - y[None, :, :]
        square[a : a + 64] = (d * d).sum(axis=2)
    for c in range(cx.shape[1]):
        square += (cx[:, c][:, None] != cy[:, c]) | (cx[:, c] < 0)[:, None]
    return np.sqrt(square)


class Part:
    """Some rows in chunks around pivots."""

    def __init__(self, x: np.ndarray, cat: np.ndarray, ids: np.ndarray, pivots: np.ndarray, pivot_cat: np.ndarray):
        far = distances(x, cat, pivots, pivot_cat)
        near = far.argmin(axis=1) if len(pivots) else np.zeros(len(x), np.int64)
        order = np.lexsort((far[np.arange(len(x)), near] if len(pivots) else ids, near))
        self.x, self.cat, self.ids, far = x[order], cat[order], ids[order], far[order]
        first = np.arange(0, len(x), CHUNK)
        self.first, self.last = first, np.append(first[1:], len(x))
        self.low, self.high = np.minimum.reduceat(far, first), np.maximum.reduceat(far, first)
        self.kinds = [[set(self.cat[a:b, c].tolist()) for c in range(cat.shape[1])] for a, b in zip(self.first, self.last)]

    def bounds(self, to_pivots: np.ndarray, cat: np.ndarray) -> np.ndarray:
        """The least distance of queries and chunks. to_pivots: distances of queries and pivots."""
        out = np.zeros((len(to_pivots), len(self.first)))
        for p in range(to_pivots.shape[1]):
            d = to_pivots[:, p][:, None]
            np.maximum(out, np.maximum(self.low[:, p] - d, d - self.high[:, p]), out=out)
        if cat.shape[1]:
            differ = np.zeros(out.shape)
            for c in range(cat.shape[1]):
                for value in np.unique(cat[:, c]):
                    without = np.array([value < 0 or value not in kinds[c] for kinds in self.kinds])
                    differ[np.ix_(cat[:, c] == value, without)] += 1
            np.maximum(out, np.sqrt(differ), out=out)
        return out - 1e-9

    def best(self, q: np.ndarray, cat: np.ndarray, to_pivots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """(query, row, distance) of the k nearest rows of each query, and how many distances were computed."""
        front, computed = self.bounds(to_pivots, cat), 0
        kth = np.full(len(q), np.inf)
        who, row, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        active = np.arange(len(q))
        while len(active):
            chunk = front[active].argmin(axis=1)
            # A chunk as far as the k-th neighbour may hold a smaller id.
            live = front[active, chunk] <= kth[active] + 10.0**-DIGITS
            live &= front[active, chunk] < np.inf
            active, chunk = active[live], chunk[live]
            front[active, chunk] = np.inf
            for c in np.unique(chunk):
                own = active[chunk == c]
                a, b = self.first[c], self.last[c]
                d = np.round(distances(q[own], cat[own], self.x[a:b], self.cat[a:b]), DIGITS)
                computed += d.size
                i, j = np.nonzero(d <= kth[own][:, None])
                who, row, dist = np.concatenate([who, own[i]]), np.concatenate([row, a + j]), np.concatenate([dist, d[i, j]])
            order = np.lexsort((self.ids[row], dist, who))
            who, row, dist = who[order], row[order], dist[order]
            nth = np.arange(len(who)) - np.searchsorted(who, who)
            kth[who[nth == k - 1]] = dist[nth == k - 1]
            who, row, dist = who[nth < k], row[nth < k], dist[nth < k]
        return who, row, dist, computed


OUT = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("distance", pa.float64()), ("computed", pa.int64())])


def _searched(shared, categorical: int, k: int):
    """k rows a query and part, and one row (q null) with the number of distances that the part took."""

    def part_of(batches: list[pa.RecordBatch], sent: dict) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        size = sent["x"].shape[1]
        x = table["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(table), size)
        cat = codes([table[f"c{i}"].to_pylist() for i in range(categorical)], [dict(s) for s in sent["seen"]]) if categorical else np.zeros((len(table), 0), np.int64)
        part = Part(x, cat, table["id"].to_numpy(), sent["pivots"], sent["pivot_cat"])
        total = 0
        for a in range(0, len(sent["x"]), SLICE):
            s = slice(a, a + SLICE)
            who, row, dist, computed = part.best(sent["x"][s], sent["cat"][s], sent["to_pivots"][s], k)
            total += computed
            yield pa.RecordBatch.from_arrays([pa.array(sent["ids"][s][who]), pa.array(part.ids[row]), pa.array(dist), pa.array(np.zeros(len(who), np.int64))], schema=OUT)
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([len(x) * len(sent["x"])]), pa.array([0.0]), pa.array([total])], schema=OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                piece = batch.slice(at, PART_ROWS)
                if held and sum(b.num_rows for b in held) + piece.num_rows > PART_ROWS:
                    yield from part_of(held, shared.value)
                    held = []
                held.append(piece)
        if held:
            yield from part_of(held, shared.value)

    return run


def nearest(train: DataFrame, queries: DataFrame, numeric: list[str] | str, categorical: list[str], key: str, k: int, pivots: int = PIVOTS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(neighbours, effort). neighbours: q (the query's key), key, distance, rank; numbers (columns, or one array column of any
    length) are scaled to the width of their range in train. effort: pairs, and how many distances were computed."""
    spark = train.sparkSession
    ship(spark)
    vector = F.col(numeric) if isinstance(numeric, str) else F.array(*numeric)
    bounds = train.select(F.posexplode(vector).alias("i", "x")).groupBy("i").agg((F.max("x") - F.min("x")).alias("w")).orderBy("i").collect()  # a row per place
    widths = F.array(*(F.lit(float(r.w or 1.0)) for r in bounds))
    scaled = F.transform(F.arrays_zip(vector.alias("x"), widths.alias("w")), lambda p: p["x"].cast("double") / p["w"])
    point = lambda rows: rows.select(F.col(key).cast("bigint").alias("id"), scaled.alias("x"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(categorical)))
    rows, asked = written(point(train), "neighbour-rows"), written(point(queries), "neighbour-queries")
    chosen = rows.orderBy(F.xxhash64("id", F.lit(7))).limit(pivots).toArrow()
    count = asked.count()
    blocks = max(1, -(-count // block))
    size = len(bounds)
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()  # about `block` rows
        seen: list[dict] = [{} for _ in categorical]
        flat = lambda t: (t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(t) else np.zeros(0)).reshape(len(t), size)
        cats = lambda t: codes([t[f"c{i}"].to_pylist() for i in range(len(categorical))], seen) if categorical else np.zeros((len(t), 0), np.int64)
        x, cat, px, pc = flat(mine), cats(mine), flat(chosen), cats(chosen)
        sent = {"ids": mine["id"].to_numpy() if len(mine) else np.zeros(0, np.int64), "x": x, "cat": cat, "pivots": px, "pivot_cat": pc, "to_pivots": distances(x, cat, px, pc), "seen": seen}
        hits = rows.mapInArrow(_searched(spark.sparkContext.broadcast(sent), len(categorical), k), "q bigint, id bigint, distance double, computed bigint")
        found = hits if found is None else found.unionByName(hits)
    found = written(found, "neighbours")
    by = Window.partitionBy("q").orderBy("distance", "id")
    ranked = found.where("q is not null").withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    effort = found.where("q is null").agg(F.sum("id").alias("pairs"), F.sum("computed").alias("computed"))
    return ranked.select("q", F.col("id").alias(key), "distance", "rank"), effort
