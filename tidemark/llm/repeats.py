"""Windows of W units (bytes or words) that start at two or more places of a corpus.

Every window is filed under the smallest hash of the K-grams in it (its anchor). Equal windows have equal anchors, so
repeats are found per anchor, exactly, while a text moves only about two rows per W-K+2 units. Consecutive windows with
one anchor form a *run* of bounded length; a run is stored as positions and a digest of its content, not as text.

0. Rows equal in doc_id and text are counted first and read once from then on: every window of such a row is repeated.
1. Write the runs, and count them per anchor. An anchor met once is dropped: its windows are unique.
2. Equal runs of an anchor are one *kind*, kept with its number of copies: a kind met twice is repeated as a whole. An
   anchor of a single kind needs no more than that number.
3. An index over the kinds of each other anchor finds the repeated windows of the kinds met once. Its groups are bounded
   in units of text.
4. An anchor whose kinds are more than a group may hold is split by a longer prefix: windows are filed under the anchor
   with about half a window of what follows it (or, where the anchor stands late in the window, of what comes before it).
   Equal windows have the same place of the anchor and so the same prefix. Steps 2 and 3 are done again with these groups.
5. Where even half a window is shared by too many kinds, the prefix is the whole window, which is then counted.
6. The spans of each document are gathered and applied to its text.

Kinds are told apart by anchor and content digest, 128 bits together; the index compares the content itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, chunks, discard, written

U64 = np.uint64
_rng = np.random.default_rng(20240607)
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = U64(0x9E3779B97F4A7C15)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


@dataclass(frozen=True)
class Windows:
    """width: units in a window; gram: units in an anchor; words: units are words, else bytes; hot: units of text that a group
    of the index may hold."""

    width: int
    gram: int
    words: bool
    hot: int

    @property
    def prefix(self) -> int:
        """Units of the longer prefix: as many as surely follow or precede the anchor in a window."""
        return (self.width + self.gram + 1) // 2


#: Windows of a run, at most.
LONGEST = 8192
#: Tasks that a repeated window of the last step is dealt to.
SALTS = 16
#: Keys of repeated rows that are broadcast, at most (16 bytes each); more are joined by a shuffle.
TWINS = 1 << 18
#: Stands for the end of any text.
WHOLE = 1 << 48


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U64(31))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(29)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(32)
    return h


def gram_hashes(units: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive units, by doubling."""
    power, have, done, out = BASE, units, 0, None
    size = 1
    while True:
        if k & size:
            out = _joined(have, size, out, done)
            done += size
        if size * 2 > k:
            break
        have = have[:-size] * power + have[size:] if len(have) > size else have[:0]
        power = pow_u64(power, 2)
        size *= 2
    return mixed(out)


def pow_u64(x: np.uint64, n: int) -> np.uint64:
    return U64(pow(int(x), n, 2**64))


def _joined(left: np.ndarray, size: int, right: np.ndarray | None, done: int) -> np.ndarray:
    """Hashes of size + done units from those of the first size units and of the done units behind them."""
    if right is None:
        return left
    n = max(0, len(right) - size)
    return left[:n] * pow_u64(BASE, done) + right[size : size + n]


def window_min(h: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w consecutive hashes."""
    size, m = 1, h
    while size * 2 <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return m if size == w else np.minimum(m[: len(m) - (w - size)], m[w - size :])


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes."""
    gap = np.ones(len(buf) + 2, bool)
    gap[1:-1] = SPACE[buf]
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[0::2], edge[1::2]


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the sum of mixed values of its bytes and their places."""
    if not len(starts):
        return np.zeros(0, U64)
    lens = ends - starts
    total = np.cumsum(lens)
    place = np.arange(total[-1]) - np.repeat(total - lens, lens)
    chars = buf[np.repeat(starts, lens) + place]
    return np.add.reduceat(mixed(BYTE_VALUE[chars] + place.astype(U64) * BASE), total - lens) ^ (lens.astype(U64) << U64(56))


def squeezed(text: bytes) -> bytes:
    """The words of a text with one space between them."""
    return b" ".join(text.split())


@dataclass
class Units:
    """Hashed units of several texts in a row; text i has units offsets[i] to offsets[i + 1]. Unit i of the row is
    raw[starts[i]:ends[i]]."""

    hashes: np.ndarray
    offsets: np.ndarray
    raw: bytes
    starts: np.ndarray
    ends: np.ndarray


def units_of(texts: list[bytes], words: bool) -> Units:
    """texts: of words, with one space between them."""
    raw = (b"\n" if words else b"").join(texts)
    buf = np.frombuffer(raw, np.uint8)
    lens = np.array([len(x) for x in texts], np.int64)
    if not words:
        at = np.arange(len(buf) + 1)
        return Units(BYTE_VALUE[buf], np.concatenate([[0], np.cumsum(lens)]), raw, at[:-1], at[1:])
    starts, ends = word_bounds(buf)
    return Units(word_hashes(buf, starts, ends), np.searchsorted(starts, np.concatenate([[0], np.cumsum(lens + 1)])), raw, starts, ends)


def digests(u: Units, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A digest of the content of units first[i] to last[i]."""
    view, digest = memoryview(u.raw), xxhash.xxh3_64_intdigest
    return np.array([digest(view[a:b]) for a, b in zip(u.starts[first].tolist(), u.ends[last].tolist())], U64).view(np.int64)


def runs_of(u: Units, spec: Windows):
    """Runs of all texts: text number, start in the text, windows (negative if a window may repeat inside), anchor, digest."""
    W, none, offsets = spec.width, (np.zeros(0, np.int64),) * 5, u.offsets
    if len(u.hashes) < W:
        return none
    h = gram_hashes(u.hashes, spec.gram)
    m = window_min(h, W - spec.gram + 1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(m)]
    at = np.arange(len(m))
    ok = at + W <= offsets[1:][text]
    new = np.empty(len(m), bool)
    new[0] = True
    new[1:] = (m[1:] != m[:-1]) | (text[1:] != text[:-1]) | (ok[1:] != ok[:-1])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(m)))
    keep = ok[first]
    first, n = first[keep], n[keep]
    if not len(first):
        return none
    if n.max() > LONGEST:
        parts = -(-n // LONGEST)
        nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        first, n = np.repeat(first, parts) + nth * LONGEST, np.minimum(LONGEST, np.repeat(n, parts) - nth * LONGEST)
    anchor = m[first]
    small = np.flatnonzero(h <= anchor.max())
    order = np.lexsort((small, h[small]))
    small = small[order]
    twice = (h[small][1:] == h[small][:-1]) & (small[1:] - small[:-1] < 2 * W)
    again = np.isin(anchor, h[small][1:][twice]) if twice.any() else np.zeros(len(first), bool)
    return text[first], first - offsets[:-1][text[first]], np.where(again, -n, n), anchor.view(np.int64), digests(u, first, first + n + W - 2)


RUN = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("mh", pa.int64()), ("sh", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])


def pieces_of(texts: list[bytes], spec: Windows, limit: int = 1 << 20) -> list[tuple[int, int, bytes]]:
    """Texts, very long ones in byte pieces that overlap by a window less one unit: (text number, first unit, bytes)."""
    out = []
    for i, x in enumerate(texts):
        if len(x) <= 2 * limit:
            out.append((i, 0, x))
        elif spec.words:
            starts, ends = word_bounds(np.frombuffer(x, np.uint8))
            step = max(1, limit // max(1, len(x) // max(1, len(starts))))
            for a in range(0, max(1, len(starts) - spec.width + 1), step):
                b = min(len(starts), a + step + spec.width - 1)
                out.append((i, a, x[starts[a] : ends[b - 1]]))
        else:
            for a in range(0, len(x) - spec.width + 1, limit):
                out.append((i, a, x[a : a + limit + spec.width - 1]))
    return out


def run_rows(spec: Windows) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            r1, r2 = (batch.column(c).to_numpy() for c in ("r1", "r2"))
            pieces = pieces_of([squeezed(x) for x in texts] if spec.words else texts, spec)
            groups = [pieces] if sum(len(p[2]) for p in pieces) <= 4 * CHUNK_BYTES else [[p] for p in pieces]
            for group in groups:
                t, start, n, mh, sh = runs_of(units_of([p[2] for p in group], spec.words), spec)
                if len(t):
                    who, base = np.array([p[0] for p in group])[t], np.array([p[1] for p in group])[t]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (r1[who], r2[who], mh, sh, start + base, n)], schema=RUN)

    return rows


def cut(text: bytes, spec: Windows, starts: list[int], ns: list[int]) -> list[bytes]:
    """The bytes of each run of a text; words have one space between them."""
    if not spec.words:
        return [text[a : a + n + spec.width - 1] for a, n in zip(starts, ns)]
    whole = squeezed(text)
    first, last = word_bounds(np.frombuffer(whole, np.uint8))
    return [whole[first[a] : last[a + n + spec.width - 2]] for a, n in zip(starts, ns)]


PIECE = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("mh", pa.int64()), ("sh", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("once", pa.bool_()), ("body", pa.binary())])


def _pieces(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size."""
    out: list[tuple] = []
    size = 0
    for row in rows:
        out.append(row)
        size += len(row[-1])
        if len(out) >= 4096 or size >= 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], schema=PIECE)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECE)], schema=PIECE)


def run_bodies(spec: Windows):
    """Each run with its bytes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch, texts in chunks(batches):
            for r1, r2, runs, text in zip(batch.column("r1").to_pylist(), batch.column("r2").to_pylist(), batch.column("runs").to_pylist(), texts):
                for x, body in zip(runs, cut(text, spec, [x["start"] for x in runs], [x["n"] for x in runs])):
                    yield r1, r2, x["mh"], x["sh"], x["start"], x["n"], x["once"], body

    return lambda batches: _pieces(rows(batches))


def finer_runs(spec: Windows):
    """Runs filed under a longer prefix: the anchor with what follows it, or what comes before it, in all windows of the run."""
    W, K, L = spec.width, spec.gram, spec.prefix

    def parts(mh: int, body: bytes) -> Iterator[tuple[int, int, int, int, bytes]]:
        u = units_of([body], spec.words)
        n = len(u.hashes) - W + 1
        places = np.flatnonzero(gram_hashes(u.hashes, K).view(np.int64) == mh)
        at = places[np.searchsorted(places, np.arange(n))]  # the first anchor in each window
        behind = at - np.arange(n) + L <= W
        new = np.flatnonzero((at[1:] != at[:-1]) | (behind[1:] != behind[:-1])) + 1
        first = np.concatenate([[0], new])
        count = np.diff(np.append(first, n))
        begin = np.where(behind[first], at[first], at[first] + K - L)
        key = digests(u, begin, begin + L - 1)
        own = digests(u, first, first + count + W - 2)
        for a, c, k, side, d in zip(first.tolist(), count.tolist(), key.tolist(), behind[first].tolist(), own.tolist()):
            filed = xxhash.xxh3_64_intdigest(b"%d %d %d" % (mh, k, side)) - 2**63
            yield a, c, filed, d, u.raw[u.starts[a] : u.ends[a + c + W - 2]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r1, r2, mh, start, body in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "mh", "start", "body"))):
                for a, c, filed, own, part in parts(mh, body):
                    yield r1, r2, filed, own, start + a, c, True, part

    return lambda batches: _pieces(rows(batches))


SPAN = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def true_runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
    return edge[0::2], edge[1::2]


def indexed(spec: Windows, repeated: Callable[[np.ndarray, np.ndarray], np.ndarray], limit: int = 1 << 19):
    """Spans of repeated windows, from rows sorted by anchor. repeated(units, rest) is the index over whole anchor groups:
    units of several runs with an end mark after each, rest: units left in the run from each place; True where the
    window that starts there also starts elsewhere."""

    def solve(rows: list[tuple]) -> pa.RecordBatch | None:
        if spec.words:
            split = [x[5].split() for x in rows]
            lens = np.array(list(map(len, split)))
            flat = pd.factorize(np.array([w for words in split for w in words], object))[0]
            parts = split
        else:
            parts = [x[5] for x in rows]
            lens = np.array(list(map(len, parts)))
            flat = np.frombuffer(b"".join(parts), np.uint8)
        marks = np.zeros(len(flat) + len(parts), np.int64)
        ends = np.cumsum(lens + 1)
        inner = np.ones(len(marks), bool)
        inner[ends - 1] = False
        marks[inner] = flat.astype(np.int64) + 1
        at = np.arange(len(marks))
        who = np.repeat(np.arange(len(parts)), lens + 1)
        rest = ends[who] - 1 - at
        hit = repeated(marks, rest) & (rest >= spec.width) & np.array([x[4] for x in rows])[who]
        a, b = true_runs(hit)
        if not len(a):
            return None
        w = who[a]
        base = np.array([x[3] for x in rows])[w] - (ends - lens - 1)[w]
        return pa.RecordBatch.from_arrays([pa.array(np.array([x[0] for x in rows])[w]), pa.array(np.array([x[1] for x in rows])[w]), pa.array(a + base), pa.array(b + base)], schema=SPAN)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "mh", "start", "once", "body"))):
                if size >= limit and row[2] != held[-1][2]:
                    if (out := solve(held)) is not None:
                        yield out
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held and (out := solve(held)) is not None:
            yield out

    return rows


WINDOW = pa.schema([("r1", pa.int64()), ("r2", pa.int64()), ("start", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())])


def single_windows(spec: Windows):
    """Each window of runs of hot anchors with its 128-bit digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int, int]] = []
        for batch in batches:
            for r1, r2, start, n, body in zip(*(batch.column(c).to_pylist() for c in ("r1", "r2", "start", "n", "body"))):
                u = units_of([body], spec.words)
                for i in range(n):
                    d = xxhash.xxh3_128_intdigest(u.raw[u.starts[i] : u.ends[i + spec.width - 1]])
                    out.append((r1, r2, start + i, (d >> 64) - 2**63, (d & (2**64 - 1)) - 2**63))
                if len(out) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=WINDOW)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=WINDOW)

    return rows


def ddl(schema: pa.Schema) -> str:
    kind = {pa.int64(): "bigint", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kind[f.type]}" for f in schema)


def _distinct_rows(keyed_docs: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(r1, r2, text) with one row per key, and the keys that more than one row has. Only rows with such a key are shuffled,
    combined in their tasks first."""
    texts = keyed_docs.select("r1", "r2", "text")
    twins = written(texts.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("r1", "r2"), "twins")
    n = twins.count()
    if not n:
        return texts, twins
    known = F.broadcast(twins) if n <= limit else twins.hint("merge")
    several = texts.join(known, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.max("text").alias("text"))
    return texts.join(known, ["r1", "r2"], "left_anti").unionByName(several), twins


def with_spans(keyed_docs: DataFrame, spec: Windows, repeated: Callable[[np.ndarray, np.ndarray], np.ndarray], twin_limit: int = TWINS) -> DataFrame:
    """keyed_docs (see common.keyed) with `spans`: an array of (a, b), the windows that start at units a to b - 1 are repeated."""
    one = F.count(F.lit(1))
    span = ("r1", "r2", F.col("start").alias("a"), (F.col("start") + F.col("n")).alias("b"))
    sole, twins = _distinct_rows(keyed_docs, twin_limit)
    runs = written(sole.mapInArrow(run_rows(spec), ddl(RUN)), "runs")
    per_anchor = runs.groupBy("mh").agg(one.alias("total"), F.min("sh").alias("lo"), F.max("sh").alias("hi"), F.min("n").alias("least")).where("total > 1 or least < 0")
    # Small sides are written out: a join whose sides are plain exchanges can have a very frequent anchor split by Spark.
    per_anchor = written(per_anchor.select("mh", ((F.col("lo") != F.col("hi")) | (F.col("least") < 0)).alias("contested")), "anchors")
    hits = written(runs.join(per_anchor.hint("merge"), "mh").select("r1", "r2", "mh", "sh", "start", F.abs("n").alias("n"), "contested"), "hits")
    discard(runs, per_anchor)
    contested = hits.where("contested")
    kinds = contested.groupBy("mh", "sh").agg(one.alias("copies"), F.min(F.struct("r1", "r2", "start")).alias("rep"), F.min("n").alias("n"))
    kinds = _sized(written(kinds, "kinds"), spec)
    place = F.struct("r1", "r2", "start")
    named = contested.join(kinds.drop("n").hint("merge"), ["mh", "sh"])
    run = F.struct("mh", "sh", "start", "n", (F.col("copies") == 1).alias("once"))
    reps = named.where(place == F.col("rep"))

    def bodies(rows: DataFrame) -> DataFrame:
        per_doc = rows.groupBy("r1", "r2").agg(F.collect_list(run).alias("runs"))
        return sole.join(per_doc.hint("merge"), ["r1", "r2"]).mapInArrow(run_bodies(spec), ddl(PIECE))

    index = lambda rows: rows.repartition("mh").sortWithinPartitions("mh").mapInArrow(indexed(spec, repeated, min(spec.hot, 1 << 19)), ddl(SPAN))
    found = index(bodies(reps.where(F.col("units") <= spec.hot)))
    whole = hits.where("not contested").select(*span).unionByName(named.where("copies > 1").select(*span))
    # Anchors with too many kinds: the same with longer prefixes, then with whole windows.
    finer = written(bodies(reps.where(F.col("units") > spec.hot)).mapInArrow(finer_runs(spec), ddl(PIECE)), "finer")
    again = finer.groupBy("mh", "sh").agg(one.alias("copies"), F.min(place).alias("rep"), F.min("n").alias("n"))
    again = _sized(written(again, "finer-kinds"), spec)
    split = finer.drop("once").join(again.drop("n").hint("merge"), ["mh", "sh"]).withColumn("once", F.col("copies") == 1)
    ours = split.where(place == F.col("rep"))
    found = found.unionByName(index(ours.where(F.col("units") <= spec.hot).select(*PIECE.names)))
    whole = whole.unionByName(split.where("copies > 1").select(*span))
    single = ours.where(F.col("units") > spec.hot).mapInArrow(single_windows(spec), ddl(WINDOW))
    twice = written(single.groupBy("w1", "w2").agg(one.alias("c")).where("c > 1").select("w1", "w2"), "windows")
    # A window in very many contexts is dealt to several tasks.
    dealt = single.withColumn("salt", F.pmod(F.xxhash64("r1", "start"), F.lit(SALTS)).cast("int"))
    salted = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    counted = dealt.join(salted.hint("merge"), ["w1", "w2", "salt"]).select("r1", "r2", F.col("start").alias("a"), (F.col("start") + 1).alias("b"))
    alike = twins.select("r1", "r2", F.lit(0).cast("bigint").alias("a"), F.lit(WHOLE).cast("bigint").alias("b"))
    spans = whole.unionByName(found).unionByName(counted).unionByName(alike).groupBy("r1", "r2").agg(F.collect_list(F.struct("a", "b")).alias("spans"))
    # Written out, so that a key that very many rows share can be split.
    return keyed_docs.join(written(spans, "spans").hint("merge"), ["r1", "r2"], "left")


def _sized(kinds: DataFrame, spec: Windows) -> DataFrame:
    """Kinds with `units`: how much text the kinds of their anchor have together."""
    units = kinds.groupBy("mh").agg(F.sum(F.col("n") + spec.width - 1).alias("units"))
    return written(kinds.join(written(units, "units").hint("merge"), "mh"), "sized")


def covered(spans: list[dict] | None, units: int, width: int) -> list[tuple[int, int]]:
    """The maximal runs of units that repeated windows cover, ascending."""
    if units < width:
        return []
    out: list[list[int]] = []
    for a, b in sorted((x["a"], x["b"] + width - 1) for x in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, units)) for a, b in out]
