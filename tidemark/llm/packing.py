"""Best-fit packing of tokenised documents into sequences of at most `capacity` tokens, in bulk-synchronous rounds.

A document is its token ids and an end id. Longer ones are cut: the first piece may be shorter, all others are full. Full
pieces are sequences of their own and take no part in the rounds. A round

1. range-sorts the pieces left (by length) and the open sequences (by gap) together, the largest first;
2. sweeps each range in a task: a piece goes to its successor, the smallest gap of the range that holds it, and what is
   left of the gap is open again for the pieces behind it;
3. exchanges across ranges: pieces without a gap in their range go to unused gaps of the nearest range above. Ranks settle
   who gets which: the driver sees only how many pieces and gaps each range has left over and names intervals of ranks,
   two a range at most beside one per range of gaps used up; a gap takes as many pieces as surely fit;
4. takes what was placed off the gaps, and starts again with the pieces left.

A round that places nothing is followed by new sequences: as many as the pieces left would fill without waste, which is
never more than they need. Once the pieces left and the open gaps are no more than the rows of one range, one task places
them all and opens a sequence where no gap holds a piece. Lengths are whole numbers, so a frequent one is split into ranges
by a salt.

Null text is an empty document, which is one end id. Rows equal in every column are packed as separate documents. An
empty table gives an empty result; columns other than doc_id and text are ignored; a very long text is one document of
many full pieces. Ties between equal lengths are settled by salt and position in the table that was written.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, prepared, written

CAPACITY = 2048
END = 0
SALTS = 64
RANGE_ROWS = 50_000  # pieces and gaps of a range, about


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """ids(text) of a byte-level BPE vocabulary. tiktoken gives the ids of `tokenizers` with the same merges at a quarter of
    the time; texts that hold a special token's string go to `tokenizers` itself, which alone knows those."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    exact = Tokenizer.from_file(path)
    specials = [t.content for t in exact.get_added_tokens_decoder().values()]
    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(text: str) -> list[int]:
        if any(s in text for s in specials):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def piece_bounds(n: int, capacity: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens."""
    first = n % capacity or capacity if n > capacity else n
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def _pieces(vocabulary: str, capacity: int, end: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = ids_of(text) if text else []
                ids.append(end)
                data = memoryview(np.array(ids, "<u4")).cast("B")
                for k, (a, n) in enumerate(piece_bounds(len(ids), capacity)):
                    row.append(i), piece.append(k), start.append(a), length.append(n)
                    crc.append(zlib.crc32(data[4 * a : 4 * (a + n)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(c, pa.int64()) for c in (start, length, crc))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return rows


_SWEPT = pa.schema([("part", pa.int32()), ("what", pa.int32()), ("id", pa.int64()), ("to", pa.int64()), ("size", pa.int64())])
_PLACED, _PIECE, _GAP = 0, 1, 2


def _sweep(opened: int | None = None, capacity: int = CAPACITY):
    """From rows (size, is_piece, id) of a range, largest first, gaps before pieces of their size: pieces placed (`to` is the
    sequence), then pieces and untouched gaps left over (`to` is the rank). If `opened` is given, no piece is left over: one
    without a gap opens a sequence, numbered from there, and gaps aren't listed."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        at_gap: dict[int, list[tuple[int, bool]]] = {}
        open_gaps = left = 0  # bit g is set if a gap of size g is open
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for size, is_piece, i in zip(*(batch.column(c).to_pylist() for c in ("size", "is_piece", "id"))):
                if not is_piece:
                    at_gap.setdefault(size, []).append((i, True))
                    open_gaps |= 1 << size
                    continue
                fits = open_gaps >> size
                if not fits and opened is None:
                    out.append((_PIECE, i, left, size))
                    left += 1
                    continue
                if fits:
                    gap = size + (fits & -fits).bit_length() - 1
                    sequence, _ = at_gap[gap].pop()
                    if not at_gap[gap]:
                        open_gaps &= ~(1 << gap)
                else:
                    gap, sequence, left = capacity, opened + left, left + 1
                if gap > size:
                    at_gap.setdefault(gap - size, []).append((sequence, False))
                    open_gaps |= 1 << gap - size
                out.append((_PLACED, i, sequence, size))
            if out:
                yield _swept(part, out)
        rest = [(g, i) for g in sorted(at_gap) for i, untouched in at_gap[g] if untouched] if opened is None else []
        for a in range(0, len(rest), 1 << 16):
            yield _swept(part, [(_GAP, i, a + k, g) for k, (g, i) in enumerate(rest[a : a + (1 << 16)])])

    return rows


def _swept(part: int, rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    what, ids, to, size = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(what, pa.int32()), *(pa.array(c, pa.int64()) for c in (ids, to, size))], schema=_SWEPT)


def exchange(ranges: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """Intervals (range of pieces, first rank, end rank, range of gaps, first rank of gaps, pieces a gap) from what the ranges
    have left over: (range, pieces, longest piece, gaps, smallest gap), the largest sizes first."""
    stack: list[list[int]] = []  # ranges of gaps above, the nearest last: range, next rank, gaps left, smallest gap
    out = []
    for part, pieces, longest, gaps, smallest in ranges:
        done = 0
        while done < pieces and stack:
            source, rank, n, least = stack[-1]
            each = max(1, least // longest)
            used = min(n, -(-(pieces - done) // each))
            end = min(pieces, done + used * each)
            out.append((part, done, end, source, rank, each))
            done = end
            stack[-1][1:3] = [rank + used, n - used]
            if used == n:
                stack.pop()
        if gaps:
            stack.append([part, 0, gaps, smallest])
    return out


def _named(intervals: list[tuple[int, int, int, int, int, int]]):
    """Pieces left over with the range and rank of the gap that they get."""
    by_part: dict[int, np.ndarray] = {p: np.array([x[1:] for x in intervals if x[0] == p]) for p in {x[0] for x in intervals}}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, rank = batch.column("part").to_numpy(), batch.column("to").to_numpy()
            source, at = np.full(len(part), -1), np.full(len(part), -1)
            for p in np.unique(part):
                rule, mine = by_part.get(int(p)), np.flatnonzero(part == p)
                if rule is None:
                    continue
                k = np.searchsorted(rule[:, 0], rank[mine], side="right") - 1
                inside = rank[mine] < rule[k, 1]
                mine, k = mine[inside], k[inside]
                source[mine] = rule[k, 2]
                at[mine] = rule[k, 3] + (rank[mine] - rule[k, 0]) // rule[k, 4]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("size"), pa.array(source), pa.array(at)], names=["id", "size", "source", "at"])

    return rows


def rounds(pieces: DataFrame, capacity: int, salts: int = SALTS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """id and sequence of every piece (id, size), in bulk-synchronous rounds."""
    spark = pieces.sparkSession
    left, made = pieces.select("id", "size"), 0
    gaps, used_up = spark.range(0).select("id", F.col("id").alias("size")), []
    placed: list[DataFrame] = []
    total = left.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).first()
    n, tokens, moved, open_gaps = total.n, total.s, 0, 0
    while n:
        last = n + open_gaps <= range_rows
        if not moved and not last:
            more = -(-tokens // capacity)
            fresh = spark.range(made, made + more).select("id", F.lit(capacity).cast("bigint").alias("size"))
            gaps, made, open_gaps = gaps.unionByName(fresh), made + more, open_gaps + more
        salt = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(salts))
        both = gaps.select("id", "size", F.lit(False).alias("is_piece"), salt.alias("salt")).unionByName(left.select("id", "size", F.lit(True).alias("is_piece"), (salt + salts).alias("salt")))
        order = [F.desc("size"), "salt", "id"]
        swept_as = "part int, what int, id bigint, to bigint, size bigint"
        if last:
            rows = both.repartition(1).sortWithinPartitions(*order).select("size", "is_piece", "id")
            placed.append(written(rows.mapInArrow(_sweep(made, capacity), swept_as).select("id", F.col("to").alias("sequence")), "placed"))
            discard(*used_up)
            break
        parts = min(4096, 1 + (n + open_gaps) // range_rows)
        sorted_rows = both.repartitionByRange(parts, F.desc("size"), "salt").sortWithinPartitions(*order)
        swept = written(sorted_rows.select("size", "is_piece", "id").mapInArrow(_sweep(), swept_as), "swept")
        over = swept.where(F.col("what") != _PLACED).groupBy("part").agg(
            F.count_if(F.col("what") == _PIECE).alias("pieces"), F.max(F.when(F.col("what") == _PIECE, F.col("size"))).alias("longest"),
            F.count_if(F.col("what") == _GAP).alias("gaps"), F.min(F.when(F.col("what") == _GAP, F.col("size"))).alias("smallest"),
        )
        intervals = exchange([tuple(r) for r in over.orderBy("part").collect()])  # a row per range: 4,096 at most
        in_range = swept.where(F.col("what") == _PLACED).select("id", "size", F.col("to").alias("sequence"))
        named = swept.where(F.col("what") == _PIECE).select("part", "id", "to", "size").mapInArrow(_named(intervals), "id bigint, size bigint, source bigint, at bigint")
        free = swept.where(F.col("what") == _GAP).select(F.col("part").cast("bigint").alias("source"), F.col("to").alias("at"), F.col("id").alias("sequence"))
        across = named.where("at >= 0").join(free.hint("merge"), ["source", "at"]).select("id", "size", "sequence")
        now = written(in_range.unionByName(across), "placed")
        placed.append(now)
        used = now.groupBy(F.col("sequence").alias("id")).agg(F.sum("size").alias("used"))
        gaps = gaps.join(used.hint("merge"), "id", "left").select("id", (F.col("size") - F.coalesce("used", F.lit(0))).alias("size")).where("size > 0")
        left = named.where("at < 0").select("id", "size")
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).first()
        moved, n, tokens = state.n, n - state.n, tokens - (state.s or 0)
        if n:
            gaps, left = written(gaps, "gaps"), written(left, "left")
            open_gaps = gaps.count()
        discard(swept, *used_up)
        used_up = [gaps, left]
    found = spark.range(0).select("id", F.col("id").alias("sequence"))
    for one in placed:
        found = found.unionByName(one.select("id", "sequence"))
    return found


def pack(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", capacity: int = CAPACITY, end: int = END, salts: int = SALTS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. vocabulary: a file's name among the
    public tokenizers or its path; its ranks lie beside it."""
    prepared(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint"
    rows = docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, capacity, end), schema)
    pieces = written(rows.withColumn("id", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    found = rounds(short.select("id", F.col("length").alias("size")), capacity, salts, range_rows)
    whole = pieces.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.col("id"), "offset": F.lit(0).cast("bigint")}).drop("id")
    both = short.join(found.hint("merge"), "id")
    before = F.sum("length").over(Window.partitionBy("sequence").orderBy("id")) - F.col("length")  # at most `capacity` pieces
    rest = both.withColumn("offset", before).withColumnRenamed("sequence", "sequence_id").drop("id")
    return whole.unionByName(rest)
