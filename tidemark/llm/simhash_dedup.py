"""SimHash near-dedup with covering locality-sensitive hashing.

Definition: A-Z become lower case, words are `[^\\x20\\x09-\\x0D]+`, shingles are three consecutive words joined by one
space, repeats included (fewer words: the whole sequence; none: fingerprint zero). A shingle's hash is XXH64 with seed 42.
A fingerprint bit is 1 if it is set in over half of the hashes. Fingerprints link at `radius` or fewer differing bits.

Covering: each of the 64 bits gets a non-zero vector of radius + 1 bits; table v (every non-zero vector) compares the
bits whose vector has an odd product with v. At most `radius` bits differ, so some v is orthogonal to all of theirs and
that table sees equal keys: no pair within the radius is missed. Equal fingerprints are joined beforehand. A bucket with
over `bucket` fingerprints is covered again over its free bits without losing a pair; a bucket then holds at most as many
distinct fingerprints as its free bits allow (about 2^14).

Null text counts as empty; documents without words share the fingerprint zero; null doc_ids never name a group unless it
has no other id, then component_id is null; an empty table gives an empty result; other columns are ignored. Very long texts are hashed shingle by shingle; repeated rows share their
fingerprint. doc_id must be a number: text that is none ends the job in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, keyed, prepared, written
from .components import components

RADIUS = 3
BUCKET = 4096
_FULL = (1 << 64) - 1


def fingerprints_of(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """A 64-bit fingerprint of each text."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split()
        if not words:
            counts.append(0)
            continue
        line = b" ".join(words)
        if len(words) <= shingle:
            hashes.append(digest(line, 42))
            counts.append(1)
            continue
        gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        starts = [0, *(gaps + 1).tolist()]
        ends = [*gaps[shingle - 1 :].tolist(), len(line)]
        hashes.extend([digest(line[a:b], 42) for a, b in zip(starts, ends)])
        counts.append(len(ends))
    n = np.array(counts, np.int64)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(n)
    if len(some):
        h = np.array(hashes, np.uint64)
        first = np.concatenate([[0], np.cumsum(n[some])[:-1]])
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), first)
            out[some] |= (ones * np.uint64(2) > n[some].astype(np.uint64)).astype(np.uint64) << np.uint64(bit)
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in chunks(batches):
        others = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, others), pa.array(fingerprints_of(texts).view(np.int64))], names=[*others, "fp"])


def covering_masks(bits: int, radius: int) -> list[int]:
    """Masks over `bits` positions (bit i of the mask: position i is compared); 2**(radius + 1) - 1 of them."""
    size = 1 << (radius + 1)
    vector = [1 + i % (size - 1) for i in range(bits)]
    return [sum(1 << i for i in range(bits) if bin(vector[i] & v).count("1") & 1) for v in range(1, size)]


def _spread(mask: int, places: list[int]) -> int:
    return sum(1 << p for i, p in enumerate(places) if mask >> i & 1)


def tables(radius: int) -> list[tuple[int, list[int]]]:
    """Each table's mask, and the masks of the tables that cover its free bits."""
    out = []
    for mask in covering_masks(64, radius):
        free = [i for i in range(64) if not mask >> i & 1]
        out.append((mask, [mask | _spread(m, free) for m in covering_masks(len(free), radius)]))
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _links(radius: int):
    """From rows (t, key, fp) sorted by (t, key): a spanning star of each component inside each bucket."""

    def emit(fp: np.ndarray, bounds: np.ndarray) -> pa.RecordBatch | None:
        us, vs = [], []
        size = np.diff(bounds)
        two = bounds[:-1][size == 2]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        us.append(fp[two + 1][near])
        vs.append(fp[two][near])
        for a, b in zip(bounds[:-1][size > 2].tolist(), bounds[1:][size > 2].tolist()):
            rest = fp[a:b]
            while len(rest) > 1:
                root, rest = rest[0], rest[1:]
                front = np.array([root])
                while len(front) and len(rest):
                    hit = np.zeros(len(rest), bool)
                    for part in np.array_split(front, max(1, len(front) * len(rest) >> 20)):
                        hit |= (np.bitwise_count(rest[None, :] ^ part[:, None]) <= radius).any(axis=0)
                    front, rest = rest[hit], rest[~hit]
                    us.append(front)
                    vs.append(np.full(len(front), root, np.uint64))
        u, v = np.concatenate(us), np.concatenate(vs)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"]) if len(u) else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append(tuple(batch.column(c).to_numpy() for c in ("t", "key", "fp")))
            t, key, fp = (np.concatenate([h[i] for h in held]) for i in range(3))
            if not len(t):
                continue
            new = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
            if not len(new):
                held = [(t, key, fp)]
                continue
            out = emit(fp[: new[-1]].view(np.uint64), np.concatenate([[0], new]))
            held = [(t[new[-1] :], key[new[-1] :], fp[new[-1] :])]
            if out is not None:
                yield out
        if held and len(held[0][0]):
            fp = np.concatenate([h[2] for h in held]).view(np.uint64)
            if (out := emit(fp, np.array([0, len(fp)]))) is not None:
                yield out

    return rows


def _rooted(prints: DataFrame, least, radius: int, bucket: int) -> DataFrame:
    """One row per distinct fingerprint of prints: fp, the aggregate `least`, and the component's smallest fingerprint."""
    distinct = written(prints.groupBy("fp").agg(least.alias("least")), "distinct")
    cover = tables(radius)
    keys = F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, (m, _) in enumerate(cover)))
    placed = distinct.select("fp", F.inline(keys))
    # Buckets with one fingerprint have no pair; those with very many are covered again.
    # Small sides are written out: a join whose sides are plain exchanges can have a very frequent key split by Spark.
    sizes = written(placed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "buckets")
    shared = placed.join(sizes.hint("merge"), ["t", "key"])
    usual = shared.where(F.col("size") <= bucket).select("t", "key", "fp")
    finer = F.array(
        *(
            F.struct((F.lit(1000 * (t + 1) + s)).alias("t2"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key2"), F.lit(t).alias("of"))
            for t, (_, more) in enumerate(cover)
            for s, m in enumerate(more)
        )
    )
    split = shared.where(F.col("size") > bucket).select("t", "fp", F.inline(F.filter(finer, lambda x: x["of"] == F.col("t"))))
    split = split.select(F.col("t2").alias("t"), F.col("key2").alias("key"), "fp")
    edges = usual.unionByName(split).repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(_links(radius), "u bigint, v bigint")
    roots = components(edges)
    # Roots are the smallest fingerprints.
    return distinct.join(roots.hint("merge"), distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def simhash_groups(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: doc_id (bigint), fingerprint, component_id."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    prints = written(rows.mapInArrow(_fingerprint_rows, "doc_id bigint, fp bigint"), "fingerprints")
    labelled = written(_rooted(prints, F.min("doc_id"), radius, bucket), "labelled")
    # A component is named by its smallest doc_id.
    names = written(labelled.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-names")
    named = written(labelled.join(names.hint("merge"), "root").select("fp", "component_id"), "simhash-named")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(named.hint("merge"), "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each_group(docs: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row of docs, whole, of each group: the smallest doc_id, then the smallest key of doc_id and text. A row without an
    id stays only if its group has no id at all."""
    prepared(docs.sparkSession)
    whole = keyed(docs.withColumn("row", F.struct("*")), "row")
    rows = whole.select(F.col("doc_id").cast("bigint").alias("doc_id"), "r1", "r2", "text")
    prints = written(rows.mapInArrow(_fingerprint_rows, "doc_id bigint, r1 bigint, r2 bigint, fp bigint"), "fingerprints")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2")
    kept = _rooted(prints, F.min(place), radius, bucket).groupBy("root").agg(F.min("least").alias("least")).select("least.r1", "least.r2")
    # Rows that share doc_id and text share a key; one of them stays. Tasks combine their own such rows before anything moves.
    one = whole.select("r1", "r2", "m_0").groupBy("r1", "r2").agg(F.min_by("m_0", F.xxhash64("m_0")).alias("m_0"))
    return one.join(kept.hint("merge"), ["r1", "r2"], "left_semi").select("m_0.*")
