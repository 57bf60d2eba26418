"""Ranked lexical search by the Best Position Algorithm over impact lists.

Definition: terms are the maximal matches of `[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+` in whole texts, only A-Z lower-cased (null
text: none). N documents have a term, L terms are in all of them, n in one, df documents hold a term, tf times in one. A
term weighs w = floor(1000 ln((2 N + 2) / (2 df + 1))), in doubles; all else is whole numbers, division rounding down. With
m = 100 - 50 + ((50 n N) div L) a document scores the sum of w ((1000000000 tf) div (1000 tf + 20 m)) over the query's
distinct terms. A query gets the k best documents with a score above 0, ties to the smaller doc_id (null last).

Index (`lexical_index`): a shard is a run of documents with about SHARD_BYTES of text, and one row: its documents, and a
posting list for each term. Where the queries' terms are few (TERMS) the index holds these only, else all.

Search (`best_positions`): a shard's lists are put in order of impact. For each query all lists are read in step. A document
met in one list is looked up in the others at once, which gives its score and its positions there. The best position of a
list is the end of the stretch from its head in which every position has been seen, whichever list it was seen from; the sum
of the impacts at the best positions bounds the score of every document not seen. Reading stops when that bound is strictly
below the k-th score: a document that ties with it may have a smaller id.

Shards are searched in rounds of growing size. A round starts from the k-th scores of the rounds before, so later shards stop
early and send little. Queries go out in blocks of at most BLOCK_PAIRS query terms, which is what a broadcast is bounded by.

Rows are documents, whatever their doc_id: a null or repeated one names each row that has it. Repeated queries are answered
each. Empty tables give an empty result, texts of any length are read in pieces, other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepared, texts_of, written
from .kd_search import best_of, rounds

K = 50
SHARD_BYTES = 16 << 20
PIECE_BYTES = 1 << 20
#: Distinct terms of queries that are sent to the tasks that index, at most (about 20 bytes each).
TERMS = 1 << 18
#: Query terms in a block of queries.
BLOCK_PAIRS = 1 << 20
#: Positions read from each list before the first check; doubled after each.
STEP = 16
FIRST, GROWTH = 64, 64
#: ASCII that is no letter or digit becomes a space, A-Z small letters.
TABLE = bytes(b if b >= 0x80 or chr(b).isdigit() or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces of about PIECE_BYTES."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            # A piece ends where no term goes on.
            while end < len(text) and TABLE[text[end]] != 32:
                end += 1
        yield text[at:end].translate(TABLE).split()
        at = end


SHARD = pa.schema(
    [
        ("u", pa.float64()),
        ("documents", pa.int64()),  # those with a term
        ("length", pa.int64()),  # terms of all documents
        ("ids", pa.list_(pa.int64())),
        ("n", pa.list_(pa.int64())),
        ("terms", pa.list_(pa.string())),
        ("df", pa.list_(pa.int64())),
        ("docs", pa.list_(pa.int32())),  # list after list: places in ids
        ("tf", pa.list_(pa.int64())),
    ]
)
SHARD_DDL = "u double, documents bigint, length bigint, ids array<bigint>, n array<bigint>, terms array<string>, df array<bigint>, docs array<int>, tf array<bigint>"


def _indexed(shared, limit: int):
    """Documents of a task as shards."""

    def shard(ids: list, lengths: list[int], names: list[bytes], who: list[np.ndarray], code: list[np.ndarray], tf: list[np.ndarray]) -> pa.RecordBatch:
        key = np.array([0 if x is None else x for x in ids], np.int64)
        order = np.lexsort((key, np.array([x is None for x in ids], bool)))
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        docs, codes, counts = rank[np.concatenate(who)], np.concatenate(code), np.concatenate(tf)
        by_list = np.lexsort((docs, codes))
        used, df = np.unique(codes, return_counts=True)
        n = np.array(lengths, np.int64)[order]
        u = np.random.default_rng([len(ids), int(n.sum()), int(np.abs(key).max())]).random()  # the same each time the task runs
        values = [u, int((n > 0).sum()), int(n.sum()), [ids[i] for i in order], n, [names[c].decode() for c in used], df, docs[by_list].astype(np.int32), counts[by_list]]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, SHARD)], schema=SHARD)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[bytes] = list(shared.value) if shared is not None else []
        known = {t: i for i, t in enumerate(names)}
        ids, lengths, who, code, tf, size = [], [], [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                counts: Counter[int] = Counter()
                n = 0
                for words in terms_of(text):
                    n += len(words)
                    if shared is None:
                        for w in words:
                            if w not in known:
                                known[w] = len(names)
                                names.append(w)
                    counts.update(map(known.get, words))
                counts.pop(None, None)
                who.append(np.full(len(counts), len(ids)))
                code.append(np.fromiter(counts.keys(), np.int64, len(counts))), tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
                ids.append(doc), lengths.append(n)
                size += len(text) + 64
                if size >= limit:
                    yield shard(ids, lengths, names, who, code, tf)
                    ids, lengths, who, code, tf, size = [], [], [], [], [], 0
                    if shared is None:
                        names, known = [], {}
        if ids:
            yield shard(ids, lengths, names, who, code, tf)

    return rows


def lexical_index(docs: DataFrame, terms: list[bytes] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs: doc_id, text. The index over `terms`, or over all terms: a written table with a row for each shard. It can be
    searched any number of times."""
    spark = docs.sparkSession
    prepared(spark)
    shared = spark.sparkContext.broadcast(terms) if terms is not None else None
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_indexed(shared, shard_bytes), SHARD_DDL)
    return written(rows, "lexical-index", **{"parquet.block.size": str(2 * SHARD_BYTES)})


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [sorted({w for part in terms_of(x) for w in part}) for x in texts_of(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([batch.column("q"), pa.array([[w.decode() for w in f] for f in found], pa.list_(pa.string()))], names=["q", "terms"])


class Lists:
    """The impact lists of a shard: for each term its documents, largest impact first, and the place of each document in it."""

    def __init__(self, shard: dict, documents: int, length: int):
        n, self.df = shard["n"], shard["df"]
        self.count = len(n)
        if len(n) and 50 * int(n.max()) * documents < 1 << 63:
            m = 50 + 50 * n * documents // max(1, length)
        else:
            m = np.array([50 + 50 * x * documents // max(1, length) for x in n.tolist()], np.int64)
        docs, tf = shard["docs"].astype(np.int64), shard["tf"]
        part = 1_000_000_000 * tf // (1000 * tf + 20 * m[docs])
        of = np.repeat(np.arange(len(self.df)), self.df)
        order = np.lexsort((docs, -part, of))
        self.docs, self.part = docs[order], part[order]  # list after list, by impact
        self.start = np.concatenate([[0], np.cumsum(self.df)])
        # Direct access: (term, document) ascending, with the position in the list.
        self.key = of * self.count + docs
        self.position = np.empty(len(order), np.int64)
        self.position[order] = np.arange(len(order))
        self.term = {t: i for i, t in enumerate(shard["terms"])}

    def find(self, lists: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the documents are in the lists: (document, position) of each that is there, with positions over all lists."""
        want = (lists[:, None] * self.count + docs).ravel()
        at = np.searchsorted(self.key, want)
        at[at == len(self.key)] = 0
        hit = np.flatnonzero(self.key[at] == want)
        return hit % len(docs), self.position[at[hit]]


def best_positions(lists: Lists, terms: np.ndarray, weights: np.ndarray, k: int, floor: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """(documents, scores, positions read) of the k best documents of a shard that score `floor` or more; terms: numbers of lists."""
    first, size = lists.start[terms], lists.df[terms]
    offset = np.concatenate([[0], np.cumsum(size)])  # the query's lists in one row
    seen = np.zeros(offset[-1], bool)
    best = np.zeros(len(terms), np.int64)  # positions seen without a gap
    met = np.zeros(lists.count, bool)
    docs, scores, read = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while True:
        upto = np.minimum(read + step, size)
        new = np.concatenate([lists.docs[a + read : a + b] for a, b in zip(first.tolist(), upto.tolist()) if b > read] or [docs[:0]])
        new = np.unique(new[~met[new]])
        met[new] = True
        if len(new):
            who, position = lists.find(terms, new)
            own = np.searchsorted(lists.start, position, side="right") - 1  # the list of each position
            nth = np.searchsorted(terms, own)
            seen[offset[nth] + position - first[nth]] = True
            score = np.zeros(len(new), np.int64)
            np.add.at(score, who, weights[nth] * lists.part[position])
            docs, scores = np.concatenate([docs, new]), np.concatenate([scores, score])
            if len(docs) > k:
                # Documents below the k-th so far never come back.
                least = np.partition(scores, -k)[-k]
                docs, scores = docs[scores >= least], scores[scores >= least]
        bound = 0
        for i, (a, n) in enumerate(zip(offset.tolist(), size.tolist())):
            ahead = seen[a + best[i] : a + n]
            gap = int(ahead.argmin()) if len(ahead) else 0
            best[i] += len(ahead) if len(ahead) and ahead[gap] else gap
            if best[i] < n:
                # At the best position, or at the head where not even that is seen: nothing unseen has more.
                bound += int(weights[i]) * int(lists.part[first[i] + max(0, best[i] - 1)])
        read, step = read + step, 2 * step
        kth = max(floor, int(np.partition(scores, -k)[-k])) if len(scores) >= k else floor
        if bound < max(kth, 1) or read >= size.max():
            break
    keep = np.flatnonzero(scores >= max(floor, 1))
    keep = keep[np.lexsort((docs[keep], -scores[keep]))][:k]
    return docs[keep], scores[keep], min(read, int(size.max()))


HIT = pa.schema([("q", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _searched(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                shard = {c: one.column(c).flatten().to_numpy() for c in ("n", "df", "docs", "tf")} | {"terms": one.column("terms")[0].as_py()}
                lists = Lists(shard, sent["documents"], sent["length"])
                qs, places, scores = [], [], []
                for q, (names, weights) in sent["queries"].items():
                    own = sorted((lists.term[t], w) for t, w in zip(names, weights) if t in lists.term)
                    if own:
                        terms, w = np.array(own, np.int64).T
                        found, score, _ = best_positions(lists, terms, w, k, sent["floor"].get(q, 1))
                        qs.append(np.full(len(found), q)), places.append(found), scores.append(score)
                if qs:
                    ids = one.column("ids").flatten().take(pa.array(np.concatenate(places)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), ids, pa.array(np.concatenate(scores))], schema=HIT)

    return run


def lexical_search(index: DataFrame, queries: DataFrame, k: int = K, block_pairs: int = BLOCK_PAIRS, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """queries: q (distinct), terms. Returns q, rank, doc_id, score from an index that holds all their terms."""
    spark = index.sparkSession
    total = index.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("documents"), F.lit(0)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    df = index.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.df").alias("df"))
    asked = written(queries.select("q", F.explode("terms").alias("term")), "lexical-asked")
    weight = F.floor(F.lit(1000) * F.log((2.0 * total.documents + 2.0) / (2.0 * F.col("df") + 1.0))).cast("bigint")
    weighted = asked.join(df.hint("merge"), "term").select("q", "term", weight.alias("w")).where("w > 0")
    weighted = written(weighted.groupBy("q").agg(F.collect_list(F.struct("term", "w")).alias("terms")), "lexical-weights")
    blocks = max(1, -(-asked.count() // block_pairs))
    discard(asked)
    found = None
    for b in range(blocks):
        mine = weighted.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()  # about block_pairs terms
        sent = {"documents": total.documents, "length": total.length, "queries": {r.q: ([t.term for t in r.terms], [t.w for t in r.terms]) for r in mine}, "floor": {}}
        best = None
        for low, high in rounds(total.shards, first, growth):
            shared = spark.sparkContext.broadcast(sent)
            hits = index.where((F.col("u") >= low) & (F.col("u") < high)).mapInArrow(_searched(shared, k), "q bigint, doc_id bigint, score bigint")
            hits = hits if best is None else hits.unionByName(best.select("q", "doc_id", "score"))
            now = written(best_of(hits, k, "q", F.desc("score"), F.asc_nulls_last("doc_id")), "lexical-hits")
            discard(*[best] * (best is not None))
            best = now
            if high < 1.0:
                sent["floor"] = {r.q: r.score for r in best.where(F.col("rank") == k).select("q", "score").collect()}  # one a query of the block
        found = best if found is None else found.unionByName(best)
    discard(weighted)
    return found.select("q", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = K, most_terms: int = TERMS, shard_bytes: int = SHARD_BYTES, **more) -> DataFrame:
    """docs: doc_id, text; items: item_id, text. Returns item_id, rank, doc_id, score."""
    prepared(docs.sparkSession)
    asked = written(items.select("item_id", "text").withColumn("q", F.monotonically_increasing_id()), "lexical-items")
    queries = written(asked.select("q", "text").mapInArrow(_query_terms, "q bigint, terms array<string>"), "lexical-queries")
    distinct = written(queries.select(F.explode("terms").alias("term")).distinct(), "lexical-terms")
    few = distinct.count() <= most_terms
    index = lexical_index(docs, [r.term.encode() for r in distinct.collect()] if few else None, shard_bytes)
    found = lexical_search(index, queries, k, **more)
    discard(distinct, index)
    return found.join(asked.select("q", "item_id").hint("merge"), "q").select("item_id", "rank", "doc_id", "score")


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents),
q AS (
  SELECT item_id, row_number() OVER () AS q,
    list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) AS w
  FROM benchmark),
c AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, w, unnest(w) AS term FROM d) GROUP BY ALL),
t AS (SELECT term, floor(1000 * ln((2 * c.n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, c.n),
s AS (
  SELECT q.q, q.item_id, p.r, p.doc_id, sum(t.w * ((1000000000 * p.tf) // (1000 * p.tf + 20 * (50 + (50 * p.n * c.n) // c.l))))::BIGINT AS score
  FROM (SELECT q, item_id, unnest(w) AS term FROM q) q JOIN t USING (term) JOIN p USING (term), c
  GROUP BY q.q, q.item_id, p.r, p.doc_id)
SELECT item_id, rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
WHERE rank <= 50
"""
