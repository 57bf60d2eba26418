"""An evidence index kept between searches: an inverted index in Parquet, extended in segments, searched by block maxima.

Folder: `docs/segment=N` has each document's tokens, `postings/segment=N/bucket=B` a row per term and block of documents (their
ids, occurrences and lengths, and the most that one of them can gain from the term), `terms/segment=N` document counts,
`manifest/v=N` the segments that are valid. A block holds about BLOCK documents of like length, fewer where they are long. An
extension adds the documents that are not stored yet as a segment, and only its manifest makes it count: what a failed one
leaves is written over by the next. Nothing stored is read again but document ids. The tokens of a block meet once, and its
postings are made of them there; tasks take about TASK_WORDS words, so larger inputs have more tasks, not larger ones.

Search: block maxima bound the score of every document of a block. Each query scores its FIRST best blocks, then those whose
bound reaches its k-th score so far; other blocks are never opened, and a document without a query word is never scored. The
postings of an opened block that hold a query's word are multiplied with its queries in one task, which keeps the k best of each
query (and those that may hold its phrase), so pairs of queries and documents are never rows. Queries are broadcast in counted
blocks. Scores are those of `retrieval.search` with its lexical part (its phrase bonus is given to documents that share a word).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.retrieval import QUERIES, ROWS, indexed
from tidemark.shipping import ship
from tidemark.storage import BROADCAST_ROWS, discard, sided, written

BLOCK = 1024
#: Words of a document that a block holds BLOCK of, on average at most.
WORDS = 512
#: Words whose postings one task makes, about.
TASK_WORDS = 8_000_000
#: Opened blocks that one task scores, about.
TASK_BLOCKS = 16
BUCKETS = 32
#: Blocks that a query scores before it has a k-th score.
FIRST = 8
_DOCS = "doc bigint, kind string, source string, title string, w string, length int, block bigint, segment int"
_POSTINGS = "term string, block bigint, docs array<bigint>, tf array<bigint>, lengths array<int>, n int, shortest int, most double, segment int, bucket int"
_LISTS = "term string, block bigint, docs array<bigint>, tf array<bigint>, lengths array<int>, n int, shortest int, most double"
_SUMS = "q bigint, doc bigint, length int, matched bigint, s double, near boolean"


def _norm(length: Column) -> Column:
    return F.greatest(F.lit(0.35), 9 / F.sqrt(F.greatest(length, F.lit(1))))


def _bucket(term: Column) -> Column:
    return F.pmod(F.hash(term), F.lit(BUCKETS))


def _lists(table: pa.Table) -> pa.Table:
    """The postings of one block's documents, terms in the order of their first places."""
    table = table.sort_by("doc")
    doc, length = table["doc"].to_numpy(), table["length"].to_numpy()
    split = pc.split_pattern(pa.concat_arrays(table["w"].chunks), " ")
    words, who = split.flatten().dictionary_encode(), split.value_parent_indices().to_numpy()
    pair, tf = np.unique(words.indices.to_numpy().astype(np.int64) * len(doc) + who, return_counts=True)
    term, at = pair // len(doc), pair % len(doc)
    first = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(first, len(pair)).astype(np.int32)
    gain = (1 + np.log(tf)) * np.maximum(0.35, 9 / np.sqrt(np.maximum(length, 1)))[at]
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (doc[at], tf.astype(np.int64), length[at])]
    block = np.full(len(first), table["block"][0].as_py(), np.int64)
    arrays = [words.dictionary.take(pa.array(term[first])), pa.array(block), *lists, pa.array(np.diff(ends)), pa.array(np.minimum.reduceat(length[at], first)), pa.array(np.maximum.reduceat(gain, first))]
    return pa.Table.from_arrays(arrays, names=["term", "block", "docs", "tf", "lengths", "n", "shortest", "most"])


def _scores(shared, k: int, digits: int):
    """For a block's postings and the numbers of the queries that open it: each query's k best documents without a phrase, and
    those that hold enough words for the phrase."""

    def best(lists: pa.Table, wanted: pa.Table) -> pa.Table:
        empty = pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.bool_())], names=["q", "doc", "length", "matched", "s", "near"])
        if not lists.num_rows or not wanted.num_rows:
            return empty
        asked = [shared.value[q] for q in wanted["qs"][0].as_py()]
        flat = lambda c: pa.concat_arrays(lists[c].chunks).flatten().to_numpy()
        docs, at = np.unique(flat("docs"), return_inverse=True)
        term = np.repeat(np.arange(lists.num_rows), lists["n"].to_numpy())
        gain, lengths = 1 + np.log(flat("tf")), np.zeros(len(docs), np.int32)
        lengths[at] = flat("lengths")
        place = {t: i for i, t in enumerate(lists["term"].to_pylist())}
        weights = np.zeros((len(place), len(asked)))
        for j, x in enumerate(asked):
            for t, weight in x["terms"]:
                if t in place:
                    weights[place[t], j] = weight
        order = np.argsort(at, kind="stable")
        at, term, gain = at[order], term[order], gain[order]
        first = np.searchsorted(at, np.arange(len(docs) + 1))
        s, matched = np.empty((len(docs), len(asked))), np.empty((len(docs), len(asked)))
        for a in range(0, len(docs), ROWS):
            b = min(len(docs), a + ROWS)
            part = slice(first[a], first[b])
            dense = np.zeros((b - a, len(place)))
            dense[at[part] - a, term[part]] = gain[part]
            s[a:b], matched[a:b] = dense @ weights, (dense > 0).astype(float) @ (weights > 0)
        distinct, inner = (np.array([x[c] for x in asked]) for c in ("distinct", "inner"))
        norm = np.maximum(0.35, 9 / np.sqrt(np.maximum(lengths, 1)))[:, None]
        score = np.round(s * (1 + np.minimum(0.25, matched / np.maximum(distinct, 1) * 0.25)) * norm, digits)
        rows, columns = [], []
        for j in range(len(asked)):
            some = np.flatnonzero(matched[:, j] > 0)
            if len(some) > k:
                top = some[score[some, j] >= np.partition(score[some, j], -k)[-k]]
                top = top[np.lexsort((docs[top], -score[top, j]))][:k]
                some = np.union1d(top, some[matched[some, j] >= inner[j]])
            rows.append(some), columns.append(np.full(len(some), j))
        i, j = np.concatenate(rows), np.concatenate(columns)
        ids = np.array([x["q"] for x in asked], np.int64)
        arrays = [ids[j], docs[i], lengths[i], matched[i, j].astype(np.int64), s[i, j], matched[i, j] >= inner[j]]
        return pa.Table.from_arrays(list(map(pa.array, arrays)), names=empty.column_names)

    return best


class EvidenceIndex:
    """The index in a folder that driver and executors share; made by its first extension."""

    def __init__(self, spark: SparkSession, path: str, block: int = BLOCK):
        self.spark, self.path, self.block = spark, path.rstrip("/"), block

    def segments(self) -> list[int]:
        """Numbers of the valid segments (one row each)."""
        try:
            rows = self.spark.read.schema("segment int, v int").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted(r.segment for r in rows.collect())

    def _stored(self, name: str, schema: str, segments: list[int]) -> DataFrame:
        if not segments:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}").where(F.col("segment").isin(segments))

    def documents(self) -> DataFrame:
        return self._stored("docs", _DOCS, self.segments())

    def postings(self) -> DataFrame:
        return self._stored("postings", _POSTINGS, self.segments())

    def extend(self, documents: DataFrame) -> int:
        """Adds the documents (see retrieval) whose `doc` is not stored; of rows that share one the first by title and text.
        Returns how many were added."""
        segments = self.segments()
        number = max(segments, default=-1) + 1
        source = F.col("source").cast("string") if "source" in documents.columns else F.lit(None).cast("string")
        own = documents.withColumns({"doc": F.col("doc").cast("bigint"), "source": source}).where("doc is not null")
        # Ids are looked at first: only rows whose id repeats are grouped, and texts aren't shuffled where few ids are stored.
        repeated = written(own.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), "evidence-repeated")
        stored = self._stored("docs", _DOCS, segments).select("doc")
        new = own.join(sided(stored), "doc", "left_anti")
        if not repeated.isEmpty():
            some = sided(repeated)
            one = new.join(some, "doc", "left_semi").groupBy("doc").agg(F.min_by(F.struct(*new.columns), F.struct("title", "text")).alias("_r")).select("_r.*")
            new = new.join(some, "doc", "left_anti").unionByName(one)
        length = F.when(F.col("w") != "", F.size(F.split("w", " "))).otherwise(0)
        rows = written(indexed(new, ("source",)).select("doc", "kind", "source", "title", "w", length.alias("length")), "evidence-rows")
        # Documents of like length share blocks, so that the maxima of a block are close to its documents' own.
        group = F.floor(2 * F.log2(F.col("length") + 1)).cast("int")
        blocks = F.ceil(F.greatest(F.count(F.lit(1)) / self.block, F.sum("length") / (self.block * WORDS)))
        sizes = rows.groupBy(group.alias("g")).agg(blocks.alias("blocks"))  # two rows for each doubling
        blocked = rows.withColumn("g", group).join(F.broadcast(sizes), "g")
        part = F.pmod(F.xxhash64("doc"), F.col("blocks"))
        block = (F.lit(number).cast("bigint") * (1 << 40)) + F.col("g") * (1 << 32) + part
        blocked.select("doc", "kind", "source", "title", "w", "length", block.alias("block")).write.mode("overwrite").parquet(f"{self.path}/docs/segment={number}")
        docs = self.spark.read.schema(_DOCS.removesuffix(", segment int")).parquet(f"{self.path}/docs/segment={number}")
        added, words = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        # Small segments use the cores that there are, larger ones have as many tasks as their words fill.
        tasks = max(-(-words // TASK_WORDS), min(self.spark.sparkContext.defaultParallelism, -(-words // (TASK_WORDS // 16))), 1)
        ship(self.spark)
        lists = docs.where("length > 0").select("doc", "block", "length", "w").repartition(tasks, "block").groupBy("block").applyInArrow(_lists, _LISTS)
        lists.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings/segment={number}")
        kept = self.spark.read.schema("term string, n int").parquet(f"{self.path}/postings/segment={number}")
        kept.groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{self.path}/terms/segment={number}")
        self.spark.createDataFrame([(number,)], "segment int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")
        discard(rows, repeated)
        return added

    def stats(self) -> DataFrame:
        """kind, source and number of documents."""
        return self.documents().groupBy("kind", "source").agg(F.count(F.lit(1)).alias("n"))

    def weights(self, queries: DataFrame) -> DataFrame:
        """q, term, weight: times asked x inverse document frequency, of the terms that are stored."""
        asked = queries.select(F.col("q").cast("bigint").alias("q"), F.explode(text.tokens(F.col("query"))).alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qf"))
        df = self._stored("terms", "term string, df bigint, segment int", self.segments()).groupBy("term").agg(F.sum("df").alias("df"))
        n = self.documents().where("length > 0").agg(F.count(F.lit(1)).alias("n"))
        idf = F.log((F.col("n") + 1) / (F.col("df") + 0.5)) + 1
        return asked.join(df.hint("merge"), "term").join(F.broadcast(n)).select("q", "term", (F.col("qf") * idf).alias("weight"))

    def topk(self, queries: DataFrame, k: int, digits: int = 6, first: int = FIRST) -> DataFrame:
        """queries: q, query. q, doc, rank, matched and score of the k best documents."""
        q = queries.select(F.col("q").cast("bigint").alias("q"), text.tokens(F.col("query")).alias("words"))
        inner = F.size(F.array_distinct(F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0)))))
        shape = written(q.select("q", F.array_join("words", " ").alias("phrase"), F.size(F.array_distinct("words")).alias("distinct"), inner.alias("inner")), "evidence-queries")
        weights = written(self.weights(queries), "evidence-weights")
        rounds = max(-(-shape.count() // QUERIES), -(-weights.count() // BROADCAST_ROWS), 1)
        mine = lambda df, i: df.where(F.pmod(F.xxhash64("q"), F.lit(rounds)) == i) if rounds > 1 else df
        every = [self._best(mine(weights, i), mine(shape, i), k, digits, first) for i in range(rounds)]
        out = every[0]
        for x in every[1:]:
            out = out.unionByName(x)
        return out

    def _best(self, weights: DataFrame, shape: DataFrame, k: int, digits: int, first: int) -> DataFrame:
        """topk for queries whose weights are few enough to be broadcast (about BROADCAST_ROWS rows)."""
        terms = weights.groupBy("q").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))
        rows = shape.join(terms.hint("merge"), "q").collect()  # about QUERIES rows
        sent = self.spark.sparkContext.broadcast({r.q: {"q": r.q, "distinct": r.distinct, "inner": r.inner, "terms": [tuple(t) for t in r.terms]} for r in rows})
        bounds = written(self.bounds(weights, shape), "evidence-bounds")
        order = Window.partitionBy("q").orderBy(F.desc("bound"), "block")
        tried = written(bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= first).select("q", "block"), "evidence-tried")
        some = written(self.scored(tried, weights, shape, sent, k, digits), "evidence-scores")
        by = Window.partitionBy("q").orderBy(F.desc(F.round("score", digits)), "doc")
        kth = some.withColumn("r", F.row_number().over(by)).where(F.col("r") == k).select("q", F.round("score", digits).alias("kth"))
        left = bounds.join(tried.hint("merge"), ["q", "block"], "left_anti").join(written(kth, "evidence-kth").hint("merge"), "q", "left")
        more = left.where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - 10.0**-digits)).select("q", "block")
        every = some.unionByName(self.scored(written(more, "evidence-more"), weights, shape, sent, k, digits))
        return every.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("q", "doc", "rank", "matched", "score")

    def _asked(self, weights: DataFrame) -> DataFrame:
        """Postings of the words that are asked for, from their buckets."""
        terms = weights.select("term").distinct()
        buckets = [r.bucket for r in terms.select(_bucket(F.col("term")).alias("bucket")).distinct().collect()]  # BUCKETS at most
        return self.postings().where(F.col("bucket").isin(buckets)).join(F.broadcast(terms), "term", "left_semi")

    def bounds(self, weights: DataFrame, shape: DataFrame) -> DataFrame:
        """q, block, bound: the most that a document of a block can score, for blocks that hold a word of the query."""
        maxima = self._asked(weights).select("term", "block", "most", "shortest")
        sums = maxima.join(F.broadcast(weights), "term").groupBy("q", "block").agg(F.sum(F.col("weight") * F.col("most")).alias("s"), F.count(F.lit(1)).alias("terms"), F.min("shortest").alias("shortest"))
        phrase = F.when(F.col("terms") >= F.col("inner"), 4 * _norm(F.col("shortest"))).otherwise(0.0)
        most = (F.col("s") + phrase) * (1 + F.least(F.lit(0.25), F.col("terms") / F.col("distinct") * 0.25))
        return sums.join(shape.hint("merge"), "q").select("q", "block", (most * (1 + 1e-9)).alias("bound"))

    def scored(self, pairs: DataFrame, weights: DataFrame, shape: DataFrame, sent, k: int, digits: int) -> DataFrame:
        """q, doc, matched, score of documents of some blocks (pairs: q, block) that share a word with the query; of each block
        the k best of a query at least. sent: the queries, broadcast."""
        ship(self.spark)
        wanted = written(pairs.groupBy("block").agg(F.collect_list("q").alias("qs")), "evidence-wanted")
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-wanted.count() // TASK_BLOCKS))
        lists = self._asked(weights).select("term", "block", "docs", "tf", "lengths", "n").join(sided(wanted.select("block")), "block", "left_semi")
        both = lists.repartition(tasks, "block").groupBy("block").cogroup(wanted.repartition(tasks, "block").groupBy("block"))
        sums = written(both.applyInArrow(_scores(sent, k, digits), _SUMS), "evidence-sums")
        # Only documents that hold all words inside the phrase can hold the phrase; their tokens are looked up.
        near = written(sums.where("near").select("q", "doc").join(shape.select("q", "phrase").hint("merge"), "q"), "evidence-near")
        found = self.documents().select("doc", "title", "w").join(sided(near), "doc")
        bonus = F.when(F.contains("title", F.col("phrase")), 4.0).when(F.contains("w", F.col("phrase")), 2.0)
        given = written(found.select("q", "doc", bonus.alias("bonus")).where("bonus is not null"), "evidence-phrases")
        score = (F.col("s") + F.coalesce("bonus", F.lit(0.0))) * (1 + F.least(F.lit(0.25), F.col("matched") / F.col("distinct") * 0.25)) * _norm(F.col("length"))
        rows = sums.join(shape.hint("merge"), "q").join(given.hint("merge"), ["q", "doc"], "left")
        return rows.select("q", "doc", "matched", score.alias("score"))
