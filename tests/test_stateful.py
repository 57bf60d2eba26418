"""Tables and state that outlive a batch: upserts by buckets, rings of runs, polls, the evidence index."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators.evidence_index import EvidenceIndex
from tidemark.streaming import rings
from tidemark.streaming.keyed_table import KeyedTable, upsert_batches
from tidemark.streaming.polling import Poll

DAY = dt.datetime(2024, 1, 1)


def files(path):
    return {str(p.relative_to(path)) for p in Path(path).rglob("part-*.parquet")}


def test_upsert_touches_only_its_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "id bigint, v string, at int", ["id"], ["at"], buckets=8)
    assert table.read().count() == 0 and table.upsert(spark.createDataFrame([], table.schema), 0) == []
    rows = [(i, f"a{i}", 1) for i in range(100)] + [(None, "none", 1)]
    assert len(table.upsert(spark.createDataFrame(rows, table.schema), 1)) == 8
    before = files(tmp_path / "t/data")
    touched = table.upsert(spark.createDataFrame([(7, "b", 2), (7, "c", 3), (7, "late", 0), (None, "new", 5)], table.schema), 2)
    assert 1 <= len(touched) <= 2
    assert {f.split("/")[1] for f in files(tmp_path / "t/data") - before} == {f"bucket={b}" for b in touched}
    got = {r.id: r.v for r in table.read().collect()}
    assert got == {i: f"a{i}" for i in range(100)} | {7: "c", None: "new"}
    assert {r.id: r.v for r in table.read(1).collect()}[7] == "a7"
    # A repeated batch changes nothing, whatever it holds.
    assert table.upsert(spark.createDataFrame([(7, "again", 9)], table.schema), 2) == []
    assert {r.id: r.v for r in table.read().collect()} == got


def test_upsert_that_ends_in_mid_batch(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "id int, v string", ["id"], [], buckets=4)
    table.upsert(spark.createDataFrame([(1, "a"), (2, "a")], table.schema), 0)
    # The data of batch 1 is written, its manifest isn't.
    real = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda data, schema=None, **k: (_ for _ in ()).throw(RuntimeError("lost")) if schema == "bucket int, batch bigint" else real(data, schema, **k))
    with pytest.raises(RuntimeError, match="lost"):
        table.upsert(real([(1, "b"), (3, "b")], table.schema), 1)
    monkeypatch.undo()
    again = KeyedTable(spark, path, "id int, v string", ["id"], [], buckets=4)
    assert {r.id: r.v for r in again.read().collect()} == {1: "a", 2: "a"}
    again.upsert(spark.createDataFrame([(1, "b"), (3, "b")], table.schema), 1)
    assert {r.id: r.v for r in again.read().collect()} == {1: "b", 2: "a", 3: "b"}
    for n in range(2, 6):
        again.upsert(spark.createDataFrame([(1, f"n{n}")], table.schema), n)
    held = again.read(4)  # a reader of the last manifest but one
    assert again.vacuum(keep=2) >= 3
    assert {r.id: r.v for r in held.collect()} == {1: "n4", 2: "a", 3: "b"}
    assert {r.id: r.v for r in again.read().collect()} == {1: "n5", 2: "a", 3: "b"} and again.batches() == [4, 5]
    assert again.vacuum(keep=2) == 0


def test_ring_over_a_restart(spark, tmp_path):
    """Runs come in three files, with a restart of the stream after the first; ties of time go by id."""
    rnd = random.Random(3)
    runs = [(rnd.randrange(4), DAY + dt.timedelta(minutes=rnd.randrange(200)), i) for i in range(300)] + [(9, DAY, 1000)]
    parts = [runs[:100], runs[100:220], runs[220:]]
    schema = "who int, seen_at timestamp, run_id bigint"
    table = KeyedTable(spark, str(tmp_path / "out"), f"who int, place int, {rings.RUN}", ["who", "place"], [], buckets=2)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = rings.last_runs(stream, "who", size=5).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).foreachBatch(upsert_batches(table)).start().awaitTermination()

    for n, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if n != 1:
            go()
    want = {}
    for who in {r[0] for r in runs}:
        last = sorted(((t, i) for w, t, i in runs if w == who), reverse=True)[:5]
        want |= {(who, p): i for p, (_, i) in enumerate(last, 1)}
    assert {(r.who, r.place): r.run_id for r in table.read().collect()} == want


def test_idle_keys_are_forgotten(spark, tmp_path):
    """A key without a run for two days of event time starts anew."""
    schema = "who int, seen_at timestamp, run_id bigint"
    steps = [[(1, DAY, 1), (2, DAY, 2)], [(2, DAY + dt.timedelta(days=5), 3)], [(2, DAY + dt.timedelta(days=6), 4)], [(1, DAY + dt.timedelta(days=7), 5)]]
    table = KeyedTable(spark, str(tmp_path / "out"), f"who int, place int, {rings.RUN}", ["who", "place"], ["seen_at"], buckets=1)
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("seen_at", "0 seconds")
        q = rings.last_runs(stream, "who", size=3, idle_ms=2 * 86_400_000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c"))
        q.trigger(availableNow=True).foreachBatch(upsert_batches(table)).start().awaitTermination()
    got = {(r.who, r.place): r.run_id for r in table.read().collect()}
    assert got[1, 1] == 5 and (1, 2) not in got
    assert got[2, 1] == 4


def test_polls_with_overlap(spark, tmp_path):
    """Rows of two polls that overlap are stored once, those without a time elsewhere; a batch repeated after it ended between
    the two tables gives the same."""
    row = lambda i, day=True: (f"Town agreed deal to sign Pat Surname for £{i}m", f"https://a.example/{i}", f"2024-01-{i % 28 + 1:02d}" if day else None, "Desk", "Town", "Pat Surname")
    schema = "title string, url string, published_at string, source string, club string, player string"
    poll = Poll(spark, str(tmp_path / "p"), buckets=4)
    first = spark.createDataFrame([row(i) for i in range(1, 30)] + [row(i, False) for i in range(3)] + [row(1)], schema)
    second = spark.createDataFrame([row(i) for i in range(20, 40)] + [row(i, False) for i in range(2, 6)], schema)
    poll(first, 0)
    real = poll.articles.upsert
    poll.articles.upsert = lambda *a: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError, match="lost"):
        poll(second, 1)
    poll.articles.upsert = real
    poll(second, 1)
    poll(second, 1)
    dated, undated = poll.articles.read().collect(), poll.undated.read().collect()
    assert sorted(r.url for r in dated) == sorted(f"https://a.example/{i}" for i in range(1, 40))
    assert sorted(r.url for r in undated) == sorted(f"https://a.example/{i}" for i in range(6))
    one = next(r for r in dated if r.url.endswith("/10"))
    assert (one.stage, one.related, one.fee_eur, one.player) == ("agreed", True, pytest.approx(11.7e6), "Pat Surname")


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(2)
    vocab = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rnd.choices(vocab, [1 / (i + 1) for i in range(400)], k=n))
    rows = [(i, say(3), say(rnd.randint(0, 60)), "a" if i % 3 else "b", "article") for i in range(600)] + [(700, None, None, "a", "signal"), (701, "w399 w398 w397", "", "b", "signal")]
    return spark.createDataFrame(rows, "doc bigint, title string, text string, source string, doc_type string").withColumn("published_at", F.lit(None).cast("timestamp"))


def test_index_gives_the_hits_of_a_search(spark, tmp_path, corpus):
    from tidemark.operators import retrieval

    index = EvidenceIndex(spark, str(tmp_path / "i"), block=16)
    assert index.stats().count() == 0
    assert index.extend(corpus.where("doc < 200")) == 200
    assert index.extend(corpus.where("doc < 400")) == 200
    before = files(tmp_path / "i")
    assert index.extend(corpus.unionByName(corpus.where("doc = 650 or doc = 5"))) == 202
    assert before < files(tmp_path / "i") and index.extend(corpus) == 0
    asked = spark.createDataFrame([(1, "w3 w250 w17"), (2, "w399 w398 w397"), (3, "nowhere"), (4, ""), (5, "w0 w1 w2 w3 w4 w5"), (6, "w320 w321 w322 w320")], "q bigint, query string")
    want = retrieval.search(corpus, asked, 7, ("lexical",))
    shape = lambda df: sorted((r.q, r["rank"], r.doc, r.matched, round(r.score, 6)) for r in df.select("q", "rank", "doc", "matched", "score").collect())
    assert shape(index.topk(asked, 7)) == shape(want)
    stats = {(r.kind, r.source): r.n for r in index.stats().collect()}
    assert stats == {("article", "a"): 400, ("article", "b"): 200, ("signal", "a"): 1, ("signal", "b"): 1}


def test_index_leaves_blocks_closed(spark, tmp_path, corpus, monkeypatch):
    """Documents without a query word are never scored, and blocks whose bound is below the k-th score are not opened."""
    index = EvidenceIndex(spark, str(tmp_path / "i"), block=8)
    index.extend(corpus)
    opened, scored = [], EvidenceIndex.scored
    monkeypatch.setattr(EvidenceIndex, "scored", lambda self, pairs, *rest: (opened.append(pairs), scored(self, pairs, *rest))[1])
    asked = spark.createDataFrame([(1, "w399 w398 w397 w0")], "q bigint, query string")
    hits = index.topk(asked, 3, first=2).collect()
    assert hits[0].doc == 701
    blocks = index.documents().select("block").distinct().count()
    assert sum(p.count() for p in opened) < blocks / 2


def test_index_tasks_and_scores_are_bounded(spark, tmp_path, corpus, monkeypatch):
    """Blocks of long documents hold fewer of them, postings are made by as many tasks as words fill, a block gives the k best
    of a query and no pairs, and repeated ids are settled as before."""
    from tidemark.operators import evidence_index

    long = spark.range(40).select(F.col("id").alias("doc"), F.lit("tt").alias("title"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(600)), lambda i: F.concat(F.lit("x"), i))).alias("text"), F.lit("a").alias("source"), F.lit("article").alias("doc_type"), F.lit(None).cast("timestamp").alias("published_at"))
    other = long.where("doc < 5").withColumn("title", F.lit("ss"))
    monkeypatch.setattr(evidence_index, "TASK_WORDS", 2000)
    index = EvidenceIndex(spark, str(tmp_path / "i"), block=2)
    assert index.extend(long.unionByName(other)) == 40
    assert {r.title for r in index.documents().where("doc < 5").collect()} == {"ss"} and index.documents().count() == 40
    assert index.documents().select("block").distinct().count() > 5  # 40 documents of 600 words at 1,024 words a block
    names = {f.name for f in (tmp_path / "i/postings/segment=0").rglob("part-*.parquet")}
    assert len({n.split("-")[1] for n in names}) > 4  # tasks that wrote postings

    index.extend(corpus.withColumn("doc", F.col("doc") + 1000))
    found, scored = [], EvidenceIndex.scored
    monkeypatch.setattr(EvidenceIndex, "scored", lambda self, *a: (found.append((a[0], scored(self, *a))), found[-1][1])[1])
    asked = spark.createDataFrame([(1, "w0 w250 w17 w30 w31")], "q bigint, query string")
    hits = index.topk(asked, 3).collect()
    assert len(hits) == 3
    for pairs, rows in found:
        assert rows.count() <= 3 * pairs.count() + rows.where("matched >= 3").count()


def test_failed_extension_is_written_over(spark, tmp_path, corpus):
    index = EvidenceIndex(spark, str(tmp_path / "i"))
    index.extend(corpus.where("doc < 10"))
    corpus.where("doc >= 500").select("doc").write.parquet(str(tmp_path / "i/docs/segment=1"))  # left behind, without a manifest
    assert index.documents().count() == 10
    assert index.extend(corpus.where("doc < 20")) == 10 and index.documents().count() == 20


def test_batches_and_buckets_are_shared(spark, tmp_path, monkeypatch):
    """A batch is read by more than one task, and so is a bucket written."""
    from tidemark.plans import streams

    rows = spark.range(4000).withColumn("poll", F.col("id") % 3)
    seen = []
    streams._run(streams._arriving(rows, str(tmp_path / "s"), 4, "poll", "id"), str(tmp_path / "s"), lambda batch, _: seen.append((batch.rdd.getNumPartitions(), sorted(r.id for r in batch.select("id").collect()))))
    assert sorted(i for _, ids in seen for i in ids) == list(range(4000)) and len(seen) <= 5
    assert max(n for n, _ in seen) > 1 and max(len(ids) for _, ids in seen) < 2000

    table = KeyedTable(spark, str(tmp_path / "t"), "id bigint, v string", ["id"], [], buckets=1)
    table.upsert(spark.range(3000).selectExpr("id", "'a' as v"), 0)
    table.upsert(spark.range(1000, 4000).selectExpr("id", "'b' as v"), 1)
    files = list((tmp_path / "t" / "data" / "v=1" / "bucket=0").glob("part-*.parquet"))
    assert len(files) > 1 and table.read().groupBy("v").count().orderBy("v").collect() == [("a", 1000), ("b", 3000)]
