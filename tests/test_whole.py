"""Queries take all rows and whole values."""

import math
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tools")]
from compare import plain

from tidemark import plans

DATA = Path("/root/testdata/sf0.001")


def duck(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def same(spark, name, sql, folder=DATA):
    df = plans.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*columns).collect()), key=repr)
    rel = duck(folder).sql(sql)
    want = sorted((tuple(plain(x) for x in r) for r in rel.select(*(f'"{c}"' for c in columns)).fetchall()), key=repr)
    assert got and got == want


def test_clusters_hold_every_direct_claim(spark):
    n = duck(DATA).sql("SELECT count(*) FROM events WHERE event_id % 3 <> 0").fetchall()[0][0]
    assert plans.QUERIES["cluster_consensus"](spark, str(DATA)).selectExpr("sum(direct_articles)").first()[0] == n


def test_cosine_behind_900_characters(spark, monkeypatch):
    from tidemark.operators import retrieval

    grams = lambda x: Counter(y[i : i + 3] for y in [f"  {' '.join(x.lower().split())}  "] for i in range(len(y) - 2))
    tail = "zephyr quartz vexing jumble"
    docs = spark.createDataFrame([(1, "t", "s", "a " * 600 + tail), (2, "t", "s", "a " * 600), (3, None, None, None)], "doc bigint, title string, source string, text string")
    docs = docs.withColumn("published_at", F.lit(None).cast("timestamp"))
    asked = spark.createDataFrame([(7, tail), (8, "qqq"), (9, None), (10, " Zephyr ")], "q bigint, query string")
    for block, size in ((64, 6_000_000), (1, 100)):
        monkeypatch.setattr(retrieval, "PART_BYTES", size)
        hits = {(r.q, r.doc): r.semantic / 4.25 for r in retrieval.search(docs, asked, 5, ("semantic",), block=block, least_cosine=0.0001).collect()}
        own, query = grams("t s " + "a " * 600 + tail), grams(tail)
        norm = lambda v: sum(n * n for n in v.values()) ** 0.5
        assert (10, 1) in hits and hits[7, 1] == pytest.approx(sum(n * own[g] for g, n in query.items()) / norm(own) / norm(query))
        assert not {q for q, _ in hits} - {7, 10}


def test_phrases_of_any_length(spark):
    """A phrase of one or two words counts too, in the title more than in the text, and as a part of longer words."""
    from tidemark.operators import retrieval

    docs = [(1, "loan news", "plain words"), (2, "plain news", "a loan deal"), (3, "plain", "reloaned"), (4, "plain", "nothing")]
    docs = spark.createDataFrame(docs, "doc bigint, title string, text string").withColumns({"source": F.lit("x"), "published_at": F.lit(None).cast("timestamp")})
    asked = spark.createDataFrame([(1, "loan"), (2, "loan deal")], "q bigint, query string")
    hits = {(r.q, r.doc): (r.matched, r.lexical) for r in retrieval.search(docs, asked, 5, ("lexical",)).collect()}
    assert set(hits) == {(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)}
    assert hits[1, 3] == (0, pytest.approx(2.0 * 9 / 3**0.5))
    idf = math.log(5 / 2.5) + 1
    # The title is read twice: two times `loan` among six words.
    assert hits[1, 1] == (1, pytest.approx((idf * (1 + math.log(2)) + 4) * 1.25 * 9 / 6**0.5))
    assert hits[1, 2][1] == pytest.approx((idf + 2) * 1.25 * 9 / 6**0.5)


def test_whole_main_text(spark):
    from tidemark.functions import text

    page = spark.createDataFrame([("<article>" + "word " * 3000 + "end</article>",)], "h string")
    assert page.select(text.main_text(F.col("h"))).first()[0] == "word " * 3000 + "end"
    assert page.select(text.main_text(F.col("h"), most=8000)).first()[0] == ("word " * 3000)[:8000]


@pytest.mark.parametrize("name", ["knn_predictions", "nb_predictions", "logistic_predictions", "forest_predictions"])
def test_late_components(spark, tmp_path, name):
    """Only component 40 of 64 tells the labels apart."""
    rows = [(i, [0.5] * 40 + [float(i % 3) + i % 7 / 100] + [0.5] * 23, i % 3) for i in range(600)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.predicted for r in plans.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got and got == {i: i % 3 for i in got}


def test_vectors_by_brute_force(spark):
    import numpy as np

    rows = duck(DATA).sql("SELECT vec_id, embedding, label FROM embeddings WHERE label IS NOT NULL").fetchall()
    ids, x, label = (np.array([r[i] for r in rows]) for i in range(3))
    x = x.astype(np.float32).astype(float)
    train = ids % 5 != 0
    assert x.shape[1] == 64
    width = np.ptp(x[train], axis=0)
    near = {}
    for i in np.flatnonzero(ids % 50 == 0):
        far = np.round(np.sqrt((((x[i] - x[train]) / width) ** 2).sum(axis=1) + (ids[i] % 4 != ids[train] % 4)), 8)
        best = label[train][np.lexsort((ids[train], far))[:5]].tolist()
        near[ids[i]] = max(best, key=lambda v: (best.count(v), -best.index(v)))
    assert {r.vec_id: r.predicted for r in plans.QUERIES["knn_predictions"](spark, str(DATA)).collect()} == near
    classes, groups = sorted(set(label.tolist())), len(set((ids[train] % 4).tolist()))
    scores = []
    for c in classes:
        own = train & (label == c)
        m, s, n = x[own].mean(axis=0), np.maximum(x[own].std(axis=0), 1e-4), own.sum()
        same_g = np.array([(ids[own] % 4 == g).sum() for g in range(4)])[ids % 4]
        scores.append(np.log((n + 1) / (train.sum() + len(classes))) + (-0.5 * np.log(2 * np.pi * s * s) - (x - m) ** 2 / (2 * s * s)).sum(axis=1) + np.log((same_g + 1) / (n + groups)))
    scores = np.array(scores)
    want = dict(zip(ids.tolist(), np.array(classes)[scores.argmax(axis=0)].tolist()))
    sure = dict(zip(ids.tolist(), (1 / np.exp(scores - scores.max(axis=0)).sum(axis=0)).tolist()))
    got = plans.QUERIES["nb_predictions"](spark, str(DATA)).collect()
    assert {r.vec_id: r.predicted for r in got} == want
    assert all(abs(r.confidence - sure[r.vec_id]) < 1e-4 for r in got)


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """The events as a folder of files, the latest rows in the first file."""
    folder = tmp_path_factory.mktemp("split")
    e = spark.read.parquet(str(DATA / "events.parquet")).toPandas().sort_values("ts", ascending=False)
    (folder / "events.parquet").mkdir()
    for k in range(5):
        e.iloc[k * 200 : (k + 1) * 200].to_parquet(folder / "events.parquet" / f"part-{k}.parquet", coerce_timestamps="us")
    return folder


@pytest.mark.parametrize("name", ["stream_daily_counts", "stream_rolling_coverage", "stream_reputation", "stream_first_seen", "stream_sessions", "stream_run_counters"])
def test_streams_of_several_files(spark, split_events, name):
    same(spark, name, plans.SQL[name], split_events)


@pytest.mark.parametrize("name, source", [("history_merge", "events"), ("run_diff", "documents"), ("unwrapped_urls", "documents"), ("page_bodies", "documents"), ("loan_return_pairs", "lineitem")])
def test_all_rows_come_back(spark, name, source):
    assert plans.QUERIES[name](spark, str(DATA)).count() == duck(DATA).sql(f"SELECT count(*) FROM {source}").fetchall()[0][0]
