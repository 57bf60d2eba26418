"""The pipeline stage by stage against plain versions."""

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute
import corpus_pipeline
from test_dedup import classes, fingerprint

from tidemark.llm.common import written

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(10**6, None, None, None, None), (10**6 + 1, "123 !!", "en", "s", 6), (10**6 + 2, "", "en", "s", 0), (None, "the other and of this that", "en", "s", 9)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).unionByName(docs.limit(3))
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, tables[-1], SF), name)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        tables.append(out)
    rows = [[(r.doc_id, r.text) for r in t.collect()] for t in tables[:-1]]
    assert {r for r in rows[0]} - {r for r in rows[1]} == {(10**6, None), (10**6 + 1, "123 !!"), (10**6 + 2, "")}
    groups = defaultdict(list)
    for k, t in rows[1]:
        groups["".join(t.split(" ")).replace("\n", "").replace("\t", "")].append((-len(t), k is None, k or 0, k, t))
    assert sorted(map(repr, rows[2])) == sorted(repr(min(g)[3:]) for g in groups.values())
    fps = [fingerprint(t.encode()) for _, t in rows[2]]
    cls = classes(len(fps), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    near = defaultdict(list)
    for (k, t), c in zip(rows[2], cls):
        near[c].append((k is None, k or 0, k, t))
    assert sorted(map(repr, rows[3])) == sorted(repr(min(g)[2:]) for g in near.values())
    kept = brute.word_repeats([t.encode() for _, t in rows[3]], 35)
    want = {k: (t if x == b" ".join(t.encode().split()) else x.decode()) for (k, t), (_, _, _, x) in zip(rows[3], kept)}
    assert dict(rows[4]) == want and len(rows[4]) == len(rows[3])
    places = defaultdict(list)
    for r in tables[5].collect():
        places[r.sequence_id].append((r.offset, r.length))
    assert {r.doc_id for r in tables[5].select("doc_id").collect()} == set(want)
    for x in places.values():
        x.sort()
        assert all(a == sum(n for _, n in x[:i]) for i, (a, _) in enumerate(x)) and sum(n for _, n in x) <= 2048


def test_empty_documents(spark):
    """Every stage takes an empty table and gives an empty one with its columns."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0).selectExpr("*", "1 AS row", "'x' AS turn")
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, SF), name)
        assert out.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
            docs = out
