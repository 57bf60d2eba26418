"""Batch retrieval counts what queries ask for, once, and what it counts is what the column functions give."""

from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import retrieval


def test_words_of_bytes(spark):
    """All characters, alone and inside words, and all that words begin and end with."""
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    rows = ["".join(f"ab{c}cd {c} {c}ef gh{c} " for c in chars[i : i + 4096]) for i in range(0, len(chars), 4096)]
    rows += ["", " ", "'", "-_'", "a", "a'", "'a'", "b'''", "--x-y--", "'_-it's'-'", "the 'the' The- -the", "o'neill's''", "x_y_ _z9_", "A1\nB2\tC3\x00D4", "King İstanbul aİ İ", None]
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", text.tokens(F.col("t")).alias("w")).collect()
    for i, want in got:
        assert [w.decode() for w in retrieval.words_of(retrieval.found_in((rows[i] or "").encode()))] == want, rows[i]


@pytest.mark.parametrize("wide", [False, True])
def test_gram_counts(wide):
    """Also where a text and a trigram do not fit 64 bits together."""
    texts = ["", "a", " ab  ab\n ab ", "\U0001f600 ab", "zz zz", " "] + [f"t{i}" for i in range(400)]
    if wide:
        texts[1] = "".join(chr(i) for i in range(0x4000, 0x50000) if not 0xD800 <= i <= 0xDFFF)
    grams = lambda x: Counter(y[i : i + 3] for y in [f"  {' '.join(x.split())}  "] for i in range(len(y) - 2)) if x.split() else Counter()
    number = lambda g: sum(ord(c) << s for c, s in zip(g, (42, 21, 0)))
    want = [{number(g): n for g, n in grams(x).items()} for x in texts]
    shape = lambda known, c: [{int(known[k]): n for k, n in zip(c.key[c.first[i] : c.first[i + 1]], c.n[c.first[i] : c.first[i + 1]])} for i in range(c.rows)]
    known, counts = retrieval.gram_counts(texts)
    assert (np.diff(known) > 0).all() and shape(known, counts) == want
    asked = np.array(sorted(map(number, ["ab ", " ab", "zz ", "t39", "qqq", "\U0001f600 a"])))
    for some in (asked, asked[:0], np.array([number("αβγ")])):
        known, counts = retrieval.gram_counts(texts, some)
        assert shape(known, counts) == [{g: n for g, n in w.items() if g in set(some.tolist())} for w in want]
        assert counts.norm == pytest.approx([sum(n * n for n in w.values()) ** 0.5 for w in want])


def test_queries_are_prepared_once_and_documents_count_what_they_ask(monkeypatch):
    """However many parts a task has, each block of queries is made ready once; other words and trigrams are not kept."""
    made, parts = [], []
    for kept, name in ((made, "Block"), (parts, "Part")):
        real = getattr(retrieval, name)
        monkeypatch.setattr(retrieval, name, lambda *a, real=real, kept=kept: (kept.append(real(*a)), kept[-1])[1])
    monkeypatch.setattr(retrieval, "PART_BYTES", 500)
    n = 60
    docs = {"doc": range(n), "title": [f"title{i} zeta" for i in range(n)], "text": [f"word{i} alpha alpha " + "filler " * i for i in range(n)], "tail": ["desk"] * n, "fields": [[None, None, "desk", "s"]] * n, "kind": ["article"] * n, "age": [None] * n, "size": [40 + 7 * i for i in range(n)]}
    batch = pa.RecordBatch.from_pydict({k: pa.array(list(v), {"doc": pa.int64(), "age": pa.int32()}.get(k)) for k, v in docs.items()})
    queries = [{"id": q, "query": w, "words": [w], "terms": [{"term": w, "weight": 1.0}]} for q, w in enumerate(("alpha", "zeta", "nowhere"))]
    rows = retrieval._search(SimpleNamespace(value=queries), retrieval.PARTS, 5, 6, 2, 0.05)(iter([batch]))
    hits = {(q, d): m for r in rows for q, d, m in zip(*(r.column(c).to_pylist() for c in ("q", "doc", "matched")))}
    assert len(parts) > 10 and len(made) == 2
    assert {hits[q, 3] for q in (0, 1)} == {1}
    for p in parts:
        # Two of the asked words are in every document; a title counts twice.
        assert p.tf.n.tolist() == [2.0, 2.0] * len(p.doc)
        assert np.isin(p.grams[0], [g for b in made for g in b.grams[0]]).all() and len(p.grams[1].key) < 25 * len(p.doc)


def test_words_of_queries_in_blocks(spark, monkeypatch):
    """Document frequencies and hits are the same if words and queries are sent in several blocks."""
    docs = [(i, f"w{i % 7} news", " ".join(f"w{i * k % 31}" for k in range(1, 12)), f"s{i % 3}") for i in range(90)] + [(90, None, None, None), (91, "the", "a 'b' of", "")]
    docs = spark.createDataFrame(docs, "doc bigint, title string, text string, source string").withColumn("published_at", F.lit(None).cast("timestamp"))
    asked = spark.createDataFrame([(i, f"w{i} w{i * 3 % 31} w{i * 5 % 31} absent{i}") for i in range(12)] + [(12, ""), (13, None)], "q bigint, query string")
    shape = lambda df: sorted((r.q, r["rank"], r.doc, r.matched, round(r.score, 6), r.methods) for r in df.collect())
    want = shape(retrieval.search(docs, asked, 4))
    monkeypatch.setattr(retrieval, "TERMS", 5)
    assert want and shape(retrieval.search(docs, asked, 4, block=3, queries_sent=4)) == want
    held = docs.select("title", "text", F.col("source").alias("tail"))
    known = spark.createDataFrame([(w,) for w in ("w1", "w2", "news", "s2", "absent", "w30", "w29", "w28")], "term string")
    found = {r.term: r.df for r in retrieval.frequencies(held, known).collect()}
    rows = [Counter(retrieval.words_of(retrieval.found_in(" ".join(x or "" for x in r).encode()))) for r in held.collect()]
    assert found == {b: n for b in ("w1", "w2", "news", "s2", "w30", "w29", "w28") if (n := sum(b.encode() in r for r in rows))} | {"": 90}
