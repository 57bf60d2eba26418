"""Dedup operators against plain versions on small inputs with ties, nulls, empty, repeated and very long texts."""

import hashlib
import random
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash

sys.path.insert(0, str(Path(__file__).resolve().parent))
import brute

from tidemark.llm.components import components
from tidemark.llm.embedding_dedup import cell_visits, embedding_dedup
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.line_dedup import line_dedup
from tidemark.llm.simhash_dedup import covering_masks, simhash_groups, tables
from tidemark.llm.substring_dedup import substring_dedup
from tidemark.llm.suffix_array_dedup import suffix_array_dedup

SCHEMA = "doc_id bigint, text string, start string, n int, spans string"  # the last three clash with inner names


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def corpus(spark):
    rnd = random.Random(3)
    vocab = ["".join(rnd.choices("abcdeé", k=rnd.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rnd.choices(vocab, k=n))
    passage, line = text(90), "\n".join(text(9) for _ in range(4))
    rows = [text(rnd.randint(0, 120)) for _ in range(60)]
    rows += [text(rnd.randint(0, 50)) + " " + passage + "\n" + text(rnd.randint(0, 50)) for _ in range(25)]
    rows += [text(5) + "\n" + line + "\n" + text(5) for _ in range(12)]
    rows += [rows[1]] * 4 + [None, "", " \t\n", "a", "ab " * 300, "x" * 700, text(9000), "é" * 150, passage.replace(" ", "\t")]
    base = text(200).split()
    for _ in range(10):
        copy = list(base)
        copy[rnd.randrange(200)] = "zz"
        rows.append(" ".join(copy))
    data = [(i, t, "s", 1, "t") for i, t in enumerate(rows)]
    data += [data[65], data[3], (None, rows[70], None, None, None), (None, None, None, None, None)]
    return spark.createDataFrame(data, SCHEMA).repartition(5), [(r[0], (r[1] or "").encode()) for r in data]


@pytest.mark.parametrize("hot", [1 << 19, 3000, 2])
@pytest.mark.parametrize("op, plain, width", [(suffix_array_dedup, brute.byte_repeats, 200), (substring_dedup, brute.word_repeats, 35)])
def test_substrings(corpus, op, plain, width, hot):
    """All columns, with groups that hold all, with longer prefixes for some groups, and with whole windows for all."""
    df, rows = corpus
    want = sorted((k is None, k or 0, n, gone, spans if op is suffix_array_dedup else 0, sha(x)) for (k, _), (n, gone, spans, x) in zip(rows, plain([t for _, t in rows], width)))
    size = "n_bytes" if op is suffix_array_dedup else "n_words"
    got = op(df, hot=hot).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r[size], r.n_removed, r.n_spans if op is suffix_array_dedup else 0, r.kept_sha256) for r in got)
    assert got == want


@pytest.mark.parametrize("limit", [1 << 18, 0])
@pytest.mark.parametrize("op, spec, width", [("suffix_array_dedup", (200, 40, False, 1 << 21), 200), ("substring_dedup", (35, 6, True, 1 << 20), 35)])
def test_very_many_equal_rows(spark, op, spec, width, limit):
    """Thousands of rows equal in doc_id and text, or without an id, beside a row that shares a part and one that shares nothing."""
    from importlib import import_module

    from tidemark.llm import repeats
    from tidemark.llm.common import keyed, prepared

    rnd = random.Random(7)
    text = lambda n: " ".join(str(rnd.randrange(10**6)) for _ in range(n))
    same, other, short = text(400), text(300), text(3)
    part = " ".join(same.split()[100:160])
    data = [(1, same)] * 5000 + [(None, other)] * 3000 + [(2, short)] * 50 + [(3, f"{part} {text(40)}"), (4, text(200))]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(8)
    prepared(spark)
    module = import_module(f"tidemark.llm.{op}")
    spans = repeats.with_spans(keyed(docs), repeats.Windows(*spec), lambda t, rest: module.repeated(t, rest, width), twin_limit=limit)
    out = module._apply(width, False)
    size = "n_words" if spec[2] else "n_bytes"
    schema = f"doc_id bigint, {size} bigint, n_removed bigint, " + ("" if spec[2] else "n_spans bigint, ") + "kept_sha256 string"
    got = spans.select("doc_id", "text", "spans").mapInArrow(out, schema).groupBy("doc_id", size, "n_removed").count().collect()
    units = (lambda t: len(t.split())) if spec[2] else (lambda t: len(t.encode()))
    want = {(1, units(same), units(same), 5000), (None, units(other), units(other), 3000), (2, units(short), 0, 50)}
    got = {tuple(r) for r in got}
    assert want <= got and len(got) == 5
    gone = {r[0]: r[2] for r in got}
    assert gone[4] == 0 and gone[3] in ((60,) if spec[2] else (len(part), len(part) + 1))


def test_index_and_tree_of_many_small_texts():
    """Both indexes against plain search; the first run of a text matters as much as the others."""
    from tidemark.llm import substring_dedup as tree, suffix_array_dedup as runs

    rnd = random.Random(11)
    for _ in range(400):
        parts = [[rnd.randint(1, 3) for _ in range(rnd.randint(0, 14))] for _ in range(rnd.randint(1, 6))]
        parts += [parts[0]] * rnd.randint(0, 2)
        text = np.array([x for part in parts for x in (*part, 0)])
        rest = np.array([len(part) - i for part in parts for i in range(len(part) + 1)])
        places = [(k, i) for k, part in enumerate(parts) for i in range(len(part) + 1)]
        windows = [tuple(parts[k][i : i + 4]) if i + 4 <= len(parts[k]) else None for k, i in places]
        want = [w is not None and windows.count(w) > 1 for w in windows]
        for op in (tree, runs):
            assert (op.repeated(text, rest, 4) & (rest >= 4)).tolist() == want


@pytest.mark.parametrize("words", [True, False])
def test_longer_prefixes(words):
    """Finer runs hold every window of a run once, and equal windows of different runs are filed under one prefix."""
    from tidemark.llm import repeats

    rnd = random.Random(9)
    spec = repeats.Windows(12, 4, words, 100)
    letters = [rnd.choice("abc") for _ in range(300)] * 2
    text = (" " if words else "").join(letters).encode()
    u = repeats.units_of([text], words)
    filed, seen = {}, []
    for t, start, n, mh, sh in zip(*(x.tolist() for x in repeats.runs_of(u, spec))):
        body = repeats.cut(text, spec, [start], [abs(n)])[0]
        row = [(1, 2, mh, sh, start, abs(n), True, body)]
        batch = repeats.pa.RecordBatch.from_arrays([repeats.pa.array(c, f.type) for c, f in zip(zip(*row), repeats.PIECE)], schema=repeats.PIECE)
        for out in repeats.finer_runs(spec)(iter([batch])):
            for r in out.to_pylist():
                for i in range(r["n"]):
                    seen.append(r["start"] + i)
                    window = tuple(letters[r["start"] + i : r["start"] + i + 12])
                    assert filed.setdefault(window, r["mh"]) == r["mh"]
    assert sorted(seen) == list(range(600 - 12 + 1))


def test_substrings_of_a_long_text_in_pieces(spark, monkeypatch):
    from tidemark.llm import repeats

    rnd = random.Random(5)
    words = [str(rnd.randrange(1000)) for _ in range(4000)]
    words[3000:3050] = words[100:150]
    text = " ".join(words).encode()
    for spec, n in ((repeats.Windows(35, 6, True, 1000), len(words)), (repeats.Windows(200, 40, False, 1000), len(text))):
        pieces = repeats.pieces_of([text], spec, limit=3000)
        assert len(pieces) > 2
        seen = []
        for _, base, body in pieces:
            _, start, count, _, _ = repeats.runs_of(repeats.units_of([body], spec.words), spec)
            seen += [base + a + i for a, c in zip(start, np.abs(count)) for i in range(c)]
        assert sorted(seen) == list(range(n - spec.width + 1))


@pytest.mark.parametrize("op", [suffix_array_dedup, substring_dedup, exact_dedup, line_dedup, simhash_groups])
def test_empty_table(spark, op):
    assert op(spark.createDataFrame([], SCHEMA)).collect() == []


def test_exact_and_near_stages_with_very_many_equal_rows(spark):
    """A third of all rows has no id and one text: counted before they move, and one of them stays."""
    from tidemark.llm.exact_dedup import one_of_each_text
    from tidemark.llm.simhash_dedup import one_of_each_group

    data = [(None, "the same text for all of these", i) for i in range(4000)] + [(5, "the same  text for all of these", 0)] * 3 + [(i, f"{i} other words {i * 7} of no kin {i * 3}", 1) for i in range(100, 130)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string, n_chars int").repartition(7)
    got = exact_dedup(docs).groupBy("doc_id", "keep_id", "group_size", "kept").count()
    got = {tuple(r) for r in got.where("doc_id is null or doc_id = 5").collect()}
    assert got == {(None, 5, 4003, False, 4000), (5, 5, 4003, True, 1), (5, 5, 4003, False, 2)}
    for stage in (one_of_each_text, one_of_each_group):
        kept = stage(docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id or -1 for r in kept.collect()) == [5, *range(100, 130)]
    alone = docs.where("doc_id is null")
    for stage in (one_of_each_text, one_of_each_group):
        assert [(r.doc_id, r.text) for r in stage(alone).collect()] == [(None, "the same text for all of these")]
    assert {tuple(r) for r in exact_dedup(alone).groupBy("keep_id", "kept").count().collect()} == {(None, True, 1), (None, False, 3999)}
    groups = {(r.doc_id, r.component_id) for r in simhash_groups(docs).where("doc_id is null or doc_id = 5").collect()}
    assert groups == {(None, 5), (5, 5)} and {r.component_id for r in simhash_groups(alone).collect()} == {None}


def test_exact(corpus):
    df, rows = corpus
    groups = defaultdict(list)
    for k, t in rows:
        groups[b"".join(t.split())].append((-len(t.decode()), k is None, k))
    got = exact_dedup(df).collect()
    assert len(got) == len(rows)
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    for body, members in groups.items():
        keep = min(members)[2]
        mine = [r for r in got if r.text_sha256 == sha(body)]
        assert len(mine) == len(members) and {r.group_size for r in mine} == {len(members)}
        assert {r.keep_id for r in mine} == {keep} and sum(r.kept for r in mine) == 1


def test_lines(corpus):
    df, rows = corpus
    firsts, seen = {}, []
    for k, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        lines = t.split(b"\n")
        for i in range(len(lines) - 2):
            firsts.setdefault(tuple(lines[i : i + 3]), (k, i))
    got = sorted((r.doc_id or -1, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup(df).collect())
    for k, t in rows:
        lines = t.split(b"\n")
        gone = {i + d for i in range(len(lines) - 2) if firsts[tuple(lines[i : i + 3])] != (k, i) for d in range(3)}
        kept = [x for i, x in enumerate(lines) if i not in gone]
        seen.append((k or -1 if k != 0 else 0, len(lines), len(gone), sha(b"\n".join(kept))))
    assert got == sorted((a or -1, b, c, d) for a, b, c, d in seen)


def fingerprint(t):
    words = t.lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("bucket", [4096, 1])
def test_simhash(corpus, bucket):
    df, rows = corpus
    fps = [fingerprint(t) for _, t in rows]
    cls = classes(len(rows), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    least = {}
    for (k, _), c in zip(rows, cls):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    want = sorted(((k, f"{f:016x}", least.get(c)) for (k, _), f, c in zip(rows, fps, cls)), key=str)
    assert any(k is None for k, _, _ in want)
    got = sorted((tuple(r) for r in simhash_groups(df, bucket=bucket).collect()), key=str)
    assert got == want


def test_covering():
    rnd = random.Random(1)
    for bits, radius in ((64, 3), (30, 3), (64, 2)):
        masks = covering_masks(bits, radius)
        for _ in range(300):
            diff = sum(1 << b for b in rnd.sample(range(bits), radius))
            assert any(diff & m == 0 for m in masks)
    assert all(mask & sub == mask for mask, more in tables(3) for sub in more)


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    cls = classes(1100, lambda i, j: False)
    root = list(range(1100))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    want = {i: top(i) for e in edges for i in e if top(i) != i}
    for contract in (True, False):
        got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u bigint, v bigint").repartition(4), contract).collect()}
        assert got == want
    assert components(spark.createDataFrame([], "u bigint, v bigint")).collect() == [] and cls


def planted_vectors(n):
    """Labelled vectors around a few directions, so that many pairs lie near the threshold and near borders of cells; one
    vector is very frequent, some are unusable, very large, very small, short, without id, or share an id."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(40, 8))
    vec = [(base[i % 40] + rng.normal(size=8) * rng.choice([0.02, 0.1, 0.15, 1.0])).astype(np.float32).astype(float).tolist() for i in range(n)]
    vec[5], vec[6], vec[7], vec[8] = None, [0.0] * 8, [float("nan")] + [1.0] * 7, [None] + [1.0] * 7
    vec[20 : 20 + n // 3] = [vec[19]] * (n // 3)
    vec[2], vec[3], vec[4] = [x * 1e300 for x in vec[19]], [x * 1e-300 for x in vec[19]], [float("inf")] * 8
    vec[9] = vec[1][:4]
    label = [None if i % 50 == 49 else i % 3 if i < n // 4 else 0 for i in range(n)]
    ids = [None if i == 15 else 40 if i == n - 1 else i for i in range(n)]
    return ids, vec, label


@pytest.mark.parametrize("n, block, cell", [(60, 8192, 4096), (300, 64, 10), (1500, 8192, 100), (1500, 50, 100)])
def test_embeddings(spark, n, block, cell):
    ids, vec, label = planted_vectors(n)
    rows = [(i, v, x, "clash", 1.0) for i, v, x in zip(ids, vec, label)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int, node string, unit double").repartition(4)
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_dedup(df, block=block, sample=800, cell=cell).collect()), key=repr)
    good = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
    scaled = lambda v: np.array(v) / max(map(abs, v))
    unit = [scaled(v) / np.linalg.norm(scaled(v)) if good(v) else None for v in vec]
    same = np.zeros((n, n), bool)
    usable = [i for i in range(n) if unit[i] is not None and label[i] is not None and len(unit[i]) == 8]
    u = np.stack([unit[i] for i in usable])
    same[np.ix_(usable, usable)] = (u @ u.T >= 0.98) & (np.array([label[i] for i in usable])[:, None] == np.array([label[i] for i in usable]))
    np.fill_diagonal(same, False)
    if n == 1500:
        others = np.delete(np.arange(n), np.arange(19, 20 + n // 3))
        assert same[np.ix_(others, others)].sum() > 2000  # thousands of links besides those of the frequent vector
    cls = classes(n, lambda i, j: same[i, j])
    least = defaultdict(lambda: None)
    for i in range(n):
        if ids[i] is not None and (least[cls[i]] is None or ids[i] < least[cls[i]]):
            least[cls[i]] = ids[i]
    want = sorted(((k is None, k or 0, int(same[i].sum()), least[cls[i]], k == least[cls[i]]) for i, k in enumerate(ids)), key=repr)
    assert got == want


def test_cells(spark):
    """Small cells are many, every vector has one home, and visits stay below all cells where vectors lie apart."""
    ids, vec, label = planted_vectors(1500)
    df = spark.createDataFrame(list(zip(ids, vec, label)), "vec_id bigint, embedding array<double>, label int")
    r = cell_visits(df, cell=50).where("size = 8").first()
    assert r.cells >= 8 and r.vectors <= r.visits < r.vectors * r.cells
    assert cell_visits(df.limit(0)).collect() == []


def test_no_vectors(spark):
    assert embedding_dedup(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).collect() == []


def test_one_row_of_each_near_group(spark):
    """Rows without an id beside rows with one, groups without any id, ids that repeat, and rows equal in id and text."""
    from tidemark.llm.simhash_dedup import one_of_each_group

    a, b, c = "the quick brown fox jumps over it", "lorem ipsum dolor sit amet again", "nine ten eleven twelve thirteen more"
    rows = [(1, a, "x"), (1, a.upper(), "x"), (None, a, "x"), (None, b, "x"), (None, b.upper(), "x"), (7, c, "x"), (7, c, "y"), (9, c, "x"), (7, "", "x"), (None, None, "x")]
    got = one_of_each_group(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert sorted(((r.text or "").lower(), r.doc_id) for r in got if r.text in (a, a.upper(), c, "")) == [("", 7), (c, 7), (a, 1)]
    assert len(got) == 4 and [r.doc_id for r in got if r.text in (b, b.upper())] == [None]
