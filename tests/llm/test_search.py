"""The three searches against plain versions: nulls, ties, repeated rows, empty tables, clashing columns, long texts, hot groups."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import best_position, kd_search, spelling
from tidemark.llm.best_position import lexical_index, lexical_search, ranked_search
from tidemark.llm.kd_search import kd_topk
from tidemark.llm.spelling import near_words, roots_of, spelling_groups, words_of

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(SMALL) for t in TERM.findall(text or "")]


def plain_search(docs, items, k):
    bags = [(d, Counter(plain_terms(t))) for d, t in docs]
    N, L = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scored = []
        for d, b in bags:
            n = sum(b.values())
            score = sum(
                math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * (50 + 50 * n * N // L))) for t in set(plain_terms(text)) if t in b
            )
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def lexicon():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choices("abcdeéß9", k=rnd.randint(1, 6))) for _ in range(250)]
    text = lambda n: rnd.choice([" ", ", ", "\x00", "_"]).join(rnd.choices(vocab, k=n))
    rows = [(i, text(rnd.randint(0, 80))) for i in range(150)]
    rows += [(1000 - i, "Abc abc ABC des") for i in range(90)] + [(None, rows[3][1])] * 3 + [(7, rows[7][1])] * 2
    rows += [(200, None), (201, ""), (202, " ..\n"), (203, text(5000)), (204, "É é İ " + "x" * 5000), (-5, rows[9][1])]
    items = [(i, text(rnd.randint(1, 12))) for i in range(25)] + [(3, rows[7][1]), (None, "abc"), (90, None), (91, ""), (92, "nowhere to be found"), (93, "abc des"), (93, "abc des")]
    return rows, items


@pytest.mark.parametrize("shard, first, growth, pairs, terms", [(1 << 24, 64, 64, 1 << 20, 1 << 18), (900, 2, 3, 40, 1 << 18), (1, 8, 4, 1 << 20, 0)])
def test_ranked_search(spark, lexicon, monkeypatch, shard, first, growth, pairs, terms):
    """One shard, many shards in rounds with several blocks of queries, and a shard of all terms for every document."""
    rows, items = lexicon
    docs = spark.createDataFrame([(*r, "t", 1) for r in rows], "doc_id bigint, text string, terms string, q int").repartition(3)
    asked = spark.createDataFrame([(*x, 1) for x in items], "item_id bigint, text string, q int")
    monkeypatch.setattr(best_position, "PIECE_BYTES", 64)
    got = ranked_search(docs, asked, 10, terms, shard, first=first, growth=growth, block_pairs=pairs).collect()
    assert sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in got], key=str) == plain_search(rows, items, 10)


def test_index_is_searched_again_over_all_terms(spark, lexicon):
    rows, items = lexicon
    index = lexical_index(spark.createDataFrame(rows, "doc_id bigint, text string"), shard_bytes=2000)
    assert index.count() > 3
    for part in (items[:4], items[10:14]):
        queries = spark.createDataFrame([(i, sorted(set(plain_terms(t)))) for i, t in part], "q bigint, terms array<string>")
        got = lexical_search(index, queries, 5, first=2, growth=2).collect()
        assert sorted([(r.q, r["rank"], r.doc_id, r.score) for r in got], key=str) == plain_search(rows, part, 5)


def test_reading_stops_early_and_never_too_early():
    """Positions read are fewer than the lists have, and the best documents are right at any step, ties included."""
    rnd = np.random.default_rng(3)
    early = 0
    for _ in range(60):
        docs, terms = 400, 5
        n = rnd.integers(1, 60, docs)
        held = [np.flatnonzero(rnd.random(docs) < rnd.choice([0.1, 0.6, 1.0])) for _ in range(terms)]
        tf = [rnd.zipf(2.2, len(h)).clip(1, 30) for h in held]
        shard = {"n": n, "df": np.array([len(h) for h in held]), "docs": np.concatenate(held).astype(np.int32), "tf": np.concatenate(tf), "terms": [str(i) for i in range(terms)]}
        lists = best_position.Lists(shard, docs, int(n.sum()))
        weights = rnd.integers(1, 4000, terms)
        score = np.zeros(docs, np.int64)
        m = 50 + 50 * n * docs // n.sum()
        for h, f, w in zip(held, tf, weights):
            score[h] += w * (10**9 * f // (1000 * f + 20 * m[h]))
        want = sorted((-s, d) for d, s in enumerate(score.tolist()) if s > 0)[:7]
        found, scores, read = best_position.best_positions(lists, np.arange(terms), weights, 7, 1, step=4)
        assert list(zip((-scores).tolist(), found.tolist())) == want
        early += read < max(map(len, held))
        floor = -want[-1][0]
        found, scores, less = best_position.best_positions(lists, np.arange(terms), weights, 7, floor, step=4)
        assert list(zip((-scores).tolist(), found.tolist())) == want and less <= read
    assert early > 40


def test_ranked_search_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "abc")], "item_id bigint, text string")
    assert [tuple(r) for r in ranked_search(docs, items).collect()] == [(1, 1, 1, math.floor(1000 * math.log(4 / 3)) * (10**9 // 3000))]
    assert ranked_search(docs.limit(0), items).collect() == []
    assert ranked_search(docs, items.limit(0)).collect() == []
    assert ranked_search(docs.where("doc_id = 2"), items).collect() == []


def plain_topk(rows, k):
    usable = [(i, v, [min(max(math.floor(1024 * float(x)), -(2**62)), 2**62) for x in e]) for i, (v, e) in enumerate(rows) if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q, e in usable:
        if q is None or q % 100:
            continue
        scored = []
        for j, v, f in usable:
            if i != j and len(e) == len(f):
                s = min(max(sum(x * y for x, y in zip(e, f)), -(2**63)), 2**63 - 1)
                scored.append((-s, v is None, v or 0, v))
        out += [(q, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("leaf, shard, block, first", [(256, 8 << 20, 32 << 20, 16), (4, 8 * 5 * 40, 8 * 5 * 3, 2), (1, 8 * 5 * 7, 32 << 20, 3)])
def test_kd_topk(spark, monkeypatch, leaf, shard, block, first):
    """One shard; many shards, rounds and blocks of queries; leaves of one vector."""
    rnd = random.Random(8)
    vec = lambda: [rnd.choice([rnd.uniform(-1, 1), 0.5]) for _ in range(5)]
    rows = [(i, vec()) for i in range(-200, 400)]
    rows += [(1000 + i, [0.25, 0.5, 0.0, -0.0, 1.0]) for i in range(0, 250)] + [(2000, None), (2100, [1.0, None, 0.0, 0.0, 0.0]), (2200, [float("nan")] * 5), (2300, [float("inf")] * 5)]
    rows += [(None, vec()), (None, rows[0][1]), (3000, [1.0, 2.0]), (3001, [0.5, -2.0]), (3100, []), (3200, []), (4000, [1e300] * 5), (4001, [-3e9, 1.0, 2.0, 0.0, 1e12])]
    rows += [rows[0], rows[0], (0, vec())]
    monkeypatch.setattr(kd_search, "SHARD_BYTES", shard)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id bigint, embedding array<double>, row int, n int").repartition(2)
    got = kd_topk(df, leaf=leaf, block_bytes=block, first=first, growth=2).collect()
    assert sorted([(r.query_id, r["rank"], r.vec_id, r.score) for r in got], key=str) == plain_topk(rows, 10)
    assert kd_topk(df.limit(0)).collect() == []


def test_boxes_prune():
    """On clustered vectors most leaves are never opened."""
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(40, 8)) * 2000
    v = np.floor(centres[rnd.integers(0, 40, 8000)] + rnd.normal(size=(8000, 8)) * 30).astype(np.int64)
    order, bounds = kd_search.median_order(v, 64)
    tree = kd_search.Tree.of(order, list(range(8000)), v[order].astype(float), bounds)
    added, add = [], kd_search.Best.add
    kd_search.Best.add = lambda self, query, *rest: (added.append(len(np.unique(query))), add(self, query, *rest))[1]
    try:
        best = kd_search.walk(tree, v[:50].astype(float), np.arange(50), 10, np.full(50, -np.inf))
    finally:
        kd_search.Best.add = add
    assert sum(added) < 50 * (len(bounds) - 1) / 4
    score = v[:50] @ v.T
    score[np.arange(50), np.arange(50)] = -(2**40)
    assert (np.sort(score, axis=1)[:, -10] == best.kth).all()


RUN = re.compile("[A-Za-zÀ-ÿ]+")


def plain_spelling(docs, least=7, often=2, factor=10):
    n = Counter()
    for doc, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(SMALL)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            word = run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run
            if len(word) >= least:
                n[word] += 1
    n = {w: c for w, c in n.items() if c >= often}
    near = defaultdict(set)
    by_rest = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            by_rest[w[:i], w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter), near[shorter].add(w)
    for group in by_rest.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) if near[w] else None for w in n}
    form = {w: f if f and n[f] >= factor * n[w] else None for w, f in form.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


@pytest.fixture(scope="module")
def misspelt():
    rnd = random.Random(6)
    base = ["".join(rnd.choices("abcdeéÿ×", k=rnd.randint(6, 10))) for _ in range(120)]
    def variant(w):
        at, c = rnd.randrange(len(w)), rnd.choice("abcdeéü")
        return rnd.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :], w[1:] + w[0]])
    words = base + [variant(w) for w in base for _ in range(6)]
    words += [variant(w) for w in words[-300:]]
    text = lambda k: rnd.choice([" ", "1", "—", "\n"]).join(rnd.choice([w, w.upper(), w.title()]) for w in rnd.choices(words, [1 / (1 + i % 120) ** 1.5 for i in range(len(words))], k=k))
    docs = [(i, text(rnd.randint(0, 150))) for i in range(200)] + [(5, None), (6, ""), (7, "a b"), (None, text(50)), (None, "abcdefgh abcdefgh"), (8, text(3000)), (9, "z" * 4000 + " " + "z" * 4000), (9, "z" * 3999 + " " + "z" * 3999)]
    docs += [(500, "yyyyyyyyy " * 300 + "yyyyyyyyx " * 20 + "yyyyyyywx " * 2)]  # a way of two forms
    return docs + [docs[3]] * 20 + [(10 + i, "hotword hotword hotwords") for i in range(300)]


@pytest.mark.parametrize("more", [{}, {"cell": 40, "sample": 400, "leaf": 4}, {"cell": 40, "block": 9, "leaf": 2, "parted": 0}, {"block": 30}])
def test_spelling(spark, misspelt, monkeypatch, more):
    """One cell a length; many cells; cells in parts, joined by a shuffle or a broadcast."""
    monkeypatch.setattr(spelling, "PIECE_BYTES", 50)
    monkeypatch.setattr(spelling, "SLICE", 16)
    docs = spark.createDataFrame([(*d, "x", 1) for d in misspelt], "doc_id bigint, text string, word string, n int").repartition(3)
    got = sorted(tuple(r) for r in spelling_groups(docs, **more).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = plain_spelling(misspelt)
    assert got == want
    assert sum(r[1] is not None and r[2] != r[1] for r in want) > 0 and len(want) > 300


def test_spelling_of_nothing(spark):
    docs = spark.createDataFrame([(1, None), (2, "short words"), (3, "onlyonce")], "doc_id bigint, text string")
    assert spelling_groups(docs).collect() == spelling_groups(docs.limit(0)).collect() == []


def test_long_ways(spark):
    way = [("a" * i, "a" * (i + 1)) for i in range(1, 20)]
    got = {r.word: r.root for r in roots_of(spark.createDataFrame(way, "word string, form string")).collect()}
    assert got == {w: "a" * 20 for w, _ in way}


def test_no_near_pair_is_outside_the_radius():
    """Counts in classes that stop at two never put an edit further away than 2, or 1 for a letter more."""
    rnd = random.Random(1)
    for _ in range(3000):
        w = "".join(rnd.choices("abéÿ×c", k=rnd.randint(7, 20)))
        at, c = rnd.randrange(len(w)), rnd.choice("abzéþ")
        for other, radius in ((w[:at] + c + w[at + 1 :], 2), (w[:at] + c + w[at:], 1)):
            x, y = (spelling.codes(spelling.letters([v], len(v)))[0] for v in (w, other))
            assert int(np.bitwise_count(x ^ y)) <= radius


def test_each_pair_of_one_length_meets_once(spark):
    """The pairs met are those that are near: counts over all words are even, and twice the pairs."""
    rnd = random.Random(5)
    words = sorted({"".join(rnd.choices("ab", k=8)) for _ in range(400)})
    table = spark.createDataFrame([(w, 2, 8) for w in words], "word string, n bigint, len bigint")
    got = {r.word: r.n_near for r in near_words(table, cell=20, sample=100, leaf=2, block=7).collect()}
    assert got == {w: k for w in words if (k := sum(sum(a != b for a, b in zip(w, v)) == 1 for v in words))}
