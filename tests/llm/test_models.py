"""Language ID, toxicity, packing and SentencePiece: held-out accuracy, brute force and round trips."""

import random
import zlib
from collections import defaultdict
from itertools import pairwise

import numpy as np
import pytest

from tidemark.llm import packing, sentencepiece_codec, toxicity
from tidemark.llm.language_id import grams_of, language_id
from tidemark.llm.toxicity import folded

SF = "/root/testdata/sf0.01"
ODD = [None, "", " ", "123 456 !!", "\n\n", "a", "Ünïcode ▁ text", "x" * 30_000]


def crc(k):
    return zlib.crc32(str(k).encode())


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_language_of_held_out_documents(spark, documents):
    odd = spark.createDataFrame([(10**6 + i, t, None, "s", 0) for i, t in enumerate(ODD)] + [(None, "the and of", "en", None, None)], documents.schema)
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in language_id(documents.unionByName(odd)).collect()}
    assert len(got) == len(truth) + len(ODD) + 1
    held = [k for k in truth if crc(k) % 4 == 2]
    assert all(got[k].held_out == (k in set(held)) for k in truth)
    assert sum(got[k].lang_pred == truth[k] for k in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values())
    assert [got[10**6 + i].lang_pred == "und" for i in range(5)] == [True] * 5 and got[10**6 + 5].lang_pred != "und"


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None), (2, None, "en")], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language_id(df).collect()} == {("und", 0.0)}
    assert language_id(df.where("doc_id > 5")).collect() == []


def test_grams():
    gram, text = grams_of(["Ab,  cd", None, "xyz"])
    got = [(bytes(int(g) >> s & 255 for s in (0, 8, 16, 24)), int(t)) for g, t in zip(gram, text)]
    assert got == [(b" ab ", 0), (b"ab c", 0), (b"b cd", 0), (b" cd ", 0), (b" xyz", 2), (b"xyz ", 2)]


def test_language_by_exact_sets(spark, documents):
    """Beside a plain version with exact sets of n-grams in place of the filter: the same members, and scores that differ by
    what the filter's corrected false positives leave."""
    from collections import Counter

    from tidemark.llm import language_id as li

    clash = documents.limit(300).selectExpr("*", "1 AS lang_pred", "'x' AS score", "2 AS c0")
    rows = clash.collect() * 2
    model = li.fit(clash.select("text", "lang"), sample=10**6)
    counts = {x: Counter() for x in model.languages}
    for r in rows[: len(rows) // 2]:
        if r.text is not None and r.lang is not None:
            counts[r.lang].update(li.grams_of([r.text])[0].tolist())
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    members = {x: {g for g, n in counts[x].items() if n >= 3 and rate[x][g] >= 0.5 * max(rate[y].get(g, 0) for y in rate)} for x in model.languages}
    members = {x: set(sorted(m, key=lambda g: (-counts[x][g], g))[: li.GRAMS]) for x, m in members.items()}
    texts = [r.text for r in rows[:300]] + ["", None, "zzqx", rows[0].text * 400]
    got = li.scores_of(model, texts)
    agree = 0
    for t, score in zip(texts, got):
        gram = li.grams_of([t])[0].tolist()
        want = [sum(g in members[x] for g in gram) for x in model.languages]
        assert all(abs(a - b) <= 0.02 * len(gram) + 1 for a, b in zip(score, want))
        agree += model.languages[int(np.argmax(score))] == model.languages[int(np.argmax(want))]
    assert agree >= len(texts) - 2
    got = li.identify(clash.unionByName(clash), model, ("doc_id", "lang"))
    pairs = defaultdict(set)
    for r in got.collect():
        pairs[r.doc_id].add((r.lang_pred, r.score))
    assert got.columns == ["doc_id", "lang", "lang_pred", "score"] and all(len(v) == 1 for v in pairs.values())


def test_grams_in_slices():
    from tidemark.llm import language_id as li

    texts = ["some words here", None, "", "  a  b ", "x" * 50, "ünï cödé"]
    whole = [np.concatenate(x).tolist() for x in zip(*li.gram_slices(texts))]
    for step in (1, 3, 7, 40):
        assert [np.concatenate(x).tolist() for x in zip(*li.gram_slices(texts, step))] == whole


def test_toxicity_by_plain_search(spark):
    """Scores beside a plain search for every term at every word, on rows with clashing columns, repeats and several labels."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(400)
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    twice = docs.unionByName(docs.limit(5)).selectExpr("doc_id", "text", "1 AS toxic", "'x' AS score", "2 AS held_out", "3 AS term")
    doubled = labels.unionByName(labels.limit(40).withColumn("toxic", 1 - labels.toxic))
    lexicon = toxicity.fit(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels, "doc_id").select("text", "toxic"))
    automaton = lexicon.automaton()
    for text in [r.text for r in docs.collect()] + [None, "", "1d10t " * 50]:
        words = toxicity.folded(text).split()
        line = f" {' '.join(words)} "
        total = 0.0
        for i, w in enumerate(words):
            found = [v for t, v in lexicon.terms.items() if (t.endswith(" ") and t == f" {w} ") or (not t.endswith(" ") and f" {w}".startswith(t))]
            near = (f"{words[i - 1] if i else ''} {w}", f"{w} {words[i + 1] if i + 1 < len(words) else ''}")
            if found and not any(p in lexicon.phrases for p in near):
                total += max(found)
        length = toxicity.folded(text).count(" ")
        assert toxicity.strength(text, lexicon, automaton) == pytest.approx(total / np.log2(2 + length) if text else 0.0), ascii(line)[:200]
    got = toxicity.toxicity(twice, doubled).collect()
    scores = defaultdict(set)
    for r in got:
        scores[r.doc_id].add((r.score, r.predicted))
    assert len(got) == 405 and all(len(v) == 1 for v in scores.values())


def test_toxicity_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = spark.createDataFrame([(10**8 + i, t) for i, t in enumerate(ODD)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs.select("doc_id", "text").unionByName(odd), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [k for k in truth if k in got and crc(k) % 5 == 0]
    right = sum(got[k].predicted == truth[k] for k in held) / len(held)
    caught = [got[k].predicted for k in held if truth[k]]
    assert right > 0.97 and sum(caught) / len(caught) > 0.85
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[10**8].score == got[10**8 + 1].score < 0.5 and got[10**8].predicted == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert toxicity.toxicity(docs.where("doc_id > 5"), none).collect() == []


def test_folding_and_exceptions():
    assert folded("ІdІоt, 1d10t!") == " idiot  idiot  "
    assert folded("ＩＤＩＯＴ") == " idiot "
    lexicon = toxicity.Lexicon({" trash ": 4.0, " low": 3.0}, frozenset({"trash can"}), 1.0, -1.0)
    a = lexicon.automaton()
    assert toxicity.strength("the trash can", lexicon, a) == 0.0
    assert toxicity.strength("7rash lowly", lexicon, a) == pytest.approx(7 / np.log2(2 + 3))
    assert toxicity.strength("yellow", lexicon, a) == 0.0


def first_fit_bound(lengths, capacity):
    return -(-sum(lengths) // capacity)


def test_packing(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    odd = ODD + ["see <|endoftext|> here", "word " * 9000]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)] + [(None, "a b")] * 2, "doc_id bigint, text string"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    clash = df.selectExpr("*", "1 AS piece", "'x' AS id", "2.5 AS size", "true AS sequence_id")  # names used inside
    got = packing.pack(clash).collect()
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    assert pieces.keys() == texts.keys() and len(pieces[None]) == 2
    for k, text in texts.items():
        ids = np.array([*tok.encode(text, add_special_tokens=False).ids, 0], "<u4")
        mine = sorted(pieces[k], key=lambda r: (r.piece, r.sequence_id))
        if k is None:
            mine = mine[:1]
        assert [r.piece for r in mine] == list(range(len(mine)))
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]] and sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
        assert len(mine) == 1 if len(ids) <= 2048 else all(r.length == 2048 for r in mine[1:])
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for x in places.values():
        x.sort()
        assert x[0][0] == 0 and x[-1][0] + x[-1][1] <= 2048 and all(a + n == b for (a, n), (b, _) in pairwise(x))
    assert len(places) <= 1.01 * first_fit_bound([r.length for r in got], 2048) + 1
    assert packing.pack(df.where("doc_id = -1")).collect() == []


def best_fit_decreasing(sizes, capacity):
    gaps = []
    for size in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= size]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else capacity) - size)
    return len(gaps)


@pytest.mark.parametrize("kind, range_rows", [("mixed", 10**6), ("mixed", 40), ("hot", 60), ("tiny", 50), ("large", 30), ("one", 5)])
def test_rounds(spark, kind, range_rows):
    """Every piece is placed once, no sequence overflows, and there are few more sequences than best fit decreasing needs;
    with one range and with many, and with one very frequent length."""
    rnd = random.Random(kind)
    sizes = {
        "mixed": [rnd.randint(1, 199) for _ in range(400)],
        "hot": [67] * 300 + [rnd.randint(1, 199) for _ in range(200)],
        "tiny": [rnd.randint(1, 9) for _ in range(500)],
        "large": [rnd.randint(101, 199) for _ in range(200)],
        "one": [7],
    }[kind]
    pieces = spark.createDataFrame(list(enumerate(sizes)), "id bigint, size bigint").repartition(3)
    got = packing.rounds(pieces, 200, salts=8, range_rows=range_rows).collect()
    fill = defaultdict(int)
    for r in got:
        fill[r.sequence] += sizes[r.id]
    assert sorted(r.id for r in got) == list(range(len(sizes))) and max(fill.values()) <= 200
    assert len(fill) <= best_fit_decreasing(sizes, 200) * 1.03 + 1


def test_exchange():
    """Ranks past a gap's share go to the next range above; a gap takes as many pieces as surely fit."""
    assert packing.exchange([(0, 0, None, 2, 100), (1, 3, 60, 2, 50), (2, 7, 20, 0, None)]) == [(1, 0, 2, 0, 0, 1), (2, 0, 4, 1, 0, 2)]
    assert packing.exchange([(0, 5, 10, 0, None)]) == []


def test_ids_of_all_kinds_of_characters():
    import sys
    import unicodedata

    import public_tokenizers
    from tokenizers import Tokenizer

    exact, ids = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder("byte_bpe_50k.json")
    kinds = defaultdict(list)
    for i in range(sys.maxunicode + 1):
        if not 0xD800 <= i <= 0xDFFF:
            kinds[unicodedata.category(chr(i))].append(chr(i))
    spaces = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()]
    rnd = random.Random(8)
    for _ in range(1500):
        few = [rnd.choice(kinds[rnd.choice(list(kinds))]) for _ in range(6)] + list("aé'0 \n") + [rnd.choice(spaces), rnd.choice(kinds["Mn"])]
        text = "".join(rnd.choices(few, k=rnd.randint(1, 30)))
        assert ids(text) == exact.encode(text, add_special_tokens=False).ids, ascii(text)
    for text in (" " * 5000, "a" * 20_000, "\n\t" * 3000, "́" * 2000, "'s" * 3000, "9" * 5000):
        assert ids(text) == exact.encode(text, add_special_tokens=False).ids


def test_sentencepiece_best_segmentation():
    m = sentencepiece_codec.model("piece_bpe_32k.model", "unigram")
    words = ["▁the", "▁there", "▁therefore", "▁xq", "▁éa", "▁a\nb", "▁▁x"]

    def best(word):
        if not word:
            return 0.0
        options = [m.scored[word[i:]][1] + best(word[:i]) for i in range(len(word)) if word[i:] in m.scored]
        return max([best(word[:-1]) + m.penalty] * (word[-1] not in m.scored) + options)

    for word, ids in m.forward(sorted(words)):
        scores = {i: s for i, s in m.scored.values()}
        chars = sum(scores.get(i, 0.0) for i in ids)
        raw = bytes(m.bytes.index(i) for i in ids if i in m.bytes).decode()
        assert chars + m.penalty * len(raw) == pytest.approx(best(word))
        assert m.decode(ids) == word.replace("▁", " ")[1:]


def test_sentencepiece_merges_as_the_library():
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    m = sentencepiece_codec.model("piece_bpe_32k.model")
    rnd = random.Random(6)
    texts = ["".join(rnd.choices("abcdeéthion ßaß\n0.", k=rnd.randint(1, 60))) for _ in range(400)] + ["a" * 40, "  a   b ", "日本語 🎉", "x\ty"]
    words = [m.words(t) for t in texts]
    ids = dict(m.forward(sorted({w for ws in words for w in ws})))
    assert [[i for w in ws for i in ids[w]] for ws in words] == sp.encode(texts)


def test_sentencepiece_round_trip(spark, documents):
    import public_tokenizers
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = [*ODD, "  two  spaces  ", "tab\tnew\nline  ​", " ", "▁▁ a▁b", "日本語 emoji 🎉"]
    df = documents.limit(100).select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(odd)], "doc_id bigint, text string"))
    texts = {r.doc_id: r.text or "" for r in df.collect()}
    twice = spark.createDataFrame([(None, "a b", 1, "x"), (None, "a b", 1, "x"), (5, None, None, None)], "doc_id bigint, text string, n_ids int, ids string")
    got = sorted(map(tuple, sentencepiece_codec.encode(twice).collect()), key=repr)
    assert got[1] == got[2] and got[1][1] == len(sp.encode("a b")) and got[0][:3] == (5, 0, 0)
    encoded = sentencepiece_codec.encode(df, ids=True).cache()
    assert {r.doc_id: r.text for r in sentencepiece_codec.decode(encoded).collect()} == texts
    for r in encoded.collect():
        assert r.n_ids == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        if "▁" not in texts[r.doc_id]:
            assert sp.decode(list(r.ids)) == texts[r.doc_id] and sp.encode(texts[r.doc_id]) == list(r.ids)
    assert sentencepiece_codec.encode(df.where("doc_id = -1")).collect() == []


def test_most_languages_are_bounded(spark, documents):
    """A dirty column adds no language beyond the bound; rows of other languages are predicted like any."""
    from tidemark.llm import language_id as li

    clean = documents.select("doc_id", "text", "lang").where("lang is not null")
    dirty = clean.limit(60).selectExpr("doc_id + 1000000 as doc_id", "text", "concat('odd', doc_id) as lang")
    known = {r.lang for r in clean.select("lang").distinct().collect()}
    model = li.fit(clean.unionByName(dirty).select("text", "lang"), most=len(known))
    assert set(model.languages) == known
    assert {r.lang_pred for r in li.identify(dirty, model).collect()} <= known | {"und"}


def test_toxicity_with_very_many_copies(spark):
    """Thousands of copies of a labelled text, and of a row, count once when the lexicon is fitted."""
    rnd = np.random.default_rng(5)
    clean = [f"w{a} w{b} w{c}" for a, b, c in rnd.integers(0, 40, (200, 3))]
    toxic = [f"{t} vile scum" for t in clean[:80]]
    rows = [(i, t) for i, t in enumerate(clean + toxic)] + [(1, clean[1])] * 3000 + [(10_000 + i, toxic[0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i >= 200)) for i in range(280)] + [(10_000 + i, 1) for i in range(3000)], "doc_id bigint, toxic int")
    sizes = []
    real = toxicity.logistic
    toxicity.logistic = lambda x, y: (sizes.append(len(x)), real(x, y))[1]
    try:
        got = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, labels).collect()}
    finally:
        toxicity.logistic = real
    assert sizes[0] <= 281
    assert sum(got[i] == int(i >= 200) for i in range(280)) >= 270
