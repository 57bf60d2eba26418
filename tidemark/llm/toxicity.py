"""Toxicity scores from a weighted lexicon, matched by Aho-Corasick on folded text.

Folding: lower case, letters that look like Latin ones become those, digits and signs used as letters become letters,
and anything else that is not alphanumeric becomes a space. Lexicon terms are whole words and word beginnings with a
weight (log odds of toxic against other labelled texts). Exception phrases (a term with the word before or behind it)
take a match back. The sum of the weights, normalised by the text's length, goes through a logistic curve.

Terms, phrases and the curve are fitted on a bounded sample of labelled rows: at most about `sample` rows of each class,
chosen by a digest of the text. Only text is an input of a score.

Null and empty texts have no match and get the curve's lowest score. With no labelled row of both classes every score
is 0. A doc_id with several labels counts as toxic if any says so. Repeated rows are scored alike; of terms with equal
weight the first by spelling is kept; very long texts are matched whole, in time and memory in proportion to them. An
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, prepared, written

SAMPLE = 4000
TERMS = 5000
PHRASES = 2000
SHORTEST, LONGEST = 4, 8

#: Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ɡ": "g", "ӏ": "l",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Fold(dict):
    """Character table that learns each new character once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        c = HOMOGLYPHS.get(c) or DIGITS.get(c) or (c if c.isalnum() else " ")
        if 0xFF01 <= code <= 0xFF5E:
            c = self[ord(chr(code - 0xFEE0).lower())]
        self[code] = c
        return c


_FOLD = _Fold()


def folded(text: str | None) -> str:
    """Folded text with a space at both ends."""
    return f" {text.lower().translate(_FOLD)} " if text else "  "


@dataclass
class Lexicon:
    terms: dict[str, float] = field(default_factory=dict)  # with a space before, and one behind for whole words
    phrases: frozenset[str] = frozenset()
    slope: float = 0.0
    offset: float = -50.0

    def automaton(self):
        a = ahocorasick.Automaton()
        for term, weight in self.terms.items():
            a.add_word(term, (len(term), weight))
        if self.terms:
            a.make_automaton()
        return a


def word_hits(line: str, automaton) -> dict[int, float]:
    """Start of each word with a match (the place of the space before it) and its largest weight."""
    found: dict[int, float] = {}
    for end, (size, weight) in automaton.iter(line):
        at = end - size + 1
        if weight > found.get(at, 0.0):
            found[at] = weight
    return found


def around(line: str, at: int) -> tuple[str, str]:
    """The word at a place with the word before it, and with the word behind it."""
    word, _, more = line[at + 1 : at + 400].partition(" ")
    before = line[max(0, at - 200) : at].split()
    behind = more.split(None, 1)
    return f"{before[-1] if before else ''} {word}", f"{word} {behind[0] if behind else ''}"


def strength(text: str | None, lexicon: Lexicon, automaton) -> float:
    """Summed weights of the matches that no exception phrase takes back, normalised by length."""
    if not text or not lexicon.terms:
        return 0.0
    line = folded(text)
    hits = word_hits(line, automaton)
    if hits and lexicon.phrases:
        hits = {at: w for at, w in hits.items() if not any(p in lexicon.phrases for p in around(line, at))}
    return sum(hits.values()) / math.log2(2 + line.count(" ")) if hits else 0.0


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def flush():
        keys = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["term", "toxic", "other"])
        counts[0].clear(), counts[1].clear()
        return out

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(folded(text).split())
            terms = {f" {w} " for w in words if len(w) >= 3}
            for n in range(SHORTEST, LONGEST + 1):
                terms.update(f" {w[:n]}" for w in words if len(w) > n)
            counts[toxic].update(terms)
            if len(counts[0]) + len(counts[1]) > 400_000:
                yield flush()
    if counts[0] or counts[1]:
        yield flush()


def _phrase_counts(lexicon: Lexicon):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                line = folded(text)
                counts[toxic].update({p for at in word_hits(line, automaton) for p in around(line, at)})
            keys = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([counts[1][k] for k in keys], pa.int64()), pa.array([counts[0][k] for k in keys], pa.int64())], names=["term", "toxic", "other"])

    return rows


def _strengths(lexicon: Lexicon):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([strength(t, lexicon, automaton) for t in batch.column("text").to_pylist()], pa.float64())], names=["toxic", "x"])

    return rows


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> tuple[float, float]:
    """Slope and offset of a lightly damped logistic curve, with both classes weighing the same."""
    top = max(float(x.max()), 1e-9)
    z = np.stack([x / top, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    b = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        grad = z.T @ (weight * (p - y)) + 1e-2 * b
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        b = b - np.linalg.solve(hess, grad)
        b = np.clip(b, -200, 200)
    return float(max(b[0], 0.0) / top), float(b[1])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Lexicon:
    """labelled: text, toxic (0 or 1). A text counts once for each label that it has, however many rows repeat it."""
    sizes = {r.toxic: r.n for r in labelled.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Lexicon()
    share = F.when(F.col("toxic") == 1, min(1.0, sample / sizes[1])).otherwise(min(1.0, sample / sizes[0]))
    texts = labelled.select(F.coalesce("text", F.lit("")).alias("text"), "toxic")
    # Chosen by a digest of the text, so copies come together; tasks combine their own before anything moves.
    chosen = written(texts.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share * 1_000_000).distinct(), "toxic-sample")
    prepared(labelled.sparkSession)
    total = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return Lexicon()
    odds = F.log(((F.col("toxic") + 0.5) / (n1 + 1.0)) / ((F.col("other") + 0.5) / (n0 + 1.0)))

    def totals(rows: DataFrame) -> DataFrame:
        return rows.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other")).withColumn("odds", odds)

    least = max(3, n1 // 300)
    terms = totals(chosen.mapInArrow(_term_counts, "term string, toxic bigint, other bigint")).where((F.col("toxic") >= least) & (F.col("odds") > 3))
    kept = terms.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(TERMS).collect()
    lexicon = Lexicon({r.term: float(r.odds) for r in kept})
    if not kept:
        return Lexicon()
    phrases = totals(chosen.mapInArrow(_phrase_counts(lexicon), "term string, toxic bigint, other bigint")).where("other >= 3 and odds < -1")
    lexicon.phrases = frozenset(r.term for r in phrases.orderBy("odds", "term").limit(PHRASES).collect())
    points = chosen.select("toxic", "text").mapInArrow(_strengths(lexicon), "toxic int, x double").toPandas()  # a number for each sampled row
    lexicon.slope, lexicon.offset = logistic(points["x"].to_numpy(), points["toxic"].to_numpy())
    return lexicon


def _scores(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = shared.value
        automaton = lexicon.automaton()
        for batch in batches:
            x = np.array([strength(t, lexicon, automaton) for t in batch.column("text").to_pylist()])
            score = 1 / (1 + np.exp(-np.clip(lexicon.slope * x + lexicon.offset, -50, 50)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted. Fitted on labels of rows whose crc32(doc_id) mod 5 is not 0."""
    prepared(docs.sparkSession)
    held = crc32_of_id() % 5 == 0
    usable = labels.where("toxic in (0, 1) and doc_id is not null").where(~held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sizes = {r.toxic: r.n for r in usable.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    # About 2 x sample ids of each class, chosen by a digest of the id, go to every task, so that texts stay where they are.
    share = F.lit(0.0)
    for value, n in sizes.items():
        share = F.when(F.col("toxic") == value, min(1.0, 2.0 * sample / n)).otherwise(share)
    ids = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    labelled = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled, sample))
    rows = docs.select("doc_id", "text", held.alias("held_out"))
    return rows.mapInArrow(_scores(shared), f"doc_id {dict(docs.dtypes)['doc_id']}, held_out boolean, score double, predicted int")
