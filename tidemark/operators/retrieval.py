"""Batch retrieval: a stated set of queries against all documents, by words, by character n-grams, by named fields and by date.

documents: doc, title, text, source, published_at and, where known, club, player, reporter, doc_type. queries: q, query.

Documents are tokenised once and written. Spark counts the document frequency of the queries' words and gives every query
its weights. Queries are counted and broadcast in blocks of about QUERIES; documents stay where they lie. A task takes its
documents in parts of about PART_BYTES of text and multiplies a part's counts with BLOCK queries at a time. A part keeps the k
best documents of each query, so what leaves a task is queries x k rows, never pairs; winners are ranked by a window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.shipping import ship
from tidemark.storage import written

PART_BYTES = 2_000_000
BLOCK = 64  # queries multiplied at a time
ROWS = 256  # documents multiplied at a time
QUERIES = 20_000  # queries that are broadcast at a time, about
TERMS = 500_000  # words of queries that are broadcast at a time, about
VALUES = 10_000  # values of fields that a block of queries remembers
#: What a match of each field weighs.
FIELDS = {"club": 1.2, "player": 2.35, "reporter": 1.15, "source": 0.95}
#: Kinds of documents that gain a little.
BOOSTED, BOOST = ("signal", "article"), 1.07
LEAST_COSINE, LEAST_FUZZY, LEAST_SCORE = 0.05, 0.58, 0.35
PARTS = ("lexical", "semantic", "structured", "recency")
_ALNUM = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: What search tokens leave out: stop words and words of one character.
SKIPPED = frozenset([w.encode() for w in text.STOP_WORDS] + [bytes([c]) for c in _ALNUM])
#: ASCII in lower case, a space for what is in no word; characters beyond ASCII whose lower case has a letter of ASCII; what no word begins with.
_WORD_BYTES = bytes(c if (c := ord(chr(i).lower())) in _ALNUM + b"_'-" else 32 for i in range(256))
_BECOME_ASCII = (("\u212a".encode(), b"k"), ("\u0130".encode(), b"i "))
_LEADING = re.compile(rb" [_'-]+")
METHODS = {"lexical": "lexical", "semantic_chargram": "semantic", "structured_entity": "structured", "recency": "recency"}


def _column(documents: DataFrame, name: str) -> Column:
    return F.col(name).cast("string") if name in documents.columns else F.lit(None).cast("string")


def expanded(query: Column, aliases: dict[str, str]) -> Column:
    """The query with the full form of every alias in it that is not there already."""
    more = [F.when(F.lower(query).rlike(rf"\b{a}\b") & ~F.contains(F.lower(query), F.lit(full)), full) for a, full in aliases.items()]
    return F.concat_ws(" ", query, *more)


def indexed(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tokens of the search text (the title counts twice) and of the title, each joined by spaces, and the kind. keep: columns of
    the documents that stay beside it."""
    fields = [_column(documents, c) for c in FIELDS]
    joined = lambda c: F.array_join(text.tokens(c), " ")
    made = {
        "doc": F.col("doc").cast("bigint"),
        "own": joined(F.concat_ws(" ", "text", *fields)),
        "title": joined(F.col("title")),
        "kind": F.replace(_column(documents, "doc_type"), F.lit("_"), F.lit(" ")),
    }
    index = documents.select(*(c.alias(k) for k, c in made.items()), *keep)
    return index.withColumn("w", F.btrim(F.concat_ws(" ", "title", "title", "own"), F.lit(" "))).drop("own")


def found_in(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text that `text.tokens` finds, before it leaves out SKIPPED."""
    for char, plain in _BECOME_ASCII:
        if char in data:
            data = data.replace(char, plain)
    data = b" " + data.translate(_WORD_BYTES)
    if any(x in data for x in (b" '", b" -", b" _")):
        data = _LEADING.sub(b" ", data)
    found = data.split()
    return [w.rstrip(b"'") for w in found] if b"'" in data else found


def words_of(found: Iterable[bytes]) -> list[bytes]:
    return [w for w in found if w not in SKIPPED]


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return column.fill_null("").cast(pa.binary()).to_pylist()


def _frequencies(shared):
    """How many of a task's documents hold each of the broadcast words; the empty word stands for documents with any word."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n = frozenset(w.encode() for w in shared.value), Counter()
        for batch in batches:
            for parts in zip(*(_texts(batch.column(c)) for c in ("title", "text", "tail"))):
                found = found_in(b" ".join(parts))
                n.update(known.intersection(found))
                n[b""] += not SKIPPED.issuperset(found)
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in n], pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "df"])

    return rows


def frequencies(held: DataFrame, known: DataFrame) -> DataFrame:
    """In how many documents (title, text, tail) each known word (term) is, if in any, and under the empty word how many documents
    have words. Known words are counted and broadcast in blocks of about TERMS."""
    blocks, found = max(1, -(-known.count() // TERMS)), None
    for i in range(blocks):
        mine = known.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == i) if blocks > 1 else known
        sent = held.sparkSession.sparkContext.broadcast(frozenset(row.term for row in mine.collect()))  # about TERMS words
        counted = held.select("title", "text", "tail").mapInArrow(_frequencies(sent), "term string, df bigint")
        counted = counted if i == 0 else counted.where("term <> ''")
        found = counted if found is None else found.unionByName(counted)
    return written(found.groupBy("term").agg(F.sum("df").alias("df")), "search-frequencies")


def weighted(held: DataFrame, queries: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Queries with their words in order, and each distinct word's weight (times asked x inverse document frequency)."""
    full = expanded(F.col("query"), aliases or {})
    q = queries.select(F.col("q").cast("bigint").alias("q"), full.alias("query"), text.tokens(full).alias("words"))
    asked = q.select("q", F.explode("words").alias("term")).groupBy("q", "term").agg(F.count(F.lit(1)).alias("qf"))
    found = frequencies(held, written(asked.select("term").distinct(), "search-terms"))
    df, n = found.where("term <> ''"), found.where("term = ''").agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))
    idf = F.log((F.col("n") + 1) / (F.col("df") + 0.5)) + 1
    terms = asked.join(df.hint("merge"), "term").join(F.broadcast(n)).groupBy("q").agg(F.collect_list(F.struct("term", (F.col("qf") * idf).alias("weight"))).alias("terms"))
    return q.join(terms.hint("merge"), "q", "left")


class Counts:
    """How often each key occurs in each row, as triples sorted by row and key."""

    def __init__(self, rows: int, who: np.ndarray, key: np.ndarray, n: np.ndarray, norm: np.ndarray | None = None):
        self.rows, self.who, self.key, self.n, self.norm = rows, who, key, n, norm
        self.first = np.searchsorted(who, np.arange(rows + 1))

    def times(self, place: np.ndarray, *weights: np.ndarray, value=None) -> list[np.ndarray]:
        """Rows x columns of each of the weights: the sum of count x weight over the keys that have a place in the weights; of
        value(count) x weight for the first if there is a value, of 1 x weight for the others then."""
        out = [np.empty((self.rows, w.shape[1]), w.dtype) for w in weights]
        for a in range(0, self.rows, ROWS):
            b = min(self.rows, a + ROWS)
            part = slice(self.first[a], self.first[b])
            at = place[self.key[part]]
            hit = np.flatnonzero(at >= 0)
            at, who, n = at[hit], self.who[part][hit] - a, self.n[part][hit]
            # Only keys that these rows have are multiplied.
            seen = np.zeros(len(weights[0]), bool)
            seen[at] = True
            column = (np.cumsum(seen) - 1)[at]
            for i, w in enumerate(weights):
                dense = np.zeros((b - a, np.count_nonzero(seen)), w.dtype)
                dense[who, column] = n if value is None else value(n) if i == 0 else 1.0
                out[i][a:b] = dense @ w[seen]
        return out


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of a sorted array and how often each is there."""
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.diff(np.append(first, len(key))).astype(float)


def _coded(alphabet: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which trigrams have only characters of the alphabet, and their codes in it, ascending as the trigrams are."""
    code, known = np.zeros(len(grams), np.int64), np.ones(len(grams), bool)
    for shift in (42, 21, 0):
        char = grams >> shift & 0x1FFFFF
        at = np.minimum(np.searchsorted(alphabet, char), len(alphabet) - 1)
        known &= alphabet[at] == char
        code = code * len(alphabet) + at
    return np.flatnonzero(known), code[known]


def gram_counts(values: list[str], wanted: np.ndarray | None = None) -> tuple[np.ndarray, Counts]:
    """Character trigrams of the squeezed, padded texts (lower-case ones) as ascending numbers, and how often each is in each text;
    only the wanted ones, if there are any, but a text's norm is that of all its trigrams. Characters are numbered within the
    texts, so that a text and a trigram are one short number, and these are sorted."""
    padded = [f"  {n}  " if (n := " ".join(v.split())) else "" for v in values]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4")
    rows, none = len(padded), np.zeros(0, np.int64)
    if not len(chars):
        return none if wanted is None else wanted, Counts(rows, none, none, np.zeros(0), np.zeros(rows))
    there = np.zeros(0x110000, bool)
    there[chars] = True
    alphabet = np.flatnonzero(there)
    base = len(alphabet)
    span, kind = base**3, np.uint32 if rows * base**3 < 1 << 32 else np.int64
    number = np.zeros(len(there), kind)
    number[alphabet] = np.arange(base)
    c = number[chars]
    code = c[:-2] * base
    code += c[1:-1]
    code *= base
    code += c[2:]
    lens = list(map(len, padded))
    if rows * span < 1 << 63:
        code += np.repeat(np.arange(rows, dtype=kind) * span, lens)[:-2]
        code.sort()
        key, n = _runs(code)
        who = key // span
        code, who = (key - who * span).astype(np.int64), who.astype(np.int64)
    else:
        who = np.repeat(np.arange(rows), lens)[:-2]
        order = np.lexsort((code, who))
        code, who = code[order], who[order]
        first = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (who[1:] != who[:-1])]))
        code, who, n = code[first], who[first], np.diff(np.append(first, len(code))).astype(float)
    # Three spaces stand only where two texts meet.
    inside = np.flatnonzero(code != int(number[32]) * (base * base + base + 1))
    code, who, n = code[inside], who[inside], n[inside]
    norm = np.sqrt(np.bincount(who, n * n, rows))
    if wanted is None:
        own, key = np.unique(code, return_inverse=True)
        grams = alphabet[own // base**2] << 42 | alphabet[own // base % base] << 21 | alphabet[own % base]
        return grams, Counts(rows, who, key, n, norm)
    index, codes = _coded(alphabet, wanted)
    if not len(codes):
        return wanted, Counts(rows, none, none, np.zeros(0), norm)
    if span <= 1 << 22:
        table = np.full(span, -1, np.int32)
        table[codes] = index
        key = table[code]
        kept = np.flatnonzero(key >= 0)
        key = key[kept]
    else:
        at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
        kept = np.flatnonzero(codes[at] == code)
        key = index[at[kept]]
    return wanted, Counts(rows, who[kept], key, n[kept], norm)


def _lower(values: Iterable[str]) -> list[str]:
    return [v.lower() for v in values]


def _places(known: np.ndarray, some: np.ndarray) -> np.ndarray:
    """For each known key its place among some of them, both ascending; -1 where it has none."""
    place = np.full(len(known), -1)
    if len(known):
        at = np.minimum(np.searchsorted(known, some), len(known) - 1)
        there = known[at] == some
        place[at[there]] = np.flatnonzero(there)
    return place


def _cosines(vocabulary: np.ndarray, rows: Counts, other: np.ndarray, queries: Counts) -> np.ndarray:
    """Cosines of rows with queries; each side has a sorted vocabulary of its own."""
    # Sums of whole numbers below 2^24 are exact in 32 bits.
    small = np.bincount(rows.who, rows.n, 1).max() * queries.n.max(initial=0) < 1 << 24
    weights = np.zeros((len(other), queries.rows), np.float32 if small else float)
    weights[queries.key, queries.who] = queries.n
    return rows.times(_places(vocabulary, other), weights)[0] / np.maximum(np.outer(rows.norm, queries.norm), 1e-12)


class Block:
    """Queries that are multiplied at a time."""

    def __init__(self, queries: list[dict], numbers: dict[bytes, int]):
        self.ids = np.array([q["id"] for q in queries], np.int64)
        self.words = [q["words"] for q in queries]
        self.phrases, self.sets = [" ".join(w) for w in self.words], [set(w) for w in self.words]
        found = [(numbers[t["term"].encode()], j, t["weight"]) for j, q in enumerate(queries) for t in q["terms"] or ()]
        self.terms, self.term = np.unique(np.array([x[0] for x in found], np.int64), return_inverse=True)
        self.query, self.weight = np.array([x[1] for x in found], np.int64), np.array([x[2] for x in found], float)
        self.grams = gram_counts(_lower(q["query"] or "" for q in queries))
        #: What values of fields give each query.
        self.points: dict[tuple[str, ...], np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.ids)


class Asked:
    """Blocks of queries, made ready once in a task. The words and trigrams that any query asks for are numbered, and documents
    count these only."""

    def __init__(self, queries: list[dict], size: int):
        self.terms = {t: i for i, t in enumerate(sorted({t["term"].encode() for q in queries for t in q["terms"] or ()}))}
        self.blocks = [Block(queries[a : a + size], self.terms) for a in range(0, len(queries), size)]
        self.grams = np.unique(np.concatenate([np.zeros(0, np.int64), *(b.grams[0] for b in self.blocks)]))


def _value_points(values: list[tuple[str, ...]], block: Block) -> np.ndarray:
    """What the values of a field (their words) give each query: words that match or are alike."""
    tokens = sorted({w for s in block.sets for w in s})
    token_grams, at = gram_counts(tokens), {w: i for i, w in enumerate(tokens)}
    of_query = [np.array([at[w] for w in s], np.int64) for s in block.sets]
    whole = _cosines(*gram_counts([" ".join(v) for v in values]), *block.grams)
    names = sorted({w for v in values for w in v})
    of_name = {w: i for i, w in enumerate(names)}
    apart = _cosines(*gram_counts(names), *token_grams) if tokens else np.zeros((len(names), 0))
    best = np.stack([apart[:, c].max(axis=1) if len(c) else np.zeros(len(names)) for c in of_query], axis=1)
    points = np.zeros((len(values), len(block)))
    for i, v in enumerate(values):
        name, own = " ".join(v), set(v)
        fuzzy = np.maximum(whole[i], best[[of_name[w] for w in v]].max(axis=0))
        for j, (phrase, words) in enumerate(zip(block.phrases, block.sets)):
            if not words:
                continue
            if name in phrase:
                points[i, j] = 1.25
            elif own & words:
                points[i, j] = min(1.0, len(own & words) / len(own))
            elif fuzzy[j] >= LEAST_FUZZY:
                points[i, j] = fuzzy[j] * 0.8
    return points


def field_points(values: list[tuple[str, ...]], block: Block) -> np.ndarray:
    """What the values give each query; a block remembers VALUES of them at most."""
    new = [v for v in values if v not in block.points]
    if len(block.points) + len(new) > VALUES:
        block.points.clear()
        new = values
    if new:
        block.points.update(zip(new, _value_points(new, block)))
    return np.stack([block.points[v] for v in values])


class Part:
    """The documents of one part, ready to meet blocks of queries."""

    def __init__(self, batches: list[pa.RecordBatch], parts: tuple[str, ...], asked: Asked):
        table = pa.Table.from_batches(batches).combine_chunks()
        self.parts, self.asked = parts, asked
        self.doc = table["doc"].to_numpy()
        self.age = table["age"].to_pylist()
        self.kind = table["kind"].to_pylist()
        n = len(self.doc)
        self.length = np.zeros(n)
        if "lexical" in parts or len(parts) > 1:
            title, body, tail = (_texts(table[c]) for c in ("title", "text", "tail"))
            self.texts, self.joined = [(t, b"%b %b" % x) for t, x in zip(title, zip(body, tail))], {}
            # A word is its number among those asked for, -1 or, if it is left out, -2; titles count twice.
            number, codes = dict.fromkeys(SKIPPED, -2) | asked.terms, []
            for t, own in ((found_in(t), found_in(o)) for t, o in self.texts):
                for found, times in ((t, 2), (own, 1)):
                    codes += [np.fromiter(map(number.get, found, repeat(-1)), np.int64, len(found))] * times
            who = np.repeat(np.arange(3 * n) // 3, list(map(len, codes)))
            codes = np.concatenate([np.zeros(0, np.int64), *codes])
            self.length = np.bincount(who[codes > -2], minlength=n).astype(float)
        if "lexical" in parts:
            hit, size = codes >= 0, max(len(asked.terms), 1)
            key, count = _runs(np.sort(who[hit] * size + codes[hit]))
            self.tf = Counts(n, key // size, key % size, count)
        if "semantic" in parts:
            # As concat_ws joins title, fields and text; what is empty adds spaces only, which are squeezed.
            whole = zip(*(table[c].fill_null("").to_pylist() for c in ("title", "tail", "text")))
            self.grams = gram_counts([" ".join(x).lower() for x in whole], asked.grams)
        if "structured" in parts:
            rows = table["fields"].to_pylist()
            words = {v: tuple(w.decode() for w in words_of(found_in((v or "").encode()))) for v in set().union(*rows)}
            self.fields = [tuple(words[v] for v in r) for r in rows]

    def holds(self, phrase: bytes, i: int) -> float:
        """What a document gains for a phrase in the words of its title or, else, of its search text."""
        if i not in self.joined:
            title, own = (words_of(found_in(x)) for x in self.texts[i])
            self.joined[i] = b" ".join(title), b" ".join([*title, *title, *own])
        title, whole = self.joined[i]
        return 4.0 if phrase in title else 2.0 if phrase in whole else 0.0

    def lexical(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Scores and numbers of shared words, documents x queries."""
        weights = np.zeros((len(block.terms), len(block)))
        weights[block.term, block.query] = block.weight
        place = np.full(max(len(self.asked.terms), 1), -1)
        place[block.terms] = np.arange(len(block.terms))
        score, shared = self.tf.times(place, weights, (weights > 0).astype(np.float32), value=lambda n: 1 + np.log(n))
        distinct = np.array([max(len(s), 1) for s in block.sets])
        bonus = np.zeros_like(score)
        for j, (phrase, words) in enumerate(zip(block.phrases, block.words)):
            # Between its first and last word a phrase has whole words; those two may be parts of longer ones.
            near = np.flatnonzero(shared[:, j] >= len(set(words[1:-1]))) if phrase else ()
            for i in near:
                bonus[i, j] = self.holds(phrase.encode(), i)
        some = (score + bonus) * (1 + np.minimum(0.25, shared / distinct * 0.25)) * np.maximum(0.35, 9 / np.sqrt(np.maximum(self.length, 1)))[:, None]
        return np.where(self.length[:, None] > 0, some, 0.0), shared

    def structured(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Field scores and whether any field matched, documents x queries."""
        total, hit = np.zeros((len(self.doc), len(block))), np.zeros((len(self.doc), len(block)), bool)
        for f, weight in enumerate(FIELDS.values()):
            values = sorted({r[f] for r in self.fields if r[f]})
            if not values:
                continue
            points, number = field_points(values, block), {v: k for k, v in enumerate(values)}
            field = np.array([number.get(r[f], -1) for r in self.fields])
            known = field >= 0
            total[known] += points[field[known]] * weight
            hit[known] |= points[field[known]] > 0
        for kind in {k for k in self.kind if k}:
            rows = np.array([k == kind for k in self.kind])
            total[np.ix_(rows, np.array([kind in p for p in block.phrases]))] += 0.5
        return total * 3.25, hit

    def best(self, block: Block, k: int, digits: int, least: float) -> pa.RecordBatch:
        """The k best documents of each query of the block."""
        shape = (len(self.doc), len(block))
        scores = {p: np.zeros(shape) for p in PARTS}
        shared, named = np.zeros(shape), np.zeros(shape, bool)
        if "lexical" in self.parts:
            scores["lexical"], shared = self.lexical(block)
        if "semantic" in self.parts:
            cosine = _cosines(*self.grams, *block.grams)
            scores["semantic"] = np.where(cosine >= least, cosine * 4.25, 0.0)
        if "structured" in self.parts:
            scores["structured"], named = self.structured(block)
        if "recency" in self.parts:
            steps = [(14, 0.35), (60, 0.22), (365, 0.10)]
            value = [0.0 if a is None else 0.03 if a < 0 else next((s for d, s in steps if a <= d), 0.0) for a in self.age]
            scores["recency"] = np.repeat(np.array(value)[:, None], len(block), axis=1)
        asked = np.array([len(w) > 0 for w in block.words])
        total = sum(scores.values())
        if len(self.parts) > 1:
            total = total * np.where([x in BOOSTED for x in self.kind], BOOST, 1.0)[:, None]
            kept = ((total >= LEAST_SCORE) | (shared > 0) | named) & asked & (self.length > 0)[:, None]
        else:
            kept = total > 0
        order = np.round(total, digits)
        rows, columns = [], []
        for j in range(len(block)):
            at = np.flatnonzero(kept[:, j])
            if len(at) > k:
                at = at[order[at, j] >= np.partition(order[at, j], -k)[-k]]
            at = at[np.lexsort((self.doc[at], -order[at, j]))][:k]
            rows.append(at), columns.append(np.full(len(at), j))
        i, j = np.concatenate(rows), np.concatenate(columns)
        arrays = [block.ids[j], self.doc[i], *(scores[p][i, j] for p in PARTS), shared[i, j].astype(np.int64), total[i, j]]
        return pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["q", "doc", *PARTS, "matched", "score"])


def _search(shared, parts: tuple[str, ...], k: int, digits: int, size: int, least: float):
    """The k best documents of each query of the broadcast block, for each part of a task's documents."""

    def part_of(held: list[pa.RecordBatch], asked: Asked) -> Iterator[pa.RecordBatch]:
        part = Part(held, parts, asked)
        for block in asked.blocks:
            yield part.best(block, k, digits, least)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(shared.value, size)
        held: list[pa.RecordBatch] = []
        full = 0
        for batch in batches:
            ends = np.cumsum(batch.column("size").fill_null(0).to_numpy() + 64)
            a = 0
            while a < batch.num_rows:
                done = int(ends[a - 1]) if a else 0
                b = max(a + 1, int(np.searchsorted(ends, done + PART_BYTES - full, side="right")))
                held.append(batch.slice(a, b - a))
                full += int(ends[b - 1]) - done
                a = b
                if full >= PART_BYTES:
                    yield from part_of(held, asked)
                    held, full = [], 0
        if held:
            yield from part_of(held, asked)

    return rows


def search(documents: DataFrame, queries: DataFrame, k: int, parts: tuple[str, ...] = PARTS, as_of: Column | None = None, aliases: dict[str, str] | None = None, digits: int = 6, block: int = BLOCK, least_cosine: float = LEAST_COSINE, queries_sent: int = QUERIES) -> DataFrame:
    """The k best documents of each query: q, doc, rank, score, its parts, matched (number of shared words), methods (the parts
    that gave something) and normalized (share of the query's best score). Ties of the score, rounded to `digits`, go to the
    smaller doc. With one part, documents that have nothing of it are no hits; with several, the score is 0.35 at least or
    a word or field is shared."""
    # Rebalanced, so that documents are read in even tasks, whatever the files of the source are.
    fields = [_column(documents, c).alias(c) for c in FIELDS]
    kind = F.replace(_column(documents, "doc_type"), F.lit("_"), F.lit(" ")).alias("kind")
    chosen = documents.select(F.col("doc").cast("bigint").alias("doc"), "title", "text", *fields, kind, "published_at")
    tail = F.concat_ws(" ", *FIELDS)
    size = F.octet_length(F.concat_ws(" ", "title", tail, "text"))
    held = written(chosen.hint("rebalance"), "search-documents").withColumns({"tail": tail, "size": size})
    spark = documents.sparkSession
    ship(spark)
    if "lexical" in parts:
        asked = written(weighted(held, queries, aliases), "search-queries")
    else:
        full = expanded(F.col("query"), aliases or {})
        none = F.lit(None).cast("array<struct<term:string,weight:double>>")
        asked = queries.select(F.col("q").cast("bigint").alias("q"), full.alias("query"), text.tokens(full).alias("words"), none.alias("terms"))
    age = F.datediff(as_of, F.col("published_at")) if as_of is not None else F.lit(None).cast("int")
    named = F.array(*FIELDS) if "structured" in parts else F.lit(None).cast("array<string>")
    held = held.withColumns({"age": age, "fields": named}).select("doc", "title", "text", "tail", "fields", "kind", "age", "size")
    asked = asked.select(F.col("q").alias("id"), "query", "words", "terms")
    blocks = max(1, -(-asked.count() // queries_sent))
    schema = "q bigint, doc bigint, " + ", ".join(f"{p} double" for p in PARTS) + ", matched bigint, score double"
    best = None
    for i in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i) if blocks > 1 else asked
        sent = spark.sparkContext.broadcast([row.asDict(recursive=True) for row in mine.collect()])  # about queries_sent rows
        found = held.mapInArrow(_search(sent, tuple(parts), k, digits, block, least_cosine), schema)
        best = found if best is None else best.unionByName(found)
    by = Window.partitionBy("q").orderBy(F.desc(F.round("score", digits)), "doc")
    ranked = best.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    methods = F.array_join(F.array_compact(F.array(*(F.when(F.col(c) > 0, name) for name, c in METHODS.items()))), "|")
    return ranked.withColumns({"methods": methods, "normalized": F.col("score") / F.first("score").over(by)})


def merged(hits: DataFrame) -> DataFrame:
    """Hits of several queries of one question (question, q, doc, score, methods) as one list: largest score, all methods and queries."""
    methods = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.split("methods", r"\|"))))), "|")
    return hits.groupBy("question", "doc").agg(F.max("score").alias("score"), F.countDistinct("q").alias("n_queries"), methods.alias("methods"))
