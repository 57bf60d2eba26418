"""Spelling variants: k-d trees over letter counts, range searches pruned by boxes, letter order verified.

Definition: runs are the maximal matches of `[A-Za-z\\u00C0-\\u00FF]+` in whole texts (null: none), only A-Z lower-cased. Let h be the
unsigned crc32 of UTF-8 `<doc_id>:<run>` (null doc_id: empty). Where 31 divides h the run loses its code point h % length.
Words are the distinct results of at least `least` code points and `often` occurrences (n). Two words are near if they
differ by exactly one inserted, deleted or replaced code point. The form of a word is its near word of largest n (ties: the
first in code-point order) if that n is `factor` times the word's n or more. Its root is the last word on the way over forms.

Letter counts: letters fall into 32 classes (a-z; six for the others), and a count stops at two. A count is written as its
first two steps, a bit each, so 64 bits hold a word's counts and the number of differing bits is the L1 distance of two words.
One edit gives at most 2 (replaced) or 1 (inserted or deleted), so no near pair is lost by classes or stops.

Search: words of a length are split into cells by a k-d tree (planes fitted on about SAMPLE words in all, every word is
placed). A word visits each cell of its own length whose box is within 2, and of the next length within 1; of two cells of
a length only one is visited for a pair. A cell's words form a k-d tree with tight boxes; a box further away than the radius is
left out with all it holds. What remains within the radius is compared letter by letter. A cell with over BLOCK words is
searched in parts, each by all visitors. What leaves a task are a word's number of near words and the best of them, not pairs.

Very long texts are read in pieces; rows that repeat a doc_id count as they are; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, prepared, texts_of, written

LEAST, OFTEN, FACTOR = 7, 2, 10
#: A run loses a letter where this divides its crc32.
EVERY = 31
PIECE_BYTES = 1 << 20
#: Counted words that a task holds before it sends them on.
HELD = 200_000
CELL = 1 << 17
BLOCK, BLOCK_BYTES = 1 << 18, 64 << 20
SAMPLE = 200_000
LEAF = 32
#: Visitors searched side by side.
SLICE = 1024
#: Cells that are searched in parts and broadcast, at most; more are joined by a shuffle.
PARTED = 1 << 16

_BYTES = np.arange(256)
_LETTER = ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)
_CLASS = np.where(_LETTER, (_LOWER - 0x61) % 26, 26 + _BYTES % 6)


def runs_of(text: bytes) -> Iterator[list[bytes]]:
    """The lower-cased runs of a text, in pieces; U+00C0 to U+00FF are the two bytes C3 and another."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        while end < len(text) and (text[end] >= 0x80 or _LETTER[text[end]]):
            end += 1
        buf = np.frombuffer(text[at:end], np.uint8)
        wide = buf == 0xC3
        keep = _LETTER[buf] | wide
        keep[1:] |= wide[:-1]
        yield np.where(keep, _LOWER[buf], 32).astype(np.uint8).tobytes().split()
        at = end


def counted(doc_id: str | None, text: bytes, least: int) -> Counter[str]:
    """The words of a document with their occurrences."""
    seen: Counter[bytes] = Counter()
    for runs in runs_of(text):
        seen.update(w for w in runs if len(w) >= least)
    out: Counter[str] = Counter()
    start = zlib.crc32(f"{doc_id or ''}:".encode())
    for run, n in seen.items():
        word, h = run.decode(), zlib.crc32(run, start)
        if h % EVERY == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            out[word] += n
    return out


def _word_counts(least: int):
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                held.update(counted(doc, text, least))
                if len(held) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], schema=schema)
                    held = Counter()
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], schema=schema)

    return rows


def letters(words: list[str], length: int) -> np.ndarray:
    """Words of one length as rows of letters (all are below U+0100)."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def codes(rows: np.ndarray) -> np.ndarray:
    """The letter counts of each row as 64 bits: bit c, a letter of class c; bit 32 + c, two of them."""
    n = len(rows)
    flat = (np.arange(n)[:, None] * 32 + _CLASS[rows]).ravel()
    counts = np.bincount(flat, minlength=32 * n).reshape(n, 32)
    bits = np.concatenate([counts >= 1, counts >= 2], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()


def median_plane(code: np.ndarray) -> int | None:
    """The bit (a letter's count is at least one, or two) that splits the words most evenly; None where all are equal."""
    ones = np.unpackbits(code.view(np.uint8).reshape(len(code), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    uneven = np.abs(2 * ones - len(code))
    best = int(uneven.argmin())
    return best if uneven[best] < len(code) else None


def _has(code: np.ndarray, bit: int) -> np.ndarray:
    return (code >> np.uint64(bit)) & np.uint64(1) == 1


@dataclass
class Tree:
    """A k-d tree over letter counts: nodes with their children (-1: a leaf), their stretch of `order`, and the counts that
    all of their words have (low) and that any has (high)."""

    order: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def of(cls, code: np.ndarray, leaf: int) -> Tree:
        order, nodes, todo = np.arange(len(code)), [], [(0, len(code), -1, False)]
        while todo:
            a, b, parent, right = todo.pop()
            own = code[order[a:b]]
            here = len(nodes)
            nodes.append([-1, -1, a, b, np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)])
            if parent >= 0:
                nodes[parent][1 if right else 0] = here
            bit = median_plane(own) if b - a > leaf else None
            if bit is not None:
                upper = _has(own, bit)
                order[a:b] = np.concatenate([order[a:b][~upper], order[a:b][upper]])
                mid = a + int((~upper).sum())
                todo += [(a, mid, here, False), (mid, b, here, True)]
        left, right, first, last, low, high = zip(*nodes)
        return cls(order, np.array(left), np.array(right), np.array(first), np.array(last), np.array(low, np.uint64), np.array(high, np.uint64))

    def within(self, code: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): code[j] is within `radius` of x[i]."""
        who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        found = []
        while len(who):
            near = distance(x[who], self.low[node], self.high[node]) <= radius
            who, node = who[near], node[near]
            end = self.left[node] < 0
            w, leaf = who[end], node[end]
            if len(w):
                size = (self.last - self.first)[leaf]
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                j = self.order[np.repeat(self.first[leaf], size) + place]
                i = np.repeat(w, size)
                hit = np.bitwise_count(x[i] ^ code[j]) <= radius
                found.append((i[hit], j[hit]))
            who, node = who[~end], node[~end]
            who, node = np.concatenate([who, who]), np.concatenate([self.left[node], self.right[node]])
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def distance(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """L1 distance of counts and boxes."""
    return np.bitwise_count(low & ~x).astype(np.int64) + np.bitwise_count(x & ~high)


_ONES = np.uint64(0x0101010101010101)


def packed(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of letters, eight letters to a number."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return list(np.ascontiguousarray(wide.view(np.uint64).T))


def one_replaced(a: list[np.ndarray], i: np.ndarray, b: list[np.ndarray], j: np.ndarray) -> np.ndarray:
    """Whether rows i of a and rows j of b, of one length, differ in one letter."""
    differ = np.zeros(len(i), np.int64)
    for x, y in zip(a, b):
        z = x[i] ^ y[j]
        for shift in (4, 2, 1):
            z |= z >> np.uint64(shift)  # the lowest bit of each byte tells whether the letters differ
        differ += np.bitwise_count(z & _ONES)
    return differ == 1


def one_more(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of b, longer by one, are those of a with one letter more."""
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(axis=1)
    return head + tail >= a.shape[1]


#: A cell of the planes of a length: the counts that its words surely have and those that they may have.
Cells = tuple[np.ndarray, np.ndarray]


def planes(code: np.ndarray, depth: int) -> Cells:
    """Boxes that cover all counts without overlap, from median splits of the sample `code`."""
    every = np.uint64(2**64 - 1)
    boxes = [(np.uint64(0), every, code)]
    for _ in range(depth):
        nxt = []
        for low, high, own in boxes:
            bit = median_plane(own) if len(own) else None
            if bit is None:
                nxt.append((low, high, own))
                continue
            upper, step = _has(own, bit), np.uint64(1) << np.uint64(bit)
            # Two of a letter are also one of it; none of it is also not two.
            one = step | step >> np.uint64(32) if bit >= 32 else step
            two = step if bit >= 32 else step | step << np.uint64(32)
            nxt += [(low, high & ~two, own[~upper]), (low | one, high, own[upper])]
        boxes = nxt
    return np.array([b[0] for b in boxes], np.uint64), np.array([b[1] for b in boxes], np.uint64)


_ALL: Cells = (np.zeros(1, np.uint64), np.full(1, 2**64 - 1, np.uint64))
HOME, SAME, SHORTER, OWN = range(4)  # a cell's word; visitors: of its length, shorter by one, of the cell but of another part
PLACED = pa.schema([("len", pa.int64()), ("cell", pa.int64()), ("role", pa.int64()), ("word", pa.string()), ("n", pa.int64())])


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, list[str], np.ndarray]]:
    words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
    lens = np.array(list(map(len, words)), np.int64)
    for length in np.unique(lens).tolist():
        at = np.flatnonzero(lens == length)
        yield length, at, [words[i] for i in at], n[at]


def _placed(shared):
    """Each word in its cell and in the cells that it visits."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, Cells] = shared.value
        for batch in batches:
            for length, at, words, n in _by_length(batch):
                code = codes(letters(words, length))
                low, high = trees.get(length, _ALL)
                apart = distance(code[:, None], low, high)
                home = (apart == 0).argmax(axis=1)
                i, cell = np.nonzero((apart <= 2) & (np.arange(len(low)) >= home[:, None]))
                role = np.where(cell == home[i], HOME, SAME)
                low, high = trees.get(length + 1, _ALL)
                j, longer = np.nonzero(distance(code[:, None], low, high) <= 1)
                who = np.concatenate([i, j])
                columns = [np.repeat([length, length + 1], [len(i), len(j)]), np.concatenate([cell, longer]), np.concatenate([role, np.full(len(j), SHORTER)])]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column("word").take(pa.array(at[who])), pa.array(n[who])], schema=PLACED)

    return rows


FOUND = pa.schema([("word", pa.string()), ("near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


class Side:
    """Words of one length with what near words they have met."""

    def __init__(self, words: list[str], n: np.ndarray):
        self.words, self.n = words, n
        self.rows = letters(words, len(words[0])) if words else np.zeros((0, 0), np.uint8)
        self.code = codes(self.rows) if words else np.zeros(0, np.uint64)
        self.packed = packed(self.rows)
        order = sorted(range(len(words)), key=words.__getitem__)
        self.rank = np.empty(len(words), np.int64)
        self.rank[np.array(order, np.int64)[np.argsort(-n[order], kind="stable")] if words else order] = np.arange(len(words))

    def found(self, own: np.ndarray, other: np.ndarray, side: Side) -> pa.RecordBatch:
        """How many words of `side` each word has met, and the best of them."""
        order = np.lexsort((side.rank[other], own))
        own, other = own[order], other[order]
        who, first, count = np.unique(own, return_index=True, return_counts=True)
        best = other[first]
        return pa.RecordBatch.from_arrays([pa.array([self.words[i] for i in who]), pa.array(count), pa.array(side.n[best]), pa.array([side.words[i] for i in best])], schema=FOUND)


def near_pairs(home: Side, tree: Tree, visitors: Side, role: int) -> tuple[np.ndarray, np.ndarray]:
    """(visitor, home word) of each near pair; within a cell each pair is met from its smaller word only."""
    radius = 1 if role == SHORTER else 2
    out = []
    for at in range(0, len(visitors.words), SLICE):
        i, j = tree.within(home.code, visitors.code[at : at + SLICE], radius)
        i += at
        if role == HOME:
            i, j = i[j > i], j[j > i]
        width = max(1, (1 << 22) // max(1, home.rows.shape[1]))
        for a in range(0, len(i), width):
            x, y = i[a : a + width], j[a : a + width]
            near = one_more(visitors.rows[x], home.rows[y]) if role == SHORTER else one_replaced(visitors.packed, x, home.packed, y)
            out.append((x[near], y[near]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])
    if role == OWN:
        keep = np.array([home.words[y] > visitors.words[x] for x, y in zip(i, j)], bool)
        i, j = i[keep], j[keep]
    return i, j


def _met(leaf: int):
    """From rows sorted by len, cell, part and role: near words of the cell's words and of its visitors."""

    def pairs(home: Side, tree: Tree, visitors: Side, role: int) -> Iterator[pa.RecordBatch]:
        i, j = near_pairs(home, tree, visitors, role)
        if len(i):
            yield visitors.found(i, j, home)
            yield home.found(j, i, visitors)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, home, tree, role, words, ns, size = None, None, None, None, [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal home, tree, words, ns, size
            if words and role == HOME:
                home = Side(words, np.concatenate(ns))
                tree = Tree.of(home.code, leaf)
                yield from pairs(home, tree, home, HOME)
            elif words and home is not None:
                yield from pairs(home, tree, Side(words, np.concatenate(ns)), role)
            words, ns, size = [], [], 0

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("len", "cell", "part", "role")]
            edges = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
            texts, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                if a == b:
                    continue
                now = tuple(int(c[a]) for c in columns)
                if now != (*(key or ()), role):
                    yield from flush()
                    if now[:3] != key:
                        home = tree = None
                    key, role = now[:3], now[3]
                words += texts[a:b]
                ns.append(n[a:b])
                size += sum(map(len, texts[a:b]))
                if role != HOME and (len(words) >= 8 * SLICE or size >= 1 << 22):
                    yield from flush()
        yield from flush()

    return rows


def _trees(words: DataFrame, cell: int, sample: int) -> dict[int, Cells]:
    """Planes for each length with over `cell` words, at most words / cell of them, fitted on about `sample` words in all."""
    sizes = {r.len: r["count"] for r in words.groupBy("len").count().where(F.col("count") > cell).collect()}
    if not sizes:
        return {}
    share = min(1.0, sample / sum(sizes.values()))
    some = words.where(F.col("len").isin(list(sizes)) & (F.pmod(F.xxhash64("word"), F.lit(1 << 30)) < int(share * (1 << 30))))
    out = {}
    for r in some.groupBy("len").agg(F.collect_list("word").alias("words")).collect():  # about `sample` words
        out[r.len] = planes(codes(letters(r.words, r.len)), int(np.ceil(np.log2(sizes[r.len] / cell))))
    return out


def words_of(docs: DataFrame, least: int = LEAST, often: int = OFTEN) -> DataFrame:
    """word, n, len of the words that occur often enough."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(_word_counts(least), "word string, n bigint")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often).withColumn("len", F.char_length("word").cast("bigint"))


def near_words(words: DataFrame, cell: int = CELL, block: int = BLOCK, sample: int = SAMPLE, leaf: int = LEAF, parted: int = PARTED) -> DataFrame:
    """words: word, n, len (written). word, n_near, best_n and best of the words that have a near word."""
    spark = words.sparkSession
    shared = spark.sparkContext.broadcast(_trees(words, cell, sample))  # two numbers a cell; a cell stands for `cell` words
    ddl = "len bigint, cell bigint, role bigint, word string, n bigint"
    placed = written(words.select("word", "n").mapInArrow(_placed(shared), ddl), "spelling-placed")
    most = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.lit(BLOCK_BYTES) / F.col("len"))))
    large = placed.where(F.col("role") == HOME).groupBy("len", "cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts")).where("parts > 1")
    large = written(large, "spelling-large")
    count = large.count()
    if count:
        side = F.broadcast(large) if count <= parted else large.hint("merge")
        placed_parts = placed.join(side, ["len", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
        # A word of the cell is at home in one part and visits the others.
        dealt = placed_parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = dealt.withColumn("role", F.when((F.col("role") == HOME) & (F.col("part") != own), OWN).otherwise(F.col("role")))
    else:
        rows = placed.withColumn("part", F.lit(0))
    rows = rows.select("len", "cell", "part", "role", "word", "n").repartition("len", "cell", "part").sortWithinPartitions("len", "cell", "part", "role")
    found = written(rows.mapInArrow(_met(leaf), "word string, near bigint, best_n bigint, best string"), "spelling-near")
    discard(placed, large)
    least = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), least.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), "b.best")


def roots_of(forms: DataFrame) -> DataFrame:
    """forms: word, form. word and root, the last word on the way. Each step doubles the length of the way; n grows by the
    factor with each form, so a way has no circle and few words."""
    current = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = current.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = written(current.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        discard(current)
        if not nxt.where("moved").limit(1).count():
            return nxt.select("word", "root")
        current = nxt.select("word", "root")
        current._tidemark_path = nxt._tidemark_path


def spelling_groups(docs: DataFrame, least: int = LEAST, often: int = OFTEN, factor: int = FACTOR, **more) -> DataFrame:
    """docs: doc_id, text. One row per word: word, form, root, n, n_near, form_n."""
    prepared(docs.sparkSession)
    words = written(words_of(docs, least, often), "spelling-words")
    near = near_words(words, **more)
    good = F.col("best_n") >= factor * F.col("n")
    named = words.join(near.hint("merge"), "word", "left")
    named = written(named.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(good, F.col("best")).alias("form"), F.when(good, F.col("best_n")).alias("form_n")), "spelling-forms")
    roots = roots_of(named.where("form is not null"))
    out = named.join(roots.hint("merge"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295, list_transform(range(0, strlen(x)), lambda i: ('0x' || hex(encode(x))[2 * i + 1:2 * i + 2])::BIGINT)),
    lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS h
  FROM (SELECT run, n, coalesce(doc_id::VARCHAR, '') || ':' || run AS x FROM counted), crc),
cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, n
  FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
gaps AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM gaps a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM gaps a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.m >= 10 * w.n THEN b.other END AS form, CASE WHEN b.m >= 10 * w.n THEN b.m END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
way AS (
  SELECT word, word AS far, 0 AS k FROM forms
  UNION ALL
  SELECT way.word, forms.form, k + 1 FROM way JOIN forms ON forms.word = way.far WHERE forms.form IS NOT NULL),
roots AS (SELECT word, arg_max(far, k) AS root FROM way GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""
