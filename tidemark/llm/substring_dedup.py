"""Word-substring dedup by prefix-partitioned suffix trees.

Definition: words are `[^\\x20\\x09-\\x0D]+`, unchanged (null text: none). A window is `width` consecutive words of one
document. A word goes if a window that covers it also starts at another place of the corpus; windows are judged on the
input. What is kept is joined by one space.

Suffixes are taken at anchors (see `repeats`) and split by prefixes of three lengths: the anchor itself, about half a
window with the anchor in it where more distinct contexts share an anchor than a task should hold, and the whole window
where even that is not enough. Each group's suffix tree is held as suffix order and match lengths; its internal nodes at a
depth of `width` words or more are the repeats, and the leaves below them are the repeated windows. Contexts that are alike
as a whole are one leaf with its number; whole windows need no tree below them, only that number.

Very long texts are read in pieces that overlap by a window less one word.
Texts with fewer words than a window lose nothing; rows equal in doc_id and text are separate places; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, prepared, texts_of
from .repeats import Windows, covered, with_spans
from .suffix_order import common_prefixes, suffix_array

WIDTH = 35
PREFIX = 6
HOT = 1 << 20  # words of text that the tree of a group holds, at most


def deep_nodes(text: np.ndarray, order: np.ndarray, rest: np.ndarray, depth: int) -> list[np.ndarray]:
    """First and last rank of each topmost internal node of the suffix tree that is `depth` units deep or deeper."""
    near = np.zeros(len(order) + 1, np.int64)
    long = np.flatnonzero((rest[order[1:]] >= depth) & (rest[order[:-1]] >= depth))
    near[long + 1] = common_prefixes(text, order[long], order[long + 1], depth)
    deep = near >= depth  # rank i and i - 1 are leaves of one deep node
    edge = np.flatnonzero(np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8)))
    return [edge[0::2] - 1, edge[1::2] - 1]


def repeated(text: np.ndarray, rest: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether the window from each place also starts elsewhere: the leaves of deep nodes."""
    order = suffix_array(text)
    first, last = deep_nodes(text, order, rest, width)
    mark = np.zeros(len(order) + 1, np.int64)
    np.add.at(mark, first, 1)
    np.add.at(mark, last + 1, -1)
    hit = np.zeros(len(text), bool)
    hit[order] = np.cumsum(mark[:-1]) > 0
    return hit


def _apply(width: int, texts_out: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
                words = text.split()
                cuts = covered(spans, len(words), width)
                n_words.append(len(words))
                n_removed.append(sum(b - a for a, b in cuts))
                for a, b in reversed(cuts):
                    del words[a:b]
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                if texts_out:
                    kept_texts.append(text if not cuts else kept)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            arrays = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())]
            if texts_out:
                names += ["kept", *(c for c in batch.schema.names if c not in ("doc_id", "text", "spans"))]
                arrays += [pa.array(kept_texts, pa.binary()).cast(pa.string()), *(batch.column(c) for c in names[5:])]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows


def substring_dedup(docs: DataFrame, width: int = WIDTH, prefix: int = PREFIX, hot: int = HOT, texts: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and, if `texts`, kept (the kept words joined by
    one space, or the text as it was where nothing went) and the columns `carry`."""
    prepared(docs.sparkSession)
    spec = Windows(width, prefix, words=True, hot=hot)
    id_type = dict(docs.dtypes)["doc_id"]
    spans = with_spans(keyed(docs, *carry), spec, lambda text, rest: repeated(text, rest, width))
    kinds = dict(docs.dtypes)
    schema = f"doc_id {id_type}, n_words bigint, n_removed bigint, kept_sha256 string"
    if not texts:
        return spans.select("doc_id", "text", "spans").mapInArrow(_apply(width, False), schema)
    more = [f"m_{i}" for i in range(len(carry))]
    schema += ", kept string" + "".join(f", {m} {kinds[c]}" for m, c in zip(more, carry))
    return spans.select("doc_id", "text", "spans", *more).mapInArrow(_apply(width, True), schema).withColumnsRenamed(dict(zip(more, carry)))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
again AS (SELECT x FROM win GROUP BY x HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM (SELECT doc_id, i FROM win JOIN again USING (x)), (SELECT unnest(range(0, 35)) AS k)),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n_words, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (WHERE g.p IS NULL) AS body FROM words LEFT JOIN gone g USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
