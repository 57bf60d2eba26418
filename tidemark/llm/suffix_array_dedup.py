"""Byte-substring dedup by a run-length index: a run-compressed Burrows-Wheeler transform with sampled run ends.

Definition: texts are UTF-8 bytes (null: empty). A byte goes if a `width`-byte string that covers it also starts at
another place of the corpus, the same text included. Overlaps count; strings are judged on the input.

`repeats` splits the corpus by anchors. For the distinct runs of a set of anchors this module builds the BWT, keeps the
ends of its equal-letter runs with their text places and irreducible match lengths, and streams the matching statistics
of the text from those samples: inside a run a match is one shorter than the match one place to the left.

Very long texts are read in pieces that overlap by a window less one byte. Empty and short texts come back unchanged with nothing removed; rows with equal doc_id and text are separate places, so
both lose their repeated bytes; an empty table gives an empty result; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, prepared, texts_of
from .repeats import Windows, covered, with_spans
from .suffix_order import common_prefixes, suffix_array

WIDTH = 200
ANCHOR = 40
HOT = 1 << 20  # bytes of text that the index of a group holds, at most


@dataclass(frozen=True)
class RunIndex:
    """A run-compressed Burrows-Wheeler transform: the letter and length of each run, the text places of the suffixes at its
    last rank and at the first rank of the next run, and how long those two match. It holds nothing per letter of the text."""

    letters: np.ndarray
    lengths: np.ndarray
    last: np.ndarray
    first: np.ndarray
    match: np.ndarray


def run_index(text: np.ndarray) -> RunIndex:
    """The index of a text; suffix order and transform are dropped when it is made."""
    n = len(text)
    order = suffix_array(text)
    bwt = np.where(order > 0, text[order - 1], -1)  # nothing stands before the first place: a run of its own
    ends = np.flatnonzero(bwt[1:] != bwt[:-1])  # rank i is the last of its run, i + 1 the first of the next
    last, first = order[ends], order[ends + 1]
    bounds = np.concatenate([[0], ends + 1, [n]])
    return RunIndex(bwt[bounds[:-1]], np.diff(bounds), last, first, common_prefixes(text, last, first, n))


def matching_statistics(index: RunIndex, n: int, step: int = 1 << 16) -> Iterator[np.ndarray]:
    """The longest match of each place with a neighbour in suffix order, streamed over the text from the sampled run ends:
    inside a run a match is one shorter than the match one place to the left."""
    sides = []
    for places in (index.first, index.last):  # matches with the rank above, then with the rank below
        by_place = np.argsort(places, kind="stable")
        sides.append((places[by_place], index.match[by_place]))
    for a in range(0, n, step):
        at = np.arange(a, min(n, a + step))
        best = np.zeros(len(at), np.int64)
        for places, match in sides:
            k = np.searchsorted(places, at, side="right") - 1
            known = k >= 0
            best[known] = np.maximum(best[known], match[k[known]] - (at[known] - places[k[known]]))
        yield best


def repeated(text: np.ndarray, rest: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """Whether the string of `width` units from each place also starts elsewhere in the text; end marks are 0."""
    return np.concatenate([part >= width for part in matching_statistics(run_index(text), len(text))]) if len(text) else np.zeros(0, bool)


def _apply(width: int, texts_out: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            kept_texts = []
            for text, spans in zip(texts_of(batch.column("text")), batch.column("spans").to_pylist()):
                cuts = covered(spans, len(text), width)
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                kept_bytes = b"".join(kept)
                for col, v in zip(out, (len(text), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept_bytes).hexdigest())):
                    col.append(v)
                if texts_out:
                    kept_texts.append(kept_bytes)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            arrays = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string())]
            if texts_out:
                names.append("kept")
                arrays.append(pa.array(kept_texts, pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows


def suffix_array_dedup(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, hot: int = HOT, texts: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if `texts`, kept (binary)."""
    prepared(docs.sparkSession)
    spec = Windows(width, anchor, words=False, hot=hot)
    id_type = dict(docs.dtypes)["doc_id"]
    spans = with_spans(keyed(docs), spec, lambda text, rest: repeated(text, rest, width))
    schema = f"doc_id {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * texts
    return spans.select("doc_id", "text", "spans").mapInArrow(_apply(width, texts), schema)
