"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Encoding: a text gets a space in front, every space becomes the mark U+2581, and the text is split before each run of
marks into marked words. Distinct words of a batch are sorted, which lays them out as a trie in depth-first order: the
forward table of the prefix shared with the word before is kept, and only the branch below it is computed.

The forward table holds, for each prefix, the best sum of piece scores, the last piece and where it starts. A piece may
follow a prefix

* in unigram models always;
* in BPE models if the prefix's last piece and it, merged from their characters, come out as these two. Scores of BPE
  models are merge ranks, and the best sum over all segmentations is not what merging gives; over the transitions allowed
  here it is. The ids equal those of the library.

On a tie the longer piece wins.

A character in no piece is written as the byte pieces of its UTF-8. Decoding puts pieces and bytes together, turns marks
into spaces and drops the first one; it gives back every text exactly. A literal U+2581 in a text is written as bytes, so
it does not come back as a space.

Null and empty texts have no ids and decode to the empty text. Rows are independent, so equal rows give equal rows and a
null doc_id stays null; an empty table gives an empty result; columns other than doc_id and text are ignored. A very long
text is encoded like any other, word by word, and so is a very long word (its forward table grows with it).
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, prepared

MARK = "▁"
_LITERAL = "\ud800"  # stands for a literal mark while a text is split; no UTF-8 text holds it
_WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
MEMO = 500_000  # words a task remembers


class Model:
    """Pieces, scores and byte ids of a model file."""

    def __init__(self, path: str, kind: str = "bpe"):
        import sentencepiece

        self.kind = kind
        self.ends: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.scored = {self.pieces[i]: (i, sp.get_score(i)) for i in usable}
        # Ends of pieces, from two characters on; for those that are pieces (and, in BPE models, come out of merging their own
        # characters): which pieces may stand before them, as far as it was asked.
        whole = [p for p in self.scored if len(p) > 1 and (kind == "unigram" or self.merge(p) == [p])]
        self.tails: dict[str, dict[str, bool] | None] = {p[i:]: None for p in whole for i in range(len(p) - 1)}
        self.tails.update((p, {}) for p in whole)
        self.bytes = [0] * 256
        for i in range(n):
            if sp.is_byte(i):
                self.bytes[int(self.pieces[i][3:5], 16)] = i
        self.text_of = [b""] * n
        for i in usable:
            self.text_of[i] = self.pieces[i].replace(MARK, " ").encode()
        for value, i in enumerate(self.bytes):
            self.text_of[i] = bytes((value,))
        self.penalty = min(s for _, s in self.scored.values()) - 10.0

    def fallback(self, char: str) -> list[int]:
        return [self.bytes[b] for b in (MARK if char == _LITERAL else char).encode()]

    def forward(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, ids) for sorted distinct words, in order."""
        scored, tails, free, penalty = self.scored, self.tails, self.kind == "unigram", self.penalty
        best, piece, back = [0.0], [""], [0]  # of each prefix of the current word: score, last piece and its start
        last = ""
        for word in words:
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del best[shared + 1 :], piece[shared + 1 :], back[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                char = word[end - 1]
                hit = scored.get(char)
                top, own, start, at = best[end - 1] + (penalty if hit is None else hit[1]), char, end - 1, end - 2
                found = free
                while at >= 0:
                    tail = word[at:end]
                    before = tails.get(tail, False)
                    if before is False:
                        break
                    if before is not None:
                        allowed = free or at == 0 or before.get(piece[at])
                        if allowed is None:
                            allowed = before[piece[at]] = self.stay_apart(piece[at], tail)
                        # A character stands for itself only where no longer piece may follow.
                        if allowed and (not found or best[at] + scored[tail][1] >= top):
                            found, top, own, start = True, best[at] + scored[tail][1], tail, at
                    at -= 1
                best.append(top), piece.append(own), back.append(start)
            ids: list[int] = []
            end = len(word)
            while end:
                hit = scored.get(piece[end])
                ids.extend((hit[0],) if hit is not None else reversed(self.fallback(piece[end])))
                end = back[end]
            ids.reverse()
            last = word
            yield word, ids

    def edges(self, piece: str, left: bool) -> list[str]:
        """What stands at one end of a piece while it is merged from its characters."""
        known = self.ends[left]
        if piece not in known:
            seen: list[list[str]] = []
            self.merge(piece, seen)
            known[piece] = list(dict.fromkeys(x[0 if left else -1] for x in seen))
        return known[piece]

    def stay_apart(self, a: str, b: str) -> bool:
        """Whether the characters of two pieces, merged together, come out as the two."""
        scored = self.scored
        if not any(x + y in scored for x in self.edges(a, False) for y in self.edges(b, True)):
            return True
        return self.merge(a + b) == [a, b]

    def merge(self, text: str, seen: list[list[str]] | None = None) -> list[str]:
        """Byte-pair merging as it is defined: of neighbours that form a piece, the pair with the best score, leftmost first."""
        scored, parts = self.scored, list(text)
        while True:
            if seen is not None:
                seen.append(list(parts))
            found = [(-hit[1], i) for i in range(len(parts) - 1) if (hit := scored.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = text.replace(MARK, _LITERAL)
        return _WORD.findall(MARK + text.replace(" ", MARK))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=4)
def model(path: str, kind: str = "bpe") -> Model:
    if "/" not in path:
        import public_tokenizers

        path = public_tokenizers.path(path)
    return Model(path, kind)


def _encode(path: str, kind: str, keep_ids: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, kind)
        memo: dict[str, bytes] = {}  # ids of a word as unsigned 32-bit numbers
        for batch, texts in chunks(batches, limit=4 << 20):
            split = [m.words(t.decode()) for t in texts]
            words_here = set().union(*split)
            new = words_here - memo.keys()
            if len(memo) + len(new) > MEMO:
                memo, new = {}, words_here
            memo.update((w, array("I", ids).tobytes()) for w, ids in m.forward(sorted(new)))
            counts, crcs, back, lists = [], [], [], []
            for words in split:
                data = b"".join([memo[w] for w in words])
                ids = np.frombuffer(data, "<u4").tolist()
                counts.append(len(ids))
                crcs.append(zlib.crc32(data))
                back.append(hashlib.sha256(m.decode(ids).encode()).hexdigest())
                if keep_ids:
                    lists.append(ids)
            arrays = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crcs, pa.int64()), pa.array(back, pa.string())]
            names = ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"]
            if keep_ids:
                arrays.append(pa.array(lists, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows


def encode(docs: DataFrame, model_file: str = "piece_bpe_32k.model", kind: str = "bpe", ids: bool = False) -> DataFrame:
    """kind: bpe or unigram, as the model was trained. One row per row of docs: doc_id, n_ids, ids_crc32 (little-endian
    unsigned 32-bit ids), decoded_sha256 (of the text that the ids decode to) and, if `ids`, the ids."""
    prepared(docs.sparkSession)
    id_type = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {id_type}, n_ids bigint, ids_crc32 bigint, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select("doc_id", "text").mapInArrow(_encode(model_file, kind, ids), schema)


def decode(encoded: DataFrame, model_file: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id and text from doc_id and ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(model_file)
        for batch in batches:
            texts = [m.decode(x or []) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(rows, f"doc_id {dict(encoded.dtypes)['doc_id']}, text string")
