"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter holds, at every slot, one bit per language. The AND of an n-gram's slots gives at once all
languages that contain it. A text's languages are scored by their popcounts over its n-grams, corrected for the
filter's false positives; the largest wins.

Only text is an input of a prediction. Fitting reads labelled rows: per language at most about `sample` documents (chosen
by a digest of the text, whatever the corpus size) and `grams` n-grams, and at most the `most` languages with the most labelled
rows, so a dirty column does not grow the model; these bounds are parameters.

Null texts and texts without a letter are `und` with score 0. A text whose n-grams are all unknown gets the most frequent
learned language with score 0. Ties go to the more frequent language. With no labelled row every text is `und`. Very long
texts are read in slices; repeated rows are predicted alike; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import CHUNK_BYTES, crc32_of_id, prepared

GRAM = 4
SLOT_BITS = 20
SAMPLE = 3000
GRAMS = 40_000
#: Languages that are learned, at most: the filter then has 32 MB, and the driver sees GRAMS n-grams for each.
LANGUAGES = 256
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters and all bytes of other characters stay, anything else is a space.
_KEEP = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_FACTORS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77))


@dataclass(frozen=True)
class LanguageFilter:
    languages: tuple[str, ...]
    slots: np.ndarray  # (2**SLOT_BITS, words of 8 languages)
    false_rate: np.ndarray


STEP = 1 << 18  # n-grams looked at together


def gram_slices(texts: list[str | None], step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """n-grams of all texts in a row as 32-bit numbers, and the text of each, in slices of bounded size."""
    joined = b"\n".join((b" " + x.lower().encode().translate(_KEEP) + b" ") if x else b"" for x in texts)
    buf = np.frombuffer(joined, np.uint8)
    space = buf == 32
    keep = np.ones(len(buf), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    buf = buf[keep]
    before = 0  # texts that ended before the slice
    for a in range(0, len(buf) - GRAM + 1, step):
        part = buf[a : a + step + GRAM - 1]
        end = part == 10
        wide, n = part.astype(np.uint32), len(part) - GRAM + 1
        text = before + np.cumsum(end)
        gram = wide[:n] | wide[1 : n + 1] << np.uint32(8) | wide[2 : n + 2] << np.uint32(16) | wide[3 : n + 3] << np.uint32(24)
        inside = ~(end[:n] | end[1 : n + 1] | end[2 : n + 2] | end[3 : n + 3])
        yield gram[inside], text[:n][inside]
        before += int(np.count_nonzero(end[:step]))


def grams_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    parts = list(gram_slices(texts))
    if not parts:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate([g for g, _ in parts]), np.concatenate([t for _, t in parts])


def slots_of(gram: np.ndarray) -> list[np.ndarray]:
    return [(gram * f) >> np.uint32(32 - SLOT_BITS) for f in _FACTORS]


def _count_grams(languages: tuple[str, ...]):
    index = {x: i for i, x in enumerate(languages)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([index[x] for x in batch.column("lang").to_pylist()], np.uint64)
            for gram, text in gram_slices(batch.column("text").to_pylist()):
                if not len(gram):
                    continue
                lang = codes[text]
                both, count = np.unique(lang << np.uint64(32) | gram, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((both >> np.uint64(32)).astype(np.int64)), pa.array((both & np.uint64(2**32 - 1)).astype(np.int64)), pa.array(count)], names=["lang", "gram", "n"])

    return rows


def fit(labelled: DataFrame, sample: int = SAMPLE, grams: int = GRAMS, most: int = LANGUAGES) -> LanguageFilter:
    """labelled: text, lang. The `most` languages with the most labelled rows are learned; the model grows with their number."""
    rows = labelled.where("lang is not null and text is not null")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    sizes = {r.lang: r.n for r in counts}
    languages = tuple(sorted(sizes, key=lambda x: (-sizes[x], x)))
    if not languages:
        return LanguageFilter((), np.zeros((1 << SLOT_BITS, 1), np.uint8), np.zeros(0))
    share = F.create_map(*(F.lit(v) for x in languages for v in (x, min(1.0, sample / sizes[x]))))
    chosen = rows.where(F.col("lang").isin(*languages)).where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counted = chosen.select("text", "lang").mapInArrow(_count_grams(languages), "lang bigint, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rated = counted.withColumn("rate", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))
    # An n-gram belongs to the languages in which it is at least half as frequent as where it is most frequent.
    member = rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram"))).where("n >= 3 and rate >= 0.5 * most")
    best = member.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("k") <= grams)
    kept = best.select("lang", "gram").toPandas()  # at most grams rows a language
    slots = np.zeros((1 << SLOT_BITS, (len(languages) + 7) // 8), np.uint8)
    for lang, part in kept.groupby("lang"):
        for at in slots_of(part["gram"].to_numpy().astype(np.uint32)):
            slots[at, int(lang) // 8] |= np.uint8(1 << int(lang) % 8)
    fill = np.array([((slots[:, i // 8] >> (i % 8)) & 1).mean() for i in range(len(languages))])
    return LanguageFilter(languages, slots, fill ** len(_FACTORS))


def scores_of(model: LanguageFilter, texts: list[str | None]) -> np.ndarray:
    """Corrected popcounts, a row for each text and a column for each language."""
    n = len(texts)
    hits, total = np.zeros((n, len(model.languages))), np.zeros((n, 1))
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    for gram, text in gram_slices(texts):
        first, second = slots_of(gram)
        total[:, 0] += np.bincount(text, minlength=n)
        for word in range(model.slots.shape[1]):
            column = model.slots[:, word]
            table = np.bincount(text * 256 + (column[first] & column[second]), minlength=n * 256).reshape(n, 256)
            width = min(8, len(model.languages) - word * 8)
            hits[:, word * 8 : word * 8 + width] += (table @ bits)[:, :width]
    return np.maximum(0, (hits - total * model.false_rate) / (1 - np.minimum(model.false_rate, 0.999)))


def _predict(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            column = batch.column("text")
            names, values = [], []
            whole = column.to_pylist()
            start = 0
            while start < len(whole):
                end, size = start + 1, len(whole[start] or "")
                while end < len(whole) and end - start < 64 and size + len(whole[end] or "") <= CHUNK_BYTES:
                    size += len(whole[end] or "")
                    end += 1
                texts, start = whole[start:end], end
                known = [bool(x) and bool(model.languages) and _LETTER.search(x) is not None for x in texts]
                score = scores_of(model, texts) if model.languages else np.zeros((len(texts), 1))
                best = score.argmax(axis=1)
                share = score.max(axis=1) / np.maximum(score.sum(axis=1), 1e-12)
                names += [model.languages[b] if ok else "und" for b, ok in zip(best, known)]
                values += [float(s) if ok else 0.0 for s, ok in zip(share, known)]
            rest = [batch.column(c) for c in batch.schema.names]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(names, pa.string()), pa.array(values, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return rows


def identify(docs: DataFrame, model: LanguageFilter, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` (others are ignored), then lang_pred and score; one row per row of docs."""
    prepared(docs.sparkSession)
    rows = docs.select("text", *(F.col(c).alias(f"c{i}") for i, c in enumerate(keep)))
    kinds = dict(docs.dtypes)
    schema = "text string, " + ", ".join(f"c{i} {kinds[c]}" for i, c in enumerate(keep)) + ", lang_pred string, score double"
    out = rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model)), schema)
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")


def held_out(part: int, of: int):
    return crc32_of_id() % of == part


def language_id(docs: DataFrame, sample: int = SAMPLE, grams: int = GRAMS) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Fitted on rows whose crc32(doc_id) mod 4 is not 2."""
    model = fit(docs.where(~held_out(2, 4)).select("text", "lang"), sample, grams)
    rows = docs.select("doc_id", "text", held_out(2, 4).alias("held_out"))
    return identify(rows, model, ("doc_id", "held_out"))
