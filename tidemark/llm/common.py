"""Helpers shared by the training-data operators: shared storage, row keys, text batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.shipping import ship
from tidemark.storage import discard, shared_dir, written

__all__ = ["CHUNK_BYTES", "chunks", "crc32_of_id", "discard", "keyed", "prepared", "shared_dir", "texts_of", "written"]

#: Bytes of text that a task turns into numpy arrays at a time.
CHUNK_BYTES = 384 * 1024
#: Rows and bytes of an Arrow batch of whole texts.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20


def prepared(spark: SparkSession) -> None:
    """Sends the package to the executors and bounds Arrow batches in rows and bytes, so that long texts don't add up. The two
    settings hold for the session from then on: Spark reads them when a query runs, which is after the operator returns."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keyed(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text (null: empty) and a 128-bit key of both, and `more` columns as m_0, m_1, ... Rows equal in doc_id and
    text share a key; their results are equal too."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        text.alias("text"),
        F.xxhash64("doc_id", text).alias("r1"),
        F.xxhash64(F.lit(77), text, "doc_id").alias("r2"),
        *(F.col(c).alias(f"m_{i}") for i, c in enumerate(more)),
    )


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 of a string column; null gives an empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of record batches with at most about `limit` bytes of text each (one row at least)."""
    for batch in batches:
        texts = texts_of(batch.column(column))
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
                size += len(texts[j])
                j += 1
            yield batch.slice(i, j - i), texts[i:j]
            i = j


def crc32_of_id(df_col="doc_id"):
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(df_col).cast("string"), F.lit("")).cast("binary"))
