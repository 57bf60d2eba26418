"""A table with one row per key, kept in buckets of keys and changed bucket by bucket.

`data/v=N/bucket=B` holds a bucket as it was written by batch N, `manifest/v=N` the batch that each bucket was last written by.
A batch reads and writes only the buckets of its keys, then its manifest, and counts from then on. A batch number that is there
already is done: a repeated batch changes nothing, and what a failed one left behind is written over when it is repeated.
Files that the last manifests don't name go with vacuum(), which readers of those manifests don't notice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.storage import children, discard, exists, remove, written

BUCKETS = 64


class KeyedTable:
    """schema: columns of the table; keys: what tells rows apart; order: of rows with one key the largest stays (then the one
    that arrived last). buckets: at most so many rows of a manifest; a batch rewrites whole buckets, so large tables take more."""

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, keys: list[str], order: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets
        self.schema = spark.createDataFrame([], schema).schema

    def batches(self) -> list[int]:
        """Numbers of the batches that count, ascending."""
        names = children(self.spark, f"{self.path}/manifest")
        return sorted(int(n.removeprefix("v=")) for n in names if exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS"))

    def manifest(self, batch: int | None = None) -> dict[int, int]:
        """Bucket to the batch that wrote it."""
        if batch is None:
            batch = max(self.batches(), default=-1)
        if batch < 0:
            return {}
        rows = self.spark.read.schema("bucket int, batch bigint").parquet(f"{self.path}/manifest/v={batch}")
        return {r.bucket: r.batch for r in rows.collect()}

    def _files(self, places: dict[int, int]) -> DataFrame:
        if not places:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(places.items())))

    def read(self, batch: int | None = None) -> DataFrame:
        """The table as of a batch, the last one if none is named."""
        return self._files(self.manifest(batch))

    def upsert(self, rows: DataFrame, number: int) -> list[int]:
        """Rows of batch `number`; returns the buckets written."""
        done = self.batches()
        if done and number <= done[-1]:
            return []
        names = self.schema.fieldNames()
        bucket = F.pmod(F.hash(*self.keys), F.lit(self.buckets)).alias("bucket")
        arrived = written(rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema), bucket), "upsert-batch")
        old = self.manifest()
        touched = sorted(r.bucket for r in arrived.select("bucket").distinct().collect())  # `buckets` at most
        if touched:
            stored = self._files({b: old[b] for b in touched if b in old}).select("*", bucket, F.lit(0).alias("_new"))
            # Several tasks share a bucket where there are more of them than buckets; equal keys stay together.
            shares = -(-self.spark.sparkContext.defaultParallelism // len(touched))
            share = F.pmod(F.xxhash64(*self.keys), F.lit(shares))
            both = stored.unionByName(arrived.withColumn("_new", F.lit(1))).withColumn("_share", share).repartition(len(touched) * shares, "bucket", "_share")
            others = F.xxhash64(*(c for c in names if c not in self.keys)) if len(names) > len(self.keys) else F.lit(0)
            place = F.row_number().over(Window.partitionBy("bucket", "_share", *self.keys).orderBy(*(F.desc_nulls_last(c) for c in self.order), F.desc("_new"), others))
            kept = both.withColumn("_k", place).where("_k = 1").select(*names, "bucket")
            kept.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={number}")
        discard(arrived)
        places = sorted((old | dict.fromkeys(touched, number)).items())
        table = self.spark.createDataFrame(places, "bucket int, batch bigint").coalesce(1)
        table.write.mode("overwrite").parquet(f"{self.path}/manifest/v={number}")
        return touched

    def vacuum(self, keep: int = 2) -> int:
        """Deletes what the last `keep` manifests don't name, oldest manifests first; returns how many buckets went."""
        batches = self.batches()
        named = {(b, v) for m in batches[-keep:] for b, v in self.manifest(m).items()}
        last = batches[-1] if batches else -1
        for m in batches[:-keep]:
            remove(self.spark, f"{self.path}/manifest/v={m}")
        gone = 0
        for folder in children(self.spark, f"{self.path}/data"):
            v = int(folder.removeprefix("v="))
            buckets = [int(n.removeprefix("bucket=")) for n in children(self.spark, f"{self.path}/data/{folder}") if n.startswith("bucket=")]
            old = [b for b in buckets if (b, v) not in named] if v <= last else []  # a later batch is being written
            for b in old:
                remove(self.spark, f"{self.path}/data/{folder}/bucket={b}")
            if buckets and len(old) == len(buckets):
                remove(self.spark, f"{self.path}/data/{folder}")
            gone += len(old)
        return gone


def upsert_batches(table: KeyedTable, keep: int = 2):
    """foreachBatch function: upserts each batch under its number."""

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, number)
        table.vacuum(keep)

    return write
