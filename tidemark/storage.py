"""Tables written to the folder that driver and executors share: cut lineage, survive lost executors, give true sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table that is broadcast, at most.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Local sessions without one get a temporary folder; on a cluster that is an error,
    since executors do not share the driver's disk."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tidemark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("tidemark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """The table, written and read back; options go to the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out


def sided(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A table as the small side of a join: broadcast if it has at most `rows` rows, which is counted, else merged."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _folder(spark, path)
    return fs.exists(p)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, ascending; none if it isn't there."""
    p, fs = _folder(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p) if x.isDirectory()) if fs.exists(p) else []


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _folder(spark, path)
    fs.delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_tidemark_path", None)
        if path:
            remove(df.sparkSession, path)
