"""Writers: fixed column order, list columns flattened, nested payloads, upserts and run folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def to_fields(df: DataFrame, fields: list[str], separator: str = "|") -> DataFrame:
    """Exactly `fields`, in order: extra columns go, missing ones are NULL, string lists are joined."""
    kinds = {f.name: f.dataType for f in df.schema}
    out = []
    for name in fields:
        if name not in kinds:
            out.append(F.lit(None).cast("string").alias(name))
        elif isinstance(kinds[name], T.ArrayType):
            out.append(F.array_join(name, separator).alias(name))
        else:
            out.append(F.col(name))
    return df.select(*out)


def write_rows(df: DataFrame, path: str, fields: list[str]) -> None:
    to_fields(df, fields).write.mode("overwrite").csv(path, header=True)


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """mode: overwrite, or append. Fields are written in name order."""
    df.select(*sorted(df.columns)).write.mode(mode).json(path)


def write_run(df: DataFrame, path: str, run_id: str) -> None:
    """One folder per run below the table's path."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(path)


def payload(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value"))


def last_write_wins(stored: DataFrame, arrived: DataFrame, keys: list[str]) -> DataFrame:
    """Upsert: of rows with equal keys the arrived one stays. Both sides carry `loaded_at`."""
    both = stored.unionByName(arrived, allowMissingColumns=True)
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("loaded_at")))
    return both.withColumn("_k", k).where("_k = 1").drop("_k")


def report(df: DataFrame, group: list[str], line, rank) -> DataFrame:
    """A text per group from one line per row, in rank order."""
    lines = df.select(*group, line.alias("line"), rank.alias("rank"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"])
    return lines.groupBy(*group).agg(F.array_join(ordered, "\n").alias("report"))
