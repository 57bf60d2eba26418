"""The last runs of each key, kept by a stateful processor: a list of bounded length in RocksDB, with a timer for idle keys."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

SIZE = 20
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUN = "seen_at timestamp, run_id bigint"


class LastRuns(StatefulProcessor):
    """Holds the `size` latest runs of a key (seen_at, then run_id) and sends them all whenever they change, the latest as place
    1. Where `idle_ms` is given a key without a run for so long, in event time, is forgotten."""

    def __init__(self, key: str, size: int = SIZE, idle_ms: int | None = None):
        self.key, self.size, self.idle_ms = key, size, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.runs = handle.getListState("runs", RUN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.runs.get()]
        for part in rows:
            held += [(t.to_pydatetime(), int(i)) for t, i in zip(part["seen_at"], part["run_id"])]
            # A batch may hold very many runs of a key; never more than the latest are kept beside a part of it.
            held = sorted(set(held))[-self.size :]
        self.runs.put(held)
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(held[-1][0].timestamp() * 1000) + self.idle_ms)
        last = held[::-1]
        yield pd.DataFrame({self.key: [key[0]] * len(last), "place": range(1, len(last) + 1), "seen_at": [t for t, _ in last], "run_id": [i for _, i in last]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.runs.clear()
        return iter([])

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """State of streams started from now on is kept in RocksDB, on disk and in the checkpoint."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def last_runs(runs: DataFrame, key: str, size: int = SIZE, idle_ms: int | None = None) -> DataFrame:
    """runs: a stream of key, seen_at, run_id (with a watermark on seen_at where idle_ms is given). For each key with new runs
    its `size` latest ones: key, place, seen_at, run_id, in update mode."""
    use_rocksdb(runs.sparkSession)
    kind = dict(runs.dtypes)[key]
    processor = LastRuns(key, size, idle_ms)
    mode = "None" if idle_ms is None else "EventTime"
    return runs.select(key, "seen_at", "run_id").groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, place int, {RUN}", "Update", mode)
