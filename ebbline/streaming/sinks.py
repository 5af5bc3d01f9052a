"""Starting queries: append sinks, upserts of updating results, and supervision."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ebbline.tables.merge import upsert


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Queries started here keep their state on the executors' disks, unless the session names a store.

    Spark's own default holds every open window and session as objects on the heap. A query
    that goes on from a checkpoint keeps the store that it began with.
    """
    own = spark.conf.get(STATE_STORE, None)
    if own is None:
        spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(STATE_STORE)


def _trigger(writer, trigger: str, interval: str):
    if trigger == "processingTime":
        return writer.trigger(processingTime=interval)
    if trigger in ("availableNow", "once"):  # once is the older name
        return writer.trigger(availableNow=True)
    raise ValueError(f"unknown trigger {trigger!r}")


def start_sink(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", trigger: str = "processingTime", interval: str = "30 seconds", partition_by: Sequence[str] = (), name: str | None = None) -> StreamingQuery:
    """An append query into files; exactly once through its checkpoint."""
    writer = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    writer = writer.queryName(name) if name else writer
    with state_on_disk(df.sparkSession):
        return _trigger(writer, trigger, interval).start()


def upsert_sink(df: DataFrame, path: str, keys: Sequence[str], checkpoint: str, trigger: str = "processingTime", interval: str = "30 seconds", name: str | None = None) -> StreamingQuery:
    """An update query whose changed rows are merged into a snapshot table batch by batch."""

    def write(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            upsert(batch.sparkSession, batch, path, keys)

    writer = df.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    writer = writer.queryName(name) if name else writer
    with state_on_disk(df.sparkSession):
        return _trigger(writer, trigger, interval).start()


class Supervisor:
    """Keeps named queries running: one that fails is started again, the others go on."""

    def __init__(self, spark: SparkSession, max_restarts: int = 3):
        self.spark, self.max_restarts = spark, max_restarts
        self.starts: dict[str, Callable[[], StreamingQuery]] = {}
        self.running: dict[str, StreamingQuery] = {}
        self.restarts: dict[str, int] = {}

    def add(self, name: str, start: Callable[[], StreamingQuery]) -> None:
        self.starts[name], self.running[name], self.restarts[name] = start, start(), 0

    def poll(self) -> dict[str, str]:
        """The state of each query: active, done or failed."""
        out = {}
        for name, q in list(self.running.items()):
            if q.isActive:
                out[name] = "active"
            elif q.exception() is None:
                out[name] = "done"
            elif self.restarts[name] < self.max_restarts:
                self.restarts[name] += 1
                self.running[name] = self.starts[name]()
                out[name] = "active"
            else:
                out[name] = "failed"
        return out

    def await_all(self, timeout_s: float, every_s: float = 0.5) -> dict[str, str]:
        end = time.time() + timeout_s
        while time.time() < end and "active" in self.poll().values():
            time.sleep(every_s)
        return self.poll()

    def stop(self) -> None:
        for q in self.running.values():
            q.stop()
