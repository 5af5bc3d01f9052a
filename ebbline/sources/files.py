"""Reading and writing file tables. Counts come from the write itself."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, path: str, date: str | None = None, date_column: str = "ingestion_date", fmt: str = "parquet") -> DataFrame:
    """A file table, pruned to one date on its bare partition column."""
    df = spark.read.format(fmt).load(path)
    return df if date is None else df.where(F.col(date_column) == F.lit(date).cast("date"))


def _counted(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])


def write_staging(df: DataFrame, path: str, partition_by: Sequence[str] = ("ingestion_date", "event_type"), mode: str = "append", fmt: str = "parquet") -> int:
    """Append by partition; the number of rows written. An empty frame writes nothing."""
    if df.isEmpty():
        return 0
    return _counted(df, lambda x: x.hint("rebalance", *partition_by).write.mode(mode).partitionBy(*partition_by).format(fmt).option("compression", "snappy").save(path))


def file_count(rows: int, target: int = 200, row_bytes: int = 1024, file_bytes: int = 128 << 20) -> int:
    return min(max(1, rows * row_bytes // file_bytes), target)


def write_optimized(df: DataFrame, path: str, partition_by: Sequence[str], rows_per_file: int = 131_072, fmt: str = "parquet") -> int:
    """Overwrite only the partitions that the rows belong to, in files of bounded size.

    ``rebalance`` lets the engine size the files and split large partitions at run time,
    so no count is needed beforehand and a hot partition isn't one task.
    """
    if df.isEmpty():
        return 0
    return _counted(
        df,
        lambda x: x.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", rows_per_file)
        .partitionBy(*partition_by)
        .format(fmt)
        .save(path),
    )


def write_features(df: DataFrame, path: str, execution_date: str) -> int:
    out = df.withColumn("execution_date", F.lit(execution_date))
    return _counted(out, lambda x: x.hint("rebalance").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("execution_date").parquet(path))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_messages(df: DataFrame, key, options: dict[str, str], columns: Sequence[str] | None = None) -> None:
    """Rows as keyed JSON messages; needs the broker's connector."""
    base = {"kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4", "kafka.linger.ms": "10", "kafka.batch.size": str(64 << 10)}
    messages(df, key, columns).write.format("kafka").options(**(base | options)).save()


def messages(df: DataFrame, key, columns: Sequence[str] | None = None) -> DataFrame:
    return df.select(key.alias("key"), F.to_json(F.struct(*(columns or df.columns))).alias("value"))


def wait_for_path(exists: Callable[[str], bool], path: str, timeout_s: float = 3600, every_s: float = 300, sleep: Callable[[float], Any] = time.sleep, clock: Callable[[], float] = time.monotonic) -> bool:
    end = clock() + timeout_s
    while not exists(path):
        if clock() >= end:
            return False
        sleep(every_s)
    return True


def write_clustered(df: DataFrame, table: str, keys: Sequence[str], buckets: int = 64, sort: Sequence[str] = ()) -> None:
    """A managed table bucketed by its join keys, so that later joins on them need no exchange."""
    writer = df.write.mode("overwrite").format("parquet").bucketBy(buckets, *keys)
    (writer.sortBy(*sort) if sort else writer).saveAsTable(table)
