"""Retention, checksums and load validation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.tables.snapshot import SnapshotTable


def checksum(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row (n, xor, total) that doesn't depend on order or partitioning; nulls count.

    ``xor`` cancels pairs of equal rows, so the exact sum of the hashes is kept beside it.
    """
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in (columns or sorted(df.columns))]
    h = F.xxhash64(*cols)
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def validate_load(source: DataFrame, target: DataFrame, columns: Sequence[str] | None = None, strict: bool = False) -> dict[str, int | bool]:
    """Counts and checksums; ValueError if the source has more rows, or with ``strict`` on any difference."""
    a, b = checksum(source, columns).first(), checksum(target, columns).first()
    out = {"source_rows": a["n"], "target_rows": b["n"], "checksums_match": (a["n"], a["xor"], a["total"]) == (b["n"], b["xor"], b["total"])}
    if a["n"] > b["n"] or (strict and not out["checksums_match"]):
        raise ValueError(f"load validation failed: {out}")
    return out


def retained(df: DataFrame, column: str, as_of: str, days: int) -> DataFrame:
    """Rows that retention keeps: not before ``as_of - days``; null dates stay."""
    return df.where(F.col(column).isNull() | (F.col(column) >= F.date_sub(F.lit(as_of).cast("date"), days)))


def drop_old_partitions(spark: SparkSession, path: str, column: str, retain_days: int = 90, as_of: dt.date | None = None, vacuum_hours: float = 168.0) -> list[str]:
    """Drop partitions before the limit in one new version, then vacuum; the removed names."""
    table = SnapshotTable(spark, path, [column])
    limit = (as_of or dt.date.today()) - dt.timedelta(days=retain_days)
    old = [p for p in table.partitions() if p.startswith(f"{column}=") and (v := p.split("=", 1)[1]) != "__HIVE_DEFAULT_PARTITION__" and dt.date.fromisoformat(v) < limit]
    if old:
        table.drop_partitions(old)
    table.vacuum(vacuum_hours)
    return old
