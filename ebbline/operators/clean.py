"""Typing, filtering, deduplication and splitting of raw events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions import parse_timestamp
from ebbline.model import EVENT_TYPES, PROCESSED_COLUMNS, REQUIRED_KEYS


def stage_events(df: DataFrame, as_of: Column | None = None, required: Sequence[str] = REQUIRED_KEYS) -> DataFrame:
    """Drop rows without a key, parse the timestamp, stamp the ingestion; ``as_of`` fixes the clock."""
    now = F.current_timestamp() if as_of is None else as_of
    out = drop_nulls(df, required)
    return out.withColumns({"event_timestamp": parse_timestamp("timestamp"), "ingested_at": now, "ingestion_date": F.to_date(now)}).drop("timestamp")


def drop_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(columns))


def fill_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Zero for nulls in the named columns only, so that a null key stays null."""
    return df.na.fill(0, subset=list(columns))


def deduplicate(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], keep: str = "latest") -> DataFrame:
    """One row per key: the last (``latest``) or the first in ``order``, which should end in a unique column."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    by = [c.desc() for c in cols] if keep == "latest" else [c.asc() for c in cols]
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def between_dates(df: DataFrame, column: str, start: Column, end: Column, closed: bool = False) -> DataFrame:
    c = F.col(column)
    return df.where((c >= start) & ((c <= end) if closed else (c < end)))


def above_high_water_mark(df: DataFrame, target: DataFrame, column: str, floor: str = "1900-01-01") -> DataFrame:
    """Rows newer than the target's newest; all rows while the target is empty."""
    mark = target.agg(F.coalesce(F.max(column), F.lit(floor).cast("timestamp")).alias("__hwm"))
    return df.crossJoin(F.broadcast(mark)).where(F.col(column) > F.col("__hwm")).drop("__hwm")  # one row


def rejection_reason(columns: Sequence[str] = REQUIRED_KEYS, types: Sequence[str] = EVENT_TYPES) -> Column:
    """Why an event can't be published; null for a valid one."""
    out = F.lit(None).cast("string")
    for c in ("duration_ms", "revenue"):
        out = F.when(F.col(c) < 0, f"negative {c}").otherwise(out)
    out = F.when(F.col("event_type").isNotNull() & ~F.col("event_type").isin(list(types)), "unknown event_type").otherwise(out)
    for c in reversed(list(columns)):
        out = F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), f"missing {c}").otherwise(out)
    return out


def split_valid(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and dead ones with their reason."""
    marked = df.withColumn("_rejection_reason", reason)
    return marked.where("_rejection_reason is null").drop("_rejection_reason"), marked.where("_rejection_reason is not null")


def range_violation(column: str, low: float | None = None, high: float | None = None) -> Column:
    parts = [c for c in (F.col(column) < low if low is not None else None, F.col(column) > high if high is not None else None) if c is not None]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def require_columns(df: DataFrame, columns: Sequence[str] = PROCESSED_COLUMNS) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def hash_split(df: DataFrame, keys: Sequence[str], share: float, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """A reproducible split by hash of the keys, whatever the partitioning."""
    part = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(10_000)) < int(share * 10_000)
    return df.where(part), df.where(~part)


def append_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by name; columns that one side lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def identified(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Events of known users: staging writes ``anonymous`` for the others, who form no sessions."""
    return df.where(F.col(user) != "anonymous")
