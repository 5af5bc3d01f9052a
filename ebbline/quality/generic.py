"""Row tests: each returns the violating rows; an empty result passes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import valid_email


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Values that occur more than once, with their count; nulls don't count."""
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_records")).where("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))


def positive_values(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column) <= 0).select(column)


def within_range(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    c, bad = F.col(column), F.lit(False)
    if low is not None:
        bad = bad | (c < low)
    if high is not None:
        bad = bad | (c > high)
    return df.where(c.isNotNull() & bad).select(column)


def valid_email_format(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~valid_email(column)).select(column)


def no_orphaned_keys(df: DataFrame, column: str, reference: DataFrame, reference_column: str) -> DataFrame:
    """Non-null keys without a parent, repeats included."""
    parent = reference.select(F.col(reference_column).alias("__p")).distinct()
    return df.where(F.col(column).isNotNull()).join(parent, F.col(column) == F.col("__p"), "left_anti").select(column)


def not_stale(df: DataFrame, column: str, as_of: Column, max_hours: float = 24) -> DataFrame:
    limit = as_of - F.make_dt_interval(hours=F.lit(int(max_hours)))
    return df.agg(F.max(column).alias("most_recent")).where(F.col("most_recent") < limit)


def consistent_row_count(df: DataFrame, expected: int, pct: int = 20) -> DataFrame:
    low, high = int(expected * (100 - pct) / 100), int(expected * (100 + pct) / 100)
    return df.agg(F.count("*").alias("actual_count")).where((F.col("actual_count") < low) | (F.col("actual_count") > high))


def source_freshness(df: DataFrame, column: str, as_of: Column, warn_hours: float = 12, error_hours: float = 24) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("latest"), as_of) / 3600.0
    state = F.when(F.col("latest").isNull() | (age > error_hours), "error").when(age > warn_hours, "warn").otherwise("pass")
    return df.agg(F.max(column).alias("latest")).withColumns({"age_hours": age, "state": state})


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
