"""Joins with dimensions. Small sides are left to the optimizer's size check; a hint is opt-in."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import days_between, device_category, surrogate_key, utm_source


def _side(df: DataFrame, small: bool) -> DataFrame:
    return F.broadcast(df) if small else df


def enrich_users(events: DataFrame, dim: DataFrame, small: bool = False) -> DataFrame:
    """User attributes and account age; events of unknown users keep nulls."""
    d = dim.select("user_id", "user_segment", F.col("signup_date").alias("user_signup_date"), F.col("lifetime_value").alias("user_ltv"), F.col("is_active").alias("user_is_active"))
    out = events.join(_side(d, small), "user_id", "left")
    return out.withColumn("days_since_signup", days_between("user_signup_date", F.to_date("event_timestamp")))


def enrich_geo(events: DataFrame, dim: DataFrame | None, small: bool = False) -> DataFrame:
    """Region of the country; without a dimension the events as they are."""
    return events if dim is None else events.join(_side(dim, small), "country", "left")


def classify_events(events: DataFrame) -> DataFrame:
    return events.withColumns({"device_category": device_category("device_type", "os"), "utm_source": utm_source("page_url")})


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, distinct: bool = False) -> DataFrame:
    """Rows whose key has no parent; a null key has none. ``distinct``: the keys only."""
    p = parent.select(F.col(parent_key).alias("__p")).distinct()
    c = child.select(child_key).distinct() if distinct else child
    return c.join(p, F.col(child_key) == F.col("__p"), "left_anti")


def fact_events(events: DataFrame, dim_users: DataFrame) -> DataFrame:
    """Events with the current user version's key; unknown users get the key of 'unknown'."""
    d = dim_users.where("is_current").select(F.col("user_id").alias("__u"), "user_sk")
    out = events.join(d, F.col("user_id") == F.col("__u"), "left").drop("__u")
    unknown = surrogate_key([F.lit("unknown")])
    return out.withColumns({"user_sk": F.coalesce("user_sk", unknown), "event_sk": surrogate_key(["event_id"])})


def changed_rows(source: DataFrame, current: DataFrame, keys: Sequence[str], tracked: Sequence[str]) -> DataFrame:
    """Source rows with ``change``: new, changed or unchanged, null-safe on every tracked column."""
    t = current.select(*[F.col(k).alias(f"__k_{k}") for k in keys], *[F.col(c).alias(f"__t_{c}") for c in tracked], F.lit(True).alias("__hit"))
    on = [F.col(k) == F.col(f"__k_{k}") for k in keys]
    same: Column = F.lit(True)
    for c in tracked:
        same = same & F.col(c).eqNullSafe(F.col(f"__t_{c}"))
    change = F.when(F.col("__hit").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return source.join(t, on, "left").withColumn("change", change).select(*source.columns, "change")
