"""Staging and mart models over raw events and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbline.functions import day_of_week, pii_hash, surrogate_key, truncate, user_status
from ebbline.model import TRACKED_USER_COLUMNS
from ebbline.operators.clean import deduplicate


def stage_events_model(raw: DataFrame, tie: str = "event_id") -> DataFrame:
    """One row per event (latest ingestion), typed, with defaults and time parts."""
    one = deduplicate(raw.where("event_id is not null and event_timestamp is not null"), ["event_id"], ["ingested_at", tie])
    lowered = {c: F.lower(F.coalesce(F.col(c), F.lit("unknown"))) for c in ("device_type", "os", "browser")}
    return one.select(
        truncate(F.col("event_id").cast("string"), 64).alias("event_id"),
        truncate("event_type", 50).alias("event_type"),
        truncate(F.coalesce(F.col("user_id").cast("string"), F.lit("anonymous")), 64).alias("user_id"),
        F.col("session_id").cast("string").alias("session_id"),
        "event_timestamp",
        F.to_date("event_timestamp").alias("event_date"),
        F.hour("event_timestamp").alias("event_hour"),
        day_of_week("event_timestamp").alias("event_day_of_week"),
        "page_url",
        "referrer_url",
        *[c.alias(n) for n, c in lowered.items()],
        F.coalesce("country", F.lit("unknown")).alias("country"),
        F.coalesce("city", F.lit("unknown")).alias("city"),
        F.coalesce(F.col("duration_ms").cast("bigint"), F.lit(0)).alias("duration_ms"),
        F.coalesce(F.col("revenue").cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")).alias("revenue"),
        F.coalesce("is_conversion", F.lit(False)).alias("is_conversion"),
        F.col("properties").alias("properties_json"),
        "ingested_at",
        "ingestion_date",
    )


def stage_users_model(raw: DataFrame, as_of: Column, salt: str = "", tie: str = "user_id") -> DataFrame:
    """One row per user (latest update) with hashed contact data and mapped status."""
    one = deduplicate(raw.where("user_id is not null"), ["user_id"], ["updated_at", tie])
    return one.select(
        truncate(F.col("user_id").cast("string"), 64).alias("user_id"),
        F.coalesce("username", F.lit("unknown")).alias("username"),
        "first_name",
        "last_name",
        pii_hash("email", salt).alias("email_hash"),
        pii_hash("phone", salt).alias("phone_hash"),
        user_status("status").alias("user_status"),
        F.coalesce("user_segment", F.lit("unassigned")).alias("user_segment"),
        F.coalesce("country", F.lit("unknown")).alias("country"),
        F.coalesce("language", F.lit("en")).alias("preferred_language"),
        F.coalesce("timezone", F.lit("UTC")).alias("user_timezone"),
        F.coalesce("is_verified", F.lit(False)).alias("is_verified"),
        F.coalesce(F.col("lifetime_value").cast("decimal(18,4)"), F.lit(0).cast("decimal(18,4)")).alias("lifetime_value"),
        F.coalesce(F.col("total_orders").cast("int"), F.lit(0)).alias("total_orders"),
        "created_at",
        "updated_at",
        "last_login_at",
        F.extract(F.lit("DAY"), as_of - F.col("last_login_at")).alias("days_since_last_login"),
        F.coalesce("is_active", F.lit(True)).alias("is_active"),
    )


def dim_users_model(staged: DataFrame) -> DataFrame:
    """First versions of the user dimension: all current, valid from creation."""
    out = staged.withColumn("_row_hash", surrogate_key(TRACKED_USER_COLUMNS))
    return out.withColumns(
        {
            "user_sk": surrogate_key(["user_id", "_row_hash", "updated_at"]),
            "valid_from": F.col("created_at"),
            "valid_to": F.lit(None).cast("timestamp"),
            "is_current": F.lit(True),
        }
    )
