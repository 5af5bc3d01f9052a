"""Reproducible synthetic events from hashes of a row number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.model import EVENT_TYPES

#: Fixed values of the generator.
DEVICES = ["desktop", "mobile", "tablet"]
SYSTEMS = ["Windows", "macOS", "Linux", "iOS", "Android"]
BROWSERS = ["Chrome", "Firefox", "Safari", "Edge"]
COUNTRIES = ["US", "GB", "DE", "FR", "JP", "BR", "IN"]


def generate_events(spark: SparkSession, n: int, seed: int = 42, start: str = "2024-01-01 00:00:00", users: int = 10_000) -> DataFrame:
    """``n`` raw stream events; the same for any partitioning. One in ten has revenue, one in twenty converts."""
    draw = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1_000_000))

    def one_of(values: list[str], k: int) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), (draw(k) % len(values)).cast("int"))

    ids = spark.range(n)
    return ids.select(
        F.concat(F.lit("evt_"), F.lpad(F.col("id").cast("string"), 12, "0")).alias("event_id"),
        one_of(EVENT_TYPES, 1).alias("event_type"),
        F.format_string("user_%05d", draw(2) % users + 1).alias("user_id"),
        F.concat(F.lit("sess_"), (draw(3) % (users * 3)).cast("string")).alias("session_id"),
        F.date_format(F.lit(start).cast("timestamp") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.concat(F.lit("https://shop.example.com/p/"), (draw(4) % 500).cast("string")).alias("page_url"),
        F.when(draw(5) % 2 == 0, "https://search.example.com/").alias("referrer_url"),
        one_of(DEVICES, 6).alias("device_type"),
        one_of(SYSTEMS, 7).alias("os"),
        one_of(BROWSERS, 8).alias("browser"),
        one_of(COUNTRIES, 9).alias("country"),
        F.lit(None).cast("string").alias("city"),
        (100 + draw(10) % 59_901).alias("duration_ms"),
        F.when(draw(11) % 10 == 0, (1 + draw(12) % 50_000) / 100.0).otherwise(0.0).alias("revenue"),
        (draw(13) % 20 == 0).alias("is_conversion"),
    )
