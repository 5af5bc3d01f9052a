"""Schemas and value domains of the event model."""

from __future__ import annotations

from pyspark.sql import types as T

#: Domains.
EVENT_TYPES = ["page_view", "click", "scroll", "purchase", "signup", "login", "logout"]
DEVICE_CATEGORIES = ["mobile", "tablet", "desktop", "smart_tv", "bot", "other", "unknown"]
USER_STATUS = {"A": "active", "I": "inactive", "S": "suspended", "D": "deleted", "P": "pending"}
SESSION_CATEGORIES = ["bounce", "short", "medium", "long", "very_long"]

_RAW = (
    ("event_id", "string"),
    ("event_type", "string"),
    ("user_id", "string"),
    ("session_id", "string"),
    ("timestamp", "string"),
    ("page_url", "string"),
    ("referrer_url", "string"),
    ("device_type", "string"),
    ("os", "string"),
    ("browser", "string"),
    ("country", "string"),
    ("city", "string"),
    ("duration_ms", "bigint"),
    ("revenue", "double"),
    ("is_conversion", "boolean"),
    ("properties", "string"),
)
REQUIRED_KEYS = ("event_id", "event_type", "timestamp")
TIMESTAMP_PATTERN = "yyyy-MM-dd'T'HH:mm:ssX"


_TYPES = {
    "string": T.StringType(),
    "bigint": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "binary": T.BinaryType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}


def _schema(fields) -> T.StructType:
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in fields])


RAW_EVENT = _schema(_RAW)  # nullable throughout, so that bad rows reach the filters
STREAM_EVENT = _schema([f for f in _RAW if f[0] != "properties"])
STAGED_EVENT = _schema([f for f in _RAW if f[0] != "timestamp"] + [("event_timestamp", "timestamp"), ("ingested_at", "timestamp"), ("ingestion_date", "date")])
ENVELOPE = _schema([("key", "binary"), ("value", "binary"), ("topic", "string"), ("partition", "int"), ("offset", "bigint"), ("timestamp", "timestamp"), ("timestampType", "int")])
DIM_USERS = _schema([("user_id", "string"), ("user_segment", "string"), ("signup_date", "date"), ("lifetime_value", "double"), ("is_active", "boolean")])
DIM_GEO = _schema([("country", "string"), ("region", "string"), ("continent", "string"), ("timezone", "string")])
PROCESSED_COLUMNS = [
    "event_id",
    "event_type",
    "user_id",
    "computed_session_id",
    "event_timestamp",
    "device_category",
    "utm_source",
    "event_sequence_number",
    "previous_event_type",
    "next_event_type",
    "seconds_to_next_event",
    "cumulative_duration_ms",
    "ingestion_date",
]
TRACKED_USER_COLUMNS = ["user_status", "user_segment", "country", "lifetime_value", "is_active", "is_verified"]
