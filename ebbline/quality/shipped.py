"""The suite and the SQL checks for the events table."""

from __future__ import annotations

from ebbline.model import DEVICE_CATEGORIES, EVENT_TYPES
from ebbline.quality.checks import Check, Severity
from ebbline.quality.suite import Expectation

#: What the events table must hold, and for which share of its rows.
EVENTS_SUITE = [
    *[Expectation("column_exists", c) for c in ("event_id", "event_type", "user_id", "event_timestamp", "revenue", "duration_ms")],
    *[Expectation("not_null", c) for c in ("event_id", "event_type", "event_timestamp", "ingestion_date")],
    Expectation("unique", "event_id"),
    Expectation("between", "revenue", 0.99, {"low": 0, "high": 1_000_000}),
    Expectation("between", "duration_ms", 0.99, {"low": 0, "high": 86_400_000}),
    Expectation("in_set", "event_type", 1.0, {"values": EVENT_TYPES}),
    Expectation("in_set", "device_type", 0.95, {"values": DEVICE_CATEGORIES}),
    Expectation("row_count", None, 1.0, {"low": 100, "high": 100_000_000}),
    Expectation("pair_ge", "event_timestamp", 0.0, {"other": "ingested_at"}),
    Expectation("pair_ge", "ingested_at", 0.95, {"other": "event_timestamp"}),
    Expectation("not_null", "user_id", 0.8),
    Expectation("regex", "event_id", 1.0, {"pattern": r"^[a-zA-Z0-9\-_]{8,64}$"}),
]


def event_checks(now: str = "current_timestamp()") -> list[Check]:
    """Five counts of events that must be zero; ``now`` is an SQL expression of the clock."""
    types = ", ".join(f"'{t}'" for t in EVENT_TYPES)
    counts = [
        ("event_id_not_null", "SELECT count(*) FROM {df} WHERE event_id IS NULL", Severity.CRITICAL),
        ("event_id_unique", "SELECT count(*) FROM (SELECT event_id FROM {df} GROUP BY event_id HAVING count(*) > 1)", Severity.CRITICAL),
        ("revenue_non_negative", "SELECT count(*) FROM {df} WHERE revenue < 0", Severity.CRITICAL),
        ("valid_event_types", f"SELECT count(*) FROM {{df}} WHERE event_type NOT IN ({types})", Severity.WARNING),
        ("timestamp_not_future", f"SELECT count(*) FROM {{df}} WHERE event_timestamp > {now}", Severity.WARNING),
    ]
    return [Check.custom_sql(name, sql, 0, "eq", severity) for name, sql, severity in counts]
