"""Sessions, sequences within them, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbline.functions import seconds_between, session_category, whole_seconds_between
from ebbline.model import EVENT_TYPES


def sessionize(df: DataFrame, gap_minutes: float = 30, user: str = "user_id", ts: str = "event_timestamp", tie: str = "event_id", whole_seconds: bool = False, keep_spread: bool = False) -> DataFrame:
    """Adds ``computed_session_id``: a new session after a gap of more than ``gap_minutes``.

    One exchange by user and one sort serve the lag and the running sum. Events without a
    user form no session (null id) and are spread by their tie column instead of meeting
    in one partition. ``whole_seconds`` compares truncated seconds. ``keep_spread`` leaves
    the column that spreads them, so that what follows needs no exchange of its own.
    """
    df = _spread(df, user, tie)
    w = Window.partitionBy(user, SPREAD).orderBy(ts, tie)
    last = F.lag(ts).over(w)
    gap = whole_seconds_between(last, F.col(ts)) if whole_seconds else seconds_between(last, F.col(ts))
    out = df.withColumn("__new", F.when(last.isNull() | (gap > gap_minutes * 60), 1).otherwise(0))
    out = out.withColumn("__k", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    number = F.when(F.col(user).isNotNull(), F.concat_ws("_", F.col(user).cast("string"), F.col("__k").cast("string")))
    return out.withColumn("computed_session_id", number).drop("__new", "__k", *([] if keep_spread else [SPREAD]))


#: Null for events of a user; else their id. A column and no expression, so that windows share an exchange.
SPREAD = "__spread"


def _spread(df: DataFrame, user: str, tie: str) -> DataFrame:
    return df if SPREAD in df.columns else df.withColumn(SPREAD, F.when(F.col(user).isNull(), F.col(tie).cast("string")))


def sequence_events(df: DataFrame, user: str = "user_id", ts: str = "event_timestamp", tie: str = "event_id", session: str = "computed_session_id") -> DataFrame:
    """Position, neighbours, seconds to the next event and running duration within the session.

    An event without a user stands alone. After ``sessionize(keep_spread=True)`` the rows
    already lie as asked for here.
    """
    kept, df = SPREAD in df.columns, _spread(df, user, tie)
    w = Window.partitionBy(user, SPREAD, session).orderBy(ts, tie)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns(
        {
            "event_sequence_number": F.row_number().over(w),
            "event_rank": F.dense_rank().over(Window.partitionBy(user, SPREAD, session).orderBy(ts)),
            "previous_event_type": F.lag("event_type").over(w),
            "next_event_type": F.lead("event_type").over(w),
            "seconds_to_next_event": whole_seconds_between(F.col(ts), F.lead(ts).over(w)),
            "cumulative_duration_ms": F.sum("duration_ms").over(upto),
        }
    )
    return out if kept else out.drop(SPREAD)


def user_neighbours(df: DataFrame, user: str = "user_id", ts: str = "event_timestamp", tie: str = "event_id") -> DataFrame:
    """Neighbours per user, across sessions; anonymous events have none."""
    kept, df = SPREAD in df.columns, _spread(df, user, tie)
    w = Window.partitionBy(user, SPREAD).orderBy(ts, tie)
    out = df.withColumns(
        {
            "user_prev_event_type": F.lag("event_type").over(w),
            "user_next_event_type": F.lead("event_type").over(w),
            "seconds_since_prev": seconds_between(F.lag(ts).over(w), F.col(ts)),
        }
    )
    return out if kept else out.drop(SPREAD)


def session_aggregates(df: DataFrame, user: str = "user_id", ts: str = "event_timestamp", session: str = "computed_session_id", extra: dict[str, Column] | None = None) -> DataFrame:
    """One row per session; first and last values are those of the earliest and latest event."""
    out = df.groupBy(user, session).agg(
        F.count("*").alias("event_count"),
        F.min(ts).alias("session_start"),
        F.max(ts).alias("session_end"),
        F.sum("duration_ms").alias("total_duration_ms"),
        F.sum("revenue").alias("total_revenue"),
        F.count_distinct("event_type").alias("distinct_event_types"),
        F.bool_or("is_conversion").alias("has_conversion"),
        F.min_by("event_type", F.struct(ts, "event_id")).alias("first_event_type"),
        F.max_by("event_type", F.struct(ts, "event_id")).alias("last_event_type"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    return out.withColumn("session_seconds", whole_seconds_between("session_start", "session_end"))


def categorize_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.withColumn("session_category", session_category("event_count", seconds_between("session_start", "session_end")))


def session_ends(df: DataFrame, user: str = "user_id", ts: str = "event_timestamp", session: str = "computed_session_id") -> DataFrame:
    """First and last event type of the session on every row (full frame); an event without a user is its own."""
    kept, df = SPREAD in df.columns, _spread(df, user, "event_id")
    w = Window.partitionBy(user, SPREAD, session).orderBy(ts, "event_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = df.withColumns({"session_first_event": F.first("event_type").over(w), "session_last_event": F.last("event_type").over(w)})
    return out if kept else out.drop(SPREAD)


def session_counts(df: DataFrame, user: str = "user_id", session: str = "computed_session_id", tie: str = "event_id") -> DataFrame:
    """Adds ``session_event_count`` on the rows' own exchange; null for events without a session."""
    kept, df = SPREAD in df.columns, _spread(df, user, tie)
    n = F.count("*").over(Window.partitionBy(user, SPREAD, session))
    out = df.withColumn("session_event_count", F.when(F.col(session).isNotNull(), n))
    return out if kept else out.drop(SPREAD)


def pivot_event_counts(df: DataFrame, user: str = "user_id", day: Column | None = None, values: list[str] = EVENT_TYPES) -> DataFrame:
    """Event counts per user and day, a column per type; zero where there are none.

    ``count_if`` per value is one partial aggregate, where pivot would make two.
    """
    day = F.to_date("event_timestamp") if day is None else day
    return df.groupBy(user, day.alias("event_date")).agg(*[F.count_if(F.col("event_type") == v).alias(v) for v in values])


def attach_sessions(events: DataFrame, sessions: DataFrame, user: str = "user_id", ts: str = "event_timestamp", extra: tuple[str, ...] = ()) -> DataFrame:
    """The session whose span holds the event, by user and range, with columns ``extra`` of it; null without one."""
    s = sessions.select(F.col(user).alias("__u"), "computed_session_id", "session_start", "session_end", *extra)
    on = (F.col(user) == F.col("__u")) & F.col(ts).between(F.col("session_start"), F.col("session_end"))
    return events.join(s, on, "left").drop("__u")


def tumbling_counts(df: DataFrame, ts: str, duration: str, keys: list[str], slide: str | None = None, aggs: list[Column] | None = None) -> DataFrame:
    """Windowed aggregates; with ``slide`` an event counts in each window that holds it."""
    win = F.window(ts, duration, slide) if slide else F.window(ts, duration)
    out = df.groupBy(win.alias("w"), *keys).agg(*(aggs or [F.count("*").alias("event_count")]))
    return out.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")


def batch_session_windows(df: DataFrame, ts: str, gap: str, keys: list[str], aggs: list[Column] | None = None) -> DataFrame:
    out = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), *(aggs or [F.count("*").alias("event_count")]))
    return out.withColumns({"window_start": F.col("w.start"), "window_end": F.col("w.end")}).drop("w")
