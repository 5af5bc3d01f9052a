"""Registered queries over the driver tables, and the SQL that each must agree with.

``events_model`` maps the driver's events to the event model; ``EV`` says the same in SQL.
All queries run over whole tables; clocks are literals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline import operators as ops
from ebbline.functions import (
    anonymise_ip,
    device_category,
    device_from_user_agent,
    pii_hash,
    row_hash,
    seconds_between,
    session_category,
    surrogate_key,
    utm_source,
    valid_email,
)
from ebbline.model import EVENT_TYPES, TRACKED_USER_COLUMNS
from ebbline.plans.staging import dim_users_model, stage_events_model, stage_users_model
from ebbline.quality import Check, DataQualityRunner, Expectation, generic, run_suite
from ebbline.quality.shipped import EVENTS_SUITE, event_checks
from ebbline.streaming import dead_letters, parse_envelope, session_metrics, start_sink, state_on_disk, valid_events, windowed_metrics
from ebbline.tables import SnapshotTable, checksum, merge_counts, merge_frame, scd2_frame, upsert
from ebbline.tables.maintenance import retained

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
AS_OF = "2024-02-01"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# -- inputs -------------------------------------------------------------------------
def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(_read(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    """The driver's events as the event model; projections only, so streams will do."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    bucket = lambda values, n: F.get(F.array(*[F.lit(v) for v in values]), (F.pmod(k, F.lit(n))).cast("int"))
    purchase = F.col("event_type") == "purchase"
    return e.select(
        "event_id",
        "user_id",
        F.when(F.col("event_type") == "view", "page_view").otherwise(F.col("event_type")).alias("event_type"),
        F.col("ts").alias("event_timestamp"),
        F.when(purchase, F.col("value").cast("decimal(18,4)")).otherwise(F.lit(0).cast("decimal(18,4)")).alias("revenue"),
        purchase.alias("is_conversion"),
        F.round(F.col("value") * 100).cast("bigint").alias("duration_ms"),
        F.to_date("ts").alias("ingestion_date"),
        (F.col("ts") + F.expr("interval 5 minutes")).alias("ingested_at"),
        F.col("props").alias("properties"),
        bucket(["Mobile", "ipad", "Laptop", "console", "bot", "watch", None], 7).alias("device_type"),
        bucket(["iOS", "Android", "Windows", "Bot", None], 5).alias("os"),
        bucket(["US", "GB", "DE", "FR", "JP"], 5).alias("country"),
    )


EV = """ev AS (
  SELECT event_id, user_id, CASE WHEN event_type = 'view' THEN 'page_view' ELSE event_type END AS event_type,
         ts AS event_timestamp,
         CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,4)) ELSE CAST(0 AS DECIMAL(18,4)) END AS revenue,
         event_type = 'purchase' AS is_conversion, CAST(round(value * 100) AS BIGINT) AS duration_ms,
         CAST(ts AS DATE) AS ingestion_date, ts + INTERVAL 5 MINUTE AS ingested_at, props AS properties,
         CASE CAST(props->>'$.k' AS BIGINT) % 7 WHEN 0 THEN 'Mobile' WHEN 1 THEN 'ipad' WHEN 2 THEN 'Laptop' WHEN 3 THEN 'console' WHEN 4 THEN 'bot' WHEN 5 THEN 'watch' END AS device_type,
         CASE CAST(props->>'$.k' AS BIGINT) % 5 WHEN 0 THEN 'iOS' WHEN 1 THEN 'Android' WHEN 2 THEN 'Windows' WHEN 3 THEN 'Bot' END AS os,
         CASE CAST(props->>'$.k' AS BIGINT) % 5 WHEN 0 THEN 'US' WHEN 1 THEN 'GB' WHEN 2 THEN 'DE' WHEN 3 THEN 'FR' WHEN 4 THEN 'JP' END AS country
  FROM events)"""


def sessions_cte(minutes: int, whole: bool = False) -> str:
    gap = "epoch(date_trunc('second', event_timestamp)) - epoch(date_trunc('second', lag(event_timestamp) OVER w))" if whole else "epoch(event_timestamp) - epoch(lag(event_timestamp) OVER w)"
    return f"""{EV}, gaps AS (
  SELECT *, {gap} AS gap, lag(event_timestamp) OVER w AS last_ts FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_timestamp, event_id)
), se AS (
  SELECT * EXCLUDE (gap, last_ts), CAST(user_id AS VARCHAR) || '_' || CAST(sum(CASE WHEN last_ts IS NULL OR gap > {minutes * 60} THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY event_timestamp, event_id ROWS UNBOUNDED PRECEDING) AS VARCHAR) AS computed_session_id
  FROM gaps)"""


def users_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _read(spark, sf_dir, "customer")
    o = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("first_order"), F.count("*").alias("orders"), F.max("o_orderdate").alias("last_order"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("user_segment"),
        F.to_date("first_order").alias("signup_date"),
        F.col("c_acctbal").cast("decimal(18,4)").alias("lifetime_value"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        "c_name",
        "c_nationkey",
        F.col("orders"),
        "first_order",
        "last_order",
    )


US = """us AS (
  SELECT c_custkey AS user_id, c_mktsegment AS user_segment, CAST(first_order AS DATE) AS signup_date, CAST(c_acctbal AS DECIMAL(18,4)) AS lifetime_value,
         c_acctbal > 0 AS is_active, c_name, c_nationkey, orders, first_order, last_order
  FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderdate) AS first_order, count(*) AS orders, max(o_orderdate) AS last_order FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


# -- sessions ---------------------------------------------------------------------------
def _sessions(spark, sf_dir, minutes=30, **options) -> DataFrame:
    return ops.sessionize(events_model(spark, sf_dir), minutes, **options)


def _session_queries() -> None:
    for minutes in (30, 240, 1440):
        query(f"sessionize_ids_{minutes}m", f"WITH {sessions_cte(minutes)} SELECT event_id, computed_session_id FROM se")(
            lambda s, d, m=minutes: _sessions(s, d, m).select("event_id", "computed_session_id")
        )


_session_queries()


@query("sessionize_whole_seconds", f"WITH {sessions_cte(30, True)} SELECT event_id, computed_session_id FROM se")
def _(spark, sf_dir):
    return _sessions(spark, sf_dir, whole_seconds=True).select("event_id", "computed_session_id")


_AGG = """ag AS (
  SELECT user_id, computed_session_id, count(*) AS event_count, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end,
         CAST(sum(duration_ms) AS BIGINT) AS total_duration_ms, CAST(sum(revenue) AS DECIMAL(28,4)) AS total_revenue, count(DISTINCT event_type) AS distinct_event_types,
         bool_or(is_conversion) AS has_conversion, arg_min(event_type, (event_timestamp, event_id)) AS first_event_type, arg_max(event_type, (event_timestamp, event_id)) AS last_event_type
  FROM se GROUP BY 1, 2)"""


@query(
    "session_aggregates",
    f"WITH {sessions_cte(1440)}, {_AGG} SELECT *, CAST(epoch(date_trunc('second', session_end)) - epoch(date_trunc('second', session_start)) AS BIGINT) AS session_seconds FROM ag",
)
def _(spark, sf_dir):
    return ops.session_aggregates(_sessions(spark, sf_dir, 1440))


_CATEGORY = "CASE WHEN event_count = 1 THEN 'bounce' WHEN secs < 30 THEN 'short' WHEN secs < 300 THEN 'medium' WHEN secs < 1800 THEN 'long' ELSE 'very_long' END"


@query(
    "session_categories",
    f"WITH {sessions_cte(240)}, {_AGG} SELECT user_id, computed_session_id, event_count, {_CATEGORY} AS session_category FROM (SELECT *, epoch(session_end) - epoch(session_start) AS secs FROM ag)",
)
def _(spark, sf_dir):
    out = ops.categorize_sessions(ops.session_aggregates(_sessions(spark, sf_dir, 240)))
    return out.select("user_id", "computed_session_id", "event_count", "session_category")


@query(
    "event_sequence",
    f"""WITH {sessions_cte(1440)} SELECT event_id, computed_session_id,
  CAST(row_number() OVER w AS INTEGER) AS event_sequence_number, CAST(dense_rank() OVER (PARTITION BY user_id, computed_session_id ORDER BY event_timestamp) AS INTEGER) AS event_rank,
  lag(event_type) OVER w AS previous_event_type, lead(event_type) OVER w AS next_event_type,
  CAST(epoch(date_trunc('second', lead(event_timestamp) OVER w)) - epoch(date_trunc('second', event_timestamp)) AS BIGINT) AS seconds_to_next_event,
  CAST(sum(duration_ms) OVER (PARTITION BY user_id, computed_session_id ORDER BY event_timestamp, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_duration_ms
  FROM se WINDOW w AS (PARTITION BY user_id, computed_session_id ORDER BY event_timestamp, event_id)""",
)
def _(spark, sf_dir):
    out = ops.sequence_events(_sessions(spark, sf_dir, 1440))
    return out.select("event_id", "computed_session_id", "event_sequence_number", "event_rank", "previous_event_type", "next_event_type", "seconds_to_next_event", "cumulative_duration_ms")


@query(
    "user_prev_next",
    f"""WITH {EV} SELECT event_id, lag(event_type) OVER w AS user_prev_event_type, lead(event_type) OVER w AS user_next_event_type,
  (epoch_us(event_timestamp) - epoch_us(lag(event_timestamp) OVER w)) / 1000000.0::DOUBLE AS seconds_since_prev
  FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY event_timestamp, event_id)""",
)
def _(spark, sf_dir):
    return ops.user_neighbours(events_model(spark, sf_dir)).select("event_id", "user_prev_event_type", "user_next_event_type", "seconds_since_prev")


@query(
    "session_first_last",
    f"""WITH {sessions_cte(1440)} SELECT event_id, first_value(event_type) OVER w AS session_first_event, last_value(event_type) OVER w AS session_last_event
  FROM se WINDOW w AS (PARTITION BY user_id, computed_session_id ORDER BY event_timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
)
def _(spark, sf_dir):
    return ops.session_ends(_sessions(spark, sf_dir, 1440)).select("event_id", "session_first_event", "session_last_event")


@query(
    "event_type_pivot",
    f"WITH {EV} SELECT user_id, CAST(event_timestamp AS DATE) AS event_date, "
    + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in EVENT_TYPES)
    + " FROM ev GROUP BY 1, 2",
)
def _(spark, sf_dir):
    return ops.pivot_event_counts(events_model(spark, sf_dir))


@query(
    "range_join_sessions",
    f"""WITH {sessions_cte(1440)}, {_AGG} SELECT e.event_id, a.computed_session_id AS session_id, a.event_count
  FROM ev e LEFT JOIN ag a ON e.user_id = a.user_id AND e.event_timestamp BETWEEN a.session_start AND a.session_end""",
)
def _(spark, sf_dir):
    events = events_model(spark, sf_dir)
    sessions = ops.session_aggregates(ops.sessionize(events, 1440)).select("user_id", "computed_session_id", "session_start", "session_end", "event_count")
    joined = ops.attach_sessions(events, sessions, extra=("event_count",))
    return joined.select("event_id", F.col("computed_session_id").alias("session_id"), "event_count")


# -- windows in batch form ------------------------------------------------------------------
_WINAGG = "count(*) AS event_count, CAST(sum(revenue) AS DECIMAL(28,4)) AS total_revenue, count(*) FILTER (is_conversion) AS conversion_count"


def _winaggs():
    return [F.count("*").alias("event_count"), F.sum("revenue").alias("total_revenue"), F.count_if("is_conversion").alias("conversion_count")]


@query("tumbling_5m", f"WITH {EV} SELECT event_type, time_bucket(INTERVAL 5 MINUTE, event_timestamp, TIMESTAMP '1970-01-01') AS window_start, {_WINAGG} FROM ev GROUP BY 1, 2")
def _(spark, sf_dir):
    return ops.tumbling_counts(events_model(spark, sf_dir), "event_timestamp", "5 minutes", ["event_type"], aggs=_winaggs()).drop("window_end")


@query(
    "sliding_5m_1m",
    f"""WITH {EV} SELECT event_type, time_bucket(INTERVAL 1 MINUTE, event_timestamp, TIMESTAMP '1970-01-01') - to_minutes(CAST(k AS INTEGER)) AS window_start, {_WINAGG}
  FROM ev, range(5) r(k) GROUP BY 1, 2""",
)
def _(spark, sf_dir):
    return ops.tumbling_counts(events_model(spark, sf_dir), "event_timestamp", "5 minutes", ["event_type"], "1 minute", _winaggs()).drop("window_end")


@query(
    "session_window_30m",
    f"""WITH {sessions_cte(30)} SELECT user_id, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end, max(event_timestamp) + INTERVAL 30 MINUTE AS window_end, {_WINAGG}
  FROM se GROUP BY user_id, computed_session_id""",
)
def _(spark, sf_dir):
    return ops.batch_session_windows(events_model(spark, sf_dir), "event_timestamp", "30 minutes", ["user_id"], _winaggs()).drop("window_start")


def _stream(spark, sf_dir) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a pattern, as a stream takes a single file only through one
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]")
    return as_events(raw).withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))  # watermarks need a zone


def _drained(df: DataFrame, mode: str, name: str) -> DataFrame:
    """All that a stream has to say now; what it appends goes to files, as it may be as much as its events.

    Only a complete result, which is small (windows, not events), stays in the driver.
    """
    import uuid

    spark, table = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    if mode == "append":
        root = _stored(spark, name)
        start_sink(df, f"{root}/rows", f"{root}/checkpoint", trigger="availableNow").awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{root}/rows")
    with state_on_disk(spark):
        query_ = df.writeStream.format("memory").queryName(table).outputMode(mode).trigger(availableNow=True).start()
    query_.awaitTermination()
    return spark.table(table)


@query("stream_tumbling_5m", f"WITH {EV} SELECT event_type, time_bucket(INTERVAL 5 MINUTE, event_timestamp, TIMESTAMP '1970-01-01') AS window_start, count(event_id) AS event_count, CAST(sum(revenue) AS DECIMAL(28,4)) AS total_revenue, count(*) FILTER (is_conversion) AS conversion_count FROM ev GROUP BY 1, 2")
def _(spark, sf_dir):
    out = _drained(windowed_metrics(_stream(spark, sf_dir), slide=None), "complete", "tumbling")
    return out.select("event_type", F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_count", "total_revenue", "conversion_count")


@query(
    "stream_closed_sessions",
    f"""WITH {sessions_cte(30)}, c AS (SELECT user_id, count(event_id) AS session_events, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end FROM se GROUP BY user_id, computed_session_id)
  SELECT * FROM c WHERE session_end + INTERVAL 30 MINUTE <= (SELECT max(event_timestamp) - INTERVAL 30 MINUTE FROM ev)""",
)
def _(spark, sf_dir):
    """Append mode emits the sessions that the watermark has passed."""
    out = _drained(session_metrics(_stream(spark, sf_dir)), "append", "sessions")
    return out.select("user_id", "session_events", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")])


# -- enrichment and scalar functions ------------------------------------------------------------
@query(
    "enrich_users",
    f"""WITH {EV}, {US} SELECT e.event_id, e.user_id, u.user_segment, u.signup_date AS user_signup_date, u.lifetime_value AS user_ltv, u.is_active AS user_is_active,
  CAST(date_diff('day', u.signup_date, CAST(e.event_timestamp AS DATE)) AS INTEGER) AS days_since_signup FROM ev e LEFT JOIN us u ON u.user_id = e.user_id""",
)
def _(spark, sf_dir):
    out = ops.enrich_users(events_model(spark, sf_dir), users_model(spark, sf_dir))
    return out.select("event_id", "user_id", "user_segment", "user_signup_date", "user_ltv", "user_is_active", "days_since_signup")


@query("enrich_geo", "SELECT c_custkey, n_name AS country, r_name AS region FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def _(spark, sf_dir):
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    geo = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    c = _read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.col("n_name").alias("country"))
    return ops.enrich_geo(c, geo).select("c_custkey", "country", "region")


@query(
    "device_category",
    f"""WITH {EV} SELECT event_id, CASE WHEN device_type IS NULL THEN 'unknown' WHEN lower(device_type) IN ('mobile','phone','smartphone') THEN 'mobile'
  WHEN lower(device_type) IN ('tablet','ipad') THEN 'tablet' WHEN lower(device_type) IN ('desktop','laptop','pc') THEN 'desktop' WHEN lower(device_type) IN ('tv','smart_tv','console') THEN 'smart_tv'
  WHEN lower(device_type) = 'bot' OR coalesce(lower(os), '') = 'bot' THEN 'bot' ELSE 'other' END AS device_category FROM ev""",
)
def _(spark, sf_dir):
    return events_model(spark, sf_dir).select("event_id", device_category("device_type", "os").alias("device_category"))


@query(
    "device_from_user_agent",
    f"""WITH {EV} SELECT event_id, CASE WHEN os IS NULL THEN 'unknown' WHEN 'Mozilla/5.0 (' || replace(os, 'iOS', 'iPhone') || ')' SIMILAR TO '.*(iPhone|Android).*' THEN 'mobile' ELSE 'desktop' END AS device FROM ev""",
)
def _(spark, sf_dir):
    agent = F.concat(F.lit("Mozilla/5.0 ("), F.replace(F.col("os"), F.lit("iOS"), F.lit("iPhone")), F.lit(")"))
    return events_model(spark, sf_dir).select("event_id", device_from_user_agent(agent).alias("device"))


@query(
    "utm_source",
    """SELECT page_id, nullif(url_decode(replace(regexp_extract(regexp_extract(url, '^[^#?]*\\?([^#]*)', 1), '(?:^|&)utm_source=([^&]+)', 1), '+', '%20')), '') AS utm_source FROM pages""",
)
def _(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", utm_source("url").alias("utm_source"))


@query(
    "pii_hash",
    "SELECT c_custkey, sha256(c_name) AS name_hash, sha256(c_name || 'pepper') AS salted_hash, substring(sha256(c_name), 1, 16) AS short_hash, md5(CAST(c_custkey AS VARCHAR) || '-' || coalesce(c_mktsegment, '_dbt_utils_surrogate_key_null_')) AS sk FROM customer",
)
def _(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select(
        "c_custkey", pii_hash("c_name").alias("name_hash"), pii_hash("c_name", "pepper").alias("salted_hash"), anonymise_ip("c_name").alias("short_hash"), surrogate_key(["c_custkey", "c_mktsegment"]).alias("sk")
    )


@query("json_props", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def _(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query(
    "time_functions",
    f"""WITH {EV} SELECT event_id, CAST(extract(hour FROM event_timestamp) AS INTEGER) AS event_hour, CAST(extract(dow FROM event_timestamp) AS INTEGER) AS event_dow,
  CAST(date_diff('day', CAST(event_timestamp AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_ago, CAST(extract(day FROM (TIMESTAMP '{AS_OF}' - event_timestamp)) AS INTEGER) AS whole_days,
  event_timestamp > TIMESTAMP '2024-01-15' AS in_future, CAST(event_timestamp AS DATE) - 30 AS window_from FROM ev""",
)
def _(spark, sf_dir):
    at = F.lit(AS_OF).cast("timestamp_ntz")
    t = F.col("event_timestamp")
    return events_model(spark, sf_dir).select(
        "event_id",
        F.hour(t).alias("event_hour"),
        (F.dayofweek(t) - 1).alias("event_dow"),
        F.datediff(F.lit(AS_OF).cast("date"), t).alias("days_ago"),
        F.extract(F.lit("DAY"), at - t).alias("whole_days"),
        (t > F.lit("2024-01-15").cast("timestamp_ntz")).alias("in_future"),
        F.date_sub(F.to_date(t), 30).alias("window_from"),
    )


# -- staging and marts ------------------------------------------------------------------------------
def raw_events(spark, sf_dir) -> DataFrame:
    """The events and a later second delivery of every tenth."""
    e = events_model(spark, sf_dir).withColumns({"session_id": F.lit(None).cast("string"), "page_url": F.lit(None).cast("string"), "referrer_url": F.lit(None).cast("string"), "browser": F.lit(None).cast("string"), "city": F.lit(None).cast("string")})
    again = e.where("event_id % 10 = 0").withColumns({"ingested_at": F.col("ingested_at") + F.expr("interval 1 hour"), "duration_ms": F.col("duration_ms") + 1})
    return e.unionByName(again)


RAW = f"""{EV}, raw AS (
  SELECT * FROM ev UNION ALL SELECT * REPLACE (ingested_at + INTERVAL 1 HOUR AS ingested_at, duration_ms + 1 AS duration_ms) FROM ev WHERE event_id % 10 = 0)"""


@query("dedup_latest", f"WITH {RAW} SELECT event_id, duration_ms, ingested_at FROM raw QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC) = 1")
def _(spark, sf_dir):
    return ops.deduplicate(raw_events(spark, sf_dir), ["event_id"], ["ingested_at"]).select("event_id", "duration_ms", "ingested_at")


@query("dedup_earliest", f"WITH {RAW} SELECT event_id, duration_ms, ingested_at FROM raw QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at) = 1")
def _(spark, sf_dir):
    return ops.deduplicate(raw_events(spark, sf_dir), ["event_id"], ["ingested_at"], "earliest").select("event_id", "duration_ms", "ingested_at")


@query(
    "stg_events",
    f"""WITH {RAW} SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, coalesce(CAST(user_id AS VARCHAR), 'anonymous') AS user_id, event_timestamp, CAST(event_timestamp AS DATE) AS event_date,
  CAST(extract(hour FROM event_timestamp) AS INTEGER) AS event_hour, CAST(extract(dow FROM event_timestamp) AS INTEGER) AS event_day_of_week, lower(coalesce(device_type, 'unknown')) AS device_type,
  lower(coalesce(os, 'unknown')) AS os, 'unknown' AS browser, country, 'unknown' AS city, duration_ms, revenue, is_conversion, properties AS properties_json, ingested_at, ingestion_date
  FROM raw QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ingested_at DESC) = 1""",
)
def _(spark, sf_dir):
    return stage_events_model(raw_events(spark, sf_dir)).drop("session_id", "page_url", "referrer_url")


def raw_users(spark, sf_dir) -> DataFrame:
    u = users_model(spark, sf_dir)
    code = F.get(F.array(*[F.lit(x) for x in ("A", "I", "S", "D", "P", "X", None)]), (F.col("user_id") % 7).cast("int"))
    return u.select(
        "user_id",
        F.col("c_name").alias("username"),
        F.lit(None).cast("string").alias("first_name"),
        F.lit(None).cast("string").alias("last_name"),
        F.concat(F.col("c_name"), F.lit("@example.com")).alias("email"),
        F.lit(None).cast("string").alias("phone"),
        code.alias("status"),
        "user_segment",
        F.lit(None).cast("string").alias("country"),
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("string").alias("timezone"),
        (F.col("user_id") % 2 == 0).alias("is_verified"),
        "lifetime_value",
        F.col("orders").alias("total_orders"),
        F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("updated_at"),
        F.col("last_order").cast("timestamp_ntz").alias("last_login_at"),
        "is_active",
    )


STGU = f"""{US}, su AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, coalesce(c_name, 'unknown') AS username, sha256(c_name || '@example.com' || 'salt') AS email_hash,
  CASE user_id % 7 WHEN 0 THEN 'active' WHEN 1 THEN 'inactive' WHEN 2 THEN 'suspended' WHEN 3 THEN 'deleted' WHEN 4 THEN 'pending' WHEN 5 THEN 'x' ELSE 'unknown' END AS user_status,
  coalesce(user_segment, 'unassigned') AS user_segment, 'unknown' AS country, 'en' AS preferred_language, 'UTC' AS user_timezone, user_id % 2 = 0 AS is_verified, lifetime_value,
  CAST(coalesce(orders, 0) AS INTEGER) AS total_orders, TIMESTAMP '2020-01-01' AS created_at, TIMESTAMP '2024-01-01' AS updated_at, CAST(last_order AS TIMESTAMP) AS last_login_at,
  CAST(extract(day FROM (TIMESTAMP '{AS_OF}' - CAST(last_order AS TIMESTAMP))) AS INTEGER) AS days_since_last_login, coalesce(is_active, true) AS is_active FROM us)"""


def _staged_users(spark, sf_dir):
    return stage_users_model(raw_users(spark, sf_dir), F.lit(AS_OF).cast("timestamp_ntz"), "salt").drop("first_name", "last_name", "phone_hash")


@query("stg_users", f"WITH {STGU} SELECT * FROM su")
def _(spark, sf_dir):
    return _staged_users(spark, sf_dir)


_TRACKED_SQL = " || '-' || ".join(f"CAST({c} AS VARCHAR)" for c in TRACKED_USER_COLUMNS)


@query(
    "dim_users_initial",
    f"""WITH {STGU}, h AS (SELECT *, md5({_TRACKED_SQL}) AS _row_hash FROM su)
  SELECT user_id, _row_hash, md5(user_id || '-' || _row_hash || '-' || strftime(updated_at, '%Y-%m-%d %H:%M:%S')) AS user_sk, created_at AS valid_from, true AS is_current FROM h""",
)
def _(spark, sf_dir):
    return dim_users_model(_staged_users(spark, sf_dir)).select("user_id", "_row_hash", "user_sk", "valid_from", "is_current")


@query(
    "fct_events",
    f"""WITH {STGU}, {sessions_cte(1440)}, {_AGG}, d AS (SELECT user_id, md5(user_id || '-first') AS user_sk FROM su WHERE CAST(user_id AS BIGINT) % 3 <> 0)
  SELECT se.event_id, md5(CAST(se.event_id AS VARCHAR)) AS event_sk, coalesce(d.user_sk, md5('unknown')) AS user_sk, se.computed_session_id, ag.event_count AS session_event_count,
  CAST(row_number() OVER (PARTITION BY se.user_id, se.computed_session_id ORDER BY se.event_timestamp, se.event_id) AS INTEGER) AS event_sequence_number,
  lag(se.event_type) OVER w AS user_prev_event_type, lead(se.event_type) OVER w AS user_next_event_type, se.revenue
  FROM se LEFT JOIN ag ON ag.computed_session_id = se.computed_session_id LEFT JOIN d ON CAST(d.user_id AS BIGINT) = se.user_id WINDOW w AS (PARTITION BY se.user_id ORDER BY se.event_timestamp, se.event_id)""",
)
def _(spark, sf_dir):
    dim = _staged_users(spark, sf_dir).select(F.col("user_id").cast("bigint").alias("user_id")).where("user_id % 3 <> 0")
    dim = dim.withColumns({"user_sk": F.md5(F.concat(F.col("user_id").cast("string"), F.lit("-first"))), "is_current": F.lit(True)})
    rows = ops.sessionize(events_model(spark, sf_dir), 1440, keep_spread=True)
    out = ops.fact_events(ops.user_neighbours(ops.session_counts(ops.sequence_events(rows))), dim)
    return out.select("event_id", "event_sk", "user_sk", "computed_session_id", "session_event_count", "event_sequence_number", "user_prev_event_type", "user_next_event_type", "revenue")


@query("incremental_hwm", f"WITH {RAW} SELECT event_id, ingested_at FROM raw WHERE ingested_at > (SELECT coalesce(max(ingested_at), TIMESTAMP '1900-01-01') FROM ev WHERE event_id % 3 = 0)")
def _(spark, sf_dir):
    done = events_model(spark, sf_dir).where("event_id % 3 = 0").select(F.col("ingested_at").cast("timestamp").alias("ingested_at"))
    new = raw_events(spark, sf_dir).withColumn("ingested_at", F.col("ingested_at").cast("timestamp"))
    return ops.above_high_water_mark(new, done, "ingested_at").select("event_id", F.col("ingested_at").cast("timestamp_ntz").alias("ingested_at"))


# -- tables ---------------------------------------------------------------------------------------
def _dim(spark, sf_dir):
    return users_model(spark, sf_dir).select(F.col("user_id"), "user_segment", F.col("lifetime_value"), "is_active")


def _dim_update(spark, sf_dir):
    """Every fifth user with another segment, every seventh as it is, and new users."""
    d = _dim(spark, sf_dir)
    changed = d.where("user_id % 5 = 0").withColumn("user_segment", F.lit("MOVED"))
    same = d.where("user_id % 5 <> 0 and user_id % 7 = 0")
    new = d.where("user_id % 11 = 0").withColumn("user_id", F.col("user_id") + 10_000_000)
    return changed.unionByName(same).unionByName(new)


DIM = f"""{US}, d AS (SELECT user_id, user_segment, lifetime_value, is_active FROM us), s AS (
  SELECT * REPLACE ('MOVED' AS user_segment) FROM d WHERE user_id % 5 = 0 UNION ALL SELECT * FROM d WHERE user_id % 5 <> 0 AND user_id % 7 = 0
  UNION ALL SELECT * REPLACE (user_id + 10000000 AS user_id) FROM d WHERE user_id % 11 = 0)"""
_TRACK = ["user_segment", "lifetime_value", "is_active"]


@query("upsert_merge", f"WITH {DIM} SELECT * FROM d WHERE user_id NOT IN (SELECT user_id FROM s) UNION ALL SELECT * FROM s")
def _(spark, sf_dir):
    return merge_frame(_dim(spark, sf_dir), _dim_update(spark, sf_dir), ["user_id"])


_MOVED = "CASE WHEN user_id % 3 = 0 THEN NULL WHEN user_id % 3 = 1 THEN 'a/b' ELSE 'c' END"
_PARTS = f"""{DIM}, t0 AS (SELECT user_id, user_segment, lifetime_value, is_active, {_MOVED} AS zone FROM d),
  t1 AS (SELECT user_id, user_segment, lifetime_value, is_active, CASE WHEN user_id % 2 = 0 THEN 'c' END AS zone FROM s)"""


def _stored(spark, name: str) -> str:
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints/ebbline"
    return f"{root.rstrip('/')}/ebbline-{name}-{uuid.uuid4().hex}"


def _upserted(spark, sf_dir, parts: list[str]) -> SnapshotTable:
    """The dimension stored by ``parts`` and merged with its update, whose rows move between partitions."""
    zone = F.when(F.col("user_id") % 3 == 0, F.lit(None)).when(F.col("user_id") % 3 == 1, "a/b").otherwise("c")
    path = _stored(spark, "upsert")
    upsert(spark, _dim(spark, sf_dir).withColumn("zone", zone), path, ["user_id"], parts)
    upsert(spark, _dim_update(spark, sf_dir).withColumn("zone", F.when(F.col("user_id") % 2 == 0, "c")), path, ["user_id"], parts)
    return SnapshotTable(spark, path, parts)


for _name, _columns in (("upsert_table", []), ("upsert_partitioned", ["zone"]), ("upsert_two_partitions", ["zone", "user_segment"])):
    query(_name, f"WITH {_PARTS} SELECT * FROM t0 WHERE user_id NOT IN (SELECT user_id FROM t1) UNION ALL SELECT * FROM t1")(
        lambda spark, sf_dir, c=_columns: _upserted(spark, sf_dir, c).read().select("user_id", "user_segment", "lifetime_value", "is_active", "zone")
    )


@query("snapshot_versions", f"WITH {_PARTS} SELECT 1 AS version, count(*) AS n FROM t0 UNION ALL SELECT 2, (SELECT count(*) FROM t0 WHERE user_id NOT IN (SELECT user_id FROM t1)) + (SELECT count(*) FROM t1)")
def _(spark, sf_dir):
    """Both versions of a merged table can be read, and there are no others."""
    table = _upserted(spark, sf_dir, ["zone"])
    frames = [table.read(v).agg(F.lit(v).alias("version"), F.count("*").alias("n")) for v in table.versions()]
    return frames[0].unionByName(frames[1]) if len(frames) == 2 else frames[0].limit(0)


@query("written_by_date", f"WITH {EV} SELECT event_id, event_type FROM ev WHERE CAST(event_timestamp AS DATE) = DATE '2024-01-10'")
def _(spark, sf_dir):
    """Events written by date and read back for one day: a partition filter, no scan of the rest."""
    path = _stored(spark, "by-date")
    events_model(spark, sf_dir).select("event_id", "event_type", F.to_date("event_timestamp").alias("day")).hint("rebalance", "day").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path).where("day = date'2024-01-10'").select("event_id", "event_type")


@query(
    "identified_sessions",
    f"WITH {EV} SELECT CAST(event_id AS VARCHAR) AS event_id FROM ev WHERE event_id % 4 <> 0",
)
def _(spark, sf_dir):
    """Every fourth event lacks its user; staging calls it anonymous, and it forms no session."""
    raw = events_model(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 4 != 0, F.col("user_id").cast("string")))
    named = raw.select(F.col("event_id").cast("string").alias("event_id"), F.coalesce("user_id", F.lit("anonymous")).alias("user_id"), "event_timestamp")
    return ops.sessionize(ops.identified(named)).where("computed_session_id is not null").select("event_id")


@query("parsed_messages", "SELECT event_id AS kafka_offset, CASE WHEN event_id % 5 = 0 THEN 'parse_error' END AS error_type, CASE WHEN event_id % 5 <> 0 THEN CAST(event_id AS VARCHAR) END AS event_id FROM events")
def _(spark, sf_dir):
    """Messages of which every fifth is broken: events and dead letters."""
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type"))
    value = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).when(F.col("event_id") % 5 == 0, F.lit('{"event_type": "click"}')).otherwise(body)
    envelopes = _read(spark, sf_dir, "events").select(F.lit(None).cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit("events").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.current_timestamp().alias("timestamp"), F.lit(0).alias("timestampType"))
    parsed = parse_envelope(envelopes)
    good = valid_events(parsed).select("kafka_offset", F.lit(None).cast("string").alias("error_type"), "event_id")
    return good.unionByName(dead_letters(parsed).select("kafka_offset", "error_type", F.lit(None).cast("string").alias("event_id")))


@query("upsert_counts", f"WITH {DIM} SELECT count(*) FILTER (d.user_id IS NULL) AS inserted, count(*) FILTER (d.user_id IS NOT NULL) AS updated, CAST(0 AS BIGINT) AS deleted FROM s LEFT JOIN d ON d.user_id = s.user_id")
def _(spark, sf_dir):
    return merge_counts(_dim(spark, sf_dir), _dim_update(spark, sf_dir), ["user_id"])


@query(
    "scd2_changes",
    f"""WITH {DIM} SELECT s.user_id, CASE WHEN d.user_id IS NULL THEN 'new' WHEN s.user_segment IS NOT DISTINCT FROM d.user_segment AND s.lifetime_value IS NOT DISTINCT FROM d.lifetime_value
  AND s.is_active IS NOT DISTINCT FROM d.is_active THEN 'unchanged' ELSE 'changed' END AS change FROM s LEFT JOIN d ON d.user_id = s.user_id""",
)
def _(spark, sf_dir):
    return ops.changed_rows(_dim_update(spark, sf_dir), _dim(spark, sf_dir), ["user_id"], _TRACK).select("user_id", "change")


@query(
    "scd2_apply",
    f"""WITH {DIM}, x AS (SELECT s.*, d.user_id AS old_id, d.user_segment AS old_segment FROM s LEFT JOIN d ON d.user_id = s.user_id), ch AS (SELECT * FROM x WHERE old_id IS NULL OR user_segment <> old_segment)
  SELECT user_id, user_segment, TIMESTAMP '2024-01-01' AS effective_from, CASE WHEN user_id IN (SELECT user_id FROM ch) THEN TIMESTAMP '{AS_OF}' END AS effective_to, user_id NOT IN (SELECT user_id FROM ch) AS is_current FROM d
  UNION ALL SELECT user_id, user_segment, TIMESTAMP '{AS_OF}', NULL, true FROM ch""",
)
def _(spark, sf_dir):
    from ebbline.tables.history import first_versions

    old = first_versions(_dim(spark, sf_dir), _TRACK, F.lit("2024-01-01").cast("timestamp"))
    out = scd2_frame(old, _dim_update(spark, sf_dir), ["user_id"], _TRACK, F.lit(AS_OF).cast("timestamp"))
    return out.select("user_id", "user_segment", F.col("effective_from").cast("timestamp_ntz").alias("effective_from"), F.col("effective_to").cast("timestamp_ntz").alias("effective_to"), "is_current")


@query("retention", f"WITH {EV} SELECT event_id, ingestion_date FROM ev WHERE ingestion_date >= DATE '{AS_OF}' - 20")
def _(spark, sf_dir):
    return retained(events_model(spark, sf_dir), "ingestion_date", AS_OF, 20).select("event_id", "ingestion_date")


@query("checksum", f"WITH {EV} SELECT count(*) AS n, true AS same_when_moved, false AS same_when_changed FROM ev")
def _(spark, sf_dir):
    """The sums don't depend on order or partitioning, and one changed row shows."""
    events = events_model(spark, sf_dir)
    changed = events.withColumn("revenue", F.when(F.col("event_id") == 7, F.col("revenue") + 1).otherwise(F.col("revenue")))
    both = checksum(events).withColumnsRenamed({"xor": "x", "total": "t"}).join(checksum(events.repartition(7, "event_type")).withColumnRenamed("n", "n2"), F.col("n") == F.col("n2"))
    other = checksum(changed).select(F.col("n").alias("n3"), F.col("total").alias("t3"))
    return both.join(other, F.col("n") == F.col("n3")).select("n", ((F.col("x") == F.col("xor")) & (F.col("t") == F.col("total"))).alias("same_when_moved"), (F.col("t") == F.col("t3")).alias("same_when_changed"))


@query("row_hash_changes", f"WITH {DIM} SELECT s.user_id FROM s JOIN d ON d.user_id = s.user_id WHERE s.user_segment <> d.user_segment")
def _(spark, sf_dir):
    a = _dim_update(spark, sf_dir).select("user_id", row_hash(_TRACK).alias("h"))
    b = _dim(spark, sf_dir).select("user_id", row_hash(_TRACK).alias("g"))
    return a.join(b, "user_id").where("h <> g").select("user_id")


@query("append_union", f"WITH {RAW} SELECT event_id, event_type, duration_ms FROM raw")
def _(spark, sf_dir):
    e = events_model(spark, sf_dir).select("event_id", "event_type", "duration_ms")
    return ops.append_rows(e, raw_events(spark, sf_dir).where(F.expr("ingested_at > event_timestamp + interval 30 minutes")).select("event_id", "event_type", "duration_ms"))


@query("date_range_scan", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20'")
def _(spark, sf_dir):
    e = _read(spark, sf_dir, "events").select("event_id", "ts")
    return ops.between_dates(e, "ts", F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-20").cast("timestamp_ntz"))


@query("reject_reasons", f"WITH {EV} SELECT event_id, CASE WHEN event_type NOT IN ({', '.join(repr(t) for t in EVENT_TYPES)}) THEN 'unknown event_type' WHEN revenue < 0 THEN 'negative revenue' END AS reason FROM ev")
def _(spark, sf_dir):
    return events_model(spark, sf_dir).select("event_id", ops.rejection_reason(("event_id", "event_type")).alias("reason"))


# -- features, volume, freshness ----------------------------------------------------------------------
@query(
    "user_features",
    f"""WITH {sessions_cte(30)}, f AS (SELECT user_id, count(event_id) AS total_events, count(DISTINCT computed_session_id) AS total_sessions, count(*) FILTER (event_type = 'purchase') AS purchase_count,
  count(*) FILTER (event_type = 'page_view') AS pageview_count, CAST(sum(revenue) AS DECIMAL(28,4)) AS total_revenue, max(revenue) AS max_revenue, count(DISTINCT device_type) AS device_count, count(DISTINCT country) AS country_count,
  count(DISTINCT CAST(event_timestamp AS DATE)) AS active_days, CAST(date_diff('day', CAST(max(event_timestamp) AS DATE), DATE '{AS_OF}') AS INTEGER) AS days_since_last_activity,
  CAST(date_diff('day', CAST(min(event_timestamp) AS DATE), CAST(max(event_timestamp) AS DATE)) AS INTEGER) AS account_age_days, round(CAST(sum(duration_ms) AS DOUBLE) / count(*), 6) AS avg_duration_ms FROM se GROUP BY user_id)
  SELECT *, CASE WHEN total_sessions > 0 THEN total_events / total_sessions ELSE 0 END AS events_per_session, purchase_count / total_events AS conversion_rate,
  CASE WHEN account_age_days > 0 THEN active_days / account_age_days ELSE 0 END AS activity_frequency, CASE WHEN days_since_last_activity > 14 THEN 1 ELSE 0 END AS is_churned FROM f""",
)
def _(spark, sf_dir):
    out = ops.user_features(_sessions(spark, sf_dir), F.lit(AS_OF).cast("date"))
    return out.withColumn("avg_duration_ms", F.round("avg_duration_ms", 6)).drop("avg_revenue")


@query("training_window", f"WITH {EV} SELECT event_id FROM ev WHERE ingestion_date >= DATE '{AS_OF}' - 15 AND ingestion_date <= DATE '{AS_OF}'")
def _(spark, sf_dir):
    return ops.training_window(events_model(spark, sf_dir), F.lit(AS_OF).cast("date"), 15).select("event_id")


@query(
    "volume_anomaly",
    "WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1), s AS (SELECT count(*) AS days, avg(n) AS m, coalesce(stddev_samp(n), 0) AS sd FROM d) "
    "SELECT days, round(m, 6) AS mean_count, round(sd, 6) AS stddev_count, round(greatest(0, m - 2 * sd), 6) AS lower_bound, round(m + 2 * sd, 6) AS upper_bound FROM s",
)
def _(spark, sf_dir):
    out = ops.daily_volume(_read(spark, sf_dir, "events"), F.to_date("ts"))
    return out.select("days", *[F.round(c, 6).alias(c) for c in ("mean_count", "stddev_count", "lower_bound", "upper_bound")])


@query("freshness", "SELECT max(ts) AS latest, date_diff('second', date_trunc('second', max(ts)), TIMESTAMP '2024-01-31') >= 0 AS is_past FROM events")
def _(spark, sf_dir):
    out = ops.freshness(_read(spark, sf_dir, "events"), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 24)
    return out.select("latest", (F.col("age_hours") >= 0).alias("is_past"))


@query("approx_users", f"WITH {EV} SELECT event_type, count(DISTINCT user_id) AS users, true AS within_10_percent FROM ev GROUP BY 1")
def _(spark, sf_dir):
    """Approximate counts keep to twice their stated error of 5 %."""
    counts = events_model(spark, sf_dir).groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("guess"), F.count_distinct("user_id").alias("users"))
    return counts.select("event_type", "users", (F.abs(F.col("guess") - F.col("users")) <= 0.1 * F.col("users")).alias("within_10_percent"))


# -- quality -------------------------------------------------------------------------------------------
def _report(spark, sf_dir, *checks) -> DataFrame:
    runner = DataQualityRunner(dataset="events")
    for c in checks:
        runner.add_check(c)
    return runner.run(events_model(spark, sf_dir)).to_dataframe(spark).select("check_name", "status", "metric_value")


def _rows(*selects: str) -> str:
    return f"WITH {EV} " + " UNION ALL ".join(selects)


def _sql_check(name: str, metric: str, ok: str, source: str = "ev") -> str:
    return f"SELECT '{name}' AS check_name, CASE WHEN {ok} THEN 'passed' ELSE 'failed' END AS status, CAST({metric} AS DOUBLE) AS metric_value FROM {source}"


@query("dq_nulls", _rows(_sql_check("not_null(event_id)", "count(*) FILTER (event_id IS NULL) / count(*)", "count(event_id) = count(*)"), _sql_check("not_null(os)", "count(*) FILTER (os IS NULL) / count(*)", "count(os) = count(*)")))
def _(spark, sf_dir):
    return _report(spark, sf_dir, Check.not_null("event_id"), Check.not_null("os"))


@query("dq_unique", _rows(_sql_check("unique(event_id)", "count(*) - count(DISTINCT event_id)", "count(*) = count(DISTINCT event_id)"), _sql_check("unique(os)", "count(*) - count(DISTINCT coalesce(os, '<null>'))", "false")))
def _(spark, sf_dir):
    return _report(spark, sf_dir, Check.unique("event_id"), Check.unique("os"))


@query(
    "dq_range",
    _rows(_sql_check("range(duration_ms)", "count(*) FILTER (duration_ms < 100 OR duration_ms > 40000)", "count(*) FILTER (duration_ms < 100 OR duration_ms > 40000) = 0"), _sql_check("range(revenue)", "count(*) FILTER (revenue < 0)", "count(*) FILTER (revenue < 0) = 0")),
)
def _(spark, sf_dir):
    return _report(spark, sf_dir, Check.in_range("duration_ms", 100, 40_000), Check.in_range("revenue", 0))


_IN = ", ".join(repr(t) for t in EVENT_TYPES)


@query("dq_accepted", _rows(_sql_check("accepted_values(event_type)", f"count(*) FILTER (event_type NOT IN ({_IN}))", f"count(*) FILTER (event_type NOT IN ({_IN})) = 0")))
def _(spark, sf_dir):
    return _report(spark, sf_dir, Check.accepted_values("event_type", EVENT_TYPES))


@query(
    "dq_ref_integrity",
    _rows(_sql_check("referential_integrity(user_id)", "count(*)", "count(*) = 0", "(SELECT DISTINCT user_id FROM ev WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0))")),
)
def _(spark, sf_dir):
    parent = _read(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    return _report(spark, sf_dir, Check.referential_integrity("user_id", parent, "c_custkey"))


@query("dq_rowcount", _rows(_sql_check("row_count", "count(*)", "count(*) >= 100"), _sql_check("latest", "count(*) FILTER (duration_ms > 100)", "true")))
def _(spark, sf_dir):
    return _report(spark, sf_dir, Check.row_count(100), Check.custom_sql("latest", "select count(*) from {df} where duration_ms > 100", 0, "gt"))


@query("dq_regex", _rows(_sql_check("regex(device_type)", "100.0 * count(*) FILTER (NOT regexp_matches(device_type, '^[A-Z]')) / count(device_type)", "false")))
def _(spark, sf_dir):
    return _report(spark, sf_dir, Check.regex("device_type", "^[A-Z]"))


_SUITE = [
    Expectation("column_exists", "event_id"),
    Expectation("not_null", "device_type", 0.5),
    Expectation("unique", "event_id"),
    Expectation("between", "duration_ms", 0.99, {"low": 100, "high": 40_000}),
    Expectation("in_set", "event_type", 0.75, {"values": EVENT_TYPES}),
    Expectation("regex", "device_type", 0.95, {"pattern": "^[A-Za-z]+$"}),
    Expectation("pair_ge", "ingested_at", 1.0, {"other": "event_timestamp"}),
    Expectation("row_count", None, 1.0, {"low": 100, "high": 100_000_000}),
]


def _suite_row(name: str, total: str, bad: str, mostly: float) -> str:
    return f"SELECT '{name}' AS name, CAST({total} AS BIGINT) AS total, CAST({bad} AS BIGINT) AS unexpected, ({total} - {bad}) / {total} >= {mostly} AS success FROM ev"


@query(
    "ge_suite",
    _rows(
        _suite_row("column_exists(event_id)", "count(*)", "0", 1),
        _suite_row("not_null(device_type)", "count(*)", "count(*) FILTER (device_type IS NULL)", 0.5),
        _suite_row("unique(event_id)", "count(event_id)", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM ev GROUP BY event_id HAVING count(*) > 1))", 1),
        _suite_row("between(duration_ms)", "count(*)", "count(*) FILTER (duration_ms NOT BETWEEN 100 AND 40000)", 0.99),
        _suite_row("in_set(event_type)", "count(*)", f"count(*) FILTER (event_type NOT IN ({_IN}))", 0.75),
        _suite_row("regex(device_type)", "count(device_type)", "count(*) FILTER (NOT regexp_matches(device_type, '^[A-Za-z]+$'))", 0.95),
        _suite_row("pair_ge(ingested_at)", "count(*)", "count(*) FILTER (ingested_at < event_timestamp)", 1),
        _suite_row("row_count()", "count(*)", "0", 1),
    ),
)
def _(spark, sf_dir):
    rows = [(r["name"], r["total"], r["unexpected"], r["success"]) for r in run_suite(events_model(spark, sf_dir), _SUITE)]
    return spark.createDataFrame(rows, "name string, total long, unexpected long, success boolean")


def flawed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with repeated and malformed ids, missing users, negative revenue."""
    i = F.col("event_id")
    return events_model(spark, sf_dir).withColumns(
        {
            "user_id": F.when(i % 4 != 0, F.col("user_id")),
            "revenue": F.when(i % 50 == 0, F.lit(-1).cast("decimal(18,4)")).otherwise(F.col("revenue")),
            "event_id": F.when(i % 9 == 0, F.concat(F.lit("no!"), (i % 2).cast("string"))).otherwise(F.concat(F.lit("event-00"), i.cast("string"))),
        }
    )


FLAWED = f"""{EV}, flawed AS (
  SELECT * REPLACE (CASE WHEN event_id % 4 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 50 = 0 THEN CAST(-1 AS DECIMAL(18,4)) ELSE revenue END AS revenue,
                    CASE WHEN event_id % 9 = 0 THEN 'no!' || (event_id % 2) ELSE 'event-00' || event_id END AS event_id) FROM ev)"""


def _flawed_row(name: str, total: str, bad: str, ok: str) -> str:
    return f"SELECT '{name}' AS name, {total} AS total, CAST({bad} AS BIGINT) AS unexpected, {ok} AS success FROM flawed"


def _mostly(name: str, bad: str, share: float, total: str = "count(*)") -> str:
    return _flawed_row(name, total, f"count(*) FILTER ({bad})", f"1 - count(*) FILTER ({bad}) / {total} >= {share}")


_DEVICES = "'mobile', 'tablet', 'desktop', 'smart_tv', 'bot', 'other', 'unknown'"
_REPEATED = "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM flawed GROUP BY event_id HAVING count(*) > 1))"


@query(
    "events_suite",
    f"WITH {FLAWED} "
    + " UNION ALL ".join(
        [
            *[_flawed_row(f"column_exists({c})", "count(*)", "0", "true") for c in ("event_id", "event_type", "user_id", "event_timestamp", "revenue", "duration_ms")],
            *[_mostly(f"not_null({c})", f"{c} IS NULL", 1) for c in ("event_id", "event_type", "event_timestamp", "ingestion_date")],
            _flawed_row("unique(event_id)", "count(event_id)", _REPEATED, f"{_REPEATED} = 0"),
            _mostly("between(revenue)", "revenue NOT BETWEEN 0 AND 1000000", 0.99, "count(revenue)"),
            _mostly("between(duration_ms)", "duration_ms NOT BETWEEN 0 AND 86400000", 0.99, "count(duration_ms)"),
            _mostly("in_set(event_type)", f"event_type NOT IN ({_IN})", 1, "count(event_type)"),
            _mostly("in_set(device_type)", f"device_type NOT IN ({_DEVICES})", 0.95, "count(device_type)"),
            _flawed_row("row_count()", "count(*)", "0", "count(*) BETWEEN 100 AND 100000000"),
            _mostly("pair_ge(event_timestamp)", "event_timestamp < ingested_at", 0),
            _mostly("pair_ge(ingested_at)", "ingested_at < event_timestamp", 0.95),
            _mostly("not_null(user_id)", "user_id IS NULL", 0.8),
            _mostly("regex(event_id)", "NOT regexp_matches(event_id, '^[a-zA-Z0-9_-]{8,64}$')", 1, "count(event_id)"),
        ]
    ),
)
def _(spark, sf_dir):
    rows = [(r["name"], r["total"], r["unexpected"], r["success"]) for r in run_suite(flawed_events(spark, sf_dir), EVENTS_SUITE)]
    return spark.createDataFrame(rows, "name string, total long, unexpected long, success boolean")


def _zero(name: str, severity: str, count: str) -> str:
    return f"SELECT '{name}' AS check_name, '{severity}' AS severity, ({count}) AS n"


@query(
    "event_sql_checks",
    f"WITH {FLAWED}, counts AS ("
    + " UNION ALL ".join(
        [
            _zero("event_id_not_null", "critical", "SELECT count(*) - count(event_id) FROM flawed"),
            _zero("event_id_unique", "critical", "SELECT count(*) FROM (SELECT 1 FROM flawed GROUP BY event_id HAVING count(*) > 1)"),
            _zero("revenue_non_negative", "critical", "SELECT count(*) FILTER (revenue < 0) FROM flawed"),
            _zero("valid_event_types", "warning", f"SELECT count(*) FILTER (event_type NOT IN ({_IN})) FROM flawed"),
            _zero("timestamp_not_future", "warning", f"SELECT count(*) FILTER (event_timestamp > TIMESTAMP '{AS_OF}') FROM flawed"),
        ]
    )
    + ") SELECT check_name, severity, n = 0 AS ok, CAST(n AS DOUBLE) AS metric_value FROM counts",
)
def _(spark, sf_dir):
    runner = DataQualityRunner(spark)
    for check in event_checks(f"timestamp '{AS_OF}'"):
        runner.add_check(check)
    rows = [(r.name, r.severity.value, r.passed, r.metric_value) for r in runner.run(flawed_events(spark, sf_dir)).results]
    return spark.createDataFrame(rows, "check_name string, severity string, ok boolean, metric_value double")


@query("dup_key_groups", f"WITH {RAW} SELECT event_id, count(*) AS n FROM raw GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf_dir):
    return generic.duplicate_groups(raw_events(spark, sf_dir), ["event_id"])


@query("generic_accepted_values", f"WITH {EV} SELECT event_id, event_type FROM ev WHERE event_type NOT IN ({_IN})")
def _(spark, sf_dir):
    return generic.accepted_values(events_model(spark, sf_dir), "event_type", EVENT_TYPES).select("event_id", "event_type")


@query("generic_positive_values", "SELECT c_acctbal FROM customer WHERE c_acctbal <= 0")
def _(spark, sf_dir):
    return generic.positive_values(_read(spark, sf_dir, "customer"), "c_acctbal")


@query("generic_within_range", "SELECT l_quantity FROM lineitem WHERE l_quantity < 5 OR l_quantity > 45")
def _(spark, sf_dir):
    return generic.within_range(_read(spark, sf_dir, "lineitem"), "l_quantity", 5, 45)


@query("generic_no_orphans", "SELECT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 <> 0)")
def _(spark, sf_dir):
    return generic.no_orphaned_keys(_read(spark, sf_dir, "orders"), "o_custkey", _read(spark, sf_dir, "customer").where("c_custkey % 4 <> 0"), "c_custkey")


@query("generic_unique", "SELECT l_orderkey, count(*) AS n_records FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def _(spark, sf_dir):
    return generic.unique(_read(spark, sf_dir, "lineitem"), "l_orderkey")


@query(
    "generic_valid_email",
    "SELECT email FROM (SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE lower(replace(c_name, '#', '.')) || '@example.com' END AS email FROM customer) WHERE NOT regexp_matches(email, '^[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}$')",
)
def _(spark, sf_dir):
    name = F.col("c_name")
    email = F.when(F.col("c_custkey") % 3 == 0, name).otherwise(F.concat(F.lower(F.replace(name, F.lit("#"), F.lit("."))), F.lit("@example.com")))
    return generic.valid_email_format(_read(spark, sf_dir, "customer").select(email.alias("email")), "email")


@query("generic_not_stale", "SELECT max(ts) AS most_recent FROM events HAVING max(ts) < TIMESTAMP '2024-03-01' - INTERVAL 24 HOUR")
def _(spark, sf_dir):
    return generic.not_stale(_read(spark, sf_dir, "events"), "ts", F.lit("2024-03-01").cast("timestamp_ntz"))


@query("generic_row_count", "SELECT count(*) AS actual_count FROM events HAVING count(*) < 40 OR count(*) > 60")
def _(spark, sf_dir):
    return generic.consistent_row_count(_read(spark, sf_dir, "events"), 50, 20)


@query(
    "source_freshness",
    "SELECT latest, CASE WHEN h > 24 THEN 'error' WHEN h > 12 THEN 'warn' ELSE 'pass' END AS state FROM (SELECT max(ts) AS latest, (epoch(TIMESTAMP '2024-01-31 06:00:00') - epoch(max(ts))) / 3600 AS h FROM events)",
)
def _(spark, sf_dir):
    return generic.source_freshness(_read(spark, sf_dir, "events"), "ts", F.lit("2024-01-31 06:00:00").cast("timestamp_ntz")).select("latest", "state")


__all__ = ["events_model", "oracle_sql", "queries", "seconds_between", "session_category", "valid_email"]
