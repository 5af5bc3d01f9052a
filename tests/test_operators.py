import datetime as dt

import pytest
from pyspark.sql import functions as F

from ebbline import operators as ops
from ebbline.functions import anonymise_ip, device_category, device_from_user_agent, session_category, surrogate_key, url_parameter, user_status, valid_event_id
from ebbline.quality.checks import assert_quality

T = dt.datetime


@pytest.fixture()
def events(spark):
    rows = [
        ("e1", "u1", "page_view", T(2024, 1, 15, 10, 0), T(2024, 1, 15, 10, 0), 10, 0.0, False),
        ("e2", "u1", "click", T(2024, 1, 15, 10, 5), T(2024, 1, 15, 10, 5), 20, 0.0, False),
        ("e3", "u1", "page_view", T(2024, 1, 15, 11, 0), T(2024, 1, 15, 11, 0), 30, 5.0, True),
        ("e4", "u2", "signup", T(2024, 1, 15, 9, 0), T(2024, 1, 15, 9, 0), 40, 0.0, False),
        ("e1", "u1", "page_view", T(2024, 1, 15, 10, 0), T(2024, 1, 15, 10, 1), 11, 0.0, False),
    ]
    return spark.createDataFrame(rows, "event_id string, user_id string, event_type string, event_timestamp timestamp, ingested_at timestamp, duration_ms long, revenue double, is_conversion boolean")


def test_deduplicate_keeps_one_end(events):
    first = ops.deduplicate(events, ["event_id"], ["ingested_at"], "earliest")
    last = ops.deduplicate(events, ["event_id"], ["ingested_at"])
    assert first.count() == last.count() == 4
    assert first.where("event_id = 'e1'").first()["duration_ms"] == 10
    assert last.where("event_id = 'e1'").first()["duration_ms"] == 11


def test_sessions_split_on_gap_only_beyond_the_limit(spark, events):
    one = ops.deduplicate(events, ["event_id"], ["ingested_at"])
    out = ops.sessionize(one)
    assert out.where("user_id = 'u1'").select("computed_session_id").distinct().count() == 2
    exact = spark.createDataFrame([("a", "u", T(2024, 1, 1, 0, 0)), ("b", "u", T(2024, 1, 1, 0, 30)), ("c", "u", T(2024, 1, 1, 1, 0, 1))], "event_id string, user_id string, event_timestamp timestamp")
    assert ops.sessionize(exact).select("computed_session_id").distinct().count() == 2


def test_anonymous_events_have_no_session(spark):
    df = spark.createDataFrame([("a", None, T(2024, 1, 1)), ("b", None, T(2024, 1, 1))], "event_id string, user_id string, event_timestamp timestamp")
    assert [r["computed_session_id"] for r in ops.sessionize(df).collect()] == [None, None]


def test_sequence_and_aggregates(events):
    one = ops.deduplicate(events, ["event_id"], ["ingested_at"], "earliest")
    seq = {r["event_id"]: r for r in ops.sequence_events(ops.sessionize(one)).collect()}
    assert (seq["e1"]["event_sequence_number"], seq["e1"]["next_event_type"], seq["e1"]["seconds_to_next_event"], seq["e2"]["cumulative_duration_ms"]) == (1, "click", 300, 30)
    agg = {r["computed_session_id"]: r for r in ops.categorize_sessions(ops.session_aggregates(ops.sessionize(one))).collect()}
    assert agg["u1_1"]["event_count"] == 2 and agg["u1_1"]["session_category"] == "long" and agg["u1_1"]["last_event_type"] == "click"
    assert agg["u1_2"]["session_category"] == "bounce" and agg["u1_2"]["has_conversion"]


def test_pivot_counts(events):
    r = ops.pivot_event_counts(events).where("user_id = 'u1'").first()
    assert (r["page_view"], r["click"], r["logout"]) == (3, 1, 0)


def test_window_sessions_agree_with_session_window(events):
    one = ops.deduplicate(events, ["event_id"], ["ingested_at"])
    assert ops.batch_session_windows(one, "event_timestamp", "30 minutes", ["user_id"]).count() == ops.sessionize(one).select("computed_session_id").distinct().count()


def test_enrichment_keeps_unknown_users(spark, events):
    users = spark.createDataFrame([("u1", "gold", dt.date(2024, 1, 1), 9.0, True)], "user_id string, user_segment string, signup_date date, lifetime_value double, is_active boolean")
    out = ops.enrich_users(events, users)
    assert out.count() == 5
    assert out.where("user_id = 'u2'").first()["days_since_signup"] is None
    assert out.where("user_id = 'u1'").first()["days_since_signup"] == 14
    assert ops.enrich_geo(events, None) is events


def test_orphans_and_changes(spark):
    child = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "k int")
    assert ops.orphans(child, parent, "k", "k").count() == 3
    assert ops.orphans(child, parent, "k", "k", distinct=True).count() == 2
    old = spark.createDataFrame([(1, None), (2, "a")], "id int, v string")
    new = spark.createDataFrame([(1, "x"), (2, "a"), (3, "b")], "id int, v string")
    assert {r["id"]: r["change"] for r in ops.changed_rows(new, old, ["id"], ["v"]).collect()} == {1: "changed", 2: "unchanged", 3: "new"}


def test_staging_drops_bad_rows_and_survives_bad_timestamps(spark):
    schema = "event_id string, event_type string, timestamp string"
    df = spark.createDataFrame([("a", "click", "2024-01-15T10:00:00Z"), (None, "click", "2024-01-15T10:00:00Z"), ("b", "click", "rubbish")], schema)
    out = {r["event_id"]: r for r in ops.stage_events(df, F.lit("2024-02-01 00:00:00").cast("timestamp")).collect()}
    assert set(out) == {"a", "b"} and out["b"]["event_timestamp"] is None
    assert out["a"]["event_timestamp"] == T(2024, 1, 15, 10, 0) and out["a"]["ingestion_date"] == dt.date(2024, 2, 1)


def test_reasons_and_split(spark):
    df = spark.createDataFrame([("a", "click", "t", 1, 1.0), ("b", "error", "t", 1, 1.0), ("c", "click", None, 1, 1.0), ("d", "click", "t", -1, 1.0)], "event_id string, event_type string, timestamp string, duration_ms long, revenue double")
    good, dead = ops.split_valid(df, ops.rejection_reason())
    assert [r["event_id"] for r in good.collect()] == ["a"]
    assert {r["event_id"]: r["_rejection_reason"] for r in dead.collect()} == {"b": "unknown event_type", "c": "missing timestamp", "d": "negative duration_ms"}


def test_hash_split_does_not_depend_on_partitions(spark):
    df = spark.range(1000)
    a, b = ops.hash_split(df, ["id"], 0.8)
    again, _ = ops.hash_split(df.repartition(7), ["id"], 0.8)
    assert a.count() + b.count() == 1000 and a.exceptAll(again).isEmpty() and 700 < a.count() < 900


def test_fill_zero_leaves_keys(spark):
    df = spark.createDataFrame([(None, None)], "k long, v long")
    assert tuple(ops.fill_zero(df, ["v"]).first()) == (None, 0)


def test_scalar_functions(spark):
    df = spark.createDataFrame(
        [("Mozilla/5.0 (iPhone; CPU)", "1.2.3.4", "A", "https://x.y/?a=1&utm_source=&utm_source=goo%20gle+x#utm_source=z"), (None, None, None, None), ("Mozilla/5.0 (Windows NT 10.0)", "1.2.3.4", "Q", "no url")],
        "ua string, ip string, st string, url string",
    )
    rows = df.select(device_from_user_agent("ua").alias("d"), anonymise_ip("ip").alias("i"), user_status("st").alias("s"), url_parameter("url", "utm_source").alias("u")).collect()
    assert [r["d"] for r in rows] == ["mobile", "unknown", "desktop"]
    assert len(rows[0]["i"]) == 16 and rows[0]["i"] == rows[2]["i"] and rows[1]["i"] is None
    assert [r["s"] for r in rows] == ["active", "unknown", "q"]
    assert [r["u"] for r in rows] == ["goo gle x", None, None]
    devices = spark.createDataFrame([("Phone", None), ("pc", "bot"), (None, "bot"), ("watch", "BOT"), ("Console", None), ("x", None)], "d string, o string")
    assert [r[0] for r in devices.select(device_category("d", "o")).collect()] == ["mobile", "desktop", "unknown", "bot", "smart_tv", "other"]
    one = spark.createDataFrame([("a", None, "b")], "x string, y string, z string")
    assert one.select(surrogate_key(["x", "y", "z"]) != surrogate_key(["x", "z"])).first()[0]
    cats = spark.createDataFrame([(1, 99.0), (2, 29.0), (2, 30.0), (2, 300.0), (2, 1800.0)], "n int, s double")
    assert [r[0] for r in cats.select(session_category("n", "s")).collect()] == ["bounce", "short", "medium", "long", "very_long"]
    ids = spark.createDataFrame([("abcdefgh",), ("short",), ("with space",)], "i string")
    assert [r[0] for r in ids.select(valid_event_id("i")).collect()] == [True, False, False]


def test_quality_assertion(spark):
    with pytest.raises(ValueError, match="DataFrame is empty"):
        assert_quality(spark.createDataFrame([], "event_id string"), ["event_id"])
    with pytest.raises(ValueError, match="missing columns"):
        ops.require_columns(spark.range(1))


def test_features(spark, events):
    e = ops.sessionize(events).withColumns({"device_type": F.lit("pc"), "country": F.lit("DE")})
    r = ops.user_features(e, F.lit("2024-02-01").cast("date")).where("user_id = 'u1'").first()
    assert (r["total_events"], r["days_since_last_activity"], r["is_churned"], r["active_days"], r["account_age_days"], r["activity_frequency"]) == (4, 17, 1, 1, 0, 0.0)


def test_volume_of_one_day(spark):
    df = spark.createDataFrame([(T(2024, 1, 1),)] * 3, "ts timestamp")
    r = ops.daily_volume(df, F.to_date("ts")).first()
    assert (r["mean_count"], r["stddev_count"], r["lower_bound"]) == (3.0, 0.0, 3.0)


def test_sessions_sequences_and_neighbours_share_one_exchange(spark):
    rows = [("e1", "u", "2024-01-01 00:00:00"), ("e2", "u", "2024-01-01 00:10:00"), ("e3", None, "2024-01-01 00:10:00"), ("e4", None, "2024-01-01 00:11:00")]
    df = spark.createDataFrame(rows, "event_id string, user_id string, event_timestamp string").selectExpr("*", "'click' as event_type", "1L as duration_ms").withColumn("event_timestamp", F.col("event_timestamp").cast("timestamp"))
    out = ops.session_counts(ops.user_neighbours(ops.sequence_events(ops.sessionize(df, keep_spread=True))))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {r["event_id"]: (r["event_sequence_number"], r["session_event_count"], r["user_prev_event_type"]) for r in out.collect()}
    assert got == {"e1": (1, 2, None), "e2": (2, 2, "click"), "e3": (1, None, None), "e4": (1, None, None)}
    assert ops.identified(spark.createDataFrame([("a",), ("anonymous",)], "user_id string")).count() == 1
