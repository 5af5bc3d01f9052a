import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ebbline.plans import registry
from ebbline.streaming import Supervisor, dead_letters, file_envelopes, parse_envelope, running_sessions, session_metrics, start_sink, upsert_sink, valid_events, windowed_metrics
from ebbline.streaming.sources import kafka_options
from ebbline.tables import SnapshotTable

SCHEMA = "event_id string, user_id string, event_type string, event_timestamp timestamp, revenue double, duration_ms long, is_conversion boolean, device_type string, country string"


def at(h, m=0):
    return f"2024-01-01T{h:02d}:{m:02d}:00Z"


@pytest.fixture()
def lines(tmp_path):
    def put(name, *rows):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        return str(folder)

    return put


def ev(i, user, when, **more):
    return {"event_id": i, "user_id": user, "event_type": "click", "timestamp": when, "revenue": 1.0, "is_conversion": False} | more


def memory(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_valid_and_dead(spark, lines):
    path = lines("a.txt", ev("e1", "u", at(1)), "rubbish", {"user_id": "x"}, ev("e2", "u", at(2), duration_ms="wrong"))
    parsed = parse_envelope(file_envelopes(spark, path))
    good = memory(valid_events(parsed), "good", "append")
    dead = memory(dead_letters(parsed), "dead", "append")
    assert {r["event_id"] for r in good.collect()} == {"e1", "e2"}
    assert good.where("event_id = 'e1'").first()["event_timestamp"] == dt.datetime(2024, 1, 1, 1)
    assert {r["raw_json"] for r in dead.collect()} == {"rubbish", '{"user_id": "x"}'} and dead.first()["error_type"] == "parse_error"


def test_windows_agree_with_batch(spark, lines):
    rows = [ev(f"e{i}", f"u{i % 3}", at(i // 60, i % 60)) for i in range(120)]
    path = lines("a.txt", *rows)
    out = memory(windowed_metrics(valid_events(parse_envelope(file_envelopes(spark, path))), slide=None), "tumbling", "update")
    batch = valid_events(parse_envelope(_batch(spark, path)))
    want = windowed_metrics(batch, slide=None)
    cols = ["window_start", "event_count", "unique_users", "total_revenue"]
    assert out.select(cols).exceptAll(want.select(cols)).isEmpty() and out.count() == want.count() == 24
    assert windowed_metrics(batch).where("event_count = 5").count() > 0


def _batch(spark, path):
    return spark.read.text(path).select(F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"), F.current_timestamp().alias("timestamp"))


def test_sessions_close_and_late_events_go(spark, lines, tmp_path):
    events = lambda p: valid_events(parse_envelope(file_envelopes(spark, p, 1)))
    path = lines("a.txt", ev("e1", "u", at(1)), ev("e2", "u", at(1, 30)), ev("e3", "u", at(2, 1)), ev("e4", None, at(1)))
    ck = str(tmp_path / "ck")
    start = lambda: start_sink(session_metrics(events(path)), str(tmp_path / "out"), ck, trigger="availableNow")
    start().awaitTermination(120)
    lines("b.txt", ev("e5", "v", at(9)))
    start().awaitTermination(120)
    lines("c.txt", ev("e6", "u", at(1, 5)), ev("e7", "v", at(20)))
    start().awaitTermination(120)
    out = {r["session_start"].hour * 60 + r["session_start"].minute: r for r in spark.read.parquet(str(tmp_path / "out")).where("user_id = 'u'").collect()}
    assert set(out) == {60, 121} and out[60]["session_events"] == 2 and out[60]["session_end"] == dt.datetime(2024, 1, 1, 1, 30) and out[60]["window_end"] == dt.datetime(2024, 1, 1, 2)


def test_running_sessions_update(spark, lines):
    path = lines("a.txt", ev("e1", "u", at(1)), ev("e2", "u", at(1, 10)), ev("e3", "u", at(3)))
    out = memory(running_sessions(valid_events(parse_envelope(file_envelopes(spark, path)))), "running", "update").collect()
    closed = [r for r in out if r["is_closed"] and r["session_start"] == dt.datetime(2024, 1, 1, 1)]
    assert len(closed) == 1 and closed[0]["session_events"] == 2 and closed[0]["session_end"] == dt.datetime(2024, 1, 1, 1, 10)
    assert any(r["session_start"] == dt.datetime(2024, 1, 1, 3) for r in out)


def test_upsert_sink_and_supervisor(spark, lines, tmp_path):
    path = lines("a.txt", ev("e1", "u", at(1)), ev("e2", "u", at(1, 1)))
    metrics = windowed_metrics(valid_events(parse_envelope(file_envelopes(spark, path))), slide=None).drop("computed_at")
    table = str(tmp_path / "t")
    sup = Supervisor(spark, 1)
    sup.add("ok", lambda: upsert_sink(metrics, table, ["window_start", "event_type"], str(tmp_path / "ck1"), "availableNow"))
    boom = F.udf(lambda x: 1 // 0, "int")
    sup.add("bad", lambda: start_sink(valid_events(parse_envelope(file_envelopes(spark, path))).select(boom("event_id").alias("x")), str(tmp_path / "b"), str(tmp_path / "ck2"), trigger="once"))
    states = sup.await_all(120)
    sup.stop()
    assert states == {"ok": "done", "bad": "failed"} and sup.restarts["bad"] == 1
    assert SnapshotTable(spark, table).read().agg(F.sum("event_count")).first()[0] == 2
    assert kafka_options("h:1", "events")["maxOffsetsPerTrigger"] == "100000"


def test_appended_results_and_state_stay_out_of_the_memory(spark, tmp_path):
    rows = [(i, f"u{i % 50}", dt.datetime(2024, 1, 1) + dt.timedelta(minutes=7 * i), 1.0, "Mobile", "US") for i in range(500)]
    spark.createDataFrame(rows, "event_id long, user_id string, event_timestamp timestamp, revenue double, device_type string, country string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    query = start_sink(session_metrics(stream), str(tmp_path / "out"), str(tmp_path / "checkpoint"), trigger="availableNow")
    assert query.awaitTermination(120)
    used = {k for p in query.recentProgress for s in p["stateOperators"] for k in s["customMetrics"]}
    assert any(k.startswith("rocksdb") for k in used)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) is None
    assert 0 < spark.read.parquet(str(tmp_path / "out")).count() <= 500
    drained = registry._drained(session_metrics(stream), "append", "sessions")
    assert drained.inputFiles() and drained.count() == spark.read.parquet(str(tmp_path / "out")).count()
