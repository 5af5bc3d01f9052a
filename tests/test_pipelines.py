import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from ebbline.model import RAW_EVENT
from ebbline.plans.graph import Model, ModelGraph
from ebbline.plans.pipelines import daily_pipeline, model_pipeline, processed_events, quality_pipeline
from ebbline.plans.registry import oracle_sql, queries
from ebbline.plans.runner import Pipeline
from ebbline.tables import SnapshotTable

QUICK = {"sleep": lambda _: None}


def states(outcomes):
    return {k: o.state for k, o in outcomes.items()}


def raw(spark, n=240):
    i = F.col("id")
    made = {
        "event_id": F.format_string("event-%05d", i),
        "event_type": F.when(i % 5 == 0, "purchase").otherwise("page_view"),
        "user_id": F.concat(F.lit("u"), i % 12),
        "timestamp": F.date_format(F.timestamp_seconds(1_704_067_200 + i * 600), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "device_type": F.lit("mobile"),
        "duration_ms": i * 10,
        "revenue": F.when(i % 5 == 0, F.lit(3.0)).otherwise(F.lit(0.0)),
    }
    return spark.range(n).select(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in RAW_EVENT])


def test_daily_pipeline(spark, tmp_path):
    said, root = [], str(tmp_path / "root")
    raw(spark).union(raw(spark).limit(20)).write.json(str(tmp_path / "raw"))
    graph = ModelGraph(spark, root, {"events": lambda s: SnapshotTable(s, f"{root}/warehouse/events").read()})
    graph.models["by_user"] = Model(lambda g: g.source("events").groupBy("user_id").count(), "table")
    read = lambda params: spark.read.schema(RAW_EVENT).json(str(tmp_path / "raw"))
    as_of = F.lit("2024-01-04 00:00:00").cast("timestamp")
    tests = {"users": lambda: graph.ref("by_user").where("user_id is null")}
    make = lambda **more: daily_pipeline(spark, str(tmp_path / "raw"), read, root, lambda kind, v: said.append(kind), graph=graph, as_of=as_of, **{"model_tests": tests, "wait_s": 0.0} | QUICK | more)
    for _ in range(2):  # a second run changes nothing
        got = make().run({"date": "2024-01-04"})
        assert {k for k, s in states(got).items() if s != "success"} == {"notify_failure"}, {k: o.error for k, o in got.items()}
        assert SnapshotTable(spark, f"{root}/warehouse/events").read().count() == 240 and graph.ref("by_user").count() == 12
    got = states(make(model_tests={"none": lambda: graph.ref("by_user")}).run({"date": "2024-01-04"}))
    assert got["test_models"] == "failed" and got["run_quality_checks"] == got["notify_success"] == "skipped" and said == ["success", "success", "failure"]


def test_quality_pipeline(spark):
    said = []
    good = processed_events(raw(spark), F.lit("2024-01-02 16:00:00").cast("timestamp")).cache()
    run = lambda df, **more: quality_pipeline(spark, lambda: df, lambda kind, v: said.append(kind), now="timestamp '2024-01-02 20:00:00'", **QUICK | more).run({"date": "2024-01-02"})
    got = run(good)
    assert states(got)["notify_all_passed"] == "success" and states(got)["notify_failures"] == "skipped" and states(got)["done"] == "success", [o.value for o in got.values()]
    bad = states(run(good.withColumn("revenue", F.lit(-1.0))))
    assert bad["notify_failures"] == bad["done"] == "success" and bad["notify_all_passed"] == "skipped"
    absent = states(run(good, ready=lambda: False))
    assert absent["wait_for_daily_load"] == "failed" and absent["run_suite"] == "skipped" and absent["notify_failures"] == "success"
    assert said == ["success", "failure", "failure"]


@pytest.mark.parametrize("baseline, way", [(-1.0, "deploy_model"), (1.0, "skip_deployment")])
def test_model_pipeline(spark, tmp_path, baseline, way):
    days = F.when(F.substring("user_id", 2, 2).cast("int") % 2 == 0, F.lit("2024-01-30")).otherwise(F.lit("2024-01-02")).cast("timestamp")
    events = processed_events(raw(spark).withColumn("user_id", F.concat(F.lit("u"), F.abs(F.xxhash64("event_id")) % 60)))
    events = events.withColumns({"event_timestamp": days, "ingestion_date": F.to_date(days)})
    told, used = [], []
    got = model_pipeline(spark, lambda: events, str(tmp_path), lambda kind, v: told.append(kind), used.append, baseline, training={"max_iter": 2, "tune": False}, **QUICK).run({"date": "2024-02-01"})
    other = {"deploy_model", "skip_deployment"} - {way}
    assert {k for k, s in states(got).items() if s != "success"} == other, {k: o.error for k, o in got.items()}
    assert told == ["completed"] and used == [f"{tmp_path}/{'model' if way == 'deploy_model' else 'candidate'}"]


def test_time_out():
    stop, calls = threading.Event(), []

    def slow(_):
        calls.append(1)
        stop.wait(20)

    got = Pipeline("p", cancel=lambda name: stop.set(), **QUICK).add("slow", slow, retries=1, timeout_s=0.2).add("quick", lambda v: 3, timeout_s=5).run()
    assert got["quick"].value == 3 and got["slow"].state == "success" and got["slow"].attempts == 2 == len(calls)
    stuck = threading.Event()
    got = Pipeline("p", **QUICK).add("stuck", lambda v: stuck.wait(20), retries=3, timeout_s=0.1).run()
    stuck.set()
    assert got["stuck"].state == "failed" and got["stuck"].attempts == 1 and "TimeoutError" in got["stuck"].error


@pytest.mark.parametrize("name", ["events_suite", "event_sql_checks"])
def test_shipped_checks_equal_sql(spark, name):
    db = duckdb.connect()
    db.sql("create view events as select * from '/root/testdata/sf0.001/events.parquet'")
    got = queries()[name](spark, "/root/testdata/sf0.001")
    want = db.sql(oracle_sql()[name])
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall()) and got.columns == want.columns
    assert any(not r[-1] for r in got.collect()) or name == "event_sql_checks"
