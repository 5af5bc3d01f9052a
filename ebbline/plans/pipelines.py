"""The scheduled pipelines - daily load, data quality, model - assembled from the library's parts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.ml.churn import should_deploy, train_churn
from ebbline.operators.clean import deduplicate, require_columns, stage_events
from ebbline.operators.enrich import classify_events
from ebbline.operators.features import daily_volume, freshness, training_window, user_features
from ebbline.operators.sessions import SPREAD, sequence_events, sessionize
from ebbline.plans.graph import ModelGraph
from ebbline.plans.runner import Pipeline
from ebbline.quality import DataQualityError, DataQualityRunner, run_suite
from ebbline.quality.shipped import EVENTS_SUITE, event_checks
from ebbline.sources.files import read_table, wait_for_path, write_features, write_optimized
from ebbline.tables.merge import upsert

Notify = Callable[[str, Mapping[str, Any]], Any]

#: The policy of the scheduled pipelines.
RETRIES, BACKOFF_S, TASK_TIMEOUT_S, SLA_S = 2, 300.0, 7_200.0, 14_400.0


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def processed_events(raw: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Raw events staged, one row per id, with sessions, sequences and classes."""
    staged = stage_events(raw, as_of)
    one = deduplicate(staged, ["event_id"], ["event_timestamp", F.xxhash64(*staged.columns)])
    return require_columns(classify_events(sequence_events(sessionize(one, keep_spread=True))).drop(SPREAD))


def _scheduled(spark: SparkSession, name: str, **policy: Any) -> Pipeline:
    """A pipeline whose timed-out tasks have their Spark jobs cancelled."""
    return Pipeline(name, **{"sla_s": SLA_S, "begin": spark.addTag, "cancel": spark.interruptTag} | policy)


def _add(p: Pipeline, name: str, run: Callable[[dict[str, Any]], Any], after=(), **kwargs: Any) -> None:
    p.add(name, run, after, **{"retries": RETRIES, "backoff_s": BACKOFF_S, "timeout_s": TASK_TIMEOUT_S} | kwargs)


def daily_pipeline(
    spark: SparkSession,
    raw_path: str,
    read_raw: Callable[[Mapping[str, Any]], DataFrame],
    root: str,
    notify: Notify,
    extract: Callable[[Mapping[str, Any]], int] = lambda params: 0,
    graph: ModelGraph | None = None,
    model_tests: Mapping[str, Callable[[], DataFrame]] | None = None,
    as_of: Column | None = None,
    wait_s: float = 3_600.0,
    **policy: Any,
) -> Pipeline:
    """Wait, extract, transform, load, build and test the models, check quality, notify.

    Every step can be repeated: the transformed partitions are overwritten and the load is
    an upsert by event id. ``read_raw`` gets the run's parameters; ``model_tests`` give
    violating rows, which must be none.
    """
    processed, events = f"{root}/processed", f"{root}/warehouse/events"
    p = _scheduled(spark, "daily", **policy)

    def wait(v):
        if not wait_for_path(lambda path: path_exists(spark, path), raw_path, wait_s, sleep=p.sleep):
            raise TimeoutError(f"nothing at {raw_path}")

    def transform(v):
        return write_optimized(processed_events(read_raw(v["params"]), as_of), processed, ["ingestion_date"])

    def load(v):
        day = v["params"].get("date")
        return upsert(spark, read_table(spark, processed, day), events, ["event_id"], ["ingestion_date"])

    def models(v):
        return {name: graph.run(name) for name in graph.models} if graph else {}

    def test(v):
        failed = [name for name, rows in (model_tests or {}).items() if not rows().isEmpty()]
        if failed:
            raise DataQualityError(f"violating rows in {failed}")

    def quality(v):
        report = DataQualityRunner(spark, dataset="events")
        for check in event_checks():
            report.add_check(check)
        found = report.run(read_table(spark, processed, v["params"].get("date")))
        found.raise_on_failure()
        return found

    _add(p, "wait_for_source_data", wait, timeout_s=None)
    _add(p, "extract_api_data", lambda v: extract(v["params"]), ["wait_for_source_data"])
    _add(p, "transform_events", transform, ["extract_api_data"])
    _add(p, "load_warehouse", load, ["transform_events"])
    _add(p, "run_models", models, ["load_warehouse"])
    _add(p, "test_models", test, ["run_models"])
    _add(p, "run_quality_checks", quality, ["test_models"])
    steps = [t.name for t in p.tasks]
    _add(p, "notify_success", lambda v: notify("success", v), steps, retries=0)
    _add(p, "notify_failure", lambda v: notify("failure", v), steps, rule="one_failed", retries=0)
    return p


def quality_pipeline(spark: SparkSession, events: Callable[[], DataFrame], notify: Notify, ready: Callable[[], bool] = lambda: True, max_age_hours: float = 6.0, days: int = 30, now: str = "current_timestamp()", **policy: Any) -> Pipeline:
    """Suite, SQL checks, freshness and volume side by side, then one of two notices.

    A check that could not run counts as failed. Volume compares the rows of the run's
    ``date`` (else of the clock's) with the ``days`` before it, two deviations either way.
    """
    p = _scheduled(spark, "quality", **policy)
    checks = ("run_suite", "run_sql_checks", "check_freshness", "detect_volume_anomalies")

    def wait(v):
        if not ready():
            raise TimeoutError("the daily load isn't there")

    def sql(v):
        runner = DataQualityRunner(spark, dataset="events")
        for check in event_checks(now):
            runner.add_check(check)
        report = runner.run(events())
        return {"passed": report.is_success, "report": report}

    def fresh(v):
        row = freshness(events(), "event_timestamp", F.expr(now), max_age_hours).first()
        return {"passed": row["is_fresh"], "age_hours": row["age_hours"]}

    def volume(v):
        day = F.lit(v["params"]["date"]).cast("date") if v["params"].get("date") else F.to_date(F.expr(now))
        df, column = events(), F.col("ingestion_date")
        n = df.where(column == day).count()
        past = daily_volume(df.where((column >= F.date_sub(day, days)) & (column < day)), column).first()
        return {"passed": past["days"] == 0 or past["lower_bound"] <= n <= past["upper_bound"], "n": n, "bounds": (past["lower_bound"], past["upper_bound"])}

    def suite(v):
        results = run_suite(events(), EVENTS_SUITE)
        return {"passed": all(r["success"] for r in results), "results": results}

    _add(p, "wait_for_daily_load", wait)
    for name, run in zip(checks, (suite, sql, fresh, volume), strict=True):
        _add(p, name, run, ["wait_for_daily_load"])
    _add(p, "decide_alert", lambda v: "notify_all_passed" if all((v[c] or {}).get("passed") for c in checks) else "notify_failures", checks, rule="all_done", branch=True)
    _add(p, "notify_all_passed", lambda v: notify("success", v), ["decide_alert"], retries=0)
    _add(p, "notify_failures", lambda v: notify("failure", v), ["decide_alert"], retries=0)
    _add(p, "done", lambda v: None, ["notify_all_passed", "notify_failures"], rule="one_success")
    return p


def model_pipeline(spark: SparkSession, events: Callable[[], DataFrame], root: str, notify: Notify, predict: Callable[[str], Any] = lambda path: None, baseline_auc: float = 0.5, days: int = 90, training: Mapping[str, Any] | None = None, **policy: Any) -> Pipeline:
    """Features, training, evaluation, deployment if the gain suffices, predictions, notice.

    ``events`` are processed ones. A deployed model replaces ``root``/model; predictions
    get its path, or the candidate's where none was deployed.
    """
    p = _scheduled(spark, "model", **policy)
    candidate, live, features = f"{root}/candidate", f"{root}/model", f"{root}/features"

    def compute(v):
        day = F.lit(v["params"]["date"]).cast("date")
        return write_features(user_features(training_window(events(), day, days), day.cast("timestamp")), features, v["params"]["date"])

    def train(v):
        rows = spark.read.parquet(features).where(F.col("execution_date") == F.lit(v["params"]["date"]))
        return train_churn(rows, candidate, **(training or {}))[1]

    def deploy(v):
        PipelineModel.load(candidate).write().overwrite().save(live)
        return live

    _add(p, "compute_features", compute)
    _add(p, "train_model", train, ["compute_features"])
    _add(p, "evaluate_model", lambda v: should_deploy(v["train_model"]["auc_roc"], baseline_auc), ["train_model"])
    _add(p, "decide_deployment", lambda v: "deploy_model" if v["evaluate_model"] else "skip_deployment", ["evaluate_model"], branch=True)
    _add(p, "deploy_model", deploy, ["decide_deployment"])
    _add(p, "skip_deployment", lambda v: candidate, ["decide_deployment"])
    _add(p, "trigger_predictions", lambda v: predict(v.get("deploy_model") or candidate), ["deploy_model", "skip_deployment"], rule="one_success")
    _add(p, "notify_completion", lambda v: notify("completed", v), ["trigger_predictions"], rule="all_done", retries=0)
    return p
