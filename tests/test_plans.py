import os
import subprocess
import sys

import pytest

from ebbline.ml import should_deploy, train_churn
from ebbline.operators.features import FEATURES
from ebbline.plans.graph import Model, ModelGraph, schema_name
from ebbline.plans.registry import oracle_sql, queries
from ebbline.plans.runner import Pipeline
from ebbline.tables import SnapshotTable

SF = "/root/testdata/sf0.001"


def test_runner_rules():
    seen, calls = [], []

    def flaky(_):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("no")
        return 5

    p = Pipeline("p", sleep=lambda _: None, on_failure=lambda n, o: seen.append(n))
    p.add("a", flaky).add("b", lambda v: v["a"] + v["params"]["x"], ["a"]).add("bad", lambda v: 1 / 0, ["a"], retries=0)
    p.add("after_bad", lambda v: 1, ["bad"]).add("alarm", lambda v: "rang", ["b", "bad"], "one_failed").add("end", lambda v: 1, ["b", "bad"], "all_done")
    p.add("pick", lambda v: "left", ["a"], branch=True).add("left", lambda v: 1, ["pick"]).add("right", lambda v: 1, ["pick"]).add("join", lambda v: 1, ["left", "right"], "one_success")
    r = p.run({"x": 2})
    assert {k: o.state for k, o in r.items()} == {"a": "success", "b": "success", "bad": "failed", "after_bad": "skipped", "alarm": "success", "end": "success", "pick": "success", "left": "success", "right": "skipped", "join": "success"}
    assert r["b"].value == 7 and r["a"].attempts == 3 and seen == ["bad"]


def test_schema_name():
    assert [schema_name("marts", t, "d") for t in ("prod", "staging", "dev")] == ["marts", "stg_marts", "dev_marts"] and schema_name(None, "prod", "d") == "d"


def test_model_graph(spark, tmp_path):
    data = {"rows": [(1, "2024-01-01 00:00:00")]}
    g = ModelGraph(spark, str(tmp_path), {"raw": lambda s: s.createDataFrame(data["rows"], "id int, t string").selectExpr("id", "cast(t as timestamp) t")})
    g.models["stg"] = Model(lambda m: m.source("raw"), "incremental", ("id",), "t")
    g.models["mid"] = Model(lambda m: m.ref("stg").where("id > 0"))
    g.models["mart"] = Model(lambda m: m.ref("mid").groupBy().count(), "table")
    g.models["loop"] = Model(lambda m: m.ref("loop"))
    g.run("stg")
    data["rows"] = [(1, "2023-01-01 00:00:00"), (2, "2024-01-02 00:00:00")]
    assert g.run("stg") == {"inserted": 1, "updated": 0, "deleted": 0}
    g.run("mart")
    assert g.ref("mart").first()[0] == 2 and g.run("mid") is None
    with pytest.raises(ValueError):
        g.ref("loop")
    assert SnapshotTable(spark, f"{tmp_path}/stg").versions() == [1, 2]


def test_queries_have_oracles():
    assert set(oracle_sql()) <= set(queries()) and len(oracle_sql()) >= 50


@pytest.mark.parametrize("name", ["session_categories", "user_features", "scd2_apply", "ge_suite", "fct_events"])
def test_registered_queries_run(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert queries()[name](spark, SF).count() > 0


def test_churn_model(spark):
    rows = [tuple([f"u{i}", *[float((i * (k + 3)) % 17) for k in range(len(FEATURES))], int((i * 3) % 17 > 8)]) for i in range(300)]
    df = spark.createDataFrame(rows, ["user_id", *FEATURES, "is_churned"])
    _, metrics = train_churn(df, max_iter=3, tune=False)
    assert metrics["auc_roc"] > 0.9 and should_deploy(metrics["auc_roc"]) and not should_deploy(0.505)
    _, tuned = train_churn(df, max_iter=2, depths=(2, 3), steps=(0.1,), bins=(16,), folds=2, parallelism=2)
    assert tuned["auc_roc"] > 0.8


def test_entry_survives_without_the_llm_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "repo"
    ignore = lambda d, names: [n for n in names if n in ("llm", ".git", "corpus_pipeline.py", "__pycache__")]
    import shutil

    shutil.copytree(root, copy, ignore=ignore)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not [n for n in q if n.startswith('op')]; assert len(e.oracle_sql()) > 40"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
