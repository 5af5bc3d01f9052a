"""The stages one after another, each judged on its own input."""

import glob
import os
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ebbline.llm import common
from ebbline.llm.common import materialize
from ebbline.llm.jaccard_join import jaccard_components

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), f"test-{name}")
        assert out.columns == docs.columns
        kept.append((docs, out))
        docs = out
    ids = [{r["doc_id"] for r in b.collect()} for _, b in kept]
    good = {d for d, q in labels.items() if q}
    assert len(good & ids[0]) >= 0.95 * len(good) and len(set(labels) - good - ids[0]) >= 0.8 * len(set(labels) - good)
    assert len(ids[1]) >= 0.97 * len(ids[0])
    groups = jaccard_components(kept[2][0], 5, (80, 100)).collect()
    assert ids[2] == {r["component_id"] for r in groups}
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in pieces} == ids[2]
    by = {}
    for r in pieces:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(sum(r["length"] for r in rs) == rs[0]["doc_tokens"] for rs in by.values())
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 4


def test_ids_go_to_the_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(common, "BROADCAST_IDS", 3)
    rows = [(i, f"t{i}") for i in [*range(-70_000, 70_000, 997), None, 5, 5, 2**62]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for strewn in (False, True):
        wanted = [i for i, _ in rows if i is not None and i % 2 and i < 2**62] + [5, 8, None] + [k * 2**40 for k in range(2000) if strewn]
        ids = materialize(spark.createDataFrame([(i,) for i in wanted], "gone long"), "test-ids")
        monkeypatch.setattr(common, "BITMAP_BYTES", 1 << 20)
        for listed in (True, False):
            got = common.by_ids(docs, "doc_id", ids, listed)
            assert got.columns == docs.columns
            assert sorted(got.collect(), key=str) == sorted((tuple(r) for r in rows if (r[0] is not None and r[0] in set(wanted)) == listed), key=str)
        if not strewn:
            plan = common.by_ids(docs.sparkSession.read.parquet(common.store(docs, "test-docs")), "doc_id", ids, False)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


def test_a_table_leaves_no_shuffle_files(spark):
    local = spark.conf.get("spark.local.dir", "/tmp")
    found = lambda: set(glob.glob(f"{local}/blockmgr-*/*/shuffle_*.data"))
    before = found()
    out = materialize(spark.range(1000).groupBy(F.expr("id % 7").alias("k")).count(), "test-shuffled")
    for _ in range(50):
        if not found() - before:
            break
        time.sleep(0.1)
    assert not found() - before and out.count() == 7
    assert spark.conf.get(common._CLEANUP, None) is None


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_remove_what_the_last_one_stored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    with common.recorded() as made:
        first = corpus_pipeline.quality_stage(spark, docs, SF)
    evidence = [p for p in made if "quality-evidence" in p]
    assert evidence and all(os.path.isdir(p) for p in evidence)
    lazy = corpus_pipeline.language_stage(spark, first, SF)  # reads the evidence, which stays
    assert all(os.path.isdir(p) for p in made) and lazy.count() > 0
    corpus_pipeline.language_stage(spark, materialize(lazy, "test-language"), SF)
    assert not any(os.path.isdir(p) for p in made)
