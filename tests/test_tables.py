import datetime as dt

import pytest
from pyspark.sql import functions as F

from ebbline.tables import (
    ConcurrentWriteError,
    IncompatibleSchemaError,
    SchemaNotFoundError,
    SchemaRegistry,
    SnapshotTable,
    apply_scd2,
    checksum,
    compatible,
    drop_old_partitions,
    upsert,
    upsert_sql,
    validate_load,
)


def frame(spark, rows, schema="id int, v string"):
    return spark.createDataFrame(rows, schema)


def test_upsert_and_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert upsert(spark, frame(spark, [(1, "a"), (2, "b")]), path, ["id"]) == {"inserted": 2, "updated": 0, "deleted": 0}
    assert upsert(spark, frame(spark, [(2, "c"), (3, "d")]), path, ["id"]) == {"inserted": 1, "updated": 1, "deleted": 0}
    t = SnapshotTable(spark, path)
    assert sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, t.read(1).collect())) == [(1, "a"), (2, "b")]
    assert t.history(1)[0]["metrics"]["updated"] == 1
    upsert(spark, frame(spark, [(2, "c"), (3, "d")]), path, ["id"])
    assert t.read().count() == 3
    with pytest.raises(ValueError):
        upsert(spark, frame(spark, [(9, "x"), (9, "y")]), path, ["id"])
    with pytest.raises(ConcurrentWriteError):
        t.overwrite(frame(spark, [(1, "z")]), version=1)
    upsert(spark, frame(spark, [(4, "e", 1.0)], "id int, v string, w double"), path, ["id"])
    assert t.read().where("w is null").count() == 3
    t.vacuum(0, now=4e9)
    assert t.versions() == [4] and t.read().count() == 4
    t.compact()
    assert t.read().count() == 4


def test_partitioned_upsert_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "p")
    schema = "id int, v string, d string"
    upsert(spark, frame(spark, [(1, "a", "x"), (2, "b", "y"), (3, "c", "z")], schema), path, ["id"], ["d"])
    upsert(spark, frame(spark, [(2, "B", "y"), (3, "C", "x")], schema), path, ["id"], ["d"])
    t = SnapshotTable(spark, path, ["d"])
    assert sorted((r["id"], r["v"], r["d"]) for r in t.read().collect()) == [(1, "a", "x"), (2, "B", "y"), (3, "C", "x")]


def test_retention(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [(1, "2024-01-01"), (2, "2024-01-10"), (3, "2024-01-11")]
    SnapshotTable(spark, path, ["d"]).overwrite(frame(spark, rows, "id int, d string"))
    assert drop_old_partitions(spark, path, "d", 20, dt.date(2024, 1, 30)) == ["d=2024-01-01"]
    assert SnapshotTable(spark, path, ["d"]).read().count() == 2
    assert drop_old_partitions(spark, path, "d", 20, dt.date(2024, 1, 30)) == []


def test_scd2(spark, tmp_path):
    path, at = str(tmp_path / "s"), lambda d: F.lit(d).cast("timestamp")
    one = frame(spark, [(1, "a"), (2, None)])
    assert apply_scd2(spark, one, path, ["id"], ["v"], at("2024-01-01")) == {"new": 2, "updated": 0, "unchanged": 0}
    assert apply_scd2(spark, one, path, ["id"], ["v"], at("2024-01-02")) == {"new": 0, "updated": 0, "unchanged": 2}
    two = frame(spark, [(1, "a"), (2, "b"), (3, "c")])
    assert apply_scd2(spark, two, path, ["id"], ["v"], at("2024-01-03")) == {"new": 1, "updated": 1, "unchanged": 1}
    rows = SnapshotTable(spark, path).read().orderBy("id", "effective_from").collect()
    old, new = [r for r in rows if r["id"] == 2]
    assert old["effective_to"] == new["effective_from"] == dt.datetime(2024, 1, 3) and not old["is_current"] and new["is_current"]
    assert len(rows) == 4


def test_checksum_and_validation(spark):
    df = frame(spark, [(i, None if i % 2 else "x") for i in range(50)])
    assert checksum(df).first() == checksum(df.repartition(7)).first()
    assert checksum(df).first() != checksum(df.union(df.limit(1)).union(df.limit(1))).first()
    assert validate_load(df, df)["checksums_match"]
    with pytest.raises(ValueError):
        validate_load(df, df.limit(3))


def test_upsert_sql():
    sql = upsert_sql("t", "t_staging", ["id", "v", "updated_at"], ["id"])
    assert sql == 'INSERT INTO t ("id", "v") SELECT "id", "v" FROM t_staging ON CONFLICT ("id") DO UPDATE SET "v" = EXCLUDED."v", "updated_at" = NOW()'
    assert upsert_sql("t", "s", ["id"], ["id"]).endswith("DO NOTHING")


def rec(*fields):
    return {"type": "record", "name": "R", "fields": list(fields)}


A, B = {"name": "a", "type": "int"}, {"name": "b", "type": "string"}


def test_compatibility():
    with_default = B | {"default": ""}
    assert compatible(rec(A, with_default), [rec(A)], "BACKWARD") == []
    assert compatible(rec(A, B), [rec(A)], "BACKWARD")
    assert compatible(rec(A, B), [rec(A)], "FORWARD") == []
    assert compatible(rec({"name": "a", "type": "long"}), [rec(A)], "BACKWARD") == []
    assert compatible(rec({"name": "a", "type": "long"}), [rec(A)], "FULL")
    assert compatible(rec(A, B), [rec(A, B), rec(A, with_default)], "BACKWARD") == []
    assert compatible(rec(A, B), [rec(A), rec(A, B)], "BACKWARD_TRANSITIVE")
    nullable = {"name": "a", "type": ["null", "int"], "default": None}
    assert compatible(rec(nullable), [rec(A)], "BACKWARD") == [] and compatible(rec(A), [rec(nullable)], "BACKWARD")
    enum = lambda *s: rec({"name": "e", "type": {"type": "enum", "name": "E", "symbols": list(s)}})
    assert compatible(enum("x", "y"), [enum("x")], "BACKWARD") == [] and compatible(enum("x"), [enum("x", "y")], "BACKWARD")


def test_registry():
    r = SchemaRegistry()
    first = r.register("s", rec(A))
    assert r.register("s", rec(A)) == first
    with pytest.raises(IncompatibleSchemaError):
        r.register("s", rec(A, B))
    assert r.evolve("s", rec(A, B), "NONE")["version"] == 2 and r.level("s") == "BACKWARD"
    assert r.get("s", 1)["version"] == 1 and r.get("s")["version"] == 2 and r.get_by_id(first["id"]) == r.get("s", 1)
    with pytest.raises(SchemaNotFoundError):
        r.get("zz")
    assert r.versions("s") == [1, 2]


@pytest.mark.parametrize("parts", [["a"], ["a", "b"]])
def test_upsert_keeps_rows_of_other_partitions(spark, tmp_path, parts):
    schema = "id int, a string, b string, v int"
    path = str(tmp_path / "t")
    upsert(spark, spark.createDataFrame([(1, "x", "p", 0), (2, "x", "q", 0), (3, "y", "p", 0), (4, None, "p", 0), (5, "a/b=c", None, 0)], schema), path, ["id"], parts)
    got = upsert(spark, spark.createDataFrame([(1, "x", "p", 1), (4, "y", "p", 1), (5, None, None, 1), (6, None, "q", 1)], schema), path, ["id"], parts)
    assert got == {"inserted": 1, "updated": 3, "deleted": 0}
    table = SnapshotTable(spark, path, parts)
    assert sorted((r["id"], r["a"], r["b"], r["v"]) for r in table.read().collect()) == [(1, "x", "p", 1), (2, "x", "q", 0), (3, "y", "p", 0), (4, "y", "p", 1), (5, None, None, 1), (6, None, "q", 1)]
    assert table.versions() == [1, 2]  # one commit, though a partition was emptied


def test_half_written_version_is_not_read_nor_built_upon(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table.overwrite(spark.range(3).toDF("id"))
    table._fs.create(table._manifest(2), False).close()
    assert table.read().count() == 3
    with pytest.raises(ConcurrentWriteError):
        table.append(spark.range(1).toDF("id"))
