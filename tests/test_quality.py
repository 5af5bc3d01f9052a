import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.quality import Check, DataQualityError, DataQualityRunner, Expectation, Severity, Status, generic, run_suite


@pytest.fixture()
def people(spark):
    rows = [
        (1, "Alice", "alice@example.com", 30, 85.5),
        (2, "Bob", "bob@example.com", 25, 92.0),
        (3, None, "charlie@example.com", 35, 78.3),
        (4, "Diana", None, 28, 95.1),
        (5, "Eve", "invalid-email", 22, 88.7),
        (1, "Alice Dup", "alice2@example.com", 30, 85.5),
    ]
    return spark.createDataFrame(rows, "id int, name string, email string, age int, score double")


def run(df, *checks):
    r = DataQualityRunner()
    for c in checks:
        r.add_check(c)
    return r.run(df)


EMAIL = r"^[^@]+@[^@]+\.[a-z]+$"


def test_checks(people):
    rep = run(
        people,
        Check.not_null("id"),
        Check.not_null("name"),
        Check.not_null("name", 0.5),
        Check.unique("id"),
        Check.unique("email"),
        Check.in_range("age", 18, 100),
        Check.in_range("age", 25, 33),
        Check.regex("email", EMAIL),
        Check.regex("email", EMAIL, 30.0),
        Check.accepted_values("name", ["Alice", "Bob"]),
        Check.row_count(7),
        Check.custom_sql("top", "select max(age) from {df}", [30, 40], "between"),
        Check.custom_sql("odd", "select 1 from {df}", 1, "nonsense"),
        Check.custom_sql("broken", "select nothing_here from {df}", 1),
    )
    assert [r.status.value for r in rep.results] == ["passed", "failed", "passed", "failed", "passed", "passed", "failed", "failed", "passed", "failed", "failed", "passed", "failed", "error"]
    assert rep.results[3].metric_value == 1
    assert not rep.is_success and "broken" in [r.name for r in rep.critical_failures]
    with pytest.raises(DataQualityError):
        rep.raise_on_failure()


def test_severity(people):
    assert run(people, Check.not_null("name", severity=Severity.WARN)).passed
    assert not run(people, Check.not_null("name", severity=Severity.FAIL)).passed


def test_empty_frame(spark, people):
    rep = run(people.limit(0), Check.not_null("id"), Check.in_range("age", 1, 2), Check.unique("id"), Check.row_count())
    assert [r.status for r in rep.results] == [Status.WARNING, Status.PASSED, Status.PASSED, Status.FAILED]


def test_schema_and_references(spark, people):
    want = T.StructType([T.StructField("id", T.LongType()), T.StructField("gone", T.StringType()), T.StructField("age", T.IntegerType())])
    assert run(people, Check.schema(want)).results[0].metric_value == 2
    parent = spark.createDataFrame([("Alice",), ("Bob",)], "n string")
    assert run(people, Check.referential_integrity("name", parent, "n")).results[0].metric_value == 4


def test_one_bad_column_does_not_hide_the_others(people):
    rep = run(people, Check.not_null("nope"), Check.not_null("id"))
    assert [r.status for r in rep.results] == [Status.ERROR, Status.PASSED]


def test_config_and_report(spark, people):
    rep = run(people, Check.from_config({"type": "null", "column": "id", "severity": "WARNING"}), Check.from_config({"type": "range", "column": "age", "low": 0}))
    assert rep.to_dataframe(spark).count() == 2 and '"is_success": true' in rep.to_json()
    with pytest.raises(ValueError):
        Check.from_config({"type": "x"})


def test_suite(people):
    seen = []
    out = run_suite(
        people,
        [Expectation("column_exists", "id"), Expectation("column_exists", "zz"), Expectation("not_null", "name", 0.8), Expectation("unique", "id"), Expectation("between", "age", 0.6, {"low": 25, "high": 33}), Expectation("pair_ge", "score", 1.0, {"other": "age"}), Expectation("row_count", None, 1.0, {"low": 7})],
        [seen.append],
    )
    assert [r["success"] for r in out] == [True, False, True, False, True, True, False]
    assert out[3]["unexpected"] == 2 and seen == [out]


def test_generic_tests(spark, people):
    assert generic.not_null(people, "name").count() == 1
    assert generic.unique(people, "id").first()["n_records"] == 2
    assert generic.within_range(people, "age", 25).count() == 1
    assert generic.valid_email_format(people, "email").first()[0] == "invalid-email"
    assert generic.consistent_row_count(people, 5).count() == 0 and generic.consistent_row_count(people, 10).count() == 1
    times = spark.sql("select timestamp'2024-01-01 00:00:00' as t")
    at = F.lit("2024-01-02 01:00:00").cast("timestamp")
    assert generic.not_stale(times, "t", at).count() == 1 and generic.not_stale(times, "t", at, 48).count() == 0
    assert generic.source_freshness(times, "t", at).first()["state"] == "error"
    child, parent = spark.createDataFrame([(1,), (2,), (None,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert generic.no_orphaned_keys(child, "k", parent, "k").count() == 1
