"""Checks of one DataFrame, evaluated together.

Every check that is a function of a scan contributes columns to one global aggregate, so
that a run reads the data once however many checks there are. Uniqueness adds one grouped
aggregate per key (partial counts first), referential integrity one anti join of distinct
keys, and custom SQL its own query.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Severity(str, Enum):
    CRITICAL = "critical"
    WARNING = "warning"
    INFO = "info"
    FAIL = "critical"
    WARN = "warning"


class Status(str, Enum):
    PASSED = "passed"
    FAILED = "failed"
    WARNING = "warning"
    ERROR = "error"


class DataQualityError(AssertionError):
    """Raised when a critical check hasn't passed."""


@dataclass
class CheckResult:
    name: str
    severity: Severity
    status: Status
    metric_value: float | None = None
    threshold: float | None = None
    message: str = ""
    details: dict[str, Any] = field(default_factory=dict)

    @property
    def passed(self) -> bool:
        return self.status in (Status.PASSED, Status.WARNING)


@dataclass
class Report:
    dataset: str
    row_count: int
    results: list[CheckResult]

    def _with(self, *status: Status) -> list[CheckResult]:
        return [r for r in self.results if r.status in status]

    @property
    def passed_checks(self) -> list[CheckResult]:
        return self._with(Status.PASSED)

    @property
    def failures(self) -> list[CheckResult]:
        return self._with(Status.FAILED, Status.ERROR)

    @property
    def warnings(self) -> list[CheckResult]:
        return [r for r in self.results if r.status is Status.WARNING or (r.status is Status.FAILED and r.severity is Severity.WARNING)]

    @property
    def critical_failures(self) -> list[CheckResult]:
        """Critical checks that failed, or that couldn't be evaluated."""
        return [r for r in self.failures if r.severity is Severity.CRITICAL]

    @property
    def is_success(self) -> bool:
        return not self.critical_failures

    passed = is_success

    def raise_on_failure(self) -> None:
        if not self.is_success:
            raise DataQualityError(f"{self.dataset}: " + "; ".join(f"{r.name}: {r.message}" for r in self.critical_failures))

    def to_json(self) -> str:
        rows = [asdict(r) | {"severity": r.severity.value, "status": r.status.value} for r in self.results]
        return json.dumps({"dataset": self.dataset, "row_count": self.row_count, "is_success": self.is_success, "results": rows}, default=str)

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        schema = "dataset string, check_name string, severity string, status string, metric_value double, threshold double, message string"
        rows = [(self.dataset, r.name, r.severity.value, r.status.value, None if r.metric_value is None else float(r.metric_value), r.threshold, r.message) for r in self.results]
        return spark.createDataFrame(rows, schema)


@dataclass
class Check:
    """A named check; the class methods make the usual ones.

    ``columns`` go into the fused aggregate, ``extra`` runs a query of its own, and
    ``judge`` gets the values by name (with ``n``, the row count).
    """

    name: str
    severity: Severity
    judge: Callable[[dict[str, Any]], CheckResult]
    columns: dict[str, Column] = field(default_factory=dict)
    extra: Callable[[SparkSession, DataFrame], dict[str, Any]] | None = None

    @classmethod
    def not_null(cls, column: str, threshold: float = 0.0, severity: Severity = Severity.CRITICAL) -> Check:
        name = f"not_null({column})"

        def judge(v):
            if not v["n"]:
                return CheckResult(name, severity, Status.WARNING, 0.0, threshold, "no rows")
            share = v["nulls"] / v["n"]
            return _result(name, severity, share <= threshold, share, threshold, f"{v['nulls']} of {v['n']} null")

        return cls(name, severity, judge, {"nulls": F.count_if(F.col(column).isNull())})

    null_check = not_null

    @classmethod
    def unique(cls, column: str, severity: Severity = Severity.CRITICAL) -> Check:
        """Duplicates are rows beyond the distinct values; null is one value."""
        name = f"unique({column})"

        def extra(_, df):
            return df.groupBy(column).agg(F.count("*").alias("c")).agg(F.count("*").alias("distinct")).first().asDict()

        return cls(name, severity, lambda v: _result(name, severity, v["n"] == v["distinct"], v["n"] - v["distinct"], 0.0, f"{v['n'] - v['distinct']} duplicates"), {}, extra)

    @classmethod
    def in_range(cls, column: str, low: float | None = None, high: float | None = None, severity: Severity = Severity.WARNING) -> Check:
        name = f"range({column})"
        c = F.col(column)
        bad = F.lit(False)
        if low is not None:
            bad = bad | (c < low)
        if high is not None:
            bad = bad | (c > high)

        def judge(v):
            return _result(name, severity, not v["bad"], v["bad"] or 0, 0.0, f"{v['bad']} outside [{low}, {high}]", {"min": v["low"], "max": v["high"]})

        return cls(name, severity, judge, {"bad": F.count_if(bad), "low": F.min(c), "high": F.max(c)})

    @classmethod
    def accepted_values(cls, column: str, values: Sequence[Any], severity: Severity = Severity.WARNING) -> Check:
        name = f"accepted_values({column})"
        return cls(name, severity, lambda v: _result(name, severity, not v["bad"], v["bad"], 0.0, f"{v['bad']} unexpected"), {"bad": F.count_if(F.col(column).isNotNull() & ~F.col(column).isin(list(values)))})

    @classmethod
    def regex(cls, column: str, pattern: str, max_violation_pct: float = 0.0, severity: Severity = Severity.CRITICAL) -> Check:
        name = f"regex({column})"

        def judge(v):
            share = 100.0 * v["bad"] / v["some"] if v["some"] else 0.0
            return _result(name, severity, share <= max_violation_pct, share, max_violation_pct, f"{v['bad']} of {v['some']} don't match")

        return cls(name, severity, judge, {"bad": F.count_if(~F.col(column).rlike(pattern)), "some": F.count(column)})

    @classmethod
    def row_count(cls, low: int = 1, high: int | None = None, severity: Severity = Severity.CRITICAL) -> Check:
        name = "row_count"
        return cls(name, severity, lambda v: _result(name, severity, v["n"] >= low and (high is None or v["n"] <= high), v["n"], float(low), f"{v['n']} rows"))

    @classmethod
    def referential_integrity(cls, column: str, reference: DataFrame, reference_column: str, severity: Severity = Severity.CRITICAL) -> Check:
        """Distinct keys without a parent; a null key is one of them."""
        name = f"referential_integrity({column})"

        def extra(_, df):
            parent = reference.select(F.col(reference_column).alias("__p")).distinct()
            return {"orphans": df.select(column).distinct().join(parent, F.col(column) == F.col("__p"), "left_anti").count()}

        return cls(name, severity, lambda v: _result(name, severity, not v["orphans"], v["orphans"], 0.0, f"{v['orphans']} orphan keys"), {}, extra)

    @classmethod
    def schema(cls, expected: T.StructType, severity: Severity = Severity.CRITICAL) -> Check:
        """Missing columns and other types; extra columns and nullability don't matter."""

        def extra(_, df):
            have = {f.name: f.dataType.simpleString() for f in df.schema}
            return {"missing": [f.name for f in expected if f.name not in have], "wrong": [f"{f.name}: {have[f.name]}" for f in expected if f.name in have and have[f.name] != f.dataType.simpleString()]}

        def judge(v):
            found = v["missing"] + v["wrong"]
            return _result("schema", severity, not found, len(found), 0.0, f"missing {v['missing']}, wrong {v['wrong']}")

        return cls("schema", severity, judge, {}, extra)

    @classmethod
    def custom_sql(cls, name: str, sql: str, expected: Any, comparison: str = "eq", severity: Severity = Severity.CRITICAL) -> Check:
        """The first value of a query over ``{df}``, compared: eq, gt, lt, gte, lte or between."""
        compare: dict[str, Callable[[Any], bool]] = {
            "eq": lambda x: x == expected,
            "gt": lambda x: x > expected,
            "lt": lambda x: x < expected,
            "gte": lambda x: x >= expected,
            "lte": lambda x: x <= expected,
            "between": lambda x: expected[0] <= x <= expected[1],
        }

        def extra(spark, df):
            return {"value": spark.sql(sql, df=df).first()[0]}

        def judge(v):
            x = v["value"]
            number = float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else None
            return _result(name, severity, comparison in compare and x is not None and compare[comparison](x), number, None, f"{x} {comparison} {expected}")

        return cls(name, severity, judge, {}, extra)

    @classmethod
    def from_config(cls, spec: dict[str, Any]) -> Check:
        """A check from {"type": ..., ...}: null, unique, range, row_count, accepted_values or regex."""
        spec = dict(spec)
        kind = spec.pop("type")
        if "severity" in spec:
            spec["severity"] = Severity(spec["severity"].lower())
        makers = {"null": cls.not_null, "unique": cls.unique, "range": cls.in_range, "row_count": cls.row_count, "accepted_values": cls.accepted_values, "regex": cls.regex}
        if kind not in makers:
            raise ValueError(f"unknown check type {kind!r}")
        return makers[kind](**spec)


def _result(name, severity, ok, value, threshold, message, details=None) -> CheckResult:
    return CheckResult(name, severity, Status.PASSED if ok else Status.FAILED, value, threshold, message, details or {})


class DataQualityRunner:
    """Collects checks and runs them in order; ``add_*`` methods chain."""

    def __init__(self, spark: SparkSession | None = None, df: DataFrame | None = None, dataset: str = "dataset"):
        self.df, self.dataset, self.checks = df, dataset, []

    def add_check(self, check: Check) -> DataQualityRunner:
        self.checks.append(check)
        return self

    def add_null_check(self, column, threshold=0.0, severity=Severity.CRITICAL):
        return self.add_check(Check.not_null(column, threshold, severity))

    def add_uniqueness_check(self, column, severity=Severity.CRITICAL):
        return self.add_check(Check.unique(column, severity))

    def add_range_check(self, column, min_value=None, max_value=None, severity=Severity.WARNING):
        return self.add_check(Check.in_range(column, min_value, max_value, severity))

    def add_referential_integrity_check(self, column, reference_df, reference_column, severity=Severity.CRITICAL):
        return self.add_check(Check.referential_integrity(column, reference_df, reference_column, severity))

    def add_schema_check(self, expected, severity=Severity.CRITICAL):
        return self.add_check(Check.schema(expected, severity))

    def add_custom_sql_check(self, name, sql, expected, comparison="eq", severity=Severity.CRITICAL):
        return self.add_check(Check.custom_sql(name, sql, expected, comparison, severity))

    def add_row_count_check(self, min_count=1, max_count=None, severity=Severity.CRITICAL):
        return self.add_check(Check.row_count(min_count, max_count, severity))

    def add_accepted_values_check(self, column, values, severity=Severity.WARNING):
        return self.add_check(Check.accepted_values(column, values, severity))

    def run(self, df: DataFrame | None = None) -> Report:
        df = self.df if df is None else df
        spark = df.sparkSession
        fused = {f"c{i}_{k}": c for i, check in enumerate(self.checks) for k, c in check.columns.items()}
        try:
            row = df.agg(F.count("*").alias("n"), *[c.alias(k) for k, c in fused.items()]).first().asDict()
            failed = None
        except Exception as e:  # one bad check must not hide the others: evaluate them apart
            row, failed = {"n": df.count()}, e
        results = []
        for i, check in enumerate(self.checks):
            try:
                if failed is not None and check.columns:
                    values = df.agg(*[c.alias(k) for k, c in check.columns.items()]).first().asDict()
                else:
                    values = {k: row[f"c{i}_{k}"] for k in check.columns}
                values["n"] = row["n"]
                if check.extra:
                    values |= check.extra(spark, df)
                results.append(check.judge(values))
            except Exception as e:
                results.append(CheckResult(check.name, check.severity, Status.ERROR, message=str(e)[:500]))
        return Report(self.dataset, row["n"], results)


def assert_quality(df: DataFrame, required: Sequence[str] = ()) -> DataFrame:
    """The frame itself, or ValueError if it is empty or a required column holds nulls."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in required]).first()
    if not row["n"]:
        raise ValueError("DataFrame is empty")
    bad = [c for c in required if row[c]]
    if bad:
        raise ValueError(f"nulls in {bad}")
    return df
