"""Expectation suites with ``mostly`` tolerances, evaluated in one aggregate."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Expectation:
    """kind: column_exists, not_null, unique, between, in_set, regex, pair_ge or row_count."""

    kind: str
    column: str | None = None
    mostly: float = 1.0
    args: dict[str, Any] = field(default_factory=dict)

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column or ''})"


def _parts(e: Expectation):
    """(rows that count, rows that fail)."""
    c = F.col(e.column) if e.column else None
    some = F.count(c) if c is not None else F.count("*")
    if e.kind == "not_null":
        return F.count("*"), F.count_if(c.isNull())
    if e.kind == "between":
        low, high = e.args.get("low"), e.args.get("high")
        bad = F.lit(False)
        bad = bad | (c < low) if low is not None else bad
        return some, F.count_if(bad | (c > high) if high is not None else bad)
    if e.kind == "in_set":
        return some, F.count_if(~c.isin(list(e.args["values"])))
    if e.kind == "regex":
        return some, F.count_if(~c.rlike(e.args["pattern"]))
    if e.kind == "pair_ge":
        other = F.col(e.args["other"])
        both = c.isNotNull() & other.isNotNull()
        return F.count_if(both), F.count_if(both & (c < other))
    raise ValueError(f"unknown expectation {e.kind!r}")


def run_suite(df: DataFrame, suite: Sequence[Expectation], actions: Sequence[Callable[[list[dict]], None]] = ()) -> list[dict[str, Any]]:
    """One result per expectation, in order: name, success, total, unexpected, ratio.

    Scan-type expectations share one aggregate; each uniqueness check is a grouped one,
    where every row of a repeated value fails. ``actions`` get the results at the end.
    """
    have = set(df.columns)
    scans = [i for i, e in enumerate(suite) if e.kind not in ("column_exists", "unique", "row_count") and (not e.column or e.column in have)]
    cols = [F.count("*").alias("n")]
    for i in scans:
        total, bad = _parts(suite[i])
        cols += [total.alias(f"t{i}"), bad.alias(f"b{i}")]
    row = df.agg(*cols).first()
    out = []
    for i, e in enumerate(suite):
        total, bad = row["n"], 0
        if e.kind == "column_exists" or (e.column and e.column not in have):
            ok = e.column in have
            bad = 0 if ok else total
        elif e.kind == "row_count":
            ok = e.args.get("low", 0) <= total <= e.args.get("high", float("inf"))
        else:
            if e.kind == "unique":
                groups = df.where(F.col(e.column).isNotNull()).groupBy(e.column).agg(F.count("*").alias("c"))
                r = groups.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("b")).first()
                total, bad = r["t"], r["b"]
            else:
                total, bad = row[f"t{i}"], row[f"b{i}"]
            ok = not total or (total - bad) / total >= e.mostly
        out.append({"name": e.name, "success": bool(ok), "total": int(total), "unexpected": int(bad), "ratio": 1.0 if not total else (total - bad) / total})
    for act in actions:
        act(out)
    return out


__all__ = ["Expectation", "Window", "run_suite"]
