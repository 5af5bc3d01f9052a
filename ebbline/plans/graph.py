"""A graph of models: sources and references resolve lazily to DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ebbline.operators.clean import above_high_water_mark
from ebbline.tables.merge import upsert
from ebbline.tables.snapshot import SnapshotTable


def schema_name(custom: str | None, target: str, default: str) -> str:
    """prod: the bare name; staging: ``stg_`` before it; else the target before it."""
    name = (custom or default).strip()
    if target == "prod":
        return name
    return f"stg_{name}" if target == "staging" else f"{target}_{name}"


@dataclass
class Model:
    build: Callable[[ModelGraph], DataFrame]
    materialized: str = "ephemeral"  # ephemeral, table or incremental
    unique_key: tuple[str, ...] = ()
    high_water_mark: str | None = None


@dataclass
class ModelGraph:
    """Ephemeral models are inlined plans, tables overwrite, incremental ones merge by key."""

    spark: SparkSession
    root: str
    sources: dict[str, Callable[[SparkSession], DataFrame]] = field(default_factory=dict)
    models: dict[str, Model] = field(default_factory=dict)
    _open: list[str] = field(default_factory=list)

    def source(self, name: str) -> DataFrame:
        return self.sources[name](self.spark)

    def table(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{name}")

    def ref(self, name: str) -> DataFrame:
        if name in self._open:
            raise ValueError(f"models refer to each other: {[*self._open, name]}")
        model = self.models[name]
        if model.materialized != "ephemeral" and self.table(name).exists():
            return self.table(name).read()
        self._open.append(name)
        try:
            return model.build(self)
        finally:
            self._open.pop()

    def run(self, name: str, full_refresh: bool = False) -> dict[str, int] | None:
        model, table = self.models[name], self.table(name)
        self._open.append(name)
        try:
            df = model.build(self)
        finally:
            self._open.pop()
        if model.materialized == "ephemeral":
            return None
        if model.materialized == "incremental" and table.exists() and not full_refresh:
            if model.high_water_mark:
                df = above_high_water_mark(df, table.read(), model.high_water_mark)
            return upsert(self.spark, df, table.path, model.unique_key)
        table.overwrite(df, "full_refresh" if full_refresh else "create")
        return {"version": table.versions()[-1]}
