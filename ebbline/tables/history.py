"""Slowly changing dimensions of type 2."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.functions import row_hash
from ebbline.operators.enrich import changed_rows
from ebbline.tables.snapshot import SnapshotTable

VALIDITY = ("effective_from", "effective_to", "is_current", "row_hash")


def first_versions(source: DataFrame, tracked: Sequence[str], effective: Column) -> DataFrame:
    return source.withColumns({"effective_from": effective, "effective_to": F.lit(None).cast("timestamp"), "is_current": F.lit(True), "row_hash": row_hash(tracked)})


def scd2_frame(dimension: DataFrame, source: DataFrame, keys: Sequence[str], tracked: Sequence[str], effective: Column) -> DataFrame:
    """The dimension after the load: expired, new and untouched versions.

    ``effective`` must be a literal or a source column; it closes the old version and
    opens the new one. Keys that the source lacks stay as they are.
    """
    marked = changed_rows(source, dimension.where("is_current").select(*keys, *tracked), keys, tracked)
    fresh = first_versions(marked.where("change <> 'unchanged'").drop("change"), tracked, effective)
    closing = marked.where("change = 'changed'").withColumn("__end", effective).select(*keys, "__end")
    joined = dimension.join(closing, list(keys), "left")
    ends = F.col("is_current") & F.col("__end").isNotNull()
    old = joined.withColumns({"effective_to": F.when(ends, F.col("__end")).otherwise(F.col("effective_to")), "is_current": F.when(ends, F.lit(False)).otherwise(F.col("is_current"))})
    return old.drop("__end").select(*dimension.columns).unionByName(fresh, allowMissingColumns=True)


def apply_scd2(spark: SparkSession, source: DataFrame, path: str, keys: Sequence[str], tracked: Sequence[str], effective: Column | None = None) -> dict[str, int]:
    """Load into the snapshot table at ``path``; returns new, updated, unchanged. One commit."""
    table = SnapshotTable(spark, path)
    if effective is None:
        effective = F.lit(spark.sql("select current_timestamp() as t").first()["t"])  # one clock for the whole load
    if source.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"several source rows for one key {list(keys)}")
    if not table.exists():
        n = source.count()
        table.overwrite(first_versions(source, tracked, effective), "scd2", {"new": n, "updated": 0, "unchanged": 0})
        return {"new": n, "updated": 0, "unchanged": 0}
    version = table._next()
    old = table.read()
    found = changed_rows(source, old.where("is_current").select(*keys, *tracked), keys, tracked).groupBy("change").agg(F.count("*").alias("n")).collect()
    by = {r["change"]: r["n"] for r in found}
    counts = {"new": by.get("new", 0), "updated": by.get("changed", 0), "unchanged": by.get("unchanged", 0)}
    if counts["new"] or counts["updated"]:
        table.overwrite(scd2_frame(old, source, keys, tracked, effective), "scd2", counts, version)
    return counts
