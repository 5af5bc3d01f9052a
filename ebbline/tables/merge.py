"""Upserts: matched rows are replaced, others inserted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.tables.snapshot import SnapshotTable


def merge_frame(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The target after the merge; columns that only the source has are added, null in old rows."""
    kept = target.join(source.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def merge_counts(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: inserted, updated, deleted."""
    hit = source.join(target.select(*keys).distinct().withColumn("__hit", F.lit(True)), list(keys), "left")
    return hit.agg(F.count_if(F.col("__hit").isNull()).alias("inserted"), F.count_if(F.col("__hit")).alias("updated"), F.lit(0).cast("long").alias("deleted"))


def _in_partitions(rows: DataFrame, parts: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Rows whose partition is (not) in ``parts``; null is a partition like any other."""
    side = parts.toDF(*[f"__part{i}" for i in range(len(columns))])
    on = [F.col(f"`{c}`").eqNullSafe(F.col(f"__part{i}")) for i, c in enumerate(columns)]
    return rows.join(side, on, how)


def upsert(spark: SparkSession, source: DataFrame, path: str, keys: Sequence[str], partition_by: Sequence[str] = ()) -> dict[str, int]:
    """Merge into the snapshot table at ``path``, made on first use; only touched partitions are rewritten.

    The source is read once into the new version: it is stored before anything is
    published. A key that occurs twice in the source is an error.
    """
    if source.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        raise ValueError(f"several source rows for one key {list(keys)}")
    table = SnapshotTable(spark, path, partition_by)
    if not table.exists():
        n = source.count()
        table.overwrite(source, "create", {"inserted": n, "updated": 0, "deleted": 0})
        return {"inserted": n, "updated": 0, "deleted": 0}
    version = table._next()
    old = table.read()
    counts = {k: int(v or 0) for k, v in merge_counts(old, source, keys).first().asDict().items()}
    merged = merge_frame(old, source, keys)
    if partition_by:
        # a row may leave its old partition: both the old and the new one are rewritten, in one version
        left = old.join(source.select(*keys).distinct(), list(keys), "left_semi").select(*partition_by)
        touched = source.select(*partition_by).union(left).distinct()
        merged = _in_partitions(merged, touched, partition_by, "left_semi")
        emptied = _in_partitions(left.distinct(), merged.select(*partition_by).distinct(), partition_by, "left_anti")
        names = [table.spec_of(r) for r in emptied.select(*[F.col(c).cast("string") for c in partition_by]).collect()]  # folders, not rows
        table.replace_partitions(merged, "merge", counts, version, names)
    else:
        table.overwrite(merged, "merge", counts, version)
    return counts
