"""Upsert into a relational table: parallel staging write, then one statement."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame


def upsert_sql(table: str, staging: str, columns: Sequence[str], keys: Sequence[str], updated_at: str | None = "updated_at") -> str:
    """INSERT ... ON CONFLICT; without non-key columns conflicting rows are left alone."""
    named = [c for c in columns if c != updated_at]
    cols = ", ".join(f'"{c}"' for c in named)
    sets = [f'"{c}" = EXCLUDED."{c}"' for c in named if c not in keys]
    if updated_at and sets:
        sets.append(f'"{updated_at}" = NOW()')
    action = f"DO UPDATE SET {', '.join(sets)}" if sets else "DO NOTHING"
    conflict = ", ".join(f'"{k}"' for k in keys)
    return f"INSERT INTO {table} ({cols}) SELECT {cols} FROM {staging} ON CONFLICT ({conflict}) {action}"


def write_jdbc_upsert(df: DataFrame, url: str, table: str, keys: Sequence[str], properties: dict[str, str], execute: Callable[[str], None] | None = None, batch_size: int = 10_000) -> str:
    """Write ``<table>_staging`` from the executors and run the statement once on the driver."""
    staging = f"{table}_staging"
    df.write.mode("overwrite").option("batchsize", batch_size).option("truncate", "true").jdbc(url, staging, properties=properties)
    sql = upsert_sql(table, staging, df.columns, keys)
    if execute is None:
        manager = df.sparkSession.sparkContext._jvm.java.sql.DriverManager
        connection = manager.getConnection(url, properties.get("user", ""), properties.get("password", ""))
        try:
            connection.createStatement().executeUpdate(sql)
        finally:
            connection.close()
    else:
        execute(sql)
    return sql
