"""Copy-on-write snapshot tables, merges, history, retention, checksums and schema rules."""

from ebbline.tables.history import apply_scd2, scd2_frame
from ebbline.tables.jdbc import upsert_sql, write_jdbc_upsert
from ebbline.tables.maintenance import checksum, drop_old_partitions, validate_load
from ebbline.tables.merge import merge_counts, merge_frame, upsert
from ebbline.tables.registry import IncompatibleSchemaError, SchemaNotFoundError, SchemaRegistry, compatible
from ebbline.tables.snapshot import ConcurrentWriteError, SnapshotTable

__all__ = [
    "ConcurrentWriteError",
    "IncompatibleSchemaError",
    "SchemaNotFoundError",
    "SchemaRegistry",
    "SnapshotTable",
    "apply_scd2",
    "checksum",
    "compatible",
    "drop_old_partitions",
    "merge_counts",
    "merge_frame",
    "scd2_frame",
    "upsert",
    "upsert_sql",
    "validate_load",
    "write_jdbc_upsert",
]
