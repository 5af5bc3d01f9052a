"""A local schema registry for Avro records, with compatibility computed here."""

from __future__ import annotations

import json
import threading
from typing import Any

LEVELS = ("NONE", "BACKWARD", "BACKWARD_TRANSITIVE", "FORWARD", "FORWARD_TRANSITIVE", "FULL", "FULL_TRANSITIVE")
#: What a writer's type may be read as.
PROMOTIONS = {"int": {"long", "float", "double"}, "long": {"float", "double"}, "float": {"double"}, "string": {"bytes"}, "bytes": {"string"}}


class SchemaRegistryError(Exception):
    pass


class SchemaNotFoundError(SchemaRegistryError):
    pass


class IncompatibleSchemaError(SchemaRegistryError):
    pass


def _kind(t: Any) -> str:
    return "union" if isinstance(t, list) else t["type"] if isinstance(t, dict) and isinstance(t["type"], str) else _kind(t["type"]) if isinstance(t, dict) else t


def can_read(reader: Any, writer: Any, at: str = "") -> list[str]:
    """Why data of ``writer`` can't be read as ``reader``; empty if it can."""
    r, w = _kind(reader), _kind(writer)
    if w == "union":
        return [e for branch in writer for e in can_read(reader, branch, at)]
    if r == "union":
        return [] if any(not can_read(branch, writer, at) for branch in reader) else [f"{at}: {w} isn't in the union"]
    if r != w:
        return [] if r in PROMOTIONS.get(w, ()) else [f"{at}: {w} can't be read as {r}"]
    if r == "record":
        have = {f["name"]: f for f in writer["fields"]}
        out = []
        for f in reader["fields"]:
            other = next((have[n] for n in (f["name"], *f.get("aliases", ())) if n in have), None)
            if other is None:
                if "default" not in f:
                    out.append(f"{at}.{f['name']}: new field without default")
            else:
                out += can_read(f["type"], other["type"], f"{at}.{f['name']}")
        return out
    if r == "enum":
        gone = set(writer["symbols"]) - set(reader["symbols"])
        return [f"{at}: symbols {sorted(gone)} are unknown"] if gone and "default" not in reader else []
    if r == "array":
        return can_read(reader["items"], writer["items"], f"{at}[]")
    if r == "map":
        return can_read(reader["values"], writer["values"], f"{at}{{}}")
    return []


def compatible(new: dict, versions: list[dict], level: str) -> list[str]:
    """Why ``new`` breaks ``level`` against earlier versions, newest last."""
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}")
    if level == "NONE" or not versions:
        return []
    against = versions if level.endswith("_TRANSITIVE") else versions[-1:]
    out = []
    for old in against:
        if not level.startswith("FORWARD"):
            out += can_read(new, old)
        if not level.startswith("BACKWARD"):
            out += can_read(old, new)
    return out


class SchemaRegistry:
    """Subjects with versions. Every lookup returns {id, subject, version, schema}."""

    def __init__(self, default_level: str = "BACKWARD"):
        self._lock = threading.RLock()
        self._default, self._levels = default_level, {}
        self._versions: dict[str, list[dict]] = {}
        self._ids: dict[str, int] = {}

    def register(self, subject: str, schema: dict) -> dict:
        with self._lock:
            known = self._versions.setdefault(subject, [])
            text = json.dumps(schema, sort_keys=True)
            for entry in known:
                if json.dumps(entry["schema"], sort_keys=True) == text:
                    return dict(entry)
            errors = compatible(schema, [e["schema"] for e in known], self.level(subject))
            if errors:
                raise IncompatibleSchemaError("; ".join(errors))
            entry = {"id": self._ids.setdefault(text, len(self._ids) + 1), "subject": subject, "version": len(known) + 1, "schema": schema}
            known.append(entry)
            return dict(entry)

    def get(self, subject: str, version: int | str = "latest") -> dict:
        with self._lock:
            known = self._versions.get(subject)
            if not known or (version != "latest" and not 1 <= int(version) <= len(known)):
                raise SchemaNotFoundError(f"{subject} {version}")
            return dict(known[-1] if version == "latest" else known[int(version) - 1])

    def get_by_id(self, schema_id: int) -> dict:
        with self._lock:
            for known in self._versions.values():
                for entry in known:
                    if entry["id"] == schema_id:
                        return dict(entry)
        raise SchemaNotFoundError(str(schema_id))

    def subjects(self) -> list[str]:
        return sorted(self._versions)

    def versions(self, subject: str) -> list[int]:
        return [e["version"] for e in self._versions.get(subject, [])]

    def level(self, subject: str) -> str:
        return self._levels.get(subject, self._default)

    def set_level(self, subject: str, level: str) -> None:
        if level not in LEVELS:
            raise ValueError(f"unknown level {level!r}")
        self._levels[subject] = level

    def check(self, subject: str, schema: dict) -> list[str]:
        return compatible(schema, [e["schema"] for e in self._versions.get(subject, [])], self.level(subject))

    def evolve(self, subject: str, schema: dict, level: str | None = None) -> dict:
        """Register under another level for this once."""
        with self._lock:
            before = self._levels.get(subject)
            if level:
                self.set_level(subject, level)
            try:
                return self.register(subject, schema)
            finally:
                if level:
                    if before is None:
                        self._levels.pop(subject, None)
                    else:
                        self._levels[subject] = before


#: Avro type names of Spark's.
_SPARK_TO_AVRO = {"string": "string", "bigint": "long", "int": "int", "double": "double", "float": "float", "boolean": "boolean", "binary": "bytes"}


def avro_of(schema, name: str = "Event", enums: dict[str, list[str]] | None = None, required: tuple[str, ...] = ()) -> dict:
    """An Avro record for a StructType; fields outside ``required`` are nullable with default null."""
    fields = []
    for f in schema:
        kind: Any = {"type": "enum", "name": f"{f.name.title().replace('_', '')}", "symbols": enums[f.name]} if enums and f.name in enums else _SPARK_TO_AVRO[f.dataType.simpleString()]
        fields.append({"name": f.name, "type": kind} if f.name in required else {"name": f.name, "type": ["null", kind], "default": None})
    return {"type": "record", "name": name, "fields": fields}
