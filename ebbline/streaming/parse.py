"""Envelopes to events; what can't be parsed goes to the dead letters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ebbline.functions import parse_timestamp
from ebbline.model import ENVELOPE, STREAM_EVENT

#: Names that consumers read, by the envelope's own.
NAMES = {
    "key": "kafka_key",
    "value": "raw_json",
    "topic": "kafka_topic",
    "partition": "kafka_partition",
    "offset": "kafka_offset",
    "timestamp": "kafka_timestamp",
    "timestampType": "kafka_timestamp_type",
}
ERROR_TYPE = "parse_error"
#: What a message must carry to be an event.
REQUIRED = ("event_id",)


def parse_envelope(stream: DataFrame, schema: T.StructType = STREAM_EVENT, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    """The envelope under its public names, with ``parsed``, ``reason`` and ``is_valid``.

    ``reason`` says why a message is no event (null for one): no JSON object, or which
    required field it lacks. Binary fields are read as text; envelope fields that the
    source doesn't have are null.
    """
    have = set(stream.columns)
    text = {f.name for f in ENVELOPE.fields if isinstance(f.dataType, T.BinaryType)}

    def field(f: T.StructField) -> Column:
        c = F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType)
        return c.cast("string") if f.name in text else c

    out = stream.select(*[field(f).alias(NAMES[f.name]) for f in ENVELOPE.fields])
    out = out.withColumn("parsed", F.from_json(NAMES["value"], schema, {"mode": "PERMISSIVE"}))
    lacks = [F.when(F.col(f"parsed.{c}").isNull(), F.lit(f"no {c}")) for c in required]
    return out.withColumn("reason", F.coalesce(F.when(F.col("parsed").isNull(), F.lit("no object")), *lacks)).withColumn("is_valid", F.col("reason").isNull())


def valid_events(parsed: DataFrame) -> DataFrame:
    """The events with typed times and where they come from."""
    lineage = {"kafka_timestamp": "kafka_ingested_at", "kafka_topic": "kafka_topic", "kafka_partition": "kafka_partition", "kafka_offset": "kafka_offset"}
    out = parsed.where("is_valid").select("parsed.*", *[F.col(a).alias(b) for a, b in lineage.items()])
    timed = reduce(lambda d, x: d.withColumn(*x), [("event_timestamp", parse_timestamp("timestamp")), ("event_date", F.to_date("event_timestamp")), ("processing_time", F.current_timestamp())], out)
    return timed.drop("timestamp")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """The other messages as they came, with the time and kind of the error."""
    envelope = [c for n, c in NAMES.items() if n != "timestampType"]
    return parsed.where("not is_valid").select(*envelope, F.current_timestamp().alias("error_timestamp"), F.lit(ERROR_TYPE).alias("error_type"))
