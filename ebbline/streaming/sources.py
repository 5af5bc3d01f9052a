"""Streams of message envelopes: a broker where its connector is present, files elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.model import ENVELOPE


def kafka_options(servers: str, topic: str, starting: str = "latest", max_offsets: int = 100_000) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "maxOffsetsPerTrigger": str(max_offsets), "failOnDataLoss": "false"}


def kafka_envelopes(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Needs the connector's jar on the class path."""
    return spark.readStream.format("kafka").options(**kafka_options(servers, topic, **options)).load()


def file_envelopes(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """JSON lines as envelopes, one message a line; the path stands for the topic."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.select(
        F.lit(None).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit(path).alias("topic"),
        F.lit(0).alias("partition"),
        F.lit(0).cast("bigint").alias("offset"),
        F.current_timestamp().alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def envelope_columns() -> list[str]:
    return ENVELOPE.fieldNames()
