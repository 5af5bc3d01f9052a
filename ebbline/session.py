"""Sessions per environment, with object-store and metastore settings."""

from __future__ import annotations

import logging
import os

from pyspark.sql import SparkSession

COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Sizing per environment.
PROFILES: dict[str, dict[str, str]] = {
    "local": {"spark.master": "local[*]", "spark.driver.memory": "2g", "spark.executor.memory": "2g", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.bindAddress": "127.0.0.1"},
    "dev": {"spark.driver.memory": "4g", "spark.executor.instances": "2", "spark.executor.cores": "2", "spark.executor.memory": "4g", "spark.sql.shuffle.partitions": "50", "spark.sql.broadcastTimeout": "600"},
    "staging": {
        "spark.driver.memory": "8g",
        "spark.executor.instances": "4",
        "spark.executor.cores": "4",
        "spark.executor.memory": "8g",
        "spark.sql.shuffle.partitions": "200",
        "spark.dynamicAllocation.enabled": "true",
        "spark.dynamicAllocation.minExecutors": "2",
        "spark.dynamicAllocation.maxExecutors": "10",
    },
    "prod": {
        "spark.executor.instances": "10",
        "spark.executor.cores": "4",
        "spark.executor.memory": "16g",
        "spark.driver.memory": "16g",
        "spark.sql.shuffle.partitions": "400",
        "spark.dynamicAllocation.enabled": "true",
        "spark.dynamicAllocation.minExecutors": "5",
        "spark.dynamicAllocation.maxExecutors": "50",
        "spark.speculation": "true",
        "spark.sql.autoBroadcastJoinThreshold": "50MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64MB",
        "spark.sql.broadcastTimeout": "600",
        "spark.speculation.multiplier": "2",
        "spark.speculation.quantile": "0.9",
        "spark.network.timeout": "600s",
        "spark.rpc.askTimeout": "600s",
    },
}


def detect_environment(env: dict[str, str] | None = None) -> str:
    """``PIPELINE_ENV``, then ``SPARK_ENV``, else local; an unknown name is local too, with a warning."""
    env = os.environ if env is None else env
    name = (env.get("PIPELINE_ENV") or env.get("SPARK_ENV") or "local").strip().lower()
    if name not in PROFILES:
        logging.getLogger(__name__).warning("unknown environment %r, taken as local; known: %s", name, ", ".join(PROFILES))
        return "local"
    return name


def object_store_conf(kind: str, **options: str) -> dict[str, str]:
    """Hadoop settings for s3a, abfss (account, key) or gs (project, keyfile)."""
    if kind == "s3a":
        conf = {"spark.hadoop.fs.s3a.impl": "org.apache.hadoop.fs.s3a.S3AFileSystem"}
        names = {"endpoint": "endpoint", "access_key": "access.key", "secret_key": "secret.key", "path_style": "path.style.access"}
        return conf | {f"spark.hadoop.fs.s3a.{names[k]}": v for k, v in options.items()}
    if kind == "abfss":
        return {f"spark.hadoop.fs.azure.account.key.{options['account']}.dfs.core.windows.net": options["key"]}
    if kind == "gs":
        conf = {"spark.hadoop.fs.gs.impl": "com.google.cloud.hadoop.fs.gcs.GoogleHadoopFileSystem"}
        names = {"project": "fs.gs.project.id", "keyfile": "google.cloud.auth.service.account.json.keyfile"}
        return conf | {f"spark.hadoop.{names[k]}": v for k, v in options.items()}
    raise ValueError(f"unknown object store {kind!r}")


def session_conf(environment: str | None = None, overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Common settings, the environment's, then the caller's own."""
    return COMMON | PROFILES[environment or detect_environment()] | (overrides or {})


def build_session(app_name: str = "ebbline", environment: str | None = None, overrides: dict[str, str] | None = None, hive: bool = False) -> SparkSession:
    builder = SparkSession.builder.appName(app_name).config(map=session_conf(environment, overrides))
    return (builder.enableHiveSupport() if hive else builder).getOrCreate()
