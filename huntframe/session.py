"""Session helpers: local sessions for tests and bench, and lineage cuts for clusters."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
_scratch: list[str] = []


def local_session(cpus: str = "*", app: str = "huntframe", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session for tests and the bench; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("HUNTFRAME_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def shared_dir(spark: SparkSession) -> str | None:
    """The shared folder for intermediate tables, or None on a cluster that names none.

    The cluster's ``spark.checkpoint.dir`` always wins. Only a local session, where driver and
    executors are one process, falls back to a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if configured:
        return configured
    if not _is_local(spark):
        return None
    path = tempfile.mkdtemp(prefix="huntframe-")
    spark.conf.set(CHECKPOINT_CONF, path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for one intermediate table or stream checkpoint inside the shared folder."""
    base = shared_dir(spark)
    if base is None:
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a table's folder, if it is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def clean_scratch(spark: SparkSession) -> None:
    """Deletes the intermediate tables this process made. Call it when their readers are done, at a session's end."""
    while _scratch:
        delete_path(spark, _scratch.pop())


def cut_lineage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Writes a selective intermediate once, so that several consumers do not rescan the source.

    The table lies in the shared folder, so lost executors do not lose it, readers take only the columns
    they need, and its real size decides whether it is broadcast. A cluster without a shared folder is an error.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
