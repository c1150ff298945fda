"""Spark session helpers.

The cluster names its shared checkpoint folder in ``spark.checkpoint.dir``;
we read it from the session and only set our own where it is unset (tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("ebbflow")
    if master:
        builder = builder.master(master)
    spark = (
        builder.config("spark.driver.memory", os.environ.get("EBBFLOW_DRIVER_MEMORY", "16g"))
        .config("spark.sql.adaptive.enabled", "true")
        # The feature stages are CPU-bound window operators over a table that
        # is small in bytes: coalescing shuffle partitions by size would put a
        # whole stage in one task.  Size spark.sql.shuffle.partitions instead.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    if shuffle_partitions:
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder; a private one only when none is named."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    # One JVM: driver and tasks share its disk.
    local = tempfile.mkdtemp(prefix="ebbflow-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return local


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by key into as many partitions as there are keys, ``spark.sql.shuffle.partitions`` at most.

    The series windows are bound by CPU over rows that are small in bytes: a shuffle that AQE may
    coalesce by size puts them, and every pass over their table, into one task.  ``df`` is read twice.
    """
    most = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(1, min(df.select(key).distinct().count(), most)), key)
