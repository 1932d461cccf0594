"""Session construction and shared-folder resolution.

On a cluster the session is created by the launcher; these helpers only fill
in settings that are unset (tests and local runs).
"""
from __future__ import annotations

import contextlib
import os
import tempfile
from collections.abc import Iterator

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "shopsignal") -> SparkSession:
    """Return the active session, or build a local one with sane defaults."""
    active = SparkSession.getActiveSession()
    if active is not None:
        ensure_checkpoint_dir(active)
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder named by ``spark.checkpoint.dir``; set one only if unset.

    A fresh local folder is used only when nothing is configured (tests, laptops).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder on the cluster")
        configured = tempfile.mkdtemp(prefix="shopsignal-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written inside leaves no shuffle files: Spark removes those of a query when it ends, not when the driver
    happens to collect its garbage. For queries whose result lies in the shared folder, where nothing reads the files again.
    A DataFrame takes the setting as it is made, so one that is checkpointed is made inside."""
    old = spark.conf.get(FILE_CLEANUP, None)
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(FILE_CLEANUP)
        else:
            spark.conf.set(FILE_CLEANUP, old)


def remove_shared(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder: its checkpoints, intermediate tables and default
    artefact folders (Spark gives every application a folder of its own below ``spark.checkpoint.dir``).

    Call it when no result is needed any more: DataFrames that read intermediate tables cannot be computed after it. The
    next query starts a new folder. Without the call nothing is deleted but checkpoints whose DataFrames
    are gone, where ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set.
    """
    from shopsignal.plans import context
    context.clear()
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        path = sc._jvm.org.apache.hadoop.fs.Path(current)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
        sc.setCheckpointDir(current.rstrip("/").rsplit("/", 1)[0])


def default_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
