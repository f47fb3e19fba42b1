"""Session settings the library relies on.

Only runtime SQL settings are touched, so the functions work on any session the caller already has.
Cluster sizing (executors, shuffle partitions, memory) stays with the caller.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

RUNTIME_SETTINGS = {
    # every timestamp in the data model is UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # texts are long: a batch handed to Python holds fewer rows than the default
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings once per session and return the session."""
    for key, value in RUNTIME_SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


@contextmanager
def dropping_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query inside go when the query ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for stored tables and stream checkpoints: ``spark.checkpoint.dir``.

    A local folder stands in only where the setting is absent and the session is local (tests); on a cluster
    a missing setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="opswatch-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder
