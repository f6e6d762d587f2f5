"""Spark session and shared-storage helpers.

On a cluster the session is created by the platform; the helpers here only
fill in settings that are unset (tests, local runs) and never override what
the cluster configured.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings applied only when the session does not already carry a value.
LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int = 8, app: str = "sectio",
              extra: dict[str, str] | None = None) -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    builder = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("SECTIO_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in {**LOCAL_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts.

    A checkpoint folder that the context already has stays. Otherwise it is
    read from ``spark.checkpoint.dir``. Only in local mode, where driver and
    executors are one process, a scratch folder is made if neither is set; on a
    cluster that is an error, as executors cannot see the driver's disk.
    """
    sc = spark.sparkContext
    held = sc.getCheckpointDir()
    if held:
        return held
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = sc.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="sectio-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir()


def write_shared(df: DataFrame) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared checkpoint folder. Its
    files stay until the cluster clears the folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/sectio-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (never local).

    (Persisting the rows around the write was measured slower at sf0.1 than
    letting the checkpoint job recompute them, so it is not done.)"""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
