"""Intermediate tables under a path that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

SHARED_DIR = "spark.checkpoint.dir"
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, as the session names it; a session on one machine, as in tests, may do without and gets one of its own."""
    configured = spark.conf.get(SHARED_DIR, None)
    if configured:
        return configured.rstrip("/")
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"set {SHARED_DIR} to a folder that all executors share")
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="staged-")
    return _own[app]


def staged(df: DataFrame, path: str) -> DataFrame:
    """Write the frame as Parquet and read it back.

    What follows then reads only the columns it needs, any number of times, and a lost executor costs a re-read
    instead of a recomputation.
    """
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
