"""Session settings the jobs are tuned for."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Texts grow several times when read from parquet and scanning them is bound
# by the CPU, so splits are smaller than Spark's default.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.files.maxPartitionBytes": str(32 << 20),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.filterPushdown": "true",
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("pagesieve")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints and tables that must outlive an executor.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Only a
    session whose tasks run in the driver's own process may leave that unset and
    gets a temporary folder; on a cluster executors would not share one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        return tempfile.mkdtemp(prefix=f"pagesieve-{name}-")
    token = os.urandom(8).hex()
    return f"{root.rstrip('/')}/pagesieve-{name}-{token}"
