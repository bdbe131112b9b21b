"""Session settings the operators are written for, and the shared work folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# AQE does three jobs here: it coalesces the many small post-aggregation partitions, turns a join into
# a broadcast only after it has measured the side, and splits skewed sort-merge partitions.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(name: str, cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the bench; on a cluster pass your own session instead."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` for staged tables.

    Without that setting only a local master may fall back to a temporary folder: on a cluster, a local one of several processes included, the
    executors need not share the driver's disk. ``remove_staged`` removes what a session has staged.
    """
    return os.path.join(_staged_root(spark), purpose, uuid.uuid4().hex)


_LOCAL_ROOTS: dict[str, str] = {}


def _staged_root(spark: SparkSession) -> str:
    """One folder per application, so that its staged tables can go as one."""
    root, app = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.applicationId
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
        if app not in _LOCAL_ROOTS:
            _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="agreelens-")
        root = _LOCAL_ROOTS[app]
    return os.path.join(root, "agreelens", app)


def remove_staged(spark: SparkSession) -> bool:
    """Remove every table that this application has staged; whether there was any.

    Results that read staged tables lazily have to be written or collected before. Any file system that Spark can write to will do.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged_root(spark))
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
