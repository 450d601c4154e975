"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(app_name: str = "dwellrank", cores: str = "*", shuffle_partitions: int | None = None) -> SparkSession:
    """A local session with the settings the package is tuned for.

    On a cluster the session comes from spark-submit; the package reads every
    setting from it and never overrides one.
    """
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DWELLRANK_DRIVER_MEMORY", "8g"))
    )
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder for a written intermediate, in the folder that ``spark.checkpoint.dir`` names (one that every executor sees).

    Only a local master may leave that setting out, as in tests; a temporary folder is used then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="dwellrank-")
    return f"{root.rstrip('/')}/dwellrank-{purpose}-{uuid.uuid4().hex}"
