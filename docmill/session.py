"""Session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "docmill",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings every docmill job assumes.

    UTC session time (dates in frontmatter and cards are UTC), AQE with
    partition coalescing and skew-join splitting, UI off.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder.

    Read from the session (``spark.checkpoint.dir`` or the context's
    checkpoint dir). Only when neither is set and the master is local --
    tests -- a fresh folder is made and registered, so
    ``DataFrame.checkpoint()`` works; on a cluster that is an error, as
    executors don't see the driver's folders.
    """
    sc = spark.sparkContext
    d = None
    try:
        d = sc.getCheckpointDir()
    except Exception:  # older API surface
        d = None
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if d:
            sc.setCheckpointDir(d)
    if not d:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.environ.get("DOCMILL_LOCAL_SCRATCH") or tempfile.gettempdir()
        d = tempfile.mkdtemp(prefix="docmill-ckpt-", dir=base)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    root = checkpoint_root(spark).rstrip("/")
    return "/".join([root, "docmill", *parts, uuid.uuid4().hex])
