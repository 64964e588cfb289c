"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Settings every job relies on: stored times are UTC; caps per key up to 10,000 rows are
    applied ahead of the shuffle; checkpoints have their folder."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    shared_root(spark)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach.

    It is the one named by ``spark.checkpoint.dir`` or set on the context; where neither is, a folder
    in the warehouse, which executors share as well. Checkpoints are sent there too.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root is None:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/shared"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is ever written to it twice by accident."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
