"""Folders that driver and executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir. Where that is unset, a local session (tests) takes a folder of its own; on a cluster
    executors could not see one, so there it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="ctxloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are done; it does so when the driver's JVM collects garbage."""
    gc.collect()
    spark._jvm.System.gc()
