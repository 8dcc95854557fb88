"""The shared folder for tables between jobs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset a temporary folder, which it then names, on a local master only."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="framegraph-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("spark.checkpoint.dir", where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def folder(spark: SparkSession) -> str:
    """A new name in the shared folder."""
    return f"{scratch(spark).rstrip('/')}/files/{uuid.uuid4().hex}"
