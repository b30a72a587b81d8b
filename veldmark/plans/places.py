"""Folders for deliveries that queries write and read again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``, which all machines share; where that is unset, a temporary one on a local master (tests), and an error on a cluster."""
    known = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not known and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    root = known or "file://" + tempfile.mkdtemp(prefix="veldmark-")
    return f"{root.rstrip('/')}/veldmark/{name}-{uuid.uuid4().hex}"
