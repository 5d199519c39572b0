"""Where a run keeps its own files: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; one of our own where that is unset and one machine runs everything."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: executors and driver need a folder that all of them share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="veritrace-"))
        top = _OWN[0]
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
