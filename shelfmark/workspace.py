"""Where the engine keeps files of its own: a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_local: dict[str, str] = {}


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path that does not exist yet, under spark.checkpoint.dir; under a temporary folder only in single-JVM local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context = spark.sparkContext
        if not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if context.applicationId not in _local:
            _local[context.applicationId] = tempfile.mkdtemp(prefix="shelfmark-")
        root = _local[context.applicationId]
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
