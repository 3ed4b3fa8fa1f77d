"""A folder that driver and executors share, for queries that write files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new folder's path under spark.checkpoint.dir, or in a temporary place where that is unset on a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{base or tempfile.mkdtemp(prefix='docketry-')}/{label}-{uuid.uuid4().hex}"
