"""Folders for tables that a query writes and reads again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder in the one the session names in ``spark.checkpoint.dir``; a temporary one only where that isn't set and Spark is local."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("A cluster needs spark.checkpoint.dir, a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="probitas-")
    folder = f"{shared.rstrip('/')}/scratch-{uuid.uuid4()}"
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
