"""Making the package importable on every executor."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark context, and keep what passes to Python at a time small where the session doesn't say how large it may be."""
    context = spark.sparkContext
    if not context.getConf().contains(BATCH_BYTES) and not getattr(spark, "_arbora_batches", False):
        spark.conf.set(BATCH_BYTES, "8m")
        spark._arbora_batches = True
    if getattr(context, "_arbora_shipped", False):
        return
    top = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="arbora-code-")
    staged = os.path.join(folder, "staged")
    shutil.copytree(top, os.path.join(staged, top.name), ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(os.path.join(folder, "arbora"), "zip", staged))
    context._arbora_shipped = True
