"""The folder that driver and executors share, tables and checkpoints in it, and global row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one where that is unset and everything runs in one process.  Raises on a cluster without it."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="arbora-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def forget(spark: SparkSession, path: str, now: bool = False) -> None:
    """Delete what lies at ``path`` when the application ends, or ``now``."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if now:
        system.delete(at, True)
    else:
        system.deleteOnExit(at)


def durable(df: DataFrame, label: str, *folders: str, sweep: bool = False, **options: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder (a folder for each value of the columns ``folders``, which are strings; ``options``: the writer's) and read back: its lineage ends there, on disks that no executor owns.

    The table goes when the application ends, or when it is handed to ``release``.  ``sweep``: shuffle files go as soon as it is written, not when the
    driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.options(**options)
    writer = writer.partitionBy(*folders) if folders else writer
    before = spark.conf.get(SWEEP, None)
    if sweep:
        spark.conf.set(SWEEP, "true")
    try:
        writer.parquet(path)
    finally:
        if sweep:
            spark.conf.set(SWEEP, before) if before is not None else spark.conf.unset(SWEEP)
    forget(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._arbora_path = path
    return out


def again(spark: SparkSession, table: DataFrame) -> DataFrame | None:
    """A table made by ``durable``, read anew in this session; None if it is gone."""
    path = table._arbora_path
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(table.schema).parquet(path) if there else None


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``durable`` that nothing will read again."""
    for t in tables:
        if path := getattr(t, "_arbora_path", None):
            forget(t.sparkSession, path, now=True)


def cut(df: DataFrame) -> DataFrame:
    """``df`` behind a reliable checkpoint: for small tables that a loop rewrites."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order: str, name: str = "row_number", label: str = "numbered") -> DataFrame:
    """``df`` with a gapless global number from 0 in ascending ``order`` (nulls first).

    Rows are range-partitioned and sorted once and written; a row's number is its place in its partition plus the rows of the
    partitions before it.  Only one count per partition reaches the driver.  Rows equal in ``order`` may be numbered either way:
    add columns to ``order`` until what remains equal is interchangeable.
    """
    spark = df.sparkSession
    keys = [F.col(c).asc_nulls_first() for c in order]
    placed = df.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys)
    # The high bits of the id are the partition, the low 33 bits the place in it.
    placed = durable(placed.withColumn("__at", F.monotonically_increasing_id()), label)
    part = F.shiftright("__at", 33).cast("int")
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    offsets = F.split(F.lit(",".join(map(str, before or [0]))), ",").cast("array<bigint>")
    number = F.element_at(offsets, part + 1) + F.col("__at").bitwiseAND((1 << 33) - 1)
    return placed.withColumn(name, number).drop("__at")
