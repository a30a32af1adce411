"""What several operators share: tables in the shared folder, whole texts in Arrow batches, columns computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.storage import cut, durable, forget, new_path, numbered, release, shared_dir, tasks

#: The word separators that the operators' contracts fix: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batches, rows: int = 256):
    """Arrow batches cut to ``rows`` rows, so that what Python makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


__all__ = ["SPACES", "cut", "documents", "durable", "forget", "let", "new_path", "numbered", "release", "shared_dir", "slices", "tasks"]
