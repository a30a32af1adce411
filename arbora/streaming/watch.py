"""Changes as streams: debouncing, unique pending items, and criteria that are judged again when they change."""

from __future__ import annotations

import json
import logging
import time
import traceback
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arbora.model import Criterion
from arbora.operators.report import assess

log = logging.getLogger(__name__)


def debounce(events: DataFrame, key: str, at: str, gap_seconds: float, order: str) -> DataFrame:
    """Batch form: of each key the events that no other follows within ``gap_seconds``; events at one time count in ``order``."""
    later = F.lead(at).over(Window.partitionBy(key).orderBy(at, order))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return events.withColumn("__next", later).filter(F.col("__next").isNull() | (micros(F.col("__next")) - micros(F.col(at)) > int(gap_seconds * 1e6))).drop("__next")


def debounce_stream(events: DataFrame, key: str, at: str, gap: str, late: str, order: str) -> DataFrame:
    """Streaming form: the last event of each session; ``key``, ``order``, ``at`` and ``emit_ts`` (the end of silence).  Sessions that the watermark hasn't passed wait."""
    sessions = events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), key)
    return sessions.agg(F.max(F.struct(at, order)).alias("last")).select(key, f"last.{order}", f"last.{at}", F.col("session.end").alias("emit_ts"))


def unique_pending(events: DataFrame, key: str, at: str, order: str, batch_seconds: int) -> DataFrame:
    """Batch form of a queue that holds an item once: per ``batch_seconds`` and key the first event."""
    batch = F.floor(F.unix_micros(F.col(at).cast("timestamp")) / (batch_seconds * 1_000_000))
    rows = events.withColumn("batch", batch.cast("bigint"))
    return rows.withColumn("__at", F.row_number().over(Window.partitionBy("batch", key).orderBy(at, order))).filter("__at = 1").drop("__at")


@contextmanager
def timed(what: str) -> Iterator[None]:
    """Logs how long the block took, in milliseconds."""
    began = time.perf_counter()
    try:
        yield
    finally:
        log.info("%s: %d ms", what, 1000 * (time.perf_counter() - began))


def overwrite_lines(path: str, lines: Callable[[DataFrame, Criterion], DataFrame]) -> Callable[[DataFrame, Criterion], None]:
    """A sink that writes what ``lines`` makes of the matches (a sorted column ``line``) as text over what was at ``path``."""

    def sink(matches: DataFrame, criterion: Criterion) -> None:
        lines(matches, criterion).select(F.col("line").alias("value")).write.mode("overwrite").text(path)

    return sink


def watch_criteria(spark: SparkSession, folder: str, edges: DataFrame, sink: Callable[[DataFrame, Criterion], None], checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Judge every criterion file that appears in ``folder`` (a new version is a new file) and hand its matches to ``sink``.

    Within a micro-batch a file counts once.  A criterion that fails is logged and the stream goes on.
    """

    def handle(batch: DataFrame, _: int) -> None:
        # Criteria are small files, some at a time: they are read on the driver, as plans are made there.
        for row in batch.dropDuplicates(["path"]).orderBy("path").collect():
            try:
                with timed(f"criterion {row['path']}"):
                    criterion = Criterion.decode(json.loads(row["value"]))
                    sink(assess(edges, [criterion]), criterion)
            except Exception:
                log.error("criterion %s: %s", row["path"], traceback.format_exc())

    files = spark.readStream.format("text").option("wholetext", "true").load(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 second")).start()
