"""A bounded sample of labelled documents for fitting a classifier on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def window_of(text: Column, chars: int, *by: Column | str) -> Column:
    """``chars`` characters in a row of a longer text, from a place picked by a hash of ``by``; the whole of a shorter one."""
    places = F.greatest(F.lit(1), F.length(text) - chars + 1)
    return F.substring(text, (F.pmod(F.xxhash64(*by, F.lit("window")), places.cast("bigint")) + 1).cast("int"), F.lit(chars))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, chars: int, where: Column | None = None) -> list[Row]:
    """About ``rows`` labelled documents at most, picked by a hash of ``doc_id``, of each long text ``chars`` characters from a place picked by hash; only for fitting.

    ``labels`` needs ``doc_id`` and the label columns; each label column and ``text`` are returned, by ascending ``doc_id``.  Of repeated
    labels of a document one counts, and of several texts under one ``doc_id`` one, so that no repetition makes the sample grow.  Texts do
    not move but for the sample: its ids, bounded by ``rows``, are broadcast.
    """
    labels = labels.filter(F.col("doc_id").isNotNull() & (where if where is not None else F.lit(True)))
    n = labels.count()
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    names = [c for c in labels.columns if c != "doc_id"]
    picked = labels.filter(chance < min(1.0, rows / max(1, n))).groupBy("doc_id").agg(F.min(F.struct(*names)).alias("labels")).select("doc_id", "labels.*")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(picked), "doc_id").select("doc_id", window_of(F.col("text"), chars, "doc_id").alias("text"), *names)
    return found.groupBy("doc_id").agg(F.min(F.struct("text", *names)).alias("row")).select("doc_id", "row.*").orderBy("doc_id").collect()
