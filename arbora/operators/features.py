"""Node features and the lookups that indexes of them serve, as filters and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.arrays import superset
from arbora.operators.graph import KEY, condense

#: In-neighbours, out-neighbours, different labels in and out, edges in and out, most labels on one pair and direction.
FEATURES = ("f1a", "f1b", "f2a", "f2b", "f3", "f6")


def signature_features(g: DataFrame) -> DataFrame:
    """``node`` and the six features, loops left out; a node with loops alone has zeros.

    One reading and two groupings: edges at each end by node and neighbour, with the labels of a pair as a set; then pairs by node, where the
    different labels are the union of these sets.
    """
    end = lambda node, other, way: F.struct(F.col(node).alias("node"), F.col(other).alias("other"), F.lit(way).alias("way"))
    ends = F.when(F.col("src") == F.col("dst"), F.array(end("src", "dst", 2))).otherwise(F.array(end("src", "dst", 1), end("dst", "src", 0)))
    rows = g.select(KEY, "label", F.explode(ends).alias("e")).select(KEY, "e.*", "label")
    pairs = rows.groupBy(KEY, "node", "other", "way").agg(F.count("*").alias("n"), F.collect_set("label").alias("labels"))
    way = lambda k: F.col("way") == k
    kinds = lambda k: F.size(F.array_distinct(F.flatten(F.collect_set(F.when(way(k), F.col("labels"))))))
    found = pairs.groupBy(KEY, "node").agg(
        F.count_if(way(0)).alias("f1a"), F.count_if(way(1)).alias("f1b"), kinds(0).alias("f2a"), kinds(1).alias("f2b"),
        F.sum(F.when(way(2), 0).otherwise(F.col("n"))).alias("f3"), F.max(F.when(way(2), 0).otherwise(F.col("n"))).alias("f6"),
    )
    return found.select(KEY, "node", *[F.coalesce(F.col(f), F.lit(0)).cast("bigint").alias(f) for f in FEATURES])


def dominating(features: DataFrame, least: dict[str, int]) -> DataFrame:
    """Nodes whose features are all at least those given: candidates for a query node."""
    for name, value in least.items():
        features = features.filter(F.col(name) >= value)
    return features


def neighbourhood(g: DataFrame, incoming: set[str], outgoing: set[str]) -> DataFrame:
    """For each ``node``, the ``neighbour`` with all ``incoming`` labels to the node and all ``outgoing`` from it.

    With neither nothing is asked of a node: ``node`` is null, for any of them, and every node of the target is a ``neighbour``.
    """
    links = condense(g.filter("src <> dst"))
    into = links.filter(superset(F.col("labels"), F.array(*map(F.lit, sorted(incoming))))).select(KEY, F.col("dst").alias("node"), F.col("src").alias("neighbour"))
    out = links.filter(superset(F.col("labels"), F.array(*map(F.lit, sorted(outgoing))))).select(KEY, F.col("src").alias("node"), F.col("dst").alias("neighbour"))
    if incoming and outgoing:
        return into.join(out, [KEY, "node", "neighbour"], "left_semi")
    if incoming or outgoing:
        return into if incoming else out
    return g.select(KEY, F.lit(None).cast("string").alias("node"), F.explode(F.array("src", "dst")).alias("neighbour")).distinct()


def set_index(entries: DataFrame, keys: str = "keys", value: str = "value") -> DataFrame:
    """Per set of keys (sorted) the set of values."""
    return entries.groupBy(F.array_sort(F.array_distinct(keys)).alias(keys)).agg(F.collect_set(value).alias("values"))


def clustered(boxes: DataFrame, parts: int, *columns: str) -> DataFrame:
    """Rows laid out for range filters: range-partitioned and sorted, so that file statistics skip most of them."""
    return boxes.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
