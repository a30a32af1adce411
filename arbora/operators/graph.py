"""Graph and multigraph algebra.  A graph is ``edges(target_id, src, label, dst)``; every function keeps targets apart."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.storage import numbered

KEY, EDGE = "target_id", ["target_id", "src", "label", "dst"]


# ---------------------------------------------------------------- graphs


def sources(g: DataFrame) -> DataFrame:
    return g.select(KEY, F.col("src").alias("node")).distinct()


def destinations(g: DataFrame) -> DataFrame:
    return g.select(KEY, F.col("dst").alias("node")).distinct()


def nodes(g: DataFrame) -> DataFrame:
    return g.select(KEY, F.explode(F.array("src", "dst")).alias("node")).distinct()


def labels(g: DataFrame) -> DataFrame:
    return g.select(KEY, "label").distinct()


def edges_from(g: DataFrame, node: str) -> DataFrame:
    return g.filter(F.col("src") == node)


def edges_to(g: DataFrame, node: str) -> DataFrame:
    return g.filter(F.col("dst") == node)


def labels_between(g: DataFrame, src: str, dst: str) -> DataFrame:
    return g.filter((F.col("src") == src) & (F.col("dst") == dst)).select(KEY, "label").distinct()


def connected_edges(g: DataFrame, node: str) -> DataFrame:
    return g.filter((F.col("src") == node) | (F.col("dst") == node))


def all_connected_edges(g: DataFrame, of: DataFrame) -> DataFrame:
    """Edges that touch any node of ``of`` (``target_id``, ``node``)."""
    by = lambda end: g.join(of.select(KEY, F.col("node").alias(end)), [KEY, end], "left_semi").select(*EDGE)
    return by("src").union(by("dst")).distinct()


def extended_subgraph(sub: DataFrame, g: DataFrame) -> DataFrame:
    """Edges of ``g`` that touch a node of ``sub``."""
    return all_connected_edges(g, nodes(sub))


def subgraph_extension(sub: DataFrame, g: DataFrame) -> DataFrame:
    """The same without the edges of ``sub``."""
    return extended_subgraph(sub, g).join(sub.select(*EDGE), EDGE, "left_anti")


def combine(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*EDGE).union(b.select(*EDGE)).distinct()


def map_edges(g: DataFrame, node: Callable[[Column], Column] | None = None, label: Callable[[Column], Column] | None = None) -> DataFrame:
    """Nodes and labels through functions on columns; edges that become equal count once."""
    n, e = node or (lambda c: c), label or (lambda c: c)
    return g.select(KEY, n(F.col("src")).alias("src"), e(F.col("label")).alias("label"), n(F.col("dst")).alias("dst")).distinct()


# ---------------------------------------------------------------- multigraphs: pairs(target_id, src, dst, labels)


def condense(g: DataFrame) -> DataFrame:
    """Of each pair of nodes the sorted set of labels."""
    return g.groupBy(KEY, "src", "dst").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def expand(pairs: DataFrame) -> DataFrame:
    return pairs.select(KEY, "src", F.explode("labels").alias("label"), "dst")


def _places(of: DataFrame, name: str) -> DataFrame:
    """``node`` of each target with its place in node order, from 0: numbered over all targets, less the target's first number, so that a target fills as many tasks as it needs."""
    rows = numbered(of.select(KEY, "node"), KEY, "node", name="__number", label="dictionary")
    first = rows.groupBy(KEY).agg(F.min("__number").alias("__first"))
    return rows.join(first, KEY).select(KEY, "node", (F.col("__number") - F.col("__first")).alias(name))


def dictionary(g: DataFrame) -> DataFrame:
    """``node_id`` from 0 within each target, in node order."""
    return _places(nodes(g), "node_id")


def encode(g: DataFrame, names: DataFrame) -> DataFrame:
    """Edges between node ids."""
    by = lambda end: names.select(KEY, F.col("node").alias(end), F.col("node_id").alias(f"{end}_id"))
    return g.join(by("src"), [KEY, "src"]).join(by("dst"), [KEY, "dst"]).select(KEY, F.col("src_id").alias("src"), "label", F.col("dst_id").alias("dst"))


def decode(coded: DataFrame, names: DataFrame) -> DataFrame:
    by = lambda end: names.select(KEY, F.col("node_id").alias(end), F.col("node").alias(f"{end}_name"))
    return coded.join(by("src"), [KEY, "src"]).join(by("dst"), [KEY, "dst"]).select(KEY, F.col("src_name").alias("src"), "label", F.col("dst_name").alias("dst"))


def extend_dictionary(names: DataFrame, extension: DataFrame) -> DataFrame:
    """Ids stay; nodes of ``extension`` without one get the next ids in node order."""
    size = names.groupBy(KEY).agg(F.count("*").alias("n"))
    new = nodes(extension).join(names, [KEY, "node"], "left_anti")
    return names.unionByName(_places(new, "__place").join(size, KEY, "left").select(KEY, "node", (F.coalesce("n", F.lit(0)) + F.col("__place")).cast("bigint").alias("node_id")))


def node_count(g: DataFrame) -> DataFrame:
    return nodes(g).groupBy(KEY).agg(F.count("*").alias("node_count"))


def adjacent(g: DataFrame) -> DataFrame:
    """``node`` and each ``neighbour`` over a link in either direction."""
    links = g.filter("src <> dst")
    return links.select(KEY, F.col("src").alias("node"), F.col("dst").alias("neighbour")).union(links.select(KEY, F.col("dst").alias("node"), F.col("src").alias("neighbour"))).distinct()


def all_adjacent(g: DataFrame, of: DataFrame) -> DataFrame:
    """Neighbours of any of the nodes ``of``, which may be among them."""
    return adjacent(g).join(of.select(KEY, "node"), [KEY, "node"], "left_semi").select(KEY, F.col("neighbour").alias("node")).distinct()


def induced(g: DataFrame, of: DataFrame) -> DataFrame:
    """Edges between the nodes ``of``, loops included."""
    for end in ("src", "dst"):
        g = g.join(of.select(KEY, F.col("node").alias(end)), [KEY, end], "left_semi")
    return g.select(*EDGE)


def signatures(g: DataFrame) -> DataFrame:
    """``node`` with ``incoming`` and ``outgoing`` (sorted lists of label sets, one per neighbour) and ``loops``."""
    pairs = condense(g)
    ends = F.array(F.struct(F.col("src").alias("node"), F.lit("out").alias("way")), F.struct(F.col("dst").alias("node"), F.lit("in").alias("way")))
    both = pairs.select(KEY, "labels", F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("node"), F.lit("loop").alias("way")))).otherwise(ends).alias("e"))
    both = both.select(KEY, "labels", F.explode("e").alias("e")).select(KEY, "e.node", "e.way", "labels")
    lists = lambda way: F.array_sort(F.collect_list(F.when(F.col("way") == way, F.col("labels")))).alias
    return both.groupBy(KEY, "node").agg(lists("in")("incoming"), lists("out")("outgoing"), F.flatten(F.collect_list(F.when(F.col("way") == "loop", F.col("labels")))).alias("loops"))
