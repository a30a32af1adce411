"""Text formats of subgraph solvers and miners."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.operators.graph import KEY, dictionary, encode
from arbora.storage import numbered


def _b64(column: str):
    return F.base64(F.col(column).cast("binary"))


def gss_lines(edges: DataFrame) -> DataFrame:
    """``line``: ``from>to,label`` with each part in Base64."""
    return edges.select(KEY, F.concat(_b64("src"), F.lit(">"), _b64("dst"), F.lit(","), _b64("label")).alias("line"))


def gss_edges(lines: DataFrame) -> DataFrame:
    """The edges of such lines."""
    part = lambda pattern: F.decode(F.unbase64(F.regexp_extract("line", pattern, 1)), "UTF-8")
    return lines.select(KEY, part("^([^>]*)>").alias("src"), part(",([^,]*)$").alias("label"), part(">([^,]*),").alias("dst"))


def gss_mappings(lines: DataFrame) -> DataFrame:
    """``mapping_id``, ``qnode``, ``tnode`` from solver output: ``mapping = (q -> t) (q -> t)``, names in Base64; other lines are skipped."""
    rows = lines.filter(F.startswith("line", F.lit("mapping = "))).select(KEY, F.xxhash64("line").alias("mapping_id"), F.explode(F.expr(r"regexp_extract_all(line, '\\(([^ ()]+) -> ([^ ()]+)\\)', 0)")).alias("pair"))
    name = lambda i: F.decode(F.unbase64(F.regexp_extract("pair", r"\(([^ ()]+) -> ([^ ()]+)\)", i)), "UTF-8")
    return rows.select(KEY, "mapping_id", name(1).alias("qnode"), name(2).alias("tnode"))


def label_dictionary(edges: DataFrame) -> DataFrame:
    """``label_id`` from 0 over all graphs, in label order.  Labels that hold locations may be as many as nodes."""
    return numbered(edges.select("label").distinct(), "label", name="label_id", label="labels")


def spmf_lines(edges: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """``graph`` (its number in target order), ``place`` and ``line``: ``t # n``, then ``v i 0`` and ``e i j l``."""
    labels = label_dictionary(edges) if labels is None else labels
    graphs = numbered(edges.select(KEY).distinct(), KEY, name="graph", label="graphs")
    names = dictionary(edges)
    head = graphs.select(KEY, "graph", F.lit("0").alias("kind"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c"), F.concat(F.lit("t # "), F.col("graph").cast("string")).alias("line"))
    v = names.join(graphs, KEY).select(KEY, "graph", F.lit("1").alias("kind"), F.col("node_id").alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c"), F.concat(F.lit("v "), F.col("node_id").cast("string"), F.lit(" 0")).alias("line"))
    coded = encode(edges, names).join(labels, "label").join(graphs, KEY)
    e = coded.select(KEY, "graph", F.lit("2").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("label_id").alias("c"), F.concat_ws(" ", F.lit("e"), "src", "dst", "label_id").alias("line"))
    return head.union(v).union(e)


def spmf_edges(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges over node ids from ``graph`` and ``line``; label ids through ``labels``."""
    part = F.split("line", " ")
    rows = lines.filter(F.startswith("line", F.lit("e "))).select("graph", F.get(part, F.lit(1)).cast("bigint").alias("src"), F.get(part, F.lit(2)).cast("bigint").alias("dst"), F.get(part, F.lit(3)).cast("bigint").alias("label_id"))
    return rows.join(labels, "label_id").select("graph", "src", "label", "dst")


def spmf_subgraphs(texts: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From ``value`` (a miner's output): (edges of each subgraph, ``graph`` and ``containing`` graph ids of its ``x`` line)."""
    blocks = texts.select(F.explode(F.filter(F.transform(F.split("value", "t #"), lambda x: F.trim(x)), lambda x: x != "")).alias("block"))
    lines = blocks.select(F.regexp_extract("block", r"^(\d+)", 1).cast("bigint").alias("graph"), F.explode(F.split("block", "\n")).alias("line"))
    within = lines.filter(F.startswith("line", F.lit("x"))).select("graph", F.transform(F.filter(F.split(F.substring("line", 2, 1 << 30), " "), lambda x: F.trim(x) != ""), lambda x: F.trim(x).cast("bigint")).alias("containing"))
    return spmf_edges(lines, labels), within
