"""Suggested extensions of a pattern, mined from its matches (``target_id``, ``query_id``, ``mapping``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora.operators.match import KEY, mapping_text

#: How many of the most frequent extensions are chosen, how many more that are rarer, and rarer than what.
FIRST, MORE, RARE = 3, 3, 0.6


def unpivot(matches: DataFrame) -> DataFrame:
    """``target_id``, ``query_id``, ``match_id``, ``qnode``, ``tnode``: a row per variable."""
    rows = matches.select(KEY, "query_id", mapping_text().alias("match_id"), "mapping").dropDuplicates([KEY, "query_id", "match_id"])
    return rows.select(KEY, "query_id", "match_id", F.explode("mapping").alias("qnode", "tnode"))


def _sizes(mapped: DataFrame) -> DataFrame:
    return mapped.select(KEY, "query_id", "match_id").distinct().groupBy("query_id").agg(F.count("*").alias("matches"))


def edge_extensions(matches: DataFrame, edges: DataFrame, query_edges: DataFrame) -> DataFrame:
    """``query_id``, ``qsrc``, ``label``, ``qdst``, ``fraction``: edges among mapped nodes that the query lacks, and the share of matches that have them.

    ``query_edges``: (``query_id``, ``src``, ``label``, ``dst``) over variables.
    """
    m = unpivot(matches)
    left = m.select(KEY, "query_id", "match_id", F.col("qnode").alias("qsrc"), F.col("tnode").alias("src"))
    right = m.select(KEY, "query_id", "match_id", F.col("qnode").alias("qdst"), F.col("tnode").alias("dst"))
    there = left.join(edges, [KEY, "src"]).join(right, [KEY, "query_id", "match_id", "dst"])
    known = query_edges.select("query_id", F.col("src").alias("qsrc"), "label", F.col("dst").alias("qdst"))
    new = there.join(known, ["query_id", "qsrc", "label", "qdst"], "left_anti")
    found = new.groupBy("query_id", "qsrc", "label", "qdst").agg(F.count("*").alias("n"))
    return found.join(_sizes(m), "query_id").select("query_id", "qsrc", "label", "qdst", (F.col("n") / F.col("matches")).alias("fraction"))


def node_occurrences(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """A row per match, variable and neighbour outside the match: its loops and the labels from and to it, as sorted arrays."""
    m = unpivot(matches)
    links = edges.filter("src <> dst")
    ways = [links.select(KEY, F.col("src").alias("tnode"), F.col("dst").alias("other"), "label", F.lit(True).alias("out")), links.select(KEY, F.col("dst").alias("tnode"), F.col("src").alias("other"), "label", F.lit(False).alias("out"))]
    near = m.join(ways[0].union(ways[1]), [KEY, "tnode"])
    taken = m.select(KEY, "query_id", "match_id", F.col("tnode").alias("other"))
    near = near.join(taken, [KEY, "query_id", "match_id", "other"], "left_anti")
    labels = lambda out: F.array_sort(F.collect_set(F.when(F.col("out") == F.lit(out), F.col("label"))))
    near = near.groupBy(KEY, "query_id", "match_id", "qnode", "other").agg(labels(True).alias("outgoing"), labels(False).alias("incoming"))
    loops = edges.filter("src = dst").groupBy(KEY, F.col("src").alias("other")).agg(F.array_sort(F.collect_set("label")).alias("loops"))
    return near.join(loops, [KEY, "other"], "left").withColumn("loops", F.coalesce("loops", F.array().cast("array<string>")))


GROUP = ("query_id", "qnode", "loops", "outgoing", "incoming")


def node_extensions(matches: DataFrame, edges: DataFrame) -> DataFrame:
    """Groups of neighbours alike in variable, loops and labels: ``fraction`` of matches that have one, and ``occurrences``."""
    seen = node_occurrences(matches, edges)
    per_match = seen.groupBy(*GROUP, KEY, "match_id").agg(F.count("*").alias("k"))
    found = per_match.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum("k").alias("occurrences"))
    return found.join(_sizes(unpivot(matches)), "query_id").select(*GROUP, (F.col("n") / F.col("matches")).alias("fraction"), "occurrences")


def samples(occurrences: DataFrame, n: int = 3) -> DataFrame:
    """Of each group the first neighbour in each of the first ``n`` targets."""
    one = occurrences.withColumn("__at", F.row_number().over(Window.partitionBy(*GROUP, KEY).orderBy("match_id", "other"))).filter("__at = 1")
    return one.withColumn("__at", F.row_number().over(Window.partitionBy(*GROUP).orderBy(KEY))).filter(F.col("__at") <= n).drop("__at")


def select_extensions(extensions: DataFrame, ties: list[str | Column]) -> DataFrame:
    """Per query the ``FIRST`` most frequent, then up to ``MORE`` of those left that are rarer than ``RARE``; ties by ``ties``; ``rank`` is the place among all.

    A rare extension's place is its place among the rare ones after all frequent ones, so each part takes its first few before anything moves.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("fraction"), *ties)
    at = F.row_number().over(order)
    frequent = extensions.filter(F.col("fraction") >= RARE).withColumn("rank", at).filter(F.col("rank") <= FIRST)
    before = extensions.groupBy("query_id").agg(F.count_if(F.col("fraction") >= RARE).alias("__before"))
    rare = extensions.filter(F.col("fraction") < RARE).withColumn("rank", at).filter(F.col("rank") <= FIRST + MORE).join(before, "query_id")
    rare = rare.filter(F.col("rank") <= MORE + F.greatest(F.lit(0), FIRST - F.col("__before"))).withColumn("rank", F.col("rank") + F.col("__before"))
    return frequent.withColumn("rank", F.col("rank").cast("bigint")).unionByName(rare.drop("__before"))


def extension_lines(edges: DataFrame, nodes: DataFrame, seen: DataFrame) -> DataFrame:
    """The text of chosen extensions as lines: ``query_id``, ``part`` (of edges 0, of nodes 1), ``rank``, ``place`` and ``line``, which in this order make it.

    ``edges`` and ``nodes`` are chosen extensions with ``rank``; ``seen`` are ``samples`` of neighbours, of which each node extension shows its own.
    """
    share = F.concat(F.lit("  - ["), F.format_string("%.2f", "fraction"), F.lit("]"))
    show = lambda rows, part, lines: rows.select("query_id", F.lit(part).alias("part"), F.col("rank").cast("bigint").alias("rank"), F.posexplode(lines).alias("place", "line"))
    indented = lambda *parts: F.concat(F.lit("    "), *parts)
    marked = lambda column, a, b: F.transform(column, lambda x: indented(F.lit(f"{a} "), x, F.lit(f" {b}")))
    of_edges = show(edges, 0, F.array(share, indented("qsrc"), indented(F.lit("> "), F.col("label"), F.lit(" >")), indented("qdst")))
    where = seen.groupBy(*GROUP).agg(F.array_sort(F.collect_list(F.struct(KEY, "other"))).alias("where"))  # a few for each group
    found = nodes.join(where, list(GROUP), "left")
    shown = F.flatten(F.transform(F.coalesce("where", F.array().cast(where.schema["where"].dataType)), lambda x: F.array(indented(F.lit("= "), x["other"]), F.concat(F.lit("      in "), x[KEY].cast("string")))))
    of_nodes = show(found, 1, F.concat(F.array(share, indented("qnode")), marked("outgoing", ">", ">"), marked("incoming", "<", "<"), marked("loops", "|", "|"), shown))
    queries = edges.select("query_id").union(nodes.select("query_id")).distinct()
    titles = F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit("- "), "query_id", F.lit("\n  Edges:")).alias("line")), F.struct(F.lit(1).alias("part"), F.lit("  Nodes:").alias("line")))
    head = queries.select("query_id", F.explode(titles).alias("t")).select("query_id", "t.part", F.lit(0).cast("bigint").alias("rank"), F.lit(0).alias("place"), "t.line")
    return head.union(of_edges).union(of_nodes)
