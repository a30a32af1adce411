"""Verdict counts, averages and reports (as lines) from matches (``target_id``, ``criterion``, ``query_id``, ``verdict``, ``mapping``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.model import VERDICTS, Criterion
from arbora.operators.match import KEY, mapping_text, search_trees
from arbora.storage import tasks


def verdict_rank(column: str = "verdict") -> Column:
    return F.array_position(F.array(*map(F.lit, VERDICTS)), F.col(column)).cast("int") - 1


def assess(edges: DataFrame, criteria: list[Criterion], keep: bool = True) -> DataFrame:
    """Matches of all criteria on all targets; a match of several trees counts once for each."""
    found = [search_trees(edges, c.patterns, keep).withColumn("criterion", F.lit(c.text)) for c in criteria]
    return reduce(DataFrame.unionByName, found).select(KEY, "criterion", "query_id", "verdict", "mapping")


def counts(matches: DataFrame) -> DataFrame:
    """``n`` per target, criterion and verdict that occurs."""
    return matches.groupBy(KEY, "criterion", "verdict").agg(F.count("*").alias("n"))


def wide_counts(matches: DataFrame) -> DataFrame:
    """One row per target and criterion with a column for each verdict."""
    return matches.groupBy(KEY, "criterion").agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS])


def averages(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Matches per verdict over the number of all ``targets``, those without a match included."""
    total = targets.select(KEY).distinct().agg(F.count("*").alias("targets"))
    per = matches.groupBy("criterion", "verdict").agg(F.count("*").alias("n"))
    return per.join(F.broadcast(total)).select("criterion", "verdict", (F.col("n") / F.col("targets")).alias("average"))  # total is one row


def details(matches: DataFrame) -> DataFrame:
    """Matches that a report lists: all but neutral ones."""
    return matches.filter(F.col("verdict") != "neutral").select(KEY, "criterion", "query_id", "verdict", mapping_text().alias("mapping"))


def _head(per: DataFrame, by: list[str]) -> DataFrame:
    """Of each group its line of counts, verdicts in order: one row per group and verdict becomes one line of three parts at most."""
    shown = F.transform(F.array_sort(F.collect_list(F.struct("rank", "verdict", "n"))), lambda x: F.concat(F.initcap(x["verdict"]), F.lit(": "), x["n"].cast("string")))
    return per.groupBy(*by).agg(F.concat(F.lit("  "), F.array_join(shown, " / ")).alias("line"))


#: Where a line stands in its section: title, counts, matches, averages.
TITLE, COUNTS, MATCH, TAIL = range(4)


def report_lines(matches: DataFrame, file: str, section: str) -> DataFrame:
    """Markdown as lines: ``file``, ``section``, ``part``, ``rank`` (of the verdict), ``query_id`` and ``line``, which in this order make the text.

    ``file`` and ``section`` are the columns by which files are split and within which sections are: target and criterion, or the reverse.  No row
    holds more than one match.
    """
    by = [file, section]
    per = matches.groupBy(*by, "verdict").agg(F.count("*").alias("n")).withColumn("rank", verdict_rank())
    place = lambda df, part, rank, query: df.select(*by, F.lit(part).alias("part"), rank.cast("int").alias("rank"), query.alias("query_id"), "line")
    none, empty = F.lit(-1), F.lit("")
    title = per.select(*by).distinct().withColumn("line", F.concat(F.lit("- "), F.col(section).cast("string")))
    nodes = F.array_join(F.transform(F.array_sort(F.map_entries("mapping")), lambda e: F.concat(F.lit("\n    - `"), e["key"], F.lit("` ->\n      `"), e["value"], F.lit("`"))), "")
    listed = matches.filter(F.col("verdict") != "neutral").withColumn("line", F.concat(F.lit("  - "), F.initcap("verdict"), F.lit(" / "), F.col("query_id"), nodes))
    return place(title, TITLE, none, empty).union(place(_head(per, by), COUNTS, none, empty)).union(place(listed, MATCH, verdict_rank(), F.col("query_id")))


def target_reports(matches: DataFrame) -> DataFrame:
    """Lines of a report for each target over its criteria."""
    return report_lines(matches, KEY, "criterion")


def criterion_reports(matches: DataFrame, targets: DataFrame) -> DataFrame:
    """Lines of a report for each criterion over its targets; the averages come last, in a section of no target."""
    mean = averages(matches, targets)
    shown = F.concat(F.lit("  "), F.initcap("verdict"), F.lit(": "), F.format_string("%.1f", "average"))
    nowhere = F.lit(None).cast(matches.schema[KEY].dataType).alias(KEY)
    tail = mean.select("criterion", nowhere, F.lit(TAIL).alias("part"), verdict_rank().alias("rank"), F.lit("").alias("query_id"), shown.alias("line"))
    title = mean.select("criterion").distinct().select("criterion", nowhere, F.lit(TAIL).alias("part"), F.lit(-1).alias("rank"), F.lit("").alias("query_id"), F.lit("- Average:").alias("line"))
    return report_lines(matches, "criterion", KEY).union(title).union(tail)


def in_order(lines: DataFrame, file: str, section: str) -> DataFrame:
    """Lines dealt to partitions and sorted within them in the order of the text (a section that is null comes last)."""
    order = [F.col(file), F.col(section).asc_nulls_last(), F.col("part"), F.col("rank"), F.col("query_id"), F.col("line")]
    return lines.repartitionByRange(tasks(lines.sparkSession), *order).sortWithinPartitions(*order)


def write_reports(lines: DataFrame, path: str, file: str, section: str) -> None:
    """A folder for each value of ``file`` with its lines as text; a long report is several files there, whose names are in order."""
    in_order(lines, file, section).select(file, F.col("line").alias("value")).write.partitionBy(file).mode("overwrite").text(path)
