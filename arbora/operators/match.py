"""Pattern search as joins.

A match is an injective mapping of a pattern's variables to nodes of one target under which every pattern edge is in the target.  Each
variable is one equi-join on ``(target_id, bound node)``; further edges are semi-joins; all variables differ.  Since edges do not repeat and
every variable is returned, each match is found once.  In a tree, a match of a node is returned unless a child extends it.

Trees are planned in groups: nodes of one shape, which differ in labels alone and whose parents are of one group, are one set of joins in which
the differing labels are columns, looked up in a literal table of the group's members.  So a family of patterns costs as much as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.model import Edge, PatternTree
from arbora.plans import planner
from arbora.storage import durable

KEY = "target_id"
#: The id of the tree node that a row matches, and of its parent.
QUERY, PARENT = "query_id", "__parent"


def kind_of(label: str) -> str:
    """What stands before a label's value: the column ``kind`` of a stored graph, by which its files are laid out."""
    return label.partition("=")[0]


def store(edges: DataFrame) -> DataFrame:
    """``edges`` with ``kind``, written once in a folder for each kind: a search for a label reads that kind alone."""
    kind = F.split_part("label", F.lit("="), F.lit(1))
    return durable(edges.select(KEY, "src", "label", "dst", kind.alias("kind")), "edges", "kind", sweep=True, compression="zstd")


class Graph:
    """The edges of all targets, split once into links and loops.  With a column ``kind`` (see ``store``) labels prune what is read."""

    def __init__(self, edges: DataFrame):
        self.kinds = "kind" in edges.columns
        self.edges = edges.select(KEY, "src", "label", "dst", *(["kind"] if self.kinds else []))

    def labelled(self, labels: tuple[str, ...]) -> DataFrame:
        found = self.edges.filter(F.col("label").isin(*labels))
        return found.filter(F.col("kind").isin(*sorted({kind_of(x) for x in labels}))) if self.kinds else found

    def linked(self, labels: tuple[str, ...], src: str, dst: str, name: str | None = None) -> DataFrame:
        """Links with one of ``labels``; which one is told in the column ``name``."""
        told = [F.col("label").alias(name)] if name else []
        return self.labelled(labels).filter("src <> dst").select(KEY, F.col("src").alias(src), F.col("dst").alias(dst), *told)

    def looped(self, labels: tuple[str, ...], node: str, name: str | None = None) -> DataFrame:
        told = [F.col("label").alias(name)] if name else []
        return self.labelled(labels).filter("src = dst").select(KEY, F.col("src").alias(node), *told)

    def nodes(self, name: str) -> DataFrame:
        return self.edges.select(KEY, F.col("src").alias(name)).union(self.edges.select(KEY, F.col("dst").alias(name))).distinct()


class Found:
    """Matches so far: a DataFrame and the column of each variable (names may hold characters that columns may not).  ``extra``: further columns to keep."""

    def __init__(self, rows: DataFrame | None, columns: dict[str, str], extra: tuple[str, ...] = ()):
        self.rows, self.columns, self.extra = rows, columns, extra

    def key(self) -> list[str]:
        return [KEY, *self.columns.values()]


class Labels:
    """What the labels of a pattern's edges stand for: themselves, or (``$0``, ``$1``, ...) one of several, told in a column of that name."""

    def __init__(self, several: dict[str, tuple[str, ...]] | None = None):
        self.several = several or {}

    def of(self, label: str) -> tuple[tuple[str, ...], str | None]:
        return (self.several[label], label) if label in self.several else ((label,), None)


def _start(graph: Graph, step: planner.Step, edges: frozenset[Edge], column: str, labels: Labels) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Candidates for a variable without a bound neighbour, and the loops still to be checked."""
    if step.loops:
        return graph.looped(*labels.of(step.loops[0][1])[:1], column, labels.of(step.loops[0][1])[1]), list(step.loops[1:])
    v = step.variable
    for s, label, d in sorted(edges):
        if s != d and v in (s, d):
            return graph.linked(labels.of(label)[0], column if s == v else "__o", "__o" if s == v else column).select(KEY, column).distinct(), []
    return graph.nodes(column), []


def extend(graph: Graph, found: Found, edges: frozenset[Edge], labels: Labels | None = None) -> Found:
    """``found`` extended by ``edges``; new variables differ from all others."""
    labels = labels or Labels()
    rows, columns = found.rows, dict(found.columns)

    def checked(rows: DataFrame, have: DataFrame, on: list[str], name: str | None) -> DataFrame:
        # A label that is one of several makes a row for each that is there.
        return rows.join(have, on) if name else rows.join(have, on, "left_semi")

    for step in planner.steps(edges, tuple(columns)):
        loops = list(step.loops)
        if step.variable is not None:
            v = step.variable
            new = columns[v] = f"v{len(columns)}"
            others = [c for name, c in columns.items() if name != v]
            if step.via is None:
                start, loops = _start(graph, step, edges, new, labels)
                rows = start if rows is None else rows.join(start, KEY)
            else:
                s, label, d = step.via
                some, name = labels.of(label)
                rows = rows.join(graph.linked(some, columns[s], columns[d], name), [KEY, columns[d] if s == v else columns[s]])
            for c in others:
                rows = rows.filter(F.col(c) != F.col(new))
        for s, label, d in step.checks:
            some, name = labels.of(label)
            rows = checked(rows, graph.linked(some, columns[s], columns[d], name), [KEY, columns[s], columns[d]], name)
        for v, label in loops:
            some, name = labels.of(label)
            rows = checked(rows, graph.looped(some, columns[v], name), [KEY, columns[v]], name)
    return Found(rows.select(KEY, *found.extra, *columns.values(), *[F.col(f"`{x}`") for x in labels.several]), columns, found.extra)


def search(edges: DataFrame, pattern: frozenset[Edge] | set[Edge]) -> DataFrame:
    """``target_id`` and one column per variable, by its name."""
    found = extend(Graph(edges), Found(None, {}), frozenset(pattern))
    return found.rows.select(KEY, *[F.col(c).alias(v) for v, c in sorted(found.columns.items())])


def search_extended(edges: DataFrame, mapping: DataFrame, base: set[Edge], extension: set[Edge]) -> DataFrame:
    """Matches of ``base`` together with ``extension`` that extend the rows of ``mapping`` (``target_id`` and a column per variable)."""
    names = [c for c in mapping.columns if c != KEY]
    columns = {v: f"v{i}" for i, v in enumerate(names)}
    rows = mapping.select(KEY, *[F.col(f"`{v}`").alias(c) for v, c in columns.items()])
    found = extend(Graph(edges), Found(rows if names else None, columns), frozenset(base | extension))
    return found.rows.select(KEY, *[F.col(c).alias(v) for v, c in sorted(found.columns.items())])


def verify(edges: DataFrame, mapping: DataFrame, pattern: set[Edge]) -> DataFrame:
    """The rows of ``mapping`` under which every pattern edge is in the target (whether nodes differ is not asked)."""
    graph, rows = Graph(edges), mapping
    for s, label, d in sorted(pattern):
        have = graph.labelled((label,))
        if s == d:
            have = have.filter("src = dst").select(F.col(KEY).alias("__t"), F.col("src").alias("__s"))
            rows = rows.join(have, (rows[KEY] == have["__t"]) & (rows[s] == have["__s"]), "left_semi")
        else:
            have = have.select(F.col(KEY).alias("__t"), F.col("src").alias("__s"), F.col("dst").alias("__d"))
            rows = rows.join(have, (rows[KEY] == have["__t"]) & (rows[s] == have["__s"]) & (rows[d] == have["__d"]), "left_semi")
    return rows


def mapping_of(columns: dict[str, str]) -> Column:
    """The mapping as a map from variable to node, by variable name."""
    pairs = [x for v, c in sorted(columns.items()) for x in (F.lit(v), F.col(c))]
    return F.create_map(*pairs)


def _group(graph: Graph, group: planner.Group, above: Found, out: list[DataFrame], keep: bool) -> Found:
    """The matches of a group's nodes and, through ``out``, those that no child extends; rows carry the ids of node and parent."""
    spark = graph.edges.sparkSession
    template, several = group.template()
    # The parent's id becomes PARENT; the members' table tells by it and the labels which node a row is of.
    rows = None if above.rows is None else above.rows.select(KEY, F.col(QUERY).alias(PARENT), *above.columns.values())
    start = Found(rows, above.columns, () if rows is None else (PARENT,))
    found = extend(graph, start, template, Labels(several)) if template else start
    rows, by = found.rows, [*found.extra, *several]
    if by:
        members = spark.createDataFrame([(*([m.parent] if found.extra else []), *m.labels, m.node.query_id) for m in group.members], ", ".join(f"`{c}` string" for c in (*by, QUERY)))
        # One row for each node of the plan, which is a program text: small whatever the data.
        rows = rows.join(F.broadcast(members), by)
    else:  # nothing tells the members apart: each match is one of all of them
        rows = rows.withColumn(QUERY, F.explode(F.array(*[F.lit(m.node.query_id) for m in group.members])))
    rows = rows.select(KEY, *found.extra, QUERY, *found.columns.values())
    if group.children and keep:
        rows = durable(rows, "matches-of-node")
    found = Found(rows, found.columns)
    if group.children:
        # Any child that extends a match suppresses it, whatever becomes of the child's own matches.
        extended = [_group(graph, c, found, out, keep).rows.select(KEY, F.col(PARENT).alias(QUERY), *found.columns.values()) for c in group.children]
        rows = rows.join(reduce(DataFrame.unionByName, extended), [KEY, QUERY, *found.columns.values()], "left_anti")
    out.append(rows.select(KEY, QUERY, F.lit(group.verdict).alias("verdict"), mapping_of(found.columns).alias("mapping")))
    return found


def search_trees(edges: DataFrame, trees: tuple[PatternTree, ...], keep: bool = True) -> DataFrame:
    """``target_id``, ``query_id``, ``verdict``, ``mapping``: the deepest matches of every tree, all trees together.

    Matches of nodes with children are needed once for each group of children and once more: ``keep`` writes them in the shared folder, so that
    they are found once.
    """
    graph, out = Graph(edges), []
    for group in planner.groups(planner.forest(tuple(trees))):
        _group(graph, group, Found(None, {}), out, keep)
    return reduce(DataFrame.unionByName, out)


def mapping_text(column: str = "mapping") -> Column:
    """A mapping as ``q=t|q=t`` in variable order: a match's identity within its target."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
