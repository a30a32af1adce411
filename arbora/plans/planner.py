"""The order in which a pattern's variables are bound, and the joins that bind them.  Pure Python: patterns are small."""

from __future__ import annotations

from dataclasses import dataclass

from arbora.model import Edge, PatternTree


@dataclass(frozen=True)
class Step:
    """Binds ``variable`` along ``via`` (None: from its loops, a first edge, or anything in the target), or checks edges among bound ones if ``variable`` is None."""

    variable: str | None
    via: Edge | None
    checks: tuple[Edge, ...]
    loops: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class TreeNode:
    """A flattened tree node: ``own`` edges extend those of its ancestors."""

    query_id: str
    verdict: str
    own: frozenset[Edge]
    children: tuple[TreeNode, ...]


def variables(edges: frozenset[Edge]) -> list[str]:
    return sorted({v for s, _, d in edges for v in (s, d)})


def neighbours(edges: frozenset[Edge]) -> dict[str, tuple[set[str], set[str]]]:
    """Per variable, those with an edge to it and those with an edge from it, loops left out."""
    found: dict[str, tuple[set[str], set[str]]] = {v: (set(), set()) for v in variables(edges)}
    for s, _, d in edges:
        if s != d:
            found[d][0].add(s)
            found[s][1].add(d)
    return found


def order(edges: frozenset[Edge], bound: tuple[str, ...] = ()) -> list[str]:
    """``bound`` first; then ever the variable with most bound neighbours, then most neighbours, then the least name."""
    near, done = neighbours(edges), list(bound)
    degree = {v: len(i) + len(o) for v, (i, o) in near.items()}
    left = [v for v in variables(edges) if v not in bound]
    while left:
        best = min(left, key=lambda v: (-len((near[v][0] | near[v][1]) & set(done)), -degree[v], v))
        done.append(best)
        left.remove(best)
    return done


def steps(edges: frozenset[Edge], bound: tuple[str, ...] = ()) -> list[Step]:
    """Joins that extend matches of ``bound`` by ``edges``: checks among bound variables come first, since they only remove rows."""
    if not edges and not bound:
        raise ValueError("a root pattern needs an edge")
    links = sorted(e for e in edges if e[0] != e[2])
    loops: dict[str, list[str]] = {}
    for s, label, d in sorted(edges):
        if s == d:
            loops.setdefault(s, []).append(label)
    plan, known = [], set(bound)
    checks = tuple(e for e in links if e[0] in known and e[2] in known)
    old = tuple((v, x) for v in sorted(known & loops.keys()) for x in loops[v])
    if checks or old:
        plan.append(Step(None, None, checks, old))
    for v in order(edges, bound)[len(bound) :]:
        touching = [e for e in links if v in (e[0], e[2]) and (e[0] in known or e[2] in known)]
        plan.append(Step(v, touching[0] if touching else None, tuple(touching[1:]), tuple((v, x) for x in loops.get(v, ()))))
        known.add(v)
    return plan


def flatten(tree: PatternTree, query_id: str) -> TreeNode:
    """Ids: ``query_0``, its children ``query_0.0``, ``query_0.1``, and so on."""
    return TreeNode(query_id, tree.verdict, tree.pattern, tuple(flatten(c, f"{query_id}.{i}") for i, c in enumerate(tree.children)))


def forest(trees: tuple[PatternTree, ...]) -> list[TreeNode]:
    for t in trees:
        if not t.pattern:
            raise ValueError("a root pattern needs an edge")
    return [flatten(t, f"query_{i}") for i, t in enumerate(trees)]


@dataclass(frozen=True)
class Member:
    """A node of a group: its parent's id, and its labels where the group's differ."""

    parent: str | None
    node: TreeNode
    labels: tuple[str, ...]


@dataclass(frozen=True)
class Group:
    """Tree nodes of one verdict whose own edges join the same variables and differ in labels alone, under parents of one group."""

    verdict: str
    members: tuple[Member, ...]
    edges: tuple[tuple[str, tuple[str, ...], str], ...]  # each with its labels, one if all members agree
    children: tuple[Group, ...]

    def template(self) -> tuple[frozenset[Edge], dict[str, tuple[str, ...]]]:
        """The edges, with ``$0``, ``$1``, ... where labels differ, and what these may be."""
        several = {f"${i}": tuple(sorted(set(labels))) for i, labels in enumerate(x for _, x, _ in self.edges if len(x) > 1)}
        names = iter(several)
        return frozenset((s, next(names) if len(labels) > 1 else labels[0], d) for s, labels, d in self.edges), several


def _shape(node: TreeNode) -> tuple:
    """What nodes of a group have in common: verdict and, in order, ends and kinds of their own edges."""
    return node.verdict, tuple((s, d, label.partition("=")[0]) for s, label, d in _ordered(node))


def _ordered(node: TreeNode) -> list[Edge]:
    return sorted(node.own, key=lambda e: (e[0], e[2], e[1]))


def groups(nodes: list[TreeNode], parents: list[str | None] | None = None) -> tuple[Group, ...]:
    """Nodes (``parents``: the id of each one's parent) by shape, and their children likewise."""
    parents = parents or [None] * len(nodes)
    by: dict[tuple, list[tuple[str | None, TreeNode]]] = {}
    for parent, node in zip(parents, nodes, strict=True):
        by.setdefault(_shape(node), []).append((parent, node))
    found = []
    for (verdict, _), some in by.items():
        columns = list(zip(*(_ordered(n) for _, n in some), strict=True))
        differ = [len({e[1] for e in column}) > 1 for column in columns]
        edges = tuple((c[0][0], tuple(e[1] for e in c) if d else (c[0][1],), c[0][2]) for c, d in zip(columns, differ, strict=True))
        members = tuple(Member(p, n, tuple(e[1] for e, d in zip(_ordered(n), differ, strict=True) if d)) for p, n in some)
        below = [(n.query_id, c) for _, n in some for c in n.children]
        found.append(Group(verdict, members, edges, groups([c for _, c in below], [p for p, _ in below])))
    return tuple(found)


def query_edges(nodes: list[TreeNode], above: frozenset[Edge] = frozenset()) -> list[tuple[str, str, str, str]]:
    """(query_id, src, label, dst) of every node, ancestors' edges included."""
    rows = []
    for n in nodes:
        full = above | n.own
        rows += [(n.query_id, *e) for e in sorted(full)]
        rows += query_edges(list(n.children), full)
    return rows
