"""Pattern search against golden graphs and a brute-force matcher on random graphs, many graphs as targets of one job."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from arbora.model import Criterion, PatternTree, annotation, decode_label, encode_label, suggested_pattern
from arbora.operators import match, report, suggest
from arbora.plans import planner

# A library: shelves hold books and boxes, a box holds letters; what is lent or torn is marked.
GOLDEN = [
    ("s1", "shelf", "s1"), ("s1", "holds", "b1"), ("s1", "holds", "b2"), ("s1", "holds", "x1"), ("s2", "shelf", "s2"), ("s2", "holds", "b3"), ("s2", "holds", "x2"), ("x1", "holds", "l1"),
    ("b1", "book", "b1"), ("b1", "lent", "b1"), ("b2", "book", "b2"), ("b3", "book", "b3"), ("b3", "lent", "b3"), ("b3", "torn", "b3"), ("x1", "box", "x1"), ("x2", "box", "x2"), ("l1", "letter", "l1"),
    ("b1", "cites", "b2"), ("b3", "cites", "b1"), ("s3", "shelf", "s3"),
]
SCHEMA = "target_id int, src string, label string, dst string"


def edges(spark, graphs):
    return spark.createDataFrame([(i, *e) for i, g in enumerate(graphs) for e in sorted(g)], SCHEMA)


def brute(target, pattern):
    names = sorted({v for s, _, d in pattern for v in (s, d)})
    nodes = sorted({v for s, _, d in target for v in (s, d)})
    for chosen in itertools.permutations(nodes, len(names)):
        m = dict(zip(names, chosen, strict=True))
        if all((m[s], e, m[d]) in target for s, e, d in pattern):
            yield m


def brute_tree(target, tree, above=frozenset(), base=None):
    """(verdict, mapping) of the deepest matches, by the recursive definition."""
    full = above | tree.pattern
    for m in brute(target, full) if full else [{}]:
        if base is not None and any(m[k] != v for k, v in base.items()):
            continue
        below = [x for c in tree.children for x in brute_any(target, c, full, m)]
        if below:
            yield from (x for c in tree.children for x in brute_tree(target, c, full, m))
        else:
            yield tree.verdict, tuple(sorted(m.items()))


def brute_any(target, tree, above, base):
    return [m for m in brute(target, above | tree.pattern) if all(m[k] == v for k, v in base.items())]


def test_golden_search(spark):
    found = match.search(edges(spark, [GOLDEN]), {("shelf", "shelf", "shelf"), ("shelf", "holds", "it"), ("it", "book", "it"), ("it", "lent", "it")})
    assert {(r["shelf"], r["it"]) for r in found.collect()} == {("s1", "b1"), ("s2", "b3")}


def test_golden_tree(spark):
    """A shelf by itself only where it holds neither a book that is lent nor a box."""
    tree = PatternTree.of(
        "neutral",
        {("s", "shelf", "s")},
        PatternTree.of("negative", {("s", "holds", "b"), ("b", "book", "b"), ("b", "lent", "b")}),
        PatternTree.of("positive", {("s", "holds", "x"), ("x", "box", "x")}, PatternTree.of("neutral", {("x", "holds", "l")})),
    )
    found = match.search_trees(edges(spark, [GOLDEN]), (tree,))
    got = {(r["query_id"], r["verdict"], tuple(sorted(r["mapping"].items()))) for r in found.collect()}
    assert got == {
        ("query_0", "neutral", (("s", "s3"),)),
        ("query_0.0", "negative", (("b", "b1"), ("s", "s1"))),
        ("query_0.0", "negative", (("b", "b3"), ("s", "s2"))),
        ("query_0.1", "positive", (("s", "s2"), ("x", "x2"))),
        ("query_0.1.0", "neutral", (("l", "l1"), ("s", "s1"), ("x", "x1"))),
    }


def random_graph(rng, nodes=5, labels="ab", size=9):
    return {(f"n{rng.randrange(nodes)}", rng.choice(labels), f"n{rng.randrange(nodes)}") for _ in range(size)}


@pytest.mark.parametrize("seed", range(4))
def test_search_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    graphs = [random_graph(rng) for _ in range(40)]
    pattern = {(f"p{rng.randrange(3)}", rng.choice("ab"), f"p{rng.randrange(3)}") for _ in range(rng.randint(1, 4))}
    rows = match.search(edges(spark, graphs), pattern).collect()
    names = planner.variables(frozenset(pattern))
    got = sorted((r["target_id"], *(r[n] for n in names)) for r in rows)
    assert got == sorted((i, *(m[n] for n in names)) for i, g in enumerate(graphs) for m in brute(g, pattern))
    verified = match.verify(edges(spark, graphs), match.search(edges(spark, graphs), pattern), pattern)
    assert verified.count() == len(got)


@pytest.mark.parametrize("seed", range(3))
def test_tree_equals_brute_force(spark, seed):
    rng = random.Random(100 + seed)
    graphs = [random_graph(rng) for _ in range(25)]
    some = lambda names: {(rng.choice(names), rng.choice("ab"), rng.choice(names))}
    tree = PatternTree.of("positive", {("x", "a", "y")}, PatternTree.of("negative", some("xy"), PatternTree.of("neutral", some("xyz"))), PatternTree.of("neutral", some("yz")))
    got = sorted((r["target_id"], r["verdict"], tuple(sorted(r["mapping"].items()))) for r in match.search_trees(edges(spark, graphs), (tree,)).collect())
    want = sorted((i, v, m) for i, g in enumerate(graphs) for v, m in brute_tree(g, tree))
    assert got == want


def test_families_equal_brute_force(spark):
    """Nodes that differ in labels are planned together, over several levels, and each keeps its own id."""
    rng = random.Random(9)
    graphs = [random_graph(rng, nodes=4, labels=["k=a", "k=b", "k=c", "k=d"], size=11) for _ in range(30)]
    leaf = lambda x, y: PatternTree.of("neutral", {("y", f"k={x}", "z"), ("z", f"k={y}", "z")})
    trees = tuple(PatternTree.of("positive", {("x", f"k={r}", "y")}, *[PatternTree.of("negative", {("y", f"k={c}", "y")}, *[leaf(e, r) for e in "ab"]) for c in "abc"]) for r in "abd")
    # The same tree twice: both have its matches.
    trees += (trees[0], PatternTree.of("negative", {("x", "k=c", "y"), ("y", "k=d", "x")}))
    assert len(planner.groups(planner.forest(trees))) == 2
    found = match.search_trees(edges(spark, graphs), trees)
    got = sorted((r["target_id"], r["query_id"].split(".")[0], r["verdict"], tuple(sorted(r["mapping"].items()))) for r in found.collect())
    assert got == sorted((i, f"query_{k}", v, m) for i, g in enumerate(graphs) for k, t in enumerate(trees) for v, m in brute_tree(g, t))
    ids = {r["query_id"] for r in found.select("query_id").distinct().collect()}
    assert {"query_0", "query_3"} <= ids and any(x.count(".") == 2 for x in ids)


def test_stored_graph(spark):
    g = edges(spark, [GOLDEN])
    tree = PatternTree.of("positive", {("a", "holds", "b"), ("b", "book", "b")})
    plain, stored = ({(r["query_id"], tuple(sorted(r["mapping"].items()))) for r in match.search_trees(x, (tree,)).collect()} for x in (g, match.store(g)))
    assert plain == stored and len(plain) == 3


CRITERIA = {
    # A system of particles: twenty edges over nine variables in the root.
    "particles": PatternTree.of(
        "positive",
        {
            ("P", "cls", "P"), ("P", "has", "life"), ("life", "fld", "life"), ("P", "has", "move"), ("move", "mth", "move"), ("move", "reads", "life"), ("P", "has", "gone"), ("gone", "mth", "gone"),
            ("gone", "reads", "life"), ("gone", "needs", "bit"), ("bit", "basic", "bit"), ("S", "cls", "S"), ("S", "has", "list"), ("list", "fld", "list"), ("list", "needs", "P"), ("list", "needs", "L"),
            ("L", "lib", "L"), ("S", "has", "run"), ("run", "reads", "list"), ("run", "calls", "gone"),
        },
        PatternTree.of("neutral", {("run", "calls", "move")}),
    ),
    # A variable that nothing connects.
    "apart": PatternTree.of("positive", {("a", "cls", "a"), ("a", "calls", "b")}, PatternTree.of("negative", {("c", "lib", "c")})),
}


def test_large_root(spark):
    """The pattern is found where it is planted, also twice, and nowhere where one of its edges is missing."""
    tree = CRITERIA["particles"]
    rename = lambda k: {(f"{s}{k}", x, f"{d}{k}") for s, x, d in tree.pattern}
    assert len(tree.pattern) == 20 and len(planner.variables(tree.pattern)) == 9
    rng, graphs, want = random.Random(3), [], Counter()
    for i in range(12):
        noise = {(f"n{rng.randrange(9)}", rng.choice(["has", "reads", "calls", "needs", "cls", "mth"]), f"n{rng.randrange(9)}") for _ in range(40)}
        if i % 3 == 0:
            graphs.append(noise | rename("x"))
            want[i, "query_0"] += 1
        elif i % 3 == 1:
            graphs.append(noise | rename("x") | rename("y") | {("runy", "calls", "movey")})
            want.update({(i, "query_0"): 1, (i, "query_0.0"): 1})
        else:
            missing = rng.choice(sorted(rename("x")))
            graphs.append(noise | (rename("x") - {missing}))
    got = Counter((r["target_id"], r["query_id"]) for r in match.search_trees(edges(spark, graphs), (tree,)).collect())
    assert got == want


def test_many_nodes(spark):
    """A family of 95 nodes in two levels is a few groups, and is found as by brute force."""
    fields, methods = [f"f{i}" for i in range(9)], [f"m{i}" for i in range(9)]
    lit = lambda v, x: (v, f"annotation.location={x}", v)
    over = {("T", "cls", "T"), ("T", "has", "m"), ("m", "overrides", "o")}
    first = PatternTree.of("positive", over, *[PatternTree.of("neutral", {lit("o", x)}) for x in ("draw", "setup", "settings")])
    second = PatternTree.of("neutral", {("m", "reads", "f")}, *[PatternTree.of("negative", {lit("f", x)}, *[PatternTree.of("neutral", over | {lit("o", y)}) for y in methods]) for x in fields])
    plan = planner.groups(planner.forest((first, second)))
    count = lambda gs: sum(1 + count(g.children) for g in gs)
    nodes = lambda gs: sum(len(g.members) + nodes(g.children) for g in gs)
    assert (count(plan), nodes(plan)) == (5, 95)
    rng, graphs = random.Random(2), []
    for _ in range(6):
        names = [f"n{i}" for i in range(5)]
        g = {(rng.choice(names), rng.choice(["has", "overrides", "reads", "reads"]), rng.choice(names)) for _ in range(12)} | {(n, "cls", n) for n in names[:2]}
        graphs.append(g | {(n, f"annotation.location={rng.choice(fields[:3] + methods[:3] + ['draw'])}", n) for n in names for _ in range(2)})
    got = Counter((r["target_id"], r["verdict"], tuple(sorted(r["mapping"].items()))) for r in match.search_trees(edges(spark, graphs), (first, second)).collect())
    assert got == Counter((i, v, m) for i, g in enumerate(graphs) for t in (first, second) for v, m in brute_tree(g, t)) and len(got) > 10


def test_unconnected_variable(spark):
    rng = random.Random(12)
    graphs = [{(f"n{rng.randrange(4)}", rng.choice(["calls", "cls", "lib"]), f"n{rng.randrange(4)}") for _ in range(9)} for _ in range(15)]
    got = Counter((r["target_id"], r["verdict"], tuple(sorted(r["mapping"].items()))) for r in match.search_trees(edges(spark, graphs), (CRITERIA["apart"],)).collect())
    assert got == Counter((i, v, m) for i, g in enumerate(graphs) for v, m in brute_tree(g, CRITERIA["apart"]))


def test_extensions_of_several_queries(spark):
    """Fractions and choices are per query, not over all."""
    g = edges(spark, [GOLDEN, GOLDEN[:9]])
    trees = (PatternTree.of("positive", {("s", "holds", "b"), ("b", "book", "b")}), PatternTree.of("positive", {("a", "cites", "b")}))
    found = match.search_trees(g, trees)
    known = spark.createDataFrame(planner.query_edges(planner.forest(trees)), "query_id string, src string, label string, dst string")
    got = {(r["query_id"], r["qsrc"], r["label"], r["qdst"]): r["fraction"] for r in suggest.edge_extensions(found, g, known).collect()}
    rows = [(r["target_id"], r["query_id"], r["mapping"]) for r in found.collect()]
    for q, tree in (("query_0", trees[0]), ("query_1", trees[1])):
        mine = [(t, m) for t, x, m in rows if x == q]
        seen = Counter((u, e, v) for t, m in mine for u in m for v in m for s, e, d in (GOLDEN, GOLDEN[:9])[t] if (s, d) == (m[u], m[v]) and (u, e, v) not in tree.pattern)
        assert {k[1:]: f for k, f in got.items() if k[0] == q} == {k: n / len(mine) for k, n in seen.items()}
    chosen = suggest.select_extensions(suggest.edge_extensions(found, g, known), ["qsrc", "label", "qdst"]).collect()
    assert {r["query_id"] for r in chosen} == {"query_0", "query_1"} and all(r["rank"] >= 1 for r in chosen)


def test_disconnected_extension(spark):
    g = edges(spark, [{("0", "0", "0"), ("0", "2", "1")}, {("2", "l", "2"), ("3", "m", "3")}])
    base, more = {("a", "0", "a")}, {("b", "2", "c")}
    direct = match.search(g, base | more).collect()
    assert direct == match.search_extended(g, match.search(g, base), base, more).collect() == []
    both = match.search(g, {("a", "l", "a"), ("b", "m", "b")}).collect()
    assert [(r["target_id"], r["a"], r["b"]) for r in both] == [(1, "2", "3")]


def test_empty_patterns(spark):
    with pytest.raises(ValueError):
        match.search_trees(edges(spark, [GOLDEN]), (PatternTree.of("positive", set()),))
    # A child with an empty pattern always matches and so suppresses its parent.
    tree = PatternTree.of("positive", {("c", "shelf", "c")}, PatternTree.of("neutral", set()))
    assert {r["verdict"] for r in match.search_trees(edges(spark, [GOLDEN]), (tree,)).collect()} == {"neutral"}


def test_order_follows_connections():
    pattern = frozenset({("a", "x", "b"), ("b", "x", "c"), ("d", "x", "d")})
    assert planner.order(pattern) == ["b", "a", "c", "d"]
    assert planner.order(pattern, ("c",))[0] == "c"


def test_codecs():
    assert decode_label({"annotation": {"scheme": "java+class"}}) == annotation("scheme", "java+class")
    assert encode_label(annotation("location", "a=b")) == {"annotation": {"location": "a=b"}}
    with pytest.raises(ValueError):
        decode_label("knows")
    raw = {"criterion": "c", "patterns": [{"verdict": "negative", "pattern": [["f", {"annotation": {"modifier": "final"}}, "f"]], "children": [{"verdict": "neutral", "pattern": [["f", "overrides", "g"]]}]}]}
    assert Criterion.decode(raw).encode() == raw
    (tree,) = suggested_pattern({"success": True, "patterns": [{"verdict": "positive", "graph": {"nodes": [{"id": "a", "labels": ["class"]}], "edges": [{"fromId": "a", "toId": "b", "label": "contains"}]}}]})
    assert tree.pattern == {("a", "class", "a"), ("a", "contains", "b")}


def test_averages_count_targets_without_matches(spark, tmp_path):
    g = edges(spark, [GOLDEN, {("x", "other", "x")}])
    found = report.assess(g, [Criterion("shelves", (PatternTree.of("positive", {("c", "shelf", "c")}),))])
    assert report.averages(found, g).first()["average"] == 1.5
    text = "\n".join(r["line"] for r in report.in_order(report.target_reports(found), "target_id", "criterion").collect())
    assert text.startswith("- shelves\n  Positive: 3\n  - Positive / query_0\n    - `c` ->\n      `s1`\n  - Positive")
    text = "\n".join(r["line"] for r in report.in_order(report.criterion_reports(found, g), "criterion", "target_id").collect())
    assert text.startswith("- 0\n  Positive: 3\n") and text.endswith("- Average:\n  Positive: 1.5")
    report.write_reports(report.target_reports(found), str(tmp_path / "out"), "target_id", "criterion")
    written = "".join(f.read_text() for f in sorted((tmp_path / "out/target_id=0").glob("*.txt")))
    assert written.startswith("- shelves\n  Positive: 3\n") and written.count("\n") == 2 + 3 * 3


def test_no_distinct_needed(spark):
    g = edges(spark, [GOLDEN])
    rows = match.search(g, {("a", "holds", "b"), ("a", "holds", "c")})
    assert rows.count() == rows.distinct().count() == rows.filter(F.col("b") != F.col("c")).count()
