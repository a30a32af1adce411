"""Algebra, index predicates, sources, text and streams on small inputs; the queries against their SQL."""

from __future__ import annotations

import io
import json
import random
import zipfile
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from arbora import commerce
from arbora.functions import arrays, text
from arbora.model import Criterion, PatternTree
from arbora.operators import extract, graph, report, suggest
from arbora.plans import planner
from arbora.queries import ORACLES, QUERIES
from arbora.sources import codecs, formats, grading, typegraph
from arbora.storage import release
from arbora.streaming import watch
from tests.conftest import DATA


def test_entry(spark):
    assert entry.entry(spark).count() == 474


@pytest.mark.parametrize("name", ["mg_dictionary", "mg_extend", "spmf_export", "spmf_import", "graph_subgraph_extension", "mg_signatures", "sig_features", "neighbourhood_both", "neighbourhood_any", "neighbourhood_incoming", "rect_inside", "match_shared", "match_disconnected", "tree_exception", "tree_family", "verdict_average", "verdict_details", "report_targets", "report_criteria", "ext_samples", "pii_alias_emails", "pii_students", "x_depends_on", "x_depends_on_units", "x_overrides", "x_dependences", "ext_several", "rect_clustered", "codec_boxes", "codec_signatures", "codec_multigraph", "ext_edges", "ext_nodes", "ext_select", "x_containing_types", "json_roundtrip", "pii_names", "event_debounce", "event_unique_queue", "rect_wrap"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {f.stem} as select * from '{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got and Counter(map(repr, got)) == Counter(map(repr, want))


def test_condense_example(spark):
    g = spark.createDataFrame([(0, "x", "in", "y"), (0, "y", "in", "x"), (0, "x", "at", "y"), (0, "x", "at", "x"), (1, "x", "on", "y")], "target_id int, src string, label string, dst string")
    assert {(r["target_id"], r["src"], tuple(r["labels"]), r["dst"]) for r in graph.condense(g).collect()} == {(0, "x", ("at", "in"), "y"), (0, "y", ("in",), "x"), (0, "x", ("at",), "x"), (1, "x", ("on",), "y")}
    names = graph.dictionary(g)
    assert {tuple(r) for r in graph.decode(graph.encode(g, names), names).collect()} == {tuple(r) for r in g.collect()}
    more = spark.createDataFrame([(0, "a", "in", "y"), (2, "z", "in", "z")], g.schema)
    longer = {(r["target_id"], r["node"]): r["node_id"] for r in graph.extend_dictionary(names, more).collect()}
    assert longer == {(0, "x"): 0, (0, "y"): 1, (0, "a"): 2, (1, "x"): 0, (1, "y"): 1, (2, "z"): 0}


def test_set_keys_and_boxes(spark):
    a = lambda *x: F.array(*[F.lit(v).cast("bigint") for v in x])
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first()["x"]
    assert value(arrays.superset(a(1, 2, 3), a(2))) and not value(arrays.superset(a(1), a(2))) and value(arrays.superset(a(1), F.array().cast("array<bigint>")))
    assert value(arrays.subset(F.array().cast("array<bigint>"), a(1))) and value(arrays.same_set(a(2, 1, 1), a(1, 2)))
    assert value(arrays.union_many(F.array(a(3, 1), a(1)))) == [1, 3] and value(arrays.intersect_many(F.array(a(3, 1), a(1, 4)))) == [1]
    box = arrays.Box(a(0, 0), a(4, 2))
    assert value(box.area()) == 8 and value(box.center()) == [2, 1] and value(box.dimensions()) == 2
    assert value(arrays.Box.from_origin(a(-2, 3)).low) == [-2, 0]
    far = arrays.Box(a(5, 0), a(6, 1))
    assert value(box.intersects(far)) and not value(box.meets(far))  # the index test lets through what differs in one dimension only
    assert value(arrays.Box.point(a(4, 2)).inside(box)) and value(box.wrap(far).high) == [6, 2]
    with pytest.raises(Exception, match="not a box"):
        value(arrays.Box.checked(a(1), a(0)).low)


def test_typegraph_files(spark, tmp_path):
    texts = {"p1": '[["a",{"annotation":{"scheme":"java+class"}},"a"],["a","contains","b"],["a","contains","b"]]', "p2": "[]", "p3": '[["a","knows","b"]]', "p4": "{"}
    for name, value in texts.items():
        (tmp_path / name / "source/graph").mkdir(parents=True)
        (tmp_path / name / "source/graph/typegraph.json").write_text(value)
    edges, errors = typegraph.read_targets(spark, str(tmp_path))
    assert {tuple(r) for r in edges.collect()} == {("p1", "a", "annotation.scheme=java+class", "a"), ("p1", "a", "contains", "b")}
    assert {r["target_id"] for r in errors.collect()} == {"p2", "p3", "p4"}
    assert typegraph.encode(edges).first()["value"] == '[["a","contains","b"],["a",{"annotation":{"scheme":"java+class"}},"a"]]'
    assert [r["target_id"] for r in typegraph.read_targets(spark, str(tmp_path), skip=2, limit=1)[1].collect()] == ["p3"]


def test_typegraphs_in_pieces(spark, tmp_path):
    """A project is many rows; only what may repeat is brought together; an error in one piece is one of the whole file."""
    rows = [(t, f"n{i}", label, 'say "x"\\\n' if i % 7 == 0 else f"m{i}") for t in range(2) for i in range(300) for label in ("contains", 'annotation.location=a"=b')]
    g = spark.createDataFrame(rows, "target_id int, src string, label string, dst string")
    texts = typegraph.encode(g.repartition(5), size=40)
    assert texts.count() >= 30 and max(len(json.loads(r["value"])) for r in texts.collect()) <= 40
    edges, errors = typegraph.decode(texts)
    assert Counter(map(tuple, edges.collect())) == Counter(rows) and errors.isEmpty()
    twice, _ = typegraph.decode(texts.select("target_id", "value").unionByName(texts.filter("target_id = 1").select("target_id", "value")))
    assert Counter(map(tuple, twice.collect())) == Counter(rows)
    more = spark.createDataFrame([(1, '[["a","knows","b"]]'), (0, "[]"), (2, "[]")], "target_id int, value string")
    kept, bad = typegraph.decode(texts.select("target_id", "value").unionByName(more))
    assert {r["target_id"] for r in kept.collect()} == {0} and {tuple(r) for r in bad.collect()} == {(1, "an invalid edge"), (2, "an empty graph")}
    typegraph.write_files(texts, str(tmp_path))
    read, _ = typegraph.read_targets(spark, str(tmp_path))
    assert Counter((int(r["target_id"]), *tuple(r)[1:]) for r in read.collect()) == Counter(rows)


def test_multigraphs_in_pieces(spark):
    rows = [(t, i % 50, label, i) for t in range(2) for i in range(300) for label in ("a", 'say "x"')]
    coded = spark.createDataFrame(rows, "target_id int, src bigint, label string, dst bigint")
    counts = spark.createDataFrame([(0, 300), (1, 300), (2, 7)], "target_id int, node_count bigint")
    texts = codecs.encode_graphs(coded.repartition(5), counts, size=40)
    found = [(r["target_id"], json.loads(r["value"])) for r in texts.collect()]
    assert len(found) >= 31 and max(len(x["edges"]) for _, x in found) <= 40 and {(t, x["nodeCount"]) for t, x in found} == {(0, 300), (1, 300), (2, 7)}
    assert Counter(map(tuple, codecs.decode_graphs(texts).collect())) == Counter(rows)
    assert Counter(map(tuple, codecs.decode_graphs(texts.union(texts)).collect())) == Counter(rows)


def test_criteria_folder(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"criterion": "c", "patterns": []}))
    (tmp_path / "b.json").write_text("{}")
    assert [c.text for c in typegraph.read_criteria(str(tmp_path))] == ["c"]
    with pytest.raises(KeyError):
        typegraph.read_criteria(str(tmp_path), strict=True)


def test_solver_formats(spark):
    enc = lambda s: __import__("base64").b64encode(s.encode()).decode()
    lines = spark.createDataFrame([(0, f"mapping = ({enc('p')} -> {enc('t 1')}) ({enc('q')} -> {enc('t2')})"), (0, "nodes = 4")], "target_id int, line string")
    assert {(r["qnode"], r["tnode"]) for r in formats.gss_mappings(lines).collect()} == {("p", "t 1"), ("q", "t2")}
    labels = spark.createDataFrame([("x", 0), ("y", 1)], "label string, label_id bigint")
    text_ = spark.createDataFrame([("t # 0 * 2\nv 0 0\nv 1 0\ne 0 1 1\nx 3 5\n\nt # 1 * 1\nv 0 0\ne 0 0 0\nx 4",)], "value string")
    edges, within = formats.spmf_subgraphs(text_, labels)
    assert {tuple(r) for r in edges.collect()} == {(0, 0, "y", 1), (1, 0, "x", 0)}
    assert {r["graph"]: r["containing"] for r in within.collect()} == {0: [3, 5], 1: [4]}


def test_archive_nested_too_deep():
    """A row says that something was left out."""
    content = b"void setup() {}"
    for k in range(11):
        into = io.BytesIO()
        with zipfile.ZipFile(into, "w") as z:
            z.writestr("a.pde" if not k else "in.zip", content)
        content = into.getvalue()
    (row,) = grading.archive_members("out.zip", content)
    assert row[0] == "out.zip" + 9 * "/in.zip" and row[1:3] == ("error", None)
    assert [r[1] for r in grading.archive_members("out.zip", content, depth=10)] == ["text"]


def test_archives(spark, tmp_path):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep/B.java", "class B {}")
    with zipfile.ZipFile(tmp_path / "one.zip", "w") as z:
        z.writestr("A.pde", "void setup() {}\nvoid draw() {}")
        z.writestr("x.zip", inner.getvalue())
        z.writestr("broken.zip", b"no zip")
        z.writestr("__MACOSX/A.pde", "junk")
        z.writestr("lib.jar", b"\0")
    rows = {(r["path"], r["kind"]) for r in grading.read_archives(spark, str(tmp_path)).collect()}
    assert rows == {("one.zip/A.pde", "text"), ("one.zip/x.zip/deep/B.java", "text"), ("one.zip/lib.jar", "verbatim"), ("one.zip/broken.zip", "error")}
    files = spark.createDataFrame([("a/sketch/A.pde", "void setup() {\n}\nvoid draw() {}"), ("a/sketch/B.pde", "int x;")], "path string, value string")
    assert [(r["path"], r["sketch"]) for r in grading.sketch_main(files).collect()] == [("a/sketch/A.pde", "sketch")]


def test_index_predicates_on_random_boxes_and_sets(spark):
    """Search inside, around and across, and sub- and supersets, against plain comparisons."""
    rng = random.Random(5)
    side = lambda: sorted(rng.sample(range(12), 2))
    boxes = [(i, list(lo), list(hi)) for i, (lo, hi) in enumerate(tuple(zip(side(), side(), strict=True)) for _ in range(150))]
    df = spark.createDataFrame(boxes, "id int, low array<bigint>, high array<bigint>")
    own = arrays.Box(F.col("low"), F.col("high"))
    for _ in range(4):
        (x1, x2), (y1, y2) = side(), side()
        w = arrays.Box(*(F.array(*[F.lit(v).cast("bigint") for v in p]) for p in ((x1, y1), (x2, y2))))
        got = lambda test: {r["id"] for r in df.filter(test).collect()}
        assert got(own.inside(w)) == {i for i, a, b in boxes if x1 <= a[0] and y1 <= a[1] and b[0] <= x2 and b[1] <= y2}
        assert got(w.inside(own)) == {i for i, a, b in boxes if a[0] <= x1 and a[1] <= y1 and x2 <= b[0] and y2 <= b[1]}
        assert got(own.meets(w)) == {i for i, a, b in boxes if a[0] <= x2 and x1 <= b[0] and a[1] <= y2 and y1 <= b[1]} <= got(own.intersects(w))
    tree = codecs.box_tree([(a, b, i) for i, a, b in boxes], capacity=4)
    assert sorted((v, a, b) for a, b, v in codecs.box_tree_entries(tree)) == [(i, a, b) for i, a, b in boxes] and codecs.box_tree([]) is None
    sets = [(i, [rng.choice("abcde") for _ in range(rng.randint(0, 5))]) for i in range(120)]
    keys = spark.createDataFrame(sets, "id int, keys array<string>")
    for word in ([], ["a"], ["b", "a", "b"], list("abcde")):
        w = F.array(*map(F.lit, word)).cast("array<string>")
        got = lambda test: {r["id"] for r in keys.filter(test).collect()}
        assert got(arrays.superset(F.col("keys"), w)) == {i for i, k in sets if set(word) <= set(k)}
        assert got(arrays.subset(F.col("keys"), w)) == {i for i, k in sets if set(k) <= set(word)}
        assert got(arrays.same_set(F.col("keys"), w)) == {i for i, k in sets if set(k) == set(word)}
    trie = codecs.set_trie((k, i) for i, k in sets)
    assert sorted((v, list(k)) for k, v in codecs.set_trie_entries(trie)) == [(i, sorted(set(k))) for i, k in sets]


def test_json_forms(spark):
    df = spark.createDataFrame([({"b": 2, "a": 1}, [[1, 2, 3], [4, 5, 6]]), ({}, [])], "m map<string, int>, g array<array<bigint>>")
    texts = df.select(codecs.encode_map("m").alias("m"), codecs.encode_grid("g").alias("g"))
    assert texts.first()["m"] == '[["a","1"],["b","2"]]' and json.loads(texts.first()["g"]) == {"base1": 0, "base2": 0, "length1": 2, "length2": 3, "values": [1, 2, 3, 4, 5, 6]}
    back = [tuple(r) for r in texts.select(codecs.decode_map(F.col("m")), codecs.decode_grid(F.col("g"))).collect()]
    assert back == [({"a": "1", "b": "2"}, [[1, 2, 3], [4, 5, 6]]), ({}, [])]
    twice = spark.createDataFrame([('[["k","old"],["k","new"]]',)], "m string")
    assert twice.select(codecs.decode_map(F.col("m"))).first()[0] == {"k": "new"}
    coded = spark.createDataFrame([(0, 0, 'say "x"', 2)], "target_id int, src bigint, label string, dst bigint")
    counts = spark.createDataFrame([(0, 3), (1, 1)], "target_id int, node_count bigint")
    texts = codecs.encode_graphs(coded, counts)
    assert {r["target_id"]: json.loads(r["value"]) for r in texts.collect()} == {0: {"nodeCount": 3, "edges": [[0, 'say "x"', 2]]}, 1: {"nodeCount": 1, "edges": []}}
    assert [tuple(r) for r in codecs.decode_graphs(texts).collect()] == [tuple(coded.first())]


def test_names(spark):
    """Whole names go, short ones between non-letters only; of the words of a name only long ones; case counts for no letter."""
    rules = text.student_rules("Müller, Jan de Vries", "1234567") + text.student_rules("Oé, Floor", None) + text.student_rules("Wu, Max", None)
    df = spark.createDataFrame([("MÜLLER muller MullerApp 1234567; jan de vries de jan VRIES Floor max oé, Oéstrus OE wu Wurst",)], "t string")
    a = text.name_alias
    want = f"{a('Müller')} {a('Müller')} {a('Müller')}App {text.number_alias('1234567')}; {a('Jan de Vries')} de jan {a('Vries')} Floor max {a('Oé')}, Oéstrus {a('Oé')} {a('Wu')} Wurst"
    assert df.select(text.replace_all(F.col("t"), rules).alias("t")).first()["t"] == want
    df = spark.createDataFrame([("MULLER und Müller",)], "t string")
    assert df.select(text.unaccent("t").alias("t")).first()["t"].startswith("MULLER und Muller")
    rows = spark.createDataFrame([("doe_LATE_12_99_my_file.zip",), ("doe_12_99_f.zip",)], "file string")
    assert [(r["late"], r["user_id"], r["attachment_id"], r["file_name"]) for r in grading.submission_names(rows).collect()] == [(True, "12", "99", "my_file.zip"), (False, "12", "99", "f.zip")]


def test_each_address_has_its_alias(spark):
    df = spark.createDataFrame([("a@x.org wrote to B@y.org, cc A@X.org!",), ("none",), (None,), ("a@x.org",)], "t string")
    one, none, null, same = (r["t"] for r in df.select(text.alias_emails(F.col("t")).alias("t")).collect())
    first, _, _, second, _, third = one.split(" ")
    assert first == same and second != first and third.startswith(first[:10]) and "@x" not in one.lower() and (none, null) == ("none", None)


def test_strings_in_objects(spark):
    df = spark.createDataFrame([(("a", ["b", None], {"k": "c"}, [("d", 1)], 7),), (None,)], "o struct<x: string, l: array<string>, m: map<string, string>, n: array<struct<s: string, i: int>>, i: int>")
    up = text.map_strings(F.col("o"), df.schema["o"].dataType, F.upper)
    one, none = (r["o"] for r in df.select(up.alias("o")).collect())
    assert (one["x"], one["l"], one["m"], tuple(one["n"][0]), one["i"], none) == ("A", ["B", None], {"k": "C"}, ("D", 1), 7, None)


def test_gradebook_rubric_and_cleaned(spark, tmp_path):
    (tmp_path / "g.csv").write_text('Student,ID,Number\n"Points Possible",,\n"Doe, Jane",12,s1\n"student, Test",13,s2\n,,\n')
    assert [tuple(r) for r in grading.read_gradebook(spark, str(tmp_path / "g.csv")).collect()] == [("Doe, Jane", "12", "s1")]
    node = lambda ids, score: {"attachments": [{"_id": i} for i in ids], "score": score, "rubricAssessmentsConnection": {"nodes": [score]}}
    raw = {"data": {"assignment": {"name": "A", "course": {"name": "C"}, "submissionsConnection": {"nodes": [node(["7", "8"], 2.0), node(["9"], 3.0)]}}}}
    (tmp_path / "r.json").write_text(json.dumps(raw))
    rubric = grading.read_rubric(spark, str(tmp_path / "r.json"))
    assert {(r["assignment"], r["course"], r["score"]) for r in rubric.collect()} == {("A", "C", 2.0), ("A", "C", 3.0)}
    handed_in = spark.createDataFrame([("8", "x.zip"), ("5", "y.zip")], "attachment_id string, archive string")
    looked = {r["attachment_id"]: r["assessment"] for r in grading.rubric_lookup(handed_in, rubric).collect()}
    assert [a["score"] for a in looked["8"]] == [2.0] and json.loads(looked["8"][0]["assessments"]) == {"nodes": [2.0]} and looked["5"] == []
    many = spark.range(1200).withColumn("archive", F.concat(F.col("id").cast("string"), F.lit(".zip")))
    ids = {r["archive"]: r["new_id"] for r in grading.shuffled_ids(many, "archive", seed=4).collect()}
    assert sorted(ids.values()) == sorted(str(i).zfill(3) for i in range(1200)) and [ids[f"{i}.zip"] for i in range(5)] != ["000", "001", "002", "003", "004"]
    assert ids == {r["archive"]: r["new_id"] for r in grading.shuffled_ids(many.repartition(7), "archive", seed=4).collect()}
    members = spark.createDataFrame([("x.zip", "x.zip/Jane Doe.pde", "text", b"// by Jane Doe", None), ("x.zip", "x.zip/l.jar", "verbatim", b"Jane", None), ("x.zip", "x.zip/b.zip", "error", None, "bad")], "archive string, path string, kind string, content binary, error string")
    out = {r["path"]: bytes(r["content"]) for r in grading.cleaned(members, grading.shuffled_ids(handed_in, "archive"), [text.Rule(text.exactly("jane doe"), "N1")]).collect()}
    assert out == {"x.zip/N1.pde": b"// by N1", "x.zip/l.jar": b"Jane"}
    marked = spark.createDataFrame([(1, [([{"a": 1}],)]), (2, []), (3, [([],)])], "id int, assessment array<struct<rubrics: array<map<string, int>>>>")
    assert [r["id"] for r in grading.assessed(marked).collect()] == [1]


def test_extraction_flags(spark):
    """Types of a unit, overriding, annotators put together, and dependences between statements."""
    rel = lambda *rows: spark.createDataFrame([(0, *r) for r in rows], "target_id int, `from` string, `to` string")
    none = extract.empty_relation(spark, "int")
    unit, a, b, m, n = "java+compilationUnit:u", "java+class:A", "java+interface:B", "java+method:m", "java+method:n"
    names = spark.createDataFrame([(0, "Boid", a)], "target_id int, simple_name string, qualified_name string")
    f = extract.Facts(spark.createDataFrame([(0, x) for x in (unit, a, b, m, n)], "target_id int, name string"), rel((unit, a), (unit, b), (a, m), (b, n)), none, rel((a, b)), rel((m, "java+class:X"), (a, b)), none, rel((m, n)), none, spark.createDataFrame([(0, a, "public")], "target_id int, name string, modifier string"), names)
    plain, more = ({tuple(r)[1:] for r in extract.depends_on(f, units).collect()} for units in (False, True))
    assert {x for x, *_ in plain} == {m, a, unit} and more - plain == {(b, "dependsOn", "java+class:X")}
    found = {tuple(r)[1:] for r in extract.structure(f).collect()}
    assert {(m, "overrides", n), (a, "implements", b)} <= found
    both = extract.typegraph(f, extract.annotators(extract.default_annotations, extract.named(("Boid",)), extract.no_annotations))
    loops = {(r["src"], r["label"]) for r in both.filter("src = dst").collect()}
    assert {(a, "annotation.nameClass=Boid"), (a, "annotation.modifier=public"), (m, "annotation.scheme=java+method"), ("java+class:X", "annotation.location=java+class:X")} <= loops
    ids = spark.createDataFrame([(0, "m", 1, "s1"), (0, "m", 2, "s2"), (0, "k", 1, "t1")], "target_id int, method string, id int, location string")
    dep = lambda *rows: spark.createDataFrame([(0, *r) for r in rows], "target_id int, method string, `from` int, `to` int")
    assert {tuple(r)[1:] for r in extract.dependence_graph(dep(("m", 1, 2)), dep(("m", 2, 1), ("k", 1, 1)), ids).collect()} == {("s1", "controlDepends", "s2"), ("s2", "dataDepends", "s1"), ("t1", "dataDepends", "t1")}


def test_nearest_types_and_cycles(spark):
    rel = lambda *rows: spark.createDataFrame([(0, *r) for r in rows], "target_id int, `from` string, `to` string")
    none = extract.empty_relation(spark, "int")
    inside = rel(("java+package:p", "java+class:A"), ("java+class:A", "java+class:B"), ("java+class:B", "java+method:m"), ("java+x:1", "java+x:2"), ("java+x:2", "java+x:1"))
    f = extract.Facts(spark.createDataFrame([(0, "java+method:m")], "target_id int, name string"), inside, none, none, rel(("java+method:m", "java+class:X")), none, none, none, none, none)
    assert {(r["element"], r["type"]) for r in extract.containing_types(f).collect()} == {("java+class:A", "java+class:A"), ("java+class:B", "java+class:B"), ("java+method:m", "java+class:B")}
    assert {r["src"] for r in extract.depends_on(f).collect()} == {"java+method:m", "java+class:B", "java+class:A", "java+package:p"}


def test_types_of_units_do_not_shuffle_pairs(spark):
    """Types of one unit, of two units, and units without dependencies; pairs of a unit's types are made after the last exchange."""
    rel = lambda *rows: spark.createDataFrame([(0, *r) for r in rows], "target_id int, `from` string, `to` string")
    none = extract.empty_relation(spark, "int")
    u, v, w = (f"java+compilationUnit:{x}" for x in "uvw")
    a, b, c, d = (f"java+class:{x}" for x in "ABCD")
    inside = rel((u, a), (u, b), (v, b), (v, c), (w, d))
    uses = rel((a, "x"), (a, "y"), (a, "x"), (c, "x"), (c, "z"), (b, "x"), (b, "e"), ("outside", "x"))
    f = extract.Facts(spark.createDataFrame([(0, a)], "target_id int, name string"), inside, rel((b, "e")), none, uses, none, none, none, none, none)
    found = extract.depends_on(f, units=True)
    # What is contained in u is x, y; in v x, z.
    want = {(u, "x"), (u, "y"), (a, "x"), (a, "y"), (b, "x"), (b, "y"), (b, "z"), (v, "x"), (v, "z"), (c, "x"), (c, "z")}
    assert Counter((r["src"], r["dst"]) for r in found.collect()) == Counter(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and sum("Aggregate" in x.split("[")[0] for x in plan.splitlines() if len(x) - len(x.lstrip(" :+-")) <= 6) == 1  # the types of several units alone


def test_typegraph_brings_edges_together_by_kind(spark):
    """The whole graph meets in no exchange, and what an annotator repeats or structure has is there once."""
    rel = lambda *rows: spark.createDataFrame([(0, *r) for r in rows], "target_id int, `from` string, `to` string")
    none = extract.empty_relation(spark, "int")
    a, m = "java+class:A", "java+method:m"
    f = extract.Facts(spark.createDataFrame([(0, a), (0, m)], "target_id int, name string"), rel((a, m)), none, none, rel((m, a), (m, a)), rel((m, m)), none, none, none, none)
    mark = lambda facts, nodes: nodes.select("target_id", "node", F.explode(F.array(F.lit("invokes"), F.lit("annotation.x=y"), F.lit("annotation.x=y"))).alias("label"))
    found = extract.typegraph(f, mark)
    want = {(a, "contains", m), (m, "dependsOn", a), (a, "dependsOn", a), (m, "invokes", m), (a, "invokes", m), (a, "invokes", a), (a, "annotation.x=y", a), (m, "annotation.x=y", m)}
    assert Counter(tuple(r)[1:] for r in found.collect()) == Counter(want)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_debounce_boundary(spark):
    rows = spark.createDataFrame([(1, "k", 0), (2, "k", 3600), (3, "k", 7201)], "event_id int, user string, s int").withColumn("ts", F.timestamp_seconds("s"))
    assert [r["event_id"] for r in watch.debounce(rows, "user", "ts", 3600, "event_id").orderBy("event_id").collect()] == [2, 3]


def test_debounce_stream(spark, tmp_path):
    rows = [(1, "k", 0), (2, "k", 10), (3, "k", 5000), (4, "z", 900_000)]
    spark.createDataFrame(rows, "event_id int, user string, s int").withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id int, user string, ts timestamp").parquet(str(tmp_path / "in"))
    out = watch.debounce_stream(stream, "user", "ts", "1 hour", "1 hour", "event_id").writeStream.format("memory").queryName("debounced").trigger(availableNow=True).start()
    out.awaitTermination(120)
    assert {r["event_id"] for r in spark.table("debounced").collect()} == {2, 3}


def test_configure_output(spark, tmp_path):
    """Extensions of a criterion's queries as text that the next version of the criterion writes over."""
    g = spark.createDataFrame([(0, "a", "t", "a"), (0, "a", "has", "b"), (0, "b", "m", "b"), (1, "c", "t", "c"), (1, "d", "in", "c")], "target_id int, src string, label string, dst string")
    criterion = Criterion("types", (PatternTree.of("positive", {("x", "t", "x")}),))

    def lines(matches, criterion):
        known = spark.createDataFrame(planner.query_edges(planner.forest(criterion.patterns)), "query_id string, src string, label string, dst string")
        edges = suggest.select_extensions(suggest.edge_extensions(matches, g, known), ["qsrc", "label", "qdst"])
        nodes = suggest.select_extensions(suggest.node_extensions(matches, g), ["qnode", "loops", "outgoing", "incoming"])
        found = suggest.extension_lines(edges, nodes, suggest.samples(suggest.node_occurrences(matches, g)))
        return found.orderBy("query_id", "part", "rank", "place").coalesce(1)

    sink = watch.overwrite_lines(str(tmp_path / "out"), lines)
    for _ in range(2):
        sink(report.assess(g, [criterion]), criterion)
    want = """- query_0
  Edges:
  Nodes:
  - [0.50]
    x
    < in <
    = d
      in 1
  - [0.50]
    x
    > has >
    | m |
    = b
      in 0"""
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == want


def test_watch_criteria(spark, tmp_path):
    g = spark.createDataFrame([(0, "a", "class", "a")], "target_id int, src string, label string, dst string")
    c = Criterion("classes", (PatternTree.of("positive", {("c", "annotation.scheme=x", "c")}),))
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text("broken")
    (tmp_path / "in/2.json").write_text(json.dumps(c.encode()))
    seen = []
    watch.watch_criteria(spark, str(tmp_path / "in"), g, lambda m, k: seen.append((k.text, m.count())), str(tmp_path / "cp"), available_now=True).awaitTermination(120)
    assert seen == [("classes", 0)]


def test_stored_graph_is_made_again_if_it_is_gone(spark):
    first = commerce.stored(spark, DATA)
    key = spark.sparkContext.applicationId, DATA
    assert commerce.stored(spark.newSession(), DATA).count() == first.count()
    release(commerce._STORED[key])
    assert commerce.stored(spark, DATA).count() == 22954


def test_commerce_edges_do_not_repeat(spark):
    g = commerce.edges(spark, DATA)
    assert g.count() == g.distinct().count() == 22954
