"""One query per operator over the test tables, and the SQL that gives the same rows.

Results are flat; sets of labels are joined to text; fractions are rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora import commerce
from arbora.functions import arrays, text
from arbora.model import Criterion, PatternTree, family
from arbora.operators import extract, features, graph, match, report, suggest
from arbora.plans import planner
from arbora.sources import codecs, formats, pieces, typegraph
from arbora.storage import durable
from arbora.streaming import watch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
WITH = "WITH RECURSIVE " + commerce.EDGES_SQL
LINKS = ", links AS (SELECT * FROM edges WHERE src <> dst), loops AS (SELECT target_id, src AS node, label FROM edges WHERE src = dst)"
PAIRS = ", pairs AS (SELECT target_id, src, dst, list(label ORDER BY label) AS labels FROM edges GROUP BY ALL)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def joined(column: str) -> F.Column:
    return F.array_join(column, ",")


# ---------------------------------------------------------------- graph algebra


@query(WITH + "SELECT target_id, src AS node FROM edges UNION SELECT target_id, dst FROM edges")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.nodes(commerce.edges(spark, d))


@query(WITH + "SELECT DISTINCT target_id, src AS node FROM edges")
def graph_from(spark: SparkSession, d: str) -> DataFrame:
    return graph.sources(commerce.edges(spark, d))


@query(WITH + "SELECT DISTINCT target_id, dst AS node FROM edges")
def graph_to(spark: SparkSession, d: str) -> DataFrame:
    return graph.destinations(commerce.edges(spark, d))


@query(WITH + "SELECT DISTINCT target_id, label FROM edges")
def graph_edges_labels(spark: SparkSession, d: str) -> DataFrame:
    return graph.labels(commerce.edges(spark, d))


@query(WITH + "SELECT * FROM edges WHERE src = 'customer:7'")
def graph_edges_from(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_from(commerce.edges(spark, d), "customer:7")


@query(WITH + "SELECT * FROM edges WHERE dst = 'part:5'")
def graph_edges_to(spark: SparkSession, d: str) -> DataFrame:
    return graph.edges_to(commerce.edges(spark, d), "part:5")


@query(WITH + "SELECT DISTINCT target_id, label FROM edges WHERE src = 'nation:3' AND dst = 'nation:3'")
def graph_edges_from_to(spark: SparkSession, d: str) -> DataFrame:
    return graph.labels_between(commerce.edges(spark, d), "nation:3", "nation:3")


@query(WITH + "SELECT * FROM edges WHERE src = 'customer:7' OR dst = 'customer:7'")
def graph_connected_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.connected_edges(commerce.edges(spark, d), "customer:7")


_BUILDING = "SELECT target_id, src AS node FROM edges WHERE label = 'annotation.nameClass=BUILDING'"


def _building(g: DataFrame) -> DataFrame:
    return g.filter("label = 'annotation.nameClass=BUILDING'").select("target_id", F.col("src").alias("node"))


@query(WITH + f", b AS ({_BUILDING}) SELECT * FROM edges e WHERE EXISTS (SELECT 1 FROM b WHERE b.target_id = e.target_id AND b.node IN (e.src, e.dst))")
def graph_all_connected_edges(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    return graph.all_connected_edges(g, _building(g))


_SUB = "sub AS (SELECT * FROM edges WHERE label = 'accessesField'), sn AS (SELECT target_id, src AS node FROM sub UNION SELECT target_id, dst FROM sub)"


@query(WITH + f", {_SUB} SELECT * FROM edges e WHERE EXISTS (SELECT 1 FROM sn WHERE sn.target_id = e.target_id AND sn.node = e.src) OR EXISTS (SELECT 1 FROM sn WHERE sn.target_id = e.target_id AND sn.node = e.dst)")
def graph_extended_subgraph(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    return graph.extended_subgraph(g.filter("label = 'accessesField'"), g)


@query(WITH + f", {_SUB} (SELECT * FROM edges e WHERE EXISTS (SELECT 1 FROM sn WHERE sn.target_id = e.target_id AND sn.node = e.src) OR EXISTS (SELECT 1 FROM sn WHERE sn.target_id = e.target_id AND sn.node = e.dst)) EXCEPT SELECT * FROM sub")
def graph_subgraph_extension(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    return graph.subgraph_extension(g.filter("label = 'accessesField'"), g)


@query(WITH + "SELECT * FROM edges WHERE label IN ('contains', 'invokes') UNION SELECT * FROM edges WHERE label IN ('contains', 'extends')")
def graph_combine(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    return graph.combine(g.filter("label in ('contains', 'invokes')"), g.filter("label in ('contains', 'extends')"))


@query(WITH + "SELECT DISTINCT target_id, split_part(src, ':', 1) AS src, split_part(label, '=', 1) AS label, split_part(dst, ':', 1) AS dst FROM edges")
def graph_map(spark: SparkSession, d: str) -> DataFrame:
    return graph.map_edges(commerce.edges(spark, d), lambda c: F.split_part(c, F.lit(":"), F.lit(1)), lambda c: F.split_part(c, F.lit("="), F.lit(1)))


# ---------------------------------------------------------------- multigraphs


_NODES = ", nodes AS (SELECT target_id, src AS node FROM edges UNION SELECT target_id, dst FROM edges), ids AS (SELECT target_id, node, row_number() OVER (PARTITION BY target_id ORDER BY node) - 1 AS node_id FROM nodes)"


@query(WITH + _NODES + "SELECT * FROM ids")
def mg_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return graph.dictionary(commerce.edges(spark, d))


@query(WITH + _NODES + "SELECT e.target_id, a.node_id AS src, label, b.node_id AS dst FROM edges e JOIN ids a ON a.target_id = e.target_id AND a.node = src JOIN ids b ON b.target_id = e.target_id AND b.node = dst")
def mg_encode(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    return graph.encode(g, graph.dictionary(g))


@query(WITH + "SELECT * FROM edges")
def mg_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    names = graph.dictionary(g)
    return graph.expand(graph.condense(graph.decode(graph.encode(g, names), names)))


@query(WITH + "SELECT target_id, src, dst, string_agg(label, ',' ORDER BY label) AS labels FROM edges GROUP BY ALL")
def mg_condense(spark: SparkSession, d: str) -> DataFrame:
    return graph.condense(commerce.edges(spark, d)).select("target_id", "src", "dst", joined("labels").alias("labels"))


@query(WITH + _NODES + "SELECT target_id, count(*) AS node_count FROM nodes GROUP BY target_id")
def mg_node_count(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_count(commerce.edges(spark, d))


@query(WITH + LINKS + " SELECT target_id, src AS node, dst AS neighbour FROM links UNION SELECT target_id, dst, src FROM links")
def mg_adjacent(spark: SparkSession, d: str) -> DataFrame:
    return graph.adjacent(commerce.edges(spark, d))


@query(WITH + LINKS + f", b AS ({_BUILDING}), adj AS (SELECT target_id, src AS node, dst AS other FROM links UNION SELECT target_id, dst, src FROM links) SELECT DISTINCT adj.target_id, other AS node FROM adj JOIN b USING (target_id, node)")
def mg_all_adjacent(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    return graph.all_adjacent(g, _building(g))


@query(WITH + ", f AS (SELECT target_id, src AS node FROM edges WHERE label IN ('annotation.modifier=F', 'annotation.scheme=customer')) SELECT e.* FROM edges e WHERE EXISTS (SELECT 1 FROM f WHERE f.target_id = e.target_id AND f.node = src) AND EXISTS (SELECT 1 FROM f WHERE f.target_id = e.target_id AND f.node = dst)")
def mg_induced(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    return graph.induced(g, g.filter("label in ('annotation.modifier=F', 'annotation.scheme=customer')").select("target_id", F.col("src").alias("node")))


@query(
    WITH
    + """, b AS (SELECT * FROM edges WHERE label = 'contains'), x AS (SELECT * FROM edges WHERE label = 'accessesField'),
bn AS (SELECT target_id, src AS node FROM b UNION SELECT target_id, dst FROM b), xn AS (SELECT target_id, src AS node FROM x UNION SELECT target_id, dst FROM x),
bi AS (SELECT target_id, node, row_number() OVER (PARTITION BY target_id ORDER BY node) - 1 AS node_id FROM bn), n AS (SELECT target_id, count(*) AS n FROM bn GROUP BY target_id),
new AS (SELECT * FROM xn EXCEPT SELECT * FROM bn)
SELECT * FROM bi UNION ALL SELECT target_id, node, n + row_number() OVER (PARTITION BY target_id ORDER BY node) - 1 FROM new JOIN n USING (target_id)"""
)
def mg_extend(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    return graph.extend_dictionary(graph.dictionary(g.filter("label = 'contains'")), g.filter("label = 'accessesField'"))


@query(
    WITH
    + PAIRS
    + """, s AS (SELECT target_id, src AS node, 'o' AS way, array_to_string(labels, '+') AS t FROM pairs WHERE src <> dst UNION ALL SELECT target_id, dst, 'i', array_to_string(labels, '+') FROM pairs WHERE src <> dst
  UNION ALL SELECT target_id, src, 'l', array_to_string(labels, ',') FROM pairs WHERE src = dst)
SELECT target_id, node, coalesce(string_agg(t, ',' ORDER BY t) FILTER (way = 'i'), '') AS incoming, coalesce(string_agg(t, ',' ORDER BY t) FILTER (way = 'o'), '') AS outgoing, coalesce(max(t) FILTER (way = 'l'), '') AS loops FROM s GROUP BY ALL"""
)
def mg_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _signature_text(graph.signatures(commerce.edges(spark, d)))


def _signature_text(signatures: DataFrame) -> DataFrame:
    text_of = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.array_join(x, "+"))), ",")
    return signatures.select("target_id", "node", text_of("incoming").alias("incoming"), text_of("outgoing").alias("outgoing"), joined("loops").alias("loops"))


# ---------------------------------------------------------------- features, set keys, boxes


_FEATURES = (
    LINKS
    + """, ends AS (SELECT target_id, src AS node, dst AS other, 1 AS o, label FROM links UNION ALL SELECT target_id, dst, src, 0, label FROM links),
pr AS (SELECT target_id, node, other, o, count(*) AS n FROM ends GROUP BY ALL),
a AS (SELECT target_id, node, count(*) FILTER (o = 0) AS f1a, count(*) FILTER (o = 1) AS f1b, CAST(sum(n) AS BIGINT) AS f3, max(n) AS f6 FROM pr GROUP BY ALL),
k AS (SELECT target_id, node, count(DISTINCT label) FILTER (o = 0) AS f2a, count(DISTINCT label) FILTER (o = 1) AS f2b FROM ends GROUP BY ALL),
every AS (SELECT target_id, src AS node FROM edges UNION SELECT target_id, dst FROM edges),
feats AS (SELECT target_id, node, coalesce(f1a, 0) AS f1a, coalesce(f1b, 0) AS f1b, coalesce(f2a, 0) AS f2a, coalesce(f2b, 0) AS f2b, coalesce(f3, 0) AS f3, coalesce(f6, 0) AS f6
  FROM every LEFT JOIN a USING (target_id, node) LEFT JOIN k USING (target_id, node))"""
)


@query(WITH + _FEATURES + "SELECT * FROM feats")
def sig_features(spark: SparkSession, d: str) -> DataFrame:
    return features.signature_features(commerce.edges(spark, d))


@query(WITH + _FEATURES + "SELECT target_id, node FROM feats WHERE f1a >= 1 AND f1b >= 4 AND f2b >= 3 AND f3 >= 8 AND f6 >= 2")
def sig_dominance(spark: SparkSession, d: str) -> DataFrame:
    found = features.dominating(features.signature_features(commerce.edges(spark, d)), {"f1a": 1, "f1b": 4, "f2b": 3, "f3": 8, "f6": 2})
    return found.select("target_id", "node")


@query(WITH + PAIRS + ", o AS (SELECT * FROM pairs WHERE src <> dst AND list_contains(labels, 'dependsOn')) SELECT target_id, src AS node, dst AS neighbour FROM o WHERE list_contains(labels, 'accessesField')")
def neighbourhood_search(spark: SparkSession, d: str) -> DataFrame:
    return features.neighbourhood(commerce.edges(spark, d), set(), {"dependsOn", "accessesField"})


@query(WITH + PAIRS + ", o AS (SELECT * FROM pairs WHERE src <> dst AND list_contains(labels, 'contains')) SELECT target_id, dst AS node, src AS neighbour FROM o")
def neighbourhood_incoming(spark: SparkSession, d: str) -> DataFrame:
    return features.neighbourhood(commerce.edges(spark, d), {"contains"}, set())


@query(WITH + " SELECT a.target_id, a.src AS node, a.dst AS neighbour FROM edges a JOIN (SELECT target_id, src, dst FROM edges WHERE label = 'dependsOn') b ON a.target_id = b.target_id AND a.src = b.src AND a.dst = b.dst WHERE a.label = 'accessesField' AND a.src <> a.dst")
def neighbourhood_both(spark: SparkSession, d: str) -> DataFrame:
    """With each edge ``accessesField`` turned round, so that some pairs have labels both ways."""
    g = commerce.edges(spark, d)
    turned = g.filter("label = 'accessesField'").select("target_id", F.col("dst").alias("src"), "label", F.col("src").alias("dst"))
    return features.neighbourhood(g.filter("label = 'dependsOn'").union(turned), {"accessesField"}, {"dependsOn"})


@query(WITH + " SELECT target_id, CAST(NULL AS VARCHAR) AS node, src AS neighbour FROM edges UNION SELECT target_id, NULL, dst FROM edges")
def neighbourhood_any(spark: SparkSession, d: str) -> DataFrame:
    return features.neighbourhood(commerce.edges(spark, d), set(), set())


def _set_query(test: Callable[[F.Column, F.Column], F.Column], word: list[str]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        pairs = graph.condense(commerce.edges(spark, d))
        return pairs.filter(test(F.col("labels"), F.array(*map(F.lit, word)))).select("target_id", "src", "dst")

    return run


for _name, _test, _word, _sql in (
    ("setkey_exact", arrays.same_set, ["accessesField", "dependsOn"], "labels = ['accessesField', 'dependsOn']"),
    ("setkey_superset", arrays.superset, ["annotation.modifier=F", "annotation.nameClass=1-URGENT"], "list_has_all(labels, ['annotation.modifier=F', 'annotation.nameClass=1-URGENT'])"),
    ("setkey_subset", arrays.subset, ["contains", "extends", "dependsOn"], "list_has_all(['contains', 'extends', 'dependsOn'], labels)"),
):
    QUERIES[_name] = _set_query(_test, _word)
    ORACLES[_name] = WITH + PAIRS + f" SELECT target_id, src, dst FROM pairs WHERE {_sql}"


@query(WITH + PAIRS + " SELECT array_to_string(labels, ',') AS keys, count(*) AS n FROM pairs GROUP BY ALL")
def setkey_index(spark: SparkSession, d: str) -> DataFrame:
    pairs = graph.condense(commerce.edges(spark, d)).select(F.col("labels").alias("keys"), F.concat_ws("/", F.col("target_id").cast("string"), "src", "dst").alias("value"))
    return features.set_index(pairs).select(joined("keys").alias("keys"), F.size("values").cast("bigint").alias("n"))


def _boxes(spark: SparkSession, d: str) -> DataFrame:
    """A box per part: from (size, floor of price / 100) up by (key mod 7, key mod 11)."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.col("p_size").cast("bigint").alias("x"), F.floor(F.col("p_retailprice") / 100).alias("y"))
    return p.select("p_partkey", F.array("x", "y").alias("low"), F.array(F.col("x") + F.col("p_partkey") % 7, F.col("y") + F.col("p_partkey") % 11).alias("high"))


_BOX = "WITH b AS (SELECT p_partkey, CAST(p_size AS BIGINT) AS x1, CAST(floor(p_retailprice / 100) AS BIGINT) AS y1, CAST(p_size AS BIGINT) + p_partkey % 7 AS x2, CAST(floor(p_retailprice / 100) AS BIGINT) + p_partkey % 11 AS y2 FROM part) "
_WINDOW = ([10, 11], [30, 16])


def _window(low: list[int] = _WINDOW[0], high: list[int] = _WINDOW[1]) -> arrays.Box:
    return arrays.Box(*(F.array(*[F.lit(v).cast("bigint") for v in side]) for side in (low, high)))


def _box_query(test: Callable[[arrays.Box, arrays.Box], F.Column]) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _boxes(spark, d).filter(test(arrays.Box(F.col("low"), F.col("high")), _window())).select("p_partkey")

    return run


for _name, _test, _sql in (
    ("rect_inside", lambda b, w: b.inside(_window([8, 9], [45, 24])), "x1 >= 8 AND y1 >= 9 AND x2 <= 45 AND y2 <= 24"),
    ("rect_contains", lambda b, w: arrays.Box.point(F.array(F.lit(20).cast("bigint"), F.lit(14).cast("bigint"))).inside(b), "x1 <= 20 AND x2 >= 20 AND y1 <= 14 AND y2 >= 14"),
    ("rect_intersects_ref", lambda b, w: b.intersects(w), "NOT ((x1 > 30 AND y1 > 16) OR (x2 < 10 AND y2 < 11))"),
    ("rect_intersects_strict", lambda b, w: b.meets(w), "x1 <= 30 AND x2 >= 10 AND y1 <= 16 AND y2 >= 11"),
):
    QUERIES[_name] = _box_query(_test)
    ORACLES[_name] = _BOX + f"SELECT p_partkey FROM b WHERE {_sql}"


@query(_BOX + "SELECT p_partkey, least(x1, 10) AS x1, least(y1, 11) AS y1, greatest(x2, 30) AS x2, greatest(y2, 16) AS y2, greatest(x1, 10) AS ix1, least(x2, 30) AS ix2, (x2 - x1) * (y2 - y1) AS area, (x1 + x2) // 2 AS cx FROM b")
def rect_wrap(spark: SparkSession, d: str) -> DataFrame:
    box = arrays.Box.checked(F.col("low"), F.col("high"))
    w, i = box.wrap(_window()), box.intersection(_window())
    at = lambda c, k: F.get(c, F.lit(k))
    return _boxes(spark, d).select("p_partkey", at(w.low, 0).alias("x1"), at(w.low, 1).alias("y1"), at(w.high, 0).alias("x2"), at(w.high, 1).alias("y2"), at(i.low, 0).alias("ix1"), at(i.high, 0).alias("ix2"), box.area().alias("area"), at(box.center(), 0).alias("cx"))


@query(_BOX + "SELECT p_partkey % 50 AS g, min(x1) AS x1, max(y2) AS y2, max(x1) AS ix1, min(y2) AS iy2 FROM b GROUP BY ALL")
def rect_wrap_all(spark: SparkSession, d: str) -> DataFrame:
    low, high = arrays.wrap_all("low", "high", 2)
    ilow, ihigh = arrays.intersect_all("low", "high", 2)
    at = lambda c, k: F.get(c, F.lit(k))
    return _boxes(spark, d).groupBy((F.col("p_partkey") % 50).alias("g")).agg(at(low, 0).alias("x1"), at(high, 1).alias("y2"), at(ilow, 0).alias("ix1"), at(ihigh, 1).alias("iy2"))


@query(_BOX + "SELECT p_partkey FROM b WHERE x1 <= 30 AND x2 >= 10 AND y1 <= 16 AND y2 >= 11")
def rect_clustered(spark: SparkSession, d: str) -> DataFrame:
    """From a stored layout whose file statistics skip most boxes."""
    at = lambda c, k: F.get(c, F.lit(k))
    flat = _boxes(spark, d).select("p_partkey", at("low", 0).alias("x1"), at("low", 1).alias("y1"), at("high", 0).alias("x2"), at("high", 1).alias("y2"))
    return durable(features.clustered(flat, 8, "x1", "y1"), "boxes").filter("x1 <= 30 and x2 >= 10 and y1 <= 16 and y2 >= 11").select("p_partkey")


@query(_BOX + "SELECT p_partkey, x1, y1, x2, y2 FROM b")
def codec_boxes(spark: SparkSession, d: str) -> DataFrame:
    text_ = _boxes(spark, d).select("p_partkey", codecs.encode_box(arrays.Box(F.col("low"), F.col("high"))).alias("value"))
    box, at = codecs.decode_box(F.col("value")), lambda c, k: F.get(c, F.lit(k))
    return text_.select("p_partkey", at(box.low, 0).alias("x1"), at(box.low, 1).alias("y1"), at(box.high, 0).alias("x2"), at(box.high, 1).alias("y2"))


@query(ORACLES["mg_signatures"])
def codec_signatures(spark: SparkSession, d: str) -> DataFrame:
    texts = graph.signatures(commerce.edges(spark, d)).select("target_id", "node", codecs.encode_signature("incoming", "outgoing", "loops").alias("value"))
    return _signature_text(texts.select("target_id", "node", codecs.decode_signature(F.col("value")).alias("s")).select("target_id", "node", "s.*"))


@query(ORACLES["mg_encode"])
def codec_multigraph(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    names = durable(graph.dictionary(g), "names", sweep=True)
    coded = durable(graph.encode(g, names), "coded", sweep=True, compression="zstd")
    counts = names.groupBy("target_id").agg(F.count("*").alias("node_count"))
    texts = durable(codecs.encode_graphs(coded, counts), "multigraphs", sweep=True, **pieces.SMALL)
    return codecs.decode_graphs(texts)


# ---------------------------------------------------------------- pattern search


def _loop(node: str, kind: str, value: str) -> tuple[str, str, str]:
    return node, f"annotation.{kind}={value}", node


CHAIN = {_loop("c", "nameClass", "BUILDING"), _loop("o", "modifier", "F"), ("c", "contains", "o"), ("o", "dependsOn", "p")}
_CHAIN_SQL = LINKS + """, m AS (SELECT a.target_id, a.src AS c, a.dst AS o, b.dst AS p FROM links a JOIN links b ON a.target_id = b.target_id AND a.dst = b.src AND b.label = 'dependsOn'
  JOIN loops x ON x.target_id = a.target_id AND x.node = a.src AND x.label = 'annotation.nameClass=BUILDING' JOIN loops y ON y.target_id = a.target_id AND y.node = a.dst AND y.label = 'annotation.modifier=F'
  WHERE a.label = 'contains' AND a.src <> b.dst)"""


@query(WITH + _CHAIN_SQL + " SELECT * FROM m")
def match_chain(spark: SparkSession, d: str) -> DataFrame:
    return match.search(commerce.stored(spark, d), CHAIN)


@query(WITH + LINKS + " SELECT a.target_id, a.src AS o, a.dst AS p FROM links a JOIN links b USING (target_id, src, dst) WHERE a.label = 'dependsOn' AND b.label = 'accessesField'")
def match_multilabel(spark: SparkSession, d: str) -> DataFrame:
    return match.search(commerce.stored(spark, d), {("o", "dependsOn", "p"), ("o", "accessesField", "p")})


@query(WITH + LINKS + " SELECT a.target_id, a.src AS o1, b.src AS o2, a.dst AS p FROM links a JOIN links b ON a.target_id = b.target_id AND a.dst = b.dst AND a.src <> b.src WHERE a.label = 'dependsOn' AND b.label = 'dependsOn'")
def match_shared(spark: SparkSession, d: str) -> DataFrame:
    return match.search(commerce.stored(spark, d), {("o1", "dependsOn", "p"), ("o2", "dependsOn", "p")})


@query(WITH + LINKS + " SELECT a.target_id, a.node AS c1, b.node AS c2 FROM loops a JOIN loops b ON a.target_id = b.target_id AND a.node <> b.node WHERE a.label = 'annotation.nameClass=BUILDING' AND b.label = 'annotation.nameClass=MACHINERY'")
def match_disconnected(spark: SparkSession, d: str) -> DataFrame:
    return match.search(commerce.stored(spark, d), {_loop("c1", "nameClass", "BUILDING"), _loop("c2", "nameClass", "MACHINERY")})


@query(WITH + LINKS + " SELECT a.target_id, a.node AS o FROM loops a JOIN loops b USING (target_id, node) WHERE a.label = 'annotation.modifier=F' AND b.label = 'annotation.nameClass=1-URGENT'")
def match_loop_only(spark: SparkSession, d: str) -> DataFrame:
    return match.search(commerce.stored(spark, d), {_loop("o", "modifier", "F"), _loop("o", "nameClass", "1-URGENT")})


@query(WITH + LINKS + " SELECT a.target_id, a.src AS o, a.dst AS p FROM links a JOIN links b USING (target_id, src, dst) WHERE a.label = 'dependsOn' AND b.label = 'accessesField'")
def match_verify(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.stored(spark, d)
    return match.verify(g, match.search(g, {("o", "dependsOn", "p")}), {("o", "dependsOn", "p"), ("o", "accessesField", "p")})


@query(WITH + _CHAIN_SQL + " SELECT m.*, l.dst AS s FROM m JOIN links l ON l.target_id = m.target_id AND l.src = o AND l.label = 'invokes' WHERE l.dst NOT IN (c, o, p)")
def match_extended(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.stored(spark, d)
    return match.search_extended(g, match.search(g, CHAIN), CHAIN, {("o", "invokes", "s")})


# ---------------------------------------------------------------- pattern trees and verdicts


STATUS = Criterion(
    "Orders are finished or urgent",
    (
        PatternTree.of(
            "negative",
            {_loop("o", "scheme", "order")},
            PatternTree.of("positive", {_loop("o", "modifier", "F")}, PatternTree.of("neutral", {_loop("o", "nameClass", "1-URGENT")})),
            PatternTree.of("neutral", {_loop("o", "nameClass", "1-URGENT")}),
        ),
    ),
)
UNRETURNED = Criterion("Orders without a returned part", (PatternTree.of("negative", {_loop("o", "scheme", "order")}, PatternTree.of("neutral", {("o", "accessesField", "p")})),))
PRIORITIES = Criterion(
    "Customers order by priority",
    family(lambda p: PatternTree.of("positive", {_loop("c", "nameClass", "BUILDING"), ("c", "contains", "o"), _loop("o", "nameClass", p)}), ("1-URGENT", "2-HIGH", "5-LOW")),
)
_STATUS_SQL = (
    LINKS
    + """, ord AS (SELECT target_id, node AS o FROM loops WHERE label = 'annotation.scheme=order'), fin AS (SELECT target_id, node AS o FROM loops WHERE label = 'annotation.modifier=F'),
urg AS (SELECT target_id, node AS o FROM loops WHERE label = 'annotation.nameClass=1-URGENT'),
status AS (SELECT target_id, 'query_0' AS query_id, 'negative' AS verdict, concat('o=', o) AS mapping FROM (SELECT * FROM ord EXCEPT SELECT * FROM fin EXCEPT SELECT * FROM urg)
  UNION ALL SELECT target_id, 'query_0.0', 'positive', concat('o=', o) FROM (SELECT * FROM fin EXCEPT SELECT * FROM urg)
  UNION ALL SELECT target_id, 'query_0.0.0', 'neutral', concat('o=', o) FROM (SELECT * FROM fin INTERSECT SELECT * FROM urg)
  UNION ALL SELECT target_id, 'query_0.1', 'neutral', concat('o=', o) FROM urg),
unret AS (SELECT target_id, 'query_0' AS query_id, 'negative' AS verdict, concat('o=', o) AS mapping FROM (SELECT * FROM ord EXCEPT SELECT target_id, src FROM links WHERE label = 'accessesField')
  UNION ALL SELECT target_id, 'query_0.0', 'neutral', concat('o=', src, '|p=', dst) FROM links WHERE label = 'accessesField'),
prio AS (SELECT l.target_id, CASE y.label WHEN 'annotation.nameClass=1-URGENT' THEN 'query_0' WHEN 'annotation.nameClass=2-HIGH' THEN 'query_1' ELSE 'query_2' END AS query_id, 'positive' AS verdict, concat('c=', l.src, '|o=', l.dst) AS mapping
  FROM links l JOIN loops x ON x.target_id = l.target_id AND x.node = l.src AND x.label = 'annotation.nameClass=BUILDING' JOIN loops y ON y.target_id = l.target_id AND y.node = l.dst
  AND y.label IN ('annotation.nameClass=1-URGENT', 'annotation.nameClass=2-HIGH', 'annotation.nameClass=5-LOW') WHERE l.label = 'contains'),
matches AS (SELECT 'Orders are finished or urgent' AS criterion, * FROM status UNION ALL SELECT 'Orders without a returned part', * FROM unret UNION ALL SELECT 'Customers order by priority', * FROM prio)"""
)


def _flat(matches: DataFrame) -> DataFrame:
    return matches.select("target_id", "query_id", "verdict", match.mapping_text().alias("mapping"))


def _matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    g = commerce.stored(spark, d)
    return g, report.assess(g, [STATUS, UNRETURNED, PRIORITIES])


@query(WITH + _STATUS_SQL + " SELECT * FROM status")
def tree_exception(spark: SparkSession, d: str) -> DataFrame:
    return _flat(match.search_trees(commerce.stored(spark, d), STATUS.patterns))


@query(WITH + _STATUS_SQL + " SELECT * FROM unret")
def tree_unused(spark: SparkSession, d: str) -> DataFrame:
    return _flat(match.search_trees(commerce.stored(spark, d), UNRETURNED.patterns))


@query(WITH + _STATUS_SQL + " SELECT * FROM prio")
def tree_family(spark: SparkSession, d: str) -> DataFrame:
    return _flat(match.search_trees(commerce.stored(spark, d), PRIORITIES.patterns))


@query(WITH + _STATUS_SQL + " SELECT target_id, criterion, verdict, count(*) AS n FROM matches GROUP BY ALL")
def verdict_counts(spark: SparkSession, d: str) -> DataFrame:
    return report.counts(_matches(spark, d)[1])


@query(WITH + _STATUS_SQL + " SELECT target_id, criterion, count(*) FILTER (verdict = 'positive') AS positive, count(*) FILTER (verdict = 'negative') AS negative, count(*) FILTER (verdict = 'neutral') AS neutral FROM matches GROUP BY ALL")
def verdict_wide(spark: SparkSession, d: str) -> DataFrame:
    return report.wide_counts(_matches(spark, d)[1])


@query(WITH + _STATUS_SQL + " SELECT criterion, verdict, round(count(*) / (SELECT count(DISTINCT target_id) FROM edges), 6) AS average FROM matches GROUP BY ALL")
def verdict_average(spark: SparkSession, d: str) -> DataFrame:
    g, found = _matches(spark, d)
    return report.averages(found, g).select("criterion", "verdict", F.round("average", 6).alias("average"))


@query(WITH + _STATUS_SQL + " SELECT target_id, criterion, query_id, verdict, mapping FROM matches WHERE verdict <> 'neutral'")
def verdict_details(spark: SparkSession, d: str) -> DataFrame:
    return report.details(_matches(spark, d)[1])


_LINES_SQL = (
    _STATUS_SQL
    + """, per AS (SELECT target_id, criterion, verdict, count(*) AS n, CAST(CASE verdict WHEN 'positive' THEN 0 WHEN 'negative' THEN 1 ELSE 2 END AS INT) AS rank FROM matches GROUP BY ALL),
named AS (SELECT *, upper(left(verdict, 1)) || substr(verdict, 2) AS title FROM per),
counted AS (SELECT target_id, criterion, '  ' || string_agg(title || ': ' || n, ' / ' ORDER BY rank) AS line FROM named GROUP BY ALL),
listed AS (SELECT target_id, criterion, CAST(CASE verdict WHEN 'positive' THEN 0 ELSE 1 END AS INT) AS rank, query_id, '  - ' || upper(left(verdict, 1)) || substr(verdict, 2) || ' / ' || query_id || chr(10)
  || '    - `' || replace(replace(mapping, '=', '` ->' || chr(10) || '      `'), '|', '`' || chr(10) || '    - `') || '`' AS line FROM matches WHERE verdict <> 'neutral'),
body AS (SELECT target_id, criterion, CAST(1 AS INT) AS part, CAST(-1 AS INT) AS rank, '' AS query_id, line FROM counted UNION ALL SELECT target_id, criterion, CAST(2 AS INT), rank, query_id, line FROM listed)"""
)
_AVERAGE_SQL = """, mean AS (SELECT criterion, title, rank, sum(n) / (SELECT count(DISTINCT target_id) FROM edges) AS average FROM named GROUP BY ALL),
tail AS (SELECT DISTINCT criterion, CAST(-1 AS INT) AS rank, '- Average:' AS line FROM mean UNION ALL SELECT criterion, rank, '  ' || title || ': ' || printf('%.1f', average) FROM mean)"""


@query(WITH + _LINES_SQL + " SELECT * FROM body UNION ALL SELECT DISTINCT target_id, criterion, CAST(0 AS INT), CAST(-1 AS INT), '', '- ' || criterion FROM per")
def report_targets(spark: SparkSession, d: str) -> DataFrame:
    return report.target_reports(durable(_matches(spark, d)[1], "matches"))


@query(WITH + _LINES_SQL + _AVERAGE_SQL + " SELECT * FROM body UNION ALL SELECT DISTINCT target_id, criterion, CAST(0 AS INT), CAST(-1 AS INT), '', '- ' || target_id FROM per UNION ALL SELECT NULL, criterion, CAST(3 AS INT), rank, '', line FROM tail")
def report_criteria(spark: SparkSession, d: str) -> DataFrame:
    g, found = _matches(spark, d)
    return report.criterion_reports(durable(found, "matches"), g)


# ---------------------------------------------------------------- suggested extensions


SEED = (PatternTree.of("positive", {_loop("c", "nameClass", "BUILDING"), ("c", "contains", "o")}),)
_SEED_SQL = LINKS + """, m AS (SELECT l.target_id, l.src AS c, l.dst AS o FROM links l JOIN loops x ON x.target_id = l.target_id AND x.node = l.src AND x.label = 'annotation.nameClass=BUILDING' WHERE l.label = 'contains'),
u AS (SELECT target_id, c || '|' || o AS id, 'c' AS q, c AS t FROM m UNION ALL SELECT target_id, c || '|' || o, 'o', o FROM m), total AS (SELECT count(*) AS n FROM m),
ext_e AS (SELECT a.q AS qsrc, e.label, b.q AS qdst, round(count(*) / (SELECT n FROM total), 6) AS fraction FROM u a JOIN u b ON a.target_id = b.target_id AND a.id = b.id JOIN edges e ON e.target_id = a.target_id AND e.src = a.t AND e.dst = b.t
  WHERE (a.q, e.label, b.q) NOT IN (('c', 'annotation.nameClass=BUILDING', 'c'), ('c', 'contains', 'o')) GROUP BY ALL),
way AS (SELECT target_id, src AS t, dst AS other, label, true AS outward FROM links UNION ALL SELECT target_id, dst, src, label, false FROM links),
occ AS (SELECT u.target_id, u.id, u.q, w.other, coalesce(string_agg(label, ',' ORDER BY label) FILTER (outward), '') AS outgoing, coalesce(string_agg(label, ',' ORDER BY label) FILTER (NOT outward), '') AS incoming
  FROM u JOIN way w ON w.target_id = u.target_id AND w.t = u.t WHERE NOT EXISTS (SELECT 1 FROM u z WHERE z.target_id = u.target_id AND z.id = u.id AND z.t = w.other) GROUP BY ALL),
lp AS (SELECT target_id, node AS other, string_agg(label, ',' ORDER BY label) AS loops FROM loops GROUP BY ALL),
ext_n AS (SELECT q AS qnode, coalesce(loops, '') AS loops, outgoing, incoming, round(count(DISTINCT (target_id, id)) / (SELECT n FROM total), 6) AS fraction, count(*) AS occurrences FROM occ LEFT JOIN lp USING (target_id, other) GROUP BY ALL)"""


def _seed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = commerce.edges(spark, d)
    known = spark.createDataFrame(planner.query_edges(planner.forest(SEED)), "query_id string, src string, label string, dst string")
    return g, match.search_trees(g, SEED), known


def _nodes_flat(found: DataFrame) -> DataFrame:
    return found.select("query_id", "qnode", joined("loops").alias("loops"), joined("outgoing").alias("outgoing"), joined("incoming").alias("incoming"), F.round("fraction", 6).alias("fraction"), "occurrences")


@query(WITH + _SEED_SQL + " SELECT 'query_0' AS query_id, * FROM ext_e")
def ext_edges(spark: SparkSession, d: str) -> DataFrame:
    g, found, known = _seed(spark, d)
    return suggest.edge_extensions(found, g, known).withColumn("fraction", F.round("fraction", 6))


@query(WITH + _SEED_SQL + " SELECT 'query_0' AS query_id, * FROM ext_n")
def ext_nodes(spark: SparkSession, d: str) -> DataFrame:
    g, found, _ = _seed(spark, d)
    return _nodes_flat(suggest.node_extensions(found, g))


@query(
    WITH
    + _SEED_SQL
    + """, r AS (SELECT *, row_number() OVER (ORDER BY fraction DESC, qnode, loops, outgoing, incoming) AS rank FROM ext_n),
rr AS (SELECT *, CASE WHEN rank > 3 AND fraction < 0.6 THEN row_number() OVER (PARTITION BY rank > 3 AND fraction < 0.6 ORDER BY rank) END AS k FROM r)
SELECT 'query_0' AS query_id, qnode, loops, outgoing, incoming, fraction, rank FROM rr WHERE rank <= 3 OR k <= 3"""
)
def ext_select(spark: SparkSession, d: str) -> DataFrame:
    g, found, _ = _seed(spark, d)
    flat = _nodes_flat(suggest.node_extensions(found, g))
    return suggest.select_extensions(flat, ["qnode", "loops", "outgoing", "incoming"]).select("query_id", "qnode", "loops", "outgoing", "incoming", "fraction", F.col("rank").cast("bigint").alias("rank"))


@query(
    WITH
    + _SEED_SQL
    + """, s AS (SELECT occ.target_id, q AS qnode, coalesce(loops, '') AS loops, outgoing, incoming, occ.other, occ.id FROM occ LEFT JOIN lp USING (target_id, other)),
one AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY qnode, loops, outgoing, incoming, target_id ORDER BY id, other) = 1)
SELECT target_id, 'query_0' AS query_id, qnode, loops, outgoing, incoming, other FROM one QUALIFY row_number() OVER (PARTITION BY qnode, loops, outgoing, incoming ORDER BY target_id) <= 3"""
)
def ext_samples(spark: SparkSession, d: str) -> DataFrame:
    g, found, _ = _seed(spark, d)
    flat = suggest.samples(suggest.node_occurrences(found, g))
    return flat.select("target_id", "query_id", "qnode", joined("loops").alias("loops"), joined("outgoing").alias("outgoing"), joined("incoming").alias("incoming"), "other")


SEVERAL = (*SEED, PatternTree.of("positive", {("o", "accessesField", "p")}))


@query(
    WITH
    + _SEED_SQL
    + """, m2 AS (SELECT target_id, src AS o, dst AS p FROM links WHERE label = 'accessesField'), u2 AS (SELECT target_id, o || '|' || p AS id, 'o' AS q, o AS t FROM m2 UNION ALL SELECT target_id, o || '|' || p, 'p', p FROM m2),
ext_2 AS (SELECT a.q AS qsrc, e.label, b.q AS qdst, round(count(*) / (SELECT count(*) FROM m2), 6) AS fraction FROM u2 a JOIN u2 b ON a.target_id = b.target_id AND a.id = b.id JOIN edges e ON e.target_id = a.target_id AND e.src = a.t AND e.dst = b.t
  WHERE (a.q, e.label, b.q) <> ('o', 'accessesField', 'p') GROUP BY ALL)
SELECT 'query_0' AS query_id, * FROM ext_e UNION ALL SELECT 'query_1', * FROM ext_2"""
)
def ext_several(spark: SparkSession, d: str) -> DataFrame:
    """Extensions of two queries at once, each against its own matches."""
    g = commerce.edges(spark, d)
    known = spark.createDataFrame(planner.query_edges(planner.forest(SEVERAL)), "query_id string, src string, label string, dst string")
    return suggest.edge_extensions(match.search_trees(commerce.stored(spark, d), SEVERAL), g, known).withColumn("fraction", F.round("fraction", 6))


# ---------------------------------------------------------------- typegraphs from facts


def facts(spark: SparkSession, d: str) -> extract.Facts:
    """The tables read as program facts: customers are types, parts are fields."""
    t = commerce.Commerce(spark, d)
    rel = lambda df, a, b: df.select("target_id", F.col(a).alias("from"), F.col(b).alias("to")).distinct()
    key = t.nation.schema["target_id"].dataType.simpleString()
    empty = extract.empty_relation(spark, key)
    containment = rel(t.customer, "n", "c").union(rel(t.order, "c", "o"))
    declared = t.nation.select("target_id", F.col("n").alias("name")).union(t.customer.select("target_id", "c")).union(t.order.select("target_id", "o"))
    names = t.customer.select("target_id", F.col("c_mktsegment").alias("simple_name"), F.col("c").alias("qualified_name")).union(t.order.select("target_id", "o_orderpriority", "o"))
    return extract.Facts(
        declared, containment, rel(t.nation, "n", "r"), empty, rel(t.line, "o", "p"), rel(t.line, "o", "s"), empty, rel(t.line.filter("l_returnflag = 'R'"), "o", "p"),
        t.order.select("target_id", F.col("o").alias("name"), F.col("o_orderstatus").alias("modifier")), names, ("customer",), ("part",), ("nation",),
    )


_UP = """, ct AS (SELECT target_id, src AS a, dst AS b FROM edges WHERE label = 'contains'), el AS (SELECT target_id, a AS element FROM ct UNION SELECT target_id, b FROM ct UNION SELECT target_id, src FROM edges WHERE label LIKE 'annotation.scheme=%'),
up AS (SELECT target_id, element, element AS container FROM el UNION SELECT up.target_id, element, ct.a FROM up JOIN ct ON ct.target_id = up.target_id AND ct.b = up.container),
tp AS (SELECT target_id, element, element AS loc FROM el UNION SELECT tp.target_id, element, ct.a FROM tp JOIN ct ON ct.target_id = tp.target_id AND ct.b = tp.loc WHERE tp.loc NOT LIKE 'customer:%'),
types AS (SELECT target_id, element, loc AS type FROM tp WHERE loc LIKE 'customer:%')"""


@query(WITH + _UP + " SELECT * FROM up")
def x_containing_elements(spark: SparkSession, d: str) -> DataFrame:
    return extract.containing_elements(facts(spark, d))


@query(WITH + _UP + " SELECT * FROM types")
def x_containing_types(spark: SparkSession, d: str) -> DataFrame:
    return extract.containing_types(facts(spark, d))


@query(WITH + " SELECT target_id, src AS unit, dst AS type FROM edges WHERE label = 'contains' AND src LIKE 'nation:%' AND dst LIKE 'customer:%'")
def x_unit_types(spark: SparkSession, d: str) -> DataFrame:
    return extract.compilation_unit_types(facts(spark, d))


_LIFT = lambda label, around, column: f"SELECT e.target_id, {column} AS src, e.label, e.dst FROM edges e JOIN {around} u ON u.target_id = e.target_id AND u.element = e.src WHERE e.label = '{label}'"


@query(WITH + _UP + " SELECT DISTINCT * FROM (" + _LIFT("dependsOn", "up", "container") + ")")
def x_depends_on(spark: SparkSession, d: str) -> DataFrame:
    return extract.depends_on(facts(spark, d))


@query(WITH + _UP + ", l AS (" + _LIFT("dependsOn", "up", "container") + ") SELECT DISTINCT * FROM l UNION SELECT l.target_id, t.dst, l.label, l.dst FROM l JOIN edges t ON t.target_id = l.target_id AND t.src = l.src AND t.label = 'contains' WHERE t.src LIKE 'nation:%' AND t.dst LIKE 'customer:%'")
def x_depends_on_units(spark: SparkSession, d: str) -> DataFrame:
    return extract.depends_on(facts(spark, d), units=True)


@query(WITH + " SELECT target_id, src, 'overrides' AS label, dst FROM edges WHERE label = 'invokes' UNION ALL SELECT target_id, src, 'implements', dst FROM edges WHERE label = 'contains' AND src LIKE 'nation:%'")
def x_overrides(spark: SparkSession, d: str) -> DataFrame:
    t = commerce.Commerce(spark, d)
    rel = lambda df, a, b: df.select("target_id", F.col(a).alias("from"), F.col(b).alias("to")).distinct()
    more = replace(facts(spark, d), method_overrides=rel(t.line, "o", "s"), implements=rel(t.customer, "n", "c"))
    return extract.structure(more).filter("label in ('overrides', 'implements')")


@query(
    WITH
    + """ SELECT t AS target_id, concat('at ', o) AS src, 'controlDepends' AS label, concat('at ', min(o) OVER (PARTITION BY t, c)) AS dst FROM oc
UNION SELECT t, concat('at ', o), 'dataDepends', concat('at ', o) FROM oc WHERE o_orderstatus = 'F'"""
)
def x_dependences(spark: SparkSession, d: str) -> DataFrame:
    """Orders as statements: each depends on its customer's first, finished ones on their own data."""
    o = commerce.Commerce(spark, d).order.select("target_id", F.col("c").alias("method"), F.col("o").alias("id"), "o_orderstatus")
    names = o.select("target_id", "method", "id", F.concat(F.lit("at "), "id").alias("location"))
    first = o.groupBy("target_id", "method").agg(F.min("id").alias("to"))
    data = o.filter("o_orderstatus = 'F'").select("target_id", "method", F.col("id").alias("from"), F.col("id").alias("to"))
    return extract.dependence_graph(o.join(first, ["target_id", "method"]).select("target_id", "method", F.col("id").alias("from"), "to"), data, names)


@query(WITH + _UP + " SELECT * FROM edges WHERE label = 'invokes' UNION " + _LIFT("invokes", "types", "type"))
def x_invokes(spark: SparkSession, d: str) -> DataFrame:
    return extract.invokes(facts(spark, d))


@query(WITH + _UP + " SELECT * FROM edges WHERE label = 'accessesField' UNION " + _LIFT("accessesField", "types", "type"))
def x_accesses(spark: SparkSession, d: str) -> DataFrame:
    return extract.accesses(facts(spark, d))


@query(
    WITH
    + """ SELECT DISTINCT target_id, src AS node, label FROM edges WHERE src = dst AND (label LIKE 'annotation.modifier=%' OR label LIKE 'annotation.scheme=%' OR label LIKE 'annotation.location=%')"""
)
def x_annotations(spark: SparkSession, d: str) -> DataFrame:
    return extract.default_annotations(facts(spark, d), graph.nodes(commerce.edges(spark, d)))


@query(WITH + " SELECT DISTINCT target_id, src AS node, concat('annotation.nameClass=', p) AS label FROM edges, (VALUES ('URGENT'), ('BUILD'), ('LOW')) AS v(p) WHERE src = dst AND label LIKE 'annotation.nameClass=%' AND contains(label, p)")
def x_name_class(spark: SparkSession, d: str) -> DataFrame:
    return extract.name_classes(facts(spark, d), ("URGENT", "BUILD", "LOW"))


@query(
    WITH
    + _UP
    + f""", s AS (SELECT * FROM edges WHERE label IN ('extends', 'contains', 'invokes', 'accessesField') UNION {_LIFT("dependsOn", "up", "container")} UNION {_LIFT("invokes", "types", "type")} UNION {_LIFT("accessesField", "types", "type")})
SELECT * FROM s UNION SELECT * FROM edges WHERE src = dst AND (label LIKE 'annotation.modifier=%' OR label LIKE 'annotation.scheme=%' OR label LIKE 'annotation.location=%')"""
)
def x_typegraph(spark: SparkSession, d: str) -> DataFrame:
    return extract.typegraph(facts(spark, d))


# ---------------------------------------------------------------- formats


@query(WITH + " SELECT target_id, to_base64(encode(src)) || '>' || to_base64(encode(dst)) || ',' || to_base64(encode(label)) AS line FROM edges")
def gss_export(spark: SparkSession, d: str) -> DataFrame:
    return formats.gss_lines(commerce.edges(spark, d))


@query(WITH + " SELECT * FROM edges")
def gss_import(spark: SparkSession, d: str) -> DataFrame:
    return formats.gss_edges(formats.gss_lines(commerce.edges(spark, d)))


_SPMF = _NODES + """, lab AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_id FROM (SELECT DISTINCT label FROM edges WHERE src <> dst)), gr AS (SELECT target_id, row_number() OVER (ORDER BY target_id) - 1 AS graph FROM (SELECT DISTINCT target_id FROM edges)),
le AS (SELECT * FROM edges WHERE src <> dst), ln AS (SELECT target_id, src AS node FROM le UNION SELECT target_id, dst FROM le), li AS (SELECT target_id, node, row_number() OVER (PARTITION BY target_id ORDER BY node) - 1 AS node_id FROM ln)"""


@query(WITH + _SPMF + " SELECT graph, concat('t # ', graph) AS line FROM gr UNION ALL SELECT graph, concat('v ', node_id, ' 0') FROM li JOIN gr USING (target_id) UNION ALL SELECT graph, concat('e ', a.node_id, ' ', b.node_id, ' ', label_id) FROM le JOIN li a ON a.target_id = le.target_id AND a.node = src JOIN li b ON b.target_id = le.target_id AND b.node = dst JOIN lab USING (label) JOIN gr ON gr.target_id = le.target_id")
def spmf_export(spark: SparkSession, d: str) -> DataFrame:
    return formats.spmf_lines(commerce.edges(spark, d).filter("src <> dst")).select("graph", "line")


@query(WITH + _SPMF + " SELECT graph, a.node_id AS src, label, b.node_id AS dst FROM le JOIN li a ON a.target_id = le.target_id AND a.node = src JOIN li b ON b.target_id = le.target_id AND b.node = dst JOIN gr ON gr.target_id = le.target_id")
def spmf_import(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d).filter("src <> dst")
    labels = formats.label_dictionary(g)
    return formats.spmf_edges(formats.spmf_lines(g, labels).select("graph", "line"), labels)


@query(WITH + " SELECT * FROM edges WHERE label <> 'annotation.none'")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    g = commerce.edges(spark, d)
    texts = durable(typegraph.encode(g), "typegraphs", sweep=True, **pieces.SMALL)
    edges, _ = typegraph.decode(texts)
    return edges


# ---------------------------------------------------------------- text


@query(rf"SELECT doc_id, regexp_replace(text, '{text.EMAIL}', 'user@example.com', 'g') AS text FROM documents")
def pii_emails(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.replace_emails(F.col("text")).alias("text"))


@query(r"SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?i)the', 'X', 'g'), '(?i)(^|[^a-z])(ion)([^a-z]|$)', '\1Y\3', 'g') AS text FROM conversations")
def pii_names(spark: SparkSession, d: str) -> DataFrame:
    rules = [text.Rule(text.exactly("the"), "X"), text.Rule("(?i)(^|[^a-z])(ion)([^a-z]|$)", "$1Y$3")]
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.replace_all(F.col("text"), rules).alias("text"))


@query(r"SELECT doc_id, regexp_replace(text, '\b[0-9]{16}\b', '0000000000000000', 'g') AS text FROM documents")
def pii_ids(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.replace_all(F.col("text"), [text.Rule(r"\b[0-9]{16}\b", "0" * 16)]).alias("text"))


@query(
    rf"""WITH p AS (SELECT doc_id, string_split_regex(text, '{text.EMAIL}') AS p, regexp_extract_all(text, '{text.EMAIL}') AS a FROM documents)
SELECT doc_id, array_to_string(list_transform(p, lambda x, i: concat(x, CASE WHEN i <= len(a) THEN concat(substr(sha256(lower(a[i])), 1, 10), '@example.com') ELSE '' END)), '') AS text FROM p"""
)
def pii_alias_emails(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.alias_emails(F.col("text")).alias("text"))


_STUDENT = "Theron, Ion de Ing"


@query(
    f"""SELECT conv_id, turn, regexp_replace(regexp_replace(text, '(?i)theron', '{text.name_alias("Theron")}', 'g'), '(?i)ion de ing', '{text.name_alias("Ion de Ing")}', 'g') AS text FROM conversations"""
)
def pii_students(spark: SparkSession, d: str) -> DataFrame:
    """The words of the first name are short and stay, as particles do."""
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.replace_all(F.col("text"), text.student_rules(_STUDENT, None)).alias("text"))


@query("SELECT doc_id, strip_accents(text) AS text FROM documents")
def unaccent(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", text.unaccent("text").alias("text"))


# ---------------------------------------------------------------- events


@query("SELECT event_id, user_id, ts FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n IS NULL OR n - ts > INTERVAL 1 HOUR")
def event_debounce(spark: SparkSession, d: str) -> DataFrame:
    return watch.debounce(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts", 3600, "event_id").select("event_id", "user_id", "ts")


@query("SELECT event_id, user_id, CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS batch FROM events QUALIFY row_number() OVER (PARTITION BY CAST(epoch_us(ts) // 86400000000 AS BIGINT), user_id ORDER BY ts, event_id) = 1")
def event_unique_queue(spark: SparkSession, d: str) -> DataFrame:
    return watch.unique_pending(spark.read.parquet(f"{d}/events.parquet"), "user_id", "ts", "event_id", 86_400).select("event_id", "user_id", "batch")


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Parts of finished orders of building customers."""
    return match_chain(spark, d)


__all__ = ["ORACLES", "QUERIES", "flagship"]
