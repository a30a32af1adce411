"""The test tables as typed graphs: one target per nation, nodes named ``kind:key``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.operators.match import store
from arbora.storage import again

#: The same edges as a common table expression for an engine that has the tables as views.
EDGES_SQL = """
ol AS (SELECT c_nationkey AS t, concat('order:', o_orderkey) AS o, concat('part:', l_partkey) AS p, concat('supplier:', l_suppkey) AS s, l_returnflag AS f
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
oc AS (SELECT c_nationkey AS t, concat('customer:', c_custkey) AS c, concat('order:', o_orderkey) AS o, o_orderstatus, o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey),
nr AS (SELECT n_nationkey AS t, concat('nation:', n_nationkey) AS n, concat('region:', n_regionkey) AS r FROM nation),
cu AS (SELECT c_nationkey AS t, concat('nation:', c_nationkey) AS n, concat('customer:', c_custkey) AS c, c_mktsegment FROM customer),
edges AS (
  SELECT t AS target_id, n AS src, 'extends' AS label, r AS dst FROM nr
  UNION SELECT t, n, 'contains', c FROM cu
  UNION SELECT t, c, 'contains', o FROM oc
  UNION SELECT t, o, 'dependsOn', p FROM ol
  UNION SELECT t, o, 'accessesField', p FROM ol WHERE f = 'R'
  UNION SELECT t, o, 'invokes', s FROM ol
  UNION SELECT t, n, 'annotation.scheme=nation', n FROM nr
  UNION SELECT t, c, 'annotation.scheme=customer', c FROM cu
  UNION SELECT t, o, 'annotation.scheme=order', o FROM oc
  UNION SELECT t, o, concat('annotation.modifier=', o_orderstatus), o FROM oc
  UNION SELECT t, o, concat('annotation.nameClass=', o_orderpriority), o FROM oc
  UNION SELECT t, c, concat('annotation.nameClass=', c_mktsegment), c FROM cu
  UNION SELECT t, p, concat('annotation.location=', p), p FROM ol
  UNION SELECT t, s, concat('annotation.location=', s), s FROM ol
  UNION SELECT t, r, concat('annotation.location=', r), r FROM nr)
"""


def _node(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


class Commerce:
    """The tables that the graph is made of, each narrowed to what edges need."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        read = lambda name, *columns: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
        customer, orders = read("customer", "c_custkey", "c_nationkey", "c_mktsegment"), read("orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        nation = read("nation", "n_nationkey", "n_regionkey")
        lines = read("lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
        self.nation = nation.select(F.col("n_nationkey").alias("target_id"), _node("nation", "n_nationkey").alias("n"), _node("region", "n_regionkey").alias("r"))
        self.customer = customer.select(F.col("c_nationkey").alias("target_id"), _node("nation", "c_nationkey").alias("n"), _node("customer", "c_custkey").alias("c"), "c_mktsegment")
        owned = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        self.order = owned.select(F.col("c_nationkey").alias("target_id"), _node("customer", "c_custkey").alias("c"), _node("order", "o_orderkey").alias("o"), "o_orderstatus", "o_orderpriority")
        placed = lines.join(owned.select("o_orderkey", "c_nationkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        self.placed = placed
        self.line = placed.select(F.col("c_nationkey").alias("target_id"), _node("order", "o_orderkey").alias("o"), _node("part", "l_partkey").alias("p"), _node("supplier", "l_suppkey").alias("s"), "l_returnflag")


def _edge(df: DataFrame, src: str, label: Column | str, dst: str, repeats: bool = False) -> DataFrame:
    out = df.select("target_id", F.col(src).alias("src"), (F.lit(label) if isinstance(label, str) else label).alias("label"), F.col(dst).alias("dst"))
    return out.distinct() if repeats else out


_STORED: dict[tuple[str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as a stored graph, written once for each application and folder, as a project's graph is loaded once for all that is asked of it."""
    key = spark.sparkContext.applicationId, sf_dir
    found = again(spark, _STORED[key]) if key in _STORED else None
    if found is None:
        found = _STORED[key] = store(made_edges(spark, sf_dir))
    return found


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).select("target_id", "src", "label", "dst")


def _uses(t: Commerce) -> DataFrame:
    """``target_id``, ``l_orderkey``, ``use`` and ``key``: parts (0), returned parts (1) and suppliers (2) of each line."""
    use = lambda n, c: F.struct(F.lit(n).alias("use"), F.col(c).cast("bigint").alias("key"))
    some = use(0, "l_partkey"), use(2, "l_suppkey")
    uses = F.when(F.col("l_returnflag") == "R", F.array(*some, use(1, "l_partkey"))).otherwise(F.array(*some))
    return t.placed.select(F.col("c_nationkey").alias("target_id"), "l_orderkey", F.explode(uses).alias("u")).select("target_id", "l_orderkey", "u.*")


def made_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges from the tables.  Labels of different parts differ, so only the parts that repeat rows are made distinct.

    Lines lie by order after they are joined, and what repeats does so within an order, so their edges are made distinct by keys there, without
    another exchange, and get their names last.
    """
    t = Commerce(spark, sf_dir)
    of = lambda kind, column: F.concat(F.lit(f"annotation.{kind}="), F.col(column))
    edge = lambda src, label, dst: F.struct(F.col(src).alias("src"), (F.lit(label) if isinstance(label, str) else label).alias("label"), F.col(dst).alias("dst"))
    each = lambda df, *some: df.select("target_id", F.explode(F.array(*some)).alias("e")).select("target_id", "e.*")
    uses = _uses(t)
    name = F.when(F.col("use") == 2, _node("supplier", "key")).otherwise(_node("part", "key"))
    label = F.when(F.col("use") == 0, "dependsOn").when(F.col("use") == 1, "accessesField").otherwise("invokes")
    used = uses.filter("use <> 1").select("target_id", "use", "key").distinct().select("target_id", name.alias("n"))
    parts = [
        _edge(t.nation, "n", "extends", "r"),
        _edge(t.nation, "n", "annotation.scheme=nation", "n"),
        each(t.customer, edge("n", "contains", "c"), edge("c", "annotation.scheme=customer", "c"), edge("c", of("nameClass", "c_mktsegment"), "c")),
        each(t.order, edge("c", "contains", "o"), edge("o", "annotation.scheme=order", "o"), edge("o", of("modifier", "o_orderstatus"), "o"), edge("o", of("nameClass", "o_orderpriority"), "o")),
        uses.distinct().select("target_id", _node("order", "l_orderkey").alias("src"), label.alias("label"), name.alias("dst")),
        _edge(used, "n", of("location", "n"), "n"),
        _edge(t.nation, "r", of("location", "r"), "r", True),
    ]
    return reduce(DataFrame.union, parts)
