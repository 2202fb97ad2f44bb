"""The driver's relational tables as property graphs.

Trade: nations, an edge from a supplier's nation to a customer's for the revenue between them. Orders: customers refer
to orders, orders call parts (an edge for each lineitem), suppliers import parts; regions contain nations, which
contain customers and suppliers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweft.session import table


def ident(kind: str, key) -> F.Column:
    return F.concat(F.lit(f"{kind}:"), key.cast("string"))


def order_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """id, kind, name, parent, is_test."""
    t = lambda n: table(spark, sf, n)
    no = F.lit(False)
    parts = [
        t("region").select(ident("region", F.col("r_regionkey")).alias("id"), F.lit("namespace").alias("kind"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"), no.alias("is_test")),
        t("nation").select(ident("nation", F.col("n_nationkey")), F.lit("module"), F.col("n_name"), ident("region", F.col("n_regionkey")), no),
        t("customer").select(ident("customer", F.col("c_custkey")), F.lit("class"), F.col("c_name"), ident("nation", F.col("c_nationkey")), F.col("c_acctbal") < 0),
        t("supplier").select(ident("supplier", F.col("s_suppkey")), F.lit("class"), F.col("s_name"), ident("nation", F.col("s_nationkey")), no),
        t("part").select(ident("part", F.col("p_partkey")), F.lit("function"), F.col("p_name"), F.lit(None).cast("string"), no),
        t("orders").select(ident("order", F.col("o_orderkey")), F.lit("method"), F.col("o_orderstatus"), F.lit(None).cast("string"), no),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def order_edges(spark: SparkSession, sf: str, *, repeated: bool = False) -> DataFrame:
    """src, dst, kind, line; a lineitem is an edge of its own. repeated leaves a supplier's imports as often as they are
    met, which saves a shuffle where only the ends count."""
    t = lambda n: table(spark, sf, n)
    refs = t("orders").select(ident("customer", F.col("o_custkey")).alias("src"), ident("order", F.col("o_orderkey")).alias("dst"), F.lit("references").alias("kind"), F.lit(0).alias("line"))
    calls = t("lineitem").select(ident("order", F.col("l_orderkey")), ident("part", F.col("l_partkey")), F.lit("calls"), F.col("l_linenumber"))
    uses = t("lineitem").select("l_suppkey", "l_partkey")
    uses = (uses if repeated else uses.distinct()).select(ident("supplier", F.col("l_suppkey")), ident("part", F.col("l_partkey")), F.lit("imports"), F.lit(0))
    return refs.union(calls).union(uses)


def trade_edges(spark: SparkSession, sf: str) -> DataFrame:
    """src, dst, weight, n: revenue in millions from suppliers' nations to customers'."""
    t = lambda n: table(spark, sf, n)
    items = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    revenue = F.round(F.sum(F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long")) / 1e8, 6)
    return items.groupBy(ident("nation", F.col("s_nationkey")).alias("src"), ident("nation", F.col("c_nationkey")).alias("dst")).agg(revenue.alias("weight"), F.count("*").alias("n"))


def whole_trade(edges: DataFrame) -> DataFrame:
    """Every flow between different nations."""
    return edges.where("src <> dst")


def sparse_trade(edges: DataFrame, keep: int = 3) -> DataFrame:
    """Each nation's largest flows to others."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return edges.where("src <> dst").withColumn("k", k).where(F.col("k") <= keep).drop("k")


NODES_SQL = """nodes AS (
  SELECT 'region:' || r_regionkey AS id, 'namespace' AS kind, r_name AS name, CAST(NULL AS VARCHAR) AS parent, false AS is_test FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'module', n_name, 'region:' || n_regionkey, false FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'class', c_name, 'nation:' || c_nationkey, c_acctbal < 0 FROM customer
  UNION ALL SELECT 'supplier:' || s_suppkey, 'class', s_name, 'nation:' || s_nationkey, false FROM supplier
  UNION ALL SELECT 'part:' || p_partkey, 'function', p_name, NULL, false FROM part
  UNION ALL SELECT 'order:' || o_orderkey, 'method', o_orderstatus, NULL, false FROM orders)"""
EDGES_SQL = """edges AS (
  SELECT 'customer:' || o_custkey AS src, 'order:' || o_orderkey AS dst, 'references' AS kind, 0 AS line FROM orders
  UNION ALL SELECT 'order:' || l_orderkey, 'part:' || l_partkey, 'calls', l_linenumber FROM lineitem
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'imports', 0 FROM lineitem)"""
TRADE_SQL = """trade AS (
  SELECT 'nation:' || s_nationkey AS src, 'nation:' || c_nationkey AS dst,
    round(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100) AS BIGINT)) / 1e8, 6) AS weight, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  GROUP BY ALL)"""
SPARSE_SQL = """sparse AS (
  SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM trade WHERE src <> dst) WHERE k <= 3)"""
WHOLE_SQL = "whole AS (SELECT src, dst, weight FROM trade WHERE src <> dst)"
