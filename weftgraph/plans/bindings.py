"""The driver's tables seen as networks, nodes, signals, hits, points and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import tasks

#: Partitions up to which Spark writes a shuffle row by row (spark.shuffle.sort.bypassMergeThreshold).
FEW = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    """source, u, v, w (hundredths, whole), row: supplier-part links with repeats."""
    x = table(spark, d, "lineitem")
    return x.select(
        F.concat("l_returnflag", F.lit(".csv")).alias("source"), F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("u"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("v"), F.round(F.col("l_discount") * 100).cast("long").alias("w"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """source, node1, node2, weight (hundredths): one row per canonical pair and network, the largest weight."""
    a, b = F.least("u", "v"), F.greatest("u", "v")
    return raw_edges(spark, d).groupBy("source", a.alias("node1"), b.alias("node2")).agg(F.max("w").alias("weight"))


EDGES_SQL = """
  SELECT l_returnflag || '.csv' AS source, least('S' || l_suppkey, 'P' || l_partkey) AS node1, greatest('S' || l_suppkey, 'P' || l_partkey) AS node2,
    max(round(l_discount * 100)::BIGINT) AS weight
  FROM lineitem GROUP BY ALL"""


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """id, taxid, nh_id: parts with their brand as cluster, suppliers without one."""
    p = table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_size").cast("string").alias("taxid"), F.col("p_brand").alias("nh_id"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_nationkey").cast("string").alias("taxid"), F.lit(None).cast("string").alias("nh_id"))
    return p.union(s)


NODES_SQL = """
  SELECT 'P' || p_partkey AS id, p_size::VARCHAR AS taxid, p_brand AS nh_id FROM part
  UNION ALL SELECT 'S' || s_suppkey, s_nationkey::VARCHAR, NULL FROM supplier"""


def signals(spark: SparkSession, d: str, with_self: bool = False, repeats: bool = False) -> DataFrame:
    """protein, signal: parts that share an order; optionally each part itself too, and pairs as often as they occur."""
    x = lines_by_order(spark, d)[0] if repeats else table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    y = x.select("l_orderkey", F.col("l_partkey").alias("other"))
    out = x.join(y, "l_orderkey").filter("l_partkey <> other").select(F.col("l_partkey").alias("protein"), F.col("other").alias("signal"))
    out = out.union(x.select("l_partkey", "l_partkey")) if with_self else out
    return out if repeats else out.distinct()


SIGNALS_SQL = """
  SELECT DISTINCT a.l_partkey AS protein, b.l_partkey AS signal FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey"""


def partition(spark: SparkSession, d: str) -> DataFrame:
    """node, cluster_id: parts by brand."""
    return table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"), F.col("p_brand").alias("cluster_id"))


def lines_by_order(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    """l_orderkey, l_partkey, each once, and the number of their tasks: as many as the orders have lines for, so that a
    task's pairs of parts do not grow with the input. Lines go there in two steps: a shuffle to more than FEW tasks holds
    all rows of a task in memory until it writes them, and a scan's task has as many as its file split, so that the first
    step is to FEW at most."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    wide = tasks(spark, 4 * lines.count())
    x = lines.repartition(min(wide, FEW), "l_orderkey").distinct()
    return (x if wide <= FEW else x.repartition(wide, "l_orderkey")), wide


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """node1, node2, weight: parts that share an order, by how many orders. Pairs are counted by their numbers, in as
    many tasks as the orders have lines for."""
    x, wide = lines_by_order(spark, d)
    y = x.select("l_orderkey", F.col("l_partkey").alias("other"))
    pairs = x.join(y, "l_orderkey").filter("l_partkey < other").select("l_partkey", "other")
    p = lambda c: F.concat(F.lit("P"), F.col(c).cast("string"))
    counted = pairs.repartition(wide, "l_partkey", "other").groupBy("l_partkey", "other").agg(F.count(F.lit(1)).alias("weight"))
    return counted.select(p("l_partkey").alias("node1"), p("other").alias("node2"), "weight")


PART_EDGES_SQL = """
  SELECT 'P' || a.l_partkey AS node1, 'P' || b.l_partkey AS node2, count(DISTINCT a.l_orderkey) AS weight
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY ALL"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    """q, t, query_id, query_len, hit_id, score, hit_len, line: a file per return flag."""
    x = table(spark, d, "lineitem").join(table(spark, d, "part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return x.select(
        F.lit("q").alias("q"), F.col("l_returnflag").alias("t"), F.col("l_partkey").alias("query_id"), F.col("p_size").cast("long").alias("query_len"),
        F.col("l_suppkey").alias("hit_id"), F.col("l_extendedprice").alias("score"), F.col("l_quantity").cast("long").alias("hit_len"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"),
    )


HITS_SQL = """
  SELECT 'q' AS q, l_returnflag AS t, l_partkey AS query_id, p_size::BIGINT AS query_len, l_suppkey AS hit_id, l_extendedprice AS score,
    l_quantity::BIGINT AS hit_len, l_orderkey * 10 + l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey"""


def points(spark: SparkSession, d: str) -> DataFrame:
    """query_id, hit_id, x, y: parts of a brand by size and price."""
    return table(spark, d, "part").select(F.col("p_brand").alias("query_id"), F.col("p_partkey").alias("hit_id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


POINTS_SQL = "SELECT p_brand AS query_id, p_partkey AS hit_id, p_size::DOUBLE AS x, p_retailprice AS y FROM part"


def taxa(spark: SparkSession, d: str) -> DataFrame:
    """node, parent, name, taxid: root, regions, nations, suppliers."""
    root = spark.createDataFrame([("root", None, "root", None)], "node string, parent string, name string, taxid string")
    r = table(spark, d, "region").select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")), F.lit("root"), "r_name", F.lit(None).cast("string"))
    n = table(spark, d, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")), "n_name", F.col("n_nationkey").cast("string"))
    s = table(spark, d, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")), "s_name", F.lit(None).cast("string"))
    return root.union(r).union(n).union(s)


TAXA_SQL = """
  SELECT 'root' AS node, NULL AS parent, 'root' AS name, NULL AS taxid UNION ALL SELECT 'R' || r_regionkey, 'root', r_name, NULL FROM region
  UNION ALL SELECT 'N' || n_nationkey, 'R' || n_regionkey, n_name, n_nationkey::VARCHAR FROM nation
  UNION ALL SELECT 'S' || s_suppkey, 'N' || s_nationkey, s_name, NULL FROM supplier"""
