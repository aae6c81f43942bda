"""The queries of the core library by name, and the SQL that gives the same rows.

Sums over doubles are kept exact by whole hundredths; ranks have total orders.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fn
from ..operators import alignment, communities, components, editing, extraction, intervals, kmer_index, networks, ranking, signal_calls, sji, taxonomy, views
from ..shared import shared_dir
from . import bindings as b

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


E, N, S, H, P, T, PE = b.EDGES_SQL, b.NODES_SQL, b.SIGNALS_SQL, b.HITS_SQL, b.POINTS_SQL, b.TAXA_SQL, b.PART_EDGES_SQL

# -- similarity networks ------------------------------------------------------------------------------------

SJI = f"""
WITH s AS ({S}), n AS (SELECT protein, count(*) AS k FROM s GROUP BY 1),
i AS (SELECT e.protein AS a, e.signal AS b, count(*) AS inter FROM s e JOIN s f ON f.protein = e.protein
  JOIN s g ON g.protein = e.signal AND g.signal = f.signal WHERE e.protein < e.signal GROUP BY 1, 2)
SELECT i.a, i.b, i.inter, n1.k + n2.k - i.inter AS uni, i.inter / (n1.k + n2.k - i.inter) AS sji
FROM i JOIN n n1 ON n1.protein = i.a JOIN n n2 ON n2.protein = i.b"""


@query(SJI)
def graph15_sji_network(spark, d):
    return sji.network(b.signals(spark, d, repeats=True)).select("a", "b", "inter", "uni", "sji")


@query(SJI.replace(S, f"{S} UNION SELECT l_partkey, l_partkey FROM lineitem"))
def graph15_sji_with_self(spark, d):
    return sji.network(b.signals(spark, d, with_self=True, repeats=True)).select("a", "b", "inter", "uni", "sji")


@query(f"""
WITH s AS ({S}), n AS (SELECT protein, count(*) AS k FROM s GROUP BY 1),
i AS (SELECT e.protein AS a, e.signal AS b, count(*) AS inter FROM s e JOIN s f ON f.protein = e.protein
  JOIN s g ON g.protein = e.signal AND g.signal = f.signal GROUP BY 1, 2)
SELECT a, b, inter, n1.k + n2.k - inter AS uni, inter / (n1.k + n2.k - inter) AS sji
FROM i JOIN n n1 ON n1.protein = a JOIN n n2 ON n2.protein = b""")
def graph16_sji_oneway_whole(spark, d):
    s = b.signals(spark, d, repeats=True)
    return sji.network_oneway(s, s).select("a", "b", "inter", "uni", "sji")


@query(f"""
WITH s AS ({S}), x AS (SELECT e.protein AS a, e.signal AS b,
  EXISTS (SELECT 1 FROM s g WHERE g.protein = e.signal AND g.signal = e.protein) AS back FROM s e)
SELECT CASE WHEN a = b THEN 'self' WHEN b NOT IN (SELECT protein FROM s) THEN 'neighbor_missing'
  WHEN back AND b < a THEN 'reciprocal_pruned' ELSE 'scored' END AS status, count(*) AS n FROM x GROUP BY 1""")
def agg2_pair_statuses(spark, d):
    return sji.pair_statuses(b.signals(spark, d))


@query(f"""
WITH s AS ({SJI}), q AS (SELECT p_partkey AS p FROM part WHERE p_size = 1), k AS (SELECT * FROM s WHERE sji > 0.02)
SELECT a AS query, b AS neighbour, sji FROM k WHERE a IN (SELECT p FROM q)
UNION ALL SELECT b, a, sji FROM k WHERE a <> b AND b IN (SELECT p FROM q)""")
def prj3_oriented_edges(spark, d):
    q = b.table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("query"))
    return sji.orient(sji.network(b.signals(spark, d, repeats=True)), q, 0.02)


@query(f"""
WITH s AS ({SJI}), q AS (SELECT p_partkey AS p FROM part WHERE p_size = 1), k AS (SELECT * FROM s WHERE sji > 0.02),
o AS (SELECT a AS query FROM k WHERE a IN (SELECT p FROM q) UNION ALL SELECT b FROM k WHERE a <> b AND b IN (SELECT p FROM q))
SELECT q.p AS query, count(o.query) AS n FROM q LEFT JOIN o ON o.query = q.p GROUP BY 1""")
def agg21_edge_counts(spark, d):
    q = b.table(spark, d, "part").filter("p_size = 1").select(F.col("p_partkey").alias("query"))
    return sji.edge_counts(sji.orient(sji.network(b.signals(spark, d, repeats=True)), q, 0.02), q)


@query(f"""
WITH s AS ({S}) SELECT DISTINCT signal AS id FROM s WHERE signal NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)""")
def join13_signals_outside(spark, d):
    signals = b.signals(spark, d).select(F.col("signal").alias("id"))
    return networks.missing(signals, b.table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("id")), "id")


# -- networks -----------------------------------------------------------------------------------------------


@query(f"SELECT source, node1, node2, weight, node1 || '|' || node2 AS id FROM ({E})")
def agg3_canonical_edges_max(spark, d):
    return networks.with_ids(networks.canonicalize(b.raw_edges(spark, d), "max", ("source",)))


def _dedup(agg: str) -> str:
    return f"""SELECT least('S' || l_suppkey, 'P' || l_partkey) AS node1, greatest('S' || l_suppkey, 'P' || l_partkey) AS node2, {agg} AS weight
FROM (SELECT *, round(l_discount * 100)::BIGINT AS w, l_orderkey * 10 + l_linenumber AS k FROM lineitem) GROUP BY 1, 2"""


@query(_dedup("sum(w)::BIGINT"))
def agg3_canonical_edges_sum(spark, d):
    return networks.canonicalize(b.raw_edges(spark, d), "sum")


@query(_dedup("sum(w)::BIGINT / count(*)"))
def agg3_canonical_edges_mean(spark, d):
    return networks.canonicalize(b.raw_edges(spark, d), "mean")


@query(_dedup("min_by(w, k)"))
def agg3_canonical_edges_first(spark, d):
    return networks.canonicalize(b.raw_edges(spark, d), "first")


@query("""
SELECT l_returnflag || '.csv' AS source, least('S' || l_suppkey, 'P' || l_partkey) AS node1, greatest('S' || l_suppkey, 'P' || l_partkey) AS node2, count(*) AS n
FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def val2_duplicate_edges(spark, d):
    return networks.duplicate_edges(b.raw_edges(spark, d))


@query("SELECT DISTINCT l_returnflag || '.csv' AS source FROM lineitem")
def set2_list_networks(spark, d):
    return networks.list_networks(b.edges(spark, d))


@query(f"""
WITH e AS ({E}), n AS (SELECT source, node1 AS id FROM e UNION SELECT source, node2 FROM e)
SELECT source, (SELECT count(*) FROM n WHERE n.source = e.source) AS nodes, count(*) AS edges, true AS ready FROM e GROUP BY source""")
def agg5_network_counts(spark, d):
    return networks.network_counts(b.edges(spark, d))


@query(f"SELECT source, node1, node2, weight FROM ({E}) WHERE source = 'A.csv'")
def flt1_edges_of_network(spark, d):
    return b.edges(spark, d).filter(F.col("source") == "A.csv")


@query(f"""
WITH e AS ({E}), n AS ({N}) SELECT id, nh_id FROM n WHERE id IN (SELECT 'P' || o_custkey FROM orders)
AND id IN (SELECT node1 FROM e WHERE source = 'R.csv' UNION SELECT node2 FROM e WHERE source = 'R.csv')""")
def flt2_search_accessions(spark, d):
    ids = b.table(spark, d, "orders").select(F.concat(F.lit("P"), F.col("o_custkey").cast("string")).alias("id"))
    return networks.search_ids(b.nodes(spark, d), networks.scoped_nodes(b.edges(spark, d)), "R.csv", ids)


@query(f"""
WITH e AS ({E}), n AS ({N}) SELECT id, taxid, nh_id FROM n WHERE taxid IN ('3', '7', '21')
AND id IN (SELECT node1 FROM e WHERE source = 'N.csv' UNION SELECT node2 FROM e WHERE source = 'N.csv')""")
def flt3_search_species(spark, d):
    return networks.search_taxids(b.nodes(spark, d), networks.scoped_nodes(b.edges(spark, d)), "N.csv", ["3", "7", "21"])


@query(f"""
WITH e AS ({E}), n AS ({N}), m AS (SELECT node1 AS id FROM e WHERE source = 'A.csv' UNION SELECT node2 FROM e WHERE source = 'A.csv')
SELECT m.id, n.taxid, n.nh_id FROM m LEFT JOIN n USING (id)""")
def join3_network_nodes(spark, d):
    return networks.load(b.nodes(spark, d), b.edges(spark, d), "A.csv")[0]


@query(f"""
WITH e AS ({E}), a AS (SELECT node1 AS src, node2 AS dst, weight FROM e WHERE source = 'N.csv' UNION ALL SELECT node2, node1, weight FROM e WHERE source = 'N.csv')
SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS k FROM a) WHERE k <= 5""")
def win2_top_neighbours(spark, d):
    return networks.adjacency(b.edges(spark, d).filter("source = 'N.csv'"), 5)


@query(f"""
WITH e AS ({E}), a AS (SELECT node1 AS src FROM e WHERE source = 'N.csv' UNION ALL SELECT node2 FROM e WHERE source = 'N.csv')
SELECT src, count(*) AS degree FROM a GROUP BY 1""")
def agg14_degrees(spark, d):
    return networks.degrees(networks.adjacency(b.edges(spark, d).filter("source = 'N.csv'")))


@query("""
SELECT name, row_number() OVER (ORDER BY position, name) - 1 AS id FROM (
  SELECT 'P' || l_partkey AS name, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY 1)""")
def win9_dense_ids(spark, d):
    names = b.raw_edges(spark, d).select(F.col("v").alias("name"), F.col("row").alias("position"))
    return networks.dense_ids(names)


@query("""
WITH n AS (SELECT name, row_number() OVER (ORDER BY position, name) - 1 AS id FROM (
  SELECT name, min(position) AS position FROM (SELECT node1 AS name, 0 AS position FROM (%s) UNION ALL SELECT node2, 1 FROM (%s)) GROUP BY 1)), e AS (%s)
SELECT a.id AS src, b.id AS dst, weight FROM e JOIN n a ON a.name = e.node1 JOIN n b ON b.name = e.node2""" % (PE, PE, PE))
def join9_encoded_edges(spark, d):
    e = b.part_edges(spark, d)
    names = e.select(F.col("node1").alias("name"), F.lit(0).alias("position")).union(e.select("node2", F.lit(1)))
    return networks.encode(e, networks.dense_ids(names))


@query("SELECT min(p_partkey) AS least, max(p_partkey) AS most, count(DISTINCT p_partkey) AS ids, min(p_partkey) = 0 AND max(p_partkey) = count(DISTINCT p_partkey) - 1 AS dense FROM part")
def val3_dense_check(spark, d):
    return networks.check_dense(b.table(spark, d, "part").select(F.col("p_partkey").alias("id")))


@query("""
SELECT id, first_at, again_at FROM (SELECT l_partkey AS id, l_orderkey * 10 + l_linenumber AS again_at,
  min(l_orderkey * 10 + l_linenumber) OVER (PARTITION BY l_partkey) AS first_at,
  row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem) WHERE k > 1""")
def val1_duplicate_nodes(spark, d):
    x = b.raw_edges(spark, d).select(F.substring("v", 2, 20).cast("long").alias("id"), F.col("row").alias("line"))
    return networks.duplicate_nodes(x)


@query("""
SELECT l_partkey AS accession, count(DISTINCT l_returnflag) AS n, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS values
FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def val6_conflicts(spark, d):
    x = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("accession"), F.col("l_returnflag").alias("taxid"))
    return networks.conflicts(x)


@query("""
SELECT s_suppkey AS id, s_name AS name FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 4000)
UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 4000""")
def set4_override(spark, d):
    old = b.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    new = b.table(spark, d, "customer").filter("c_acctbal > 4000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return networks.override(old, new, "id")


@query("SELECT l_returnflag, l_linestatus, min(l_orderkey) AS at FROM lineitem GROUP BY 1, 2")
def set7_first_rows(spark, d):
    x = b.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_orderkey").alias("at"))
    return networks.first_rows(x, "at")


@query(f"""
WITH n AS ({N}), a AS (SELECT p_partkey, p_brand FROM part WHERE p_size > 40)
SELECT coalesce(n.id, 'P' || p_partkey) AS id, p_brand AS brand FROM n FULL JOIN a ON n.id = 'P' || p_partkey""")
def dml1_reconcile(spark, d):
    a = b.table(spark, d, "part").filter("p_size > 40").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("brand"))
    return networks.reconcile(b.nodes(spark, d), a)


# -- views, edits, ranges -----------------------------------------------------------------------------------

REP = f"""n AS ({N}), r AS (SELECT id, CASE WHEN nh_id IS NULL OR nh_id = 'Brand#11' THEN id ELSE nh_id END AS rep,
  CASE WHEN nh_id IS NULL OR nh_id = 'Brand#11' THEN 'protein' ELSE 'cluster' END AS kind FROM n WHERE id NOT LIKE '%7')"""


def _view(spark, d):
    n = b.nodes(spark, d)
    return views.view(n, b.edges(spark, d).filter("source = 'N.csv'"), spark.createDataFrame([("Brand#11",)], "nh_id string"), n.filter("id LIKE '%7'"))


@query(f"WITH {REP} SELECT rep AS id, kind, count(*) AS size FROM r GROUP BY 1, 2")
def graph1_view_nodes(spark, d):
    return _view(spark, d)[0]


@query(f"""
WITH {REP}, e AS ({E}), z AS (SELECT rep, count(*) AS size FROM r GROUP BY 1),
t AS (SELECT least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b, sum(weight)::BIGINT AS total
  FROM e JOIN r a ON a.id = node1 JOIN r b ON b.id = node2 WHERE source = 'N.csv' AND a.rep <> b.rep GROUP BY 1, 2)
SELECT a, b, total, x.size * y.size AS pairs, total / (x.size * y.size) AS weight FROM t JOIN z x ON x.rep = a JOIN z y ON y.rep = b""")
def graph1_view_edges(spark, d):
    return _view(spark, d)[1]


@query(f"""
WITH n AS ({N}), e AS ({PE}), z AS (SELECT nh_id, count(*) AS size FROM n GROUP BY 1),
i AS (SELECT a.id AS x, b.id AS y, weight FROM e JOIN n a ON a.id = node1 JOIN n b ON b.id = node2 WHERE a.nh_id = b.nh_id),
t AS (SELECT id, sum(weight)::BIGINT AS total FROM (SELECT x AS id, weight FROM i UNION ALL SELECT y, weight FROM i) GROUP BY 1)
SELECT n.id, coalesce(total, 0) AS total, CASE WHEN n.nh_id IS NOT NULL AND size > 1 THEN coalesce(total, 0) / size ELSE 0 END AS centrality
FROM n LEFT JOIN t USING (id) LEFT JOIN z ON z.nh_id = n.nh_id""")
def agg10_centrality(spark, d):
    n = b.nodes(spark, d)
    sizes = n.groupBy("nh_id").agg(F.count(F.lit(1)).alias("nh_size"))
    return views.centrality(n.join(sizes, "nh_id", "left"), b.part_edges(spark, d))


def _ranges(spark, d):
    x = b.table(spark, d, "orders")
    low = F.floor(F.col("o_totalprice")).cast("long")
    return x.select(F.col("o_orderpriority").alias("source"), low.alias("low"), (low + F.pmod(F.col("o_orderkey"), F.lit(50))).alias("high")).filter("low < high")


@query("""
WITH r AS (SELECT o_orderpriority AS source, floor(o_totalprice)::BIGINT AS low, floor(o_totalprice)::BIGINT + o_orderkey % 50 AS high FROM orders WHERE o_orderkey % 50 > 0),
m AS (SELECT *, max(high) OVER (PARTITION BY source ORDER BY low, high ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR low > reach THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY low, high ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT source, min(low) AS low, max(high) AS high FROM i GROUP BY source, k""")
def win13_merged_ranges(spark, d):
    return intervals.merge(_ranges(spark, d), ("source",))


@query("""
WITH r AS (SELECT o_orderpriority AS source, floor(o_totalprice)::BIGINT AS low, floor(o_totalprice)::BIGINT + o_orderkey % 50 AS high FROM orders WHERE o_orderkey % 50 > 0)
SELECT source, low, high FROM r WHERE high <= 100010 OR low >= 100030
UNION ALL SELECT source, low, least(high, 100010) FROM r WHERE NOT (high <= 100010 OR low >= 100030) AND low < 100010
UNION ALL SELECT source, greatest(low, 100030), high FROM r WHERE NOT (high <= 100010 OR low >= 100030) AND high > 100030""")
def win14_ranges_without(spark, d):
    out = intervals.subtract(_ranges(spark, d), 100010, 100030)
    return out.select("source", F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"))


def _hidden_ranges(spark):
    return spark.createDataFrame([(0, 2), (1, 3), (7, 9)], "low long, high long")


@query(f"SELECT source, node1, node2, weight FROM ({E}) WHERE weight < 3 OR (weight >= 7 AND weight < 9)")
def flt5_hidden_by_range(spark, d):
    return intervals.hidden(b.edges(spark, d), _hidden_ranges(spark))


@query(f"""
SELECT source, node1, node2, weight, CASE WHEN weight BETWEEN 4 AND 6 THEN 'green' WHEN weight BETWEEN 0 AND 5 THEN 'red' END AS color FROM ({E})""")
def flt9_edge_highlight(spark, d):
    layers = spark.createDataFrame([(1, 0, 5, "red"), (2, 4, 6, "green")], "layer int, low long, high long, color string")
    return intervals.highlight(b.edges(spark, d), layers)


def _edit(spark, d):
    e = networks.with_ids(b.edges(spark, d).filter("source = 'A.csv'"))
    n = networks.scoped_nodes(e).select("id")
    few = e.filter("weight = 5").select("id")
    return n, e, editing.Edit(n.filter("id LIKE 'P%1'"), few, _hidden_ranges(spark))


@query(f"""
SELECT source, node1, node2, weight, node1 || '|' || node2 AS id FROM ({E})
WHERE source = 'A.csv' AND NOT (weight < 3 OR (weight >= 7 AND weight < 9)) AND weight <> 5 AND NOT (node1 LIKE 'P%1' OR node2 LIKE 'P%1')""")
def flt6_visible_edges(spark, d):
    _, e, edit = _edit(spark, d)
    return editing.visible_edges(e, edit)


@query(f"""
WITH e AS (SELECT * FROM ({E}) WHERE source = 'A.csv'), n AS (SELECT node1 AS id FROM e UNION SELECT node2 FROM e)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE id LIKE 'P%1') AS hidden_nodes, count(*) AS edges,
  count(*) FILTER (NOT (weight < 3 OR (weight >= 7 AND weight < 9)) AND weight <> 5 AND NOT (node1 LIKE 'P%1' OR node2 LIKE 'P%1')) AS visible_edges FROM e""")
def agg19_edit_statistics(spark, d):
    return editing.statistics(*_edit(spark, d))


@query(f"SELECT node1 || '|' || node2 AS id FROM ({E}) WHERE source = 'A.csv' AND weight = 5")
def dml8_edit_payload(spark, d):
    _, e, edit = _edit(spark, d)
    return editing.payload(e, edit)


@query(f"""
WITH n AS ({N}), m AS (SELECT n.id, nh_id, 1 AS layer, 'red' AS color FROM n WHERE taxid = '3' UNION ALL SELECT n.id, nh_id, 2, 'blue' FROM n WHERE taxid IN ('3', '4')),
s AS (SELECT CASE WHEN nh_id IS NULL OR nh_id = 'Brand#11' THEN id ELSE nh_id END AS id, color, min(layer) AS layer FROM m GROUP BY 1, 2)
SELECT id, list(color ORDER BY layer, color) AS colors FROM s GROUP BY 1""")
def join20_node_highlights(spark, d):
    n = b.nodes(spark, d)
    layer = lambda k, c, t: n.filter(F.col("taxid").isin(t)).select("id", F.lit(k).alias("layer"), F.lit(c).alias("color"))
    return views.derived_highlights(layer(1, "red", ["3"]).union(layer(2, "blue", ["3", "4"])), n, spark.createDataFrame([("Brand#11",)], "nh_id string"))


@query(f"""
WITH n AS ({N}), a AS (SELECT * FROM (VALUES ('P1'), ('P2'), ('Brand#23'), ('S3'), ('none')) t(id))
SELECT id FROM a WHERE id IN (SELECT id FROM n) UNION SELECT n.id FROM n JOIN a ON a.id = n.nh_id""")
def join21_resolved_ids(spark, d):
    return views.resolve(spark.createDataFrame([(x,) for x in ("P1", "P2", "Brand#23", "S3", "none")], "id string"), b.nodes(spark, d))


@query(f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY nh_id ORDER BY id) - 1 AS k FROM ({N}) WHERE nh_id IS NOT NULL)
SELECT nh_id, (k // 5)::BIGINT AS line, string_agg(id, ', ' ORDER BY k) AS ids FROM n GROUP BY 1, 2""")
def win11_export_lines(spark, d):
    return views.export_rows(b.nodes(spark, d))


# -- communities --------------------------------------------------------------------------------------------

METRICS = f"""
WITH e AS ({PE}), p AS (SELECT 'P' || p_partkey AS node, p_brand AS cluster_id FROM part), z AS (SELECT cluster_id, count(*) AS size FROM p GROUP BY 1),
i AS (SELECT a.cluster_id, count(*) AS n, sum(weight)::BIGINT AS w FROM e JOIN p a ON a.node = node1 JOIN p b ON b.node = node2 WHERE a.cluster_id = b.cluster_id GROUP BY 1)
SELECT cluster_id, size, coalesce(n, 0) AS internal_edges, coalesce(w, 0) AS internal_weight_sum, CASE WHEN n > 0 THEN w / n ELSE 0 END AS avg_internal_weight,
  size * (size - 1) // 2 AS max_internal_edges, coalesce(n, 0) / greatest(1, size * (size - 1) // 2) AS internal_density,
  coalesce(w, 0) / greatest(1, size * (size - 1) // 2) AS weighted_density FROM z LEFT JOIN i USING (cluster_id)"""


@query(METRICS)
def agg4_community_metrics(spark, d):
    return communities.metrics(b.part_edges(spark, d), b.partition(spark, d))


@query(f"SELECT cluster_id, size FROM ({METRICS}) WHERE size >= 5 AND weighted_density <= 0.06 AND internal_edges > 0")
def flt13_refine_candidates(spark, d):
    m = communities.metrics(b.part_edges(spark, d), b.partition(spark, d))
    return communities.candidates(m, 5, 0.06).select("cluster_id", "size")


@query(f"""
WITH p AS (SELECT 'P' || p_partkey AS node, p_brand AS cluster_id FROM part), z AS (SELECT cluster_id, count(*) AS nh_size FROM p GROUP BY 1)
SELECT node, p_size::VARCHAR AS taxid, 'net.' || cluster_id AS nh_id, nh_size FROM p JOIN z USING (cluster_id) JOIN part ON node = 'P' || p_partkey""")
def attr1_attributes(spark, d):
    t = b.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("accession"), F.col("p_size").cast("string").alias("taxid"))
    return communities.attributes(b.partition(spark, d), t, "net")


@query("""
SELECT node, cluster_id, row_number() OVER (ORDER BY a, b, node) AS place FROM (
  SELECT p_partkey AS node, p_size || '.' || (p_partkey % 12) AS cluster_id, p_size AS a, p_partkey % 12 AS b FROM part)""")
def srt2_natural_order(spark, d):
    p = b.table(spark, d, "part").select(F.col("p_partkey").alias("node"), F.concat_ws(".", F.col("p_size").cast("string"), (F.col("p_partkey") % 12).cast("string")).alias("cluster_id"))
    return p.withColumn("place", F.row_number().over(Window.orderBy(fn.dotted_key(F.col("cluster_id")), "node")).cast("long"))


@query(f"""
WITH RECURSIVE e AS (SELECT node1 AS a, node2 AS b FROM ({PE}) WHERE weight >= 2), s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, a AS seen FROM s UNION SELECT r.node, s.b FROM r JOIN s ON s.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY 1""")
def graph3_components(spark, d):
    return components.connected_components(b.part_edges(spark, d).filter("weight >= 2"))


@query()
def graph11_communities(spark, d):
    return communities.communities(b.part_edges(spark, d))


@query()
def graph12_refined_communities(spark, d):
    return communities.refine(b.part_edges(spark, d), b.partition(spark, d), min_nodes=5, density=0.5)[0]


@query(f"""
WITH p AS (SELECT 'P' || p_partkey AS node, p_partkey // 2 AS c FROM part), e AS ({PE}),
m AS (SELECT c, count(*) AS size FROM p GROUP BY 1), i AS (SELECT a.c, sum(weight)::DOUBLE AS w FROM e JOIN p a ON a.node = node1 JOIN p b ON b.node = node2 WHERE a.c = b.c GROUP BY 1),
x AS (SELECT c FROM m LEFT JOIN i USING (c) WHERE size = 2 AND coalesce(w, 0) < 0.5)
SELECT node, CASE WHEN p.c IN (SELECT c FROM x) THEN p.c || '.' || (row_number() OVER (PARTITION BY p.c ORDER BY node) - 1) ELSE p.c::VARCHAR END AS cluster_id FROM p""")
def graph13_weak_pairs(spark, d):
    p = b.table(spark, d, "part").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("node"), F.floor(F.col("p_partkey") / 2).cast("string").alias("cluster_id"))
    return communities.weak_pairs(p, communities.metrics(b.part_edges(spark, d), p), 0.5)[0]


# -- paths and extraction -----------------------------------------------------------------------------------


@query(f"""
WITH RECURSIVE s AS (SELECT node1 AS a, node2 AS b FROM ({PE}) UNION SELECT node2, node1 FROM ({PE})),
r AS (SELECT 'P1' AS id, 0 AS hop UNION SELECT s.b, r.hop + 1 FROM r JOIN s ON s.a = r.id WHERE r.hop < 2)
SELECT id, min(hop) AS hop FROM r GROUP BY 1""")
def graph4_reach(spark, d):
    return extraction.reach(networks.adjacency(b.part_edges(spark, d)), spark.createDataFrame([("P1",)], "id string"), 2)


@query(f"""
WITH s AS (SELECT node1 AS a, node2 AS b, weight FROM ({PE}) UNION ALL SELECT node2, node1, weight FROM ({PE})),
o AS (SELECT 'P1' AS id, 'P1' AS seed UNION ALL SELECT 'P2', 'P2' UNION ALL SELECT 'P3', 'P1'),
m AS (SELECT s.b AS id, seed, max(weight) AS best FROM s JOIN o ON o.id = s.a WHERE s.b NOT IN (SELECT id FROM o) GROUP BY 1, 2)
SELECT id, count(*) AS seeds, sum(best)::BIGINT AS score FROM m GROUP BY 1""")
def agg22_candidate_scores(spark, d):
    owners = spark.createDataFrame([("P1", "P1"), ("P2", "P2"), ("P3", "P1")], "id string, seed string")
    return extraction.candidate_scores(networks.adjacency(b.part_edges(spark, d)), owners)


@query(f"SELECT node1, node2, weight FROM ({PE.replace('SELECT', 'SELECT', 1)}) WHERE node1 IN (SELECT 'P' || p_partkey FROM part WHERE p_size <= 20) AND node2 IN (SELECT 'P' || p_partkey FROM part WHERE p_size <= 20)".replace("node1, node2, weight", "least(node1, node2) AS node1, greatest(node1, node2) AS node2, weight", 1))
def graph8_induced(spark, d):
    ids = b.table(spark, d, "part").filter("p_size <= 20").select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"))
    return extraction.induced(networks.adjacency(b.part_edges(spark, d)), ids)


@query()
def graph7_extract(spark, d):
    return extraction.extract(networks.adjacency(b.part_edges(spark, d)), ["P1", "P2", "P3"], max_nodes=60)[0]


# -- hits, points, signals ----------------------------------------------------------------------------------


@query(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, t, query_id ORDER BY score DESC, line) AS rank FROM ({H})) WHERE rank <= 3")
def win1_top_hits(spark, d):
    return ranking.top_hits(b.hits(spark, d), 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""
SELECT q, query_id, hit_id, greatest(query_len, hit_len) / least(query_len, hit_len) AS x, score AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY q, t, query_id ORDER BY score DESC, line) AS rank FROM ({H})) WHERE rank <= 5""")
def alg6_make_2d(spark, d):
    return ranking.make_2d(b.hits(spark, d), 5)


@query(f"""
WITH x AS (SELECT query_id AS query, hit_id AS target, max(floor(score / 1000)) AS score FROM ({H}) GROUP BY 1, 2),
r AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY score DESC) AS r, row_number() OVER (PARTITION BY query ORDER BY score DESC, target) AS k FROM x)
SELECT query, target, score::BIGINT AS score FROM r WHERE r <= 6 AND k <= 5""")
def win4_prefilter_rank(spark, d):
    x = b.hits(spark, d).groupBy(F.col("query_id").alias("query"), F.col("hit_id").alias("target")).agg(F.max(F.floor(F.col("score") / 1000)).alias("score"))
    return ranking.prefilter_keep(x, 3)


@query(f"""
SELECT query_id, hit_id, x, y FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY y, hit_id) AS k FROM ({P}))
WHERE k > floor(n * 0.25)""")
def win6_trim_lowest(spark, d):
    return ranking.trim_lowest(b.points(spark, d))


@query(f"""
WITH p AS ({P}), m AS (SELECT query_id, median(x) AS median_x, median(y) AS median_y FROM p GROUP BY 1)
SELECT query_id, median_x, median_y, median(abs(x - median_x)) AS mad_x, median(abs(y - median_y)) AS mad_y FROM p JOIN m USING (query_id) GROUP BY ALL""")
def agg17_robust_scale(spark, d):
    return signal_calls.robust_scale(b.points(spark, d))


@query(f"""
WITH p AS ({P}), m AS (SELECT query_id, median(y) AS m FROM p GROUP BY 1), s AS (SELECT query_id, m, median(abs(y - m)) AS s FROM p JOIN m USING (query_id) GROUP BY ALL)
SELECT query_id, hit_id, x, y FROM p JOIN s USING (query_id) WHERE y > m + 1.0::DOUBLE * 1.4826::DOUBLE * greatest(s, 1e-12)""")
def son6_outliers(spark, d):
    return signal_calls.outliers(b.points(spark, d), 1.0)


@query(f"""
WITH p AS ({P}), s AS (SELECT *, hit_id % 7 = 0 AS signal FROM p)
SELECT query_id, hit_id, NOT signal AND EXISTS (SELECT 1 FROM s t WHERE t.query_id = s.query_id AND t.signal AND t.x > s.x AND t.y < s.y) AS promoted FROM s""")
def join18_dominators(spark, d):
    x = b.points(spark, d).withColumn("signal", F.col("hit_id") % 7 == 0)
    return signal_calls.dominators(x).select("query_id", "hit_id", "promoted")


@query(f"""
WITH p AS ({P}), c AS (SELECT query_id, hit_id % 3 AS label, count(*) AS n, sum(x)::BIGINT / count(*) AS cx FROM p GROUP BY 1, 2)
SELECT query_id, label, n, cx, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, label) = 1 AS noise FROM c""")
def agg18_centroids(spark, d):
    x = b.points(spark, d).withColumn("label", F.col("hit_id") % 3)
    return signal_calls.centroids(x, ("query_id",), "label").drop("cy")


@query(f"""
WITH p AS ({P}), c AS (SELECT query_id, hit_id, sqrt((x - 1) * (x - 1) + (y - 1000 - 100) * (y - 1000 - 100)) AS d FROM p)
SELECT query_id, arg_min(hit_id, (d, hit_id)) AS hit_id FROM c GROUP BY 1 HAVING min(d) <= 500""")
def son10_self_hits(spark, d):
    x = b.points(spark, d).withColumn("y", F.col("y") - 1000)
    return signal_calls.self_hits(x, 500.0)


@query()
def son13_signal_calls(spark, d):
    return signal_calls.call_signals(b.points(spark, d))


def _sequences(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.regexp_replace(F.upper("p_name"), "[^A-Z]", "").alias("seq"))


@query()
def alg4_top_targets(spark, d):
    """Queries of one sequence have the same targets: one of them is asked against the whole table."""
    seqs = _sequences(spark, d)
    asked = seqs.groupBy("seq").agg(F.min("id").alias("id"))
    top = alignment.top_targets(asked, seqs, alignment.simple_matrix(), 5)
    each = seqs.join(asked.withColumnRenamed("id", "query"), "seq").select("id", "query")
    return top.join(each, "query").select(F.col("id").alias("query"), "target", "similarity", "rank")


@query("""
WITH p AS (SELECT regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS s, min(p_partkey) AS id, count(*) AS n_rows FROM part GROUP BY 1),
g AS (SELECT id, n, n_rows, substr(s, i, 2) AS g, i FROM (SELECT id, n_rows, s, length(s) AS n, unnest(range(1, length(s))) AS i FROM p)),
v AS (SELECT a.id AS query, b.id AS target, a.n_rows AS queries, b.n_rows AS targets, b.i - a.i AS diagonal, count(*) AS votes FROM g a JOIN g b ON a.g = b.g
  WHERE greatest(a.n, b.n) <= least(a.n, b.n) * 1.5::DOUBLE GROUP BY 1, 2, 3, 4, 5)
SELECT query, target, queries, targets, diagonal, votes FROM (SELECT *, row_number() OVER (PARTITION BY query, target ORDER BY votes DESC, abs(diagonal), diagonal DESC) AS k FROM v) WHERE k = 1""")
def alg1_diagonals(spark, d):
    """Pairs of the distinct sequences of the whole table, with the number of rows that have each."""
    one = _sequences(spark, d).groupBy("seq").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("rows"))
    x = alignment.diagonals(one, one).withColumn("diagonal", F.col("diagonal").cast("long"))
    x = x.join(one.select(F.col("id").alias("query"), F.col("rows").alias("queries")), "query").join(one.select(F.col("id").alias("target"), F.col("rows").alias("targets")), "target")
    return x.select("query", "target", "queries", "targets", "diagonal", "votes")


GRAMS = """s AS (SELECT p_partkey AS id, p_type AS set, regexp_replace(upper(p_name), '[^A-Z]', '', 'g') AS s FROM part),
g AS (SELECT id, set, n, substr(s, i, 2) AS g, i FROM (SELECT id, set, s, length(s) AS n, unnest(range(1, length(s))) AS i FROM s)),
v AS (SELECT a.id AS query, b.id AS target, b.set AS target_set, b.i - a.i AS diagonal, count(*) AS votes FROM g a JOIN g b ON a.g = b.g
  WHERE a.id % 50 = 0 AND greatest(a.n, b.n) <= least(a.n, b.n) * 1.5::DOUBLE GROUP BY 1, 2, 3, 4),
d AS (SELECT query, target, target_set, diagonal, votes FROM (SELECT *, row_number() OVER (PARTITION BY query, target ORDER BY votes DESC, abs(diagonal), diagonal DESC) AS k FROM v) WHERE k = 1)"""


def _sets(spark, d):
    """set, id, seq: parts by type."""
    return b.table(spark, d, "part").select(F.col("p_type").alias("set"), F.col("p_partkey").alias("id"), F.col("p_name").alias("seq"))


@query(f"WITH {GRAMS} SELECT query, target, diagonal, votes FROM d")
def alg1_searched_diagonals(spark, d):
    """Every fiftieth part against all rows."""
    seqs = _sets(spark, d)
    return alignment.diagonals(seqs.filter("id % 50 = 0"), seqs)


@query(f"""WITH {GRAMS},
e AS (SELECT query, target, target_set, diagonal, unnest(range(1, length(q.s) + 1)) AS i, q.s AS q, t.s AS t FROM d JOIN s q ON q.id = query JOIN s t ON t.id = target),
m AS (SELECT query, target, target_set, count(*) FILTER (i + diagonal BETWEEN 1 AND length(t) AND substr(q, i, 1) = substr(t, i + diagonal, 1)) / least(length(any_value(q)), length(any_value(t))) AS score
  FROM e GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY query, target_set ORDER BY score DESC) AS r, row_number() OVER (PARTITION BY query, target_set ORDER BY score DESC, target) AS k FROM m WHERE score >= 0.05)
SELECT query, target, target_set, score FROM r WHERE r <= 9 AND k <= 8""")
def alg5_reference_candidates(spark, d):
    """Every fiftieth part against the parts of each type by a stored index: the candidates of the best five. Queries of one
    sequence have the same candidates: one of them is asked."""
    seqs, path = _sets(spark, d), shared_dir(spark, "reference")
    kmer_index.store_index(kmer_index.build_index(alignment.least_copies(seqs, 5)), path)
    held = alignment.copies(seqs.filter("id % 50 = 0"))
    asked = kmer_index.build_index(held.select(F.col("number").alias("id"), "seq").distinct())
    found = alignment.prefilter_sets(asked, kmer_index.stored_index(spark, path), alignment.simple_matrix(), 5, 2, 1.5, 0.05)
    each = held.select(F.col("number").alias("one"), F.explode("ids").alias("query"))
    return found.withColumnRenamed("query", "one").join(each, "one").select("query", "target", "target_set", "score")


@query()
def alg1_diagonals_whole(spark, d):
    """All pairs of the whole table; no SQL, which takes too long. Each pair of sequences is worked out once."""
    seqs = _sequences(spark, d)
    return alignment.diagonals(seqs, seqs).select("query", "target", F.col("diagonal").cast("long").alias("diagonal"), "votes")


# -- taxonomy -----------------------------------------------------------------------------------------------

PATHS = f"""RECURSIVE t AS ({T}), a AS (SELECT node, node AS ancestor, 0 AS steps FROM t UNION ALL SELECT a.node, t.parent, steps + 1 FROM a JOIN t ON t.node = a.ancestor WHERE t.parent IS NOT NULL)"""


@query(f"WITH {PATHS} SELECT node, ancestor, steps FROM a")
def graph18_tree_paths(spark, d):
    return taxonomy.paths(b.taxa(spark, d))


@query(f"WITH {PATHS}, m AS (SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_acctbal > 5000) SELECT ancestor AS node, count(m.node) AS n FROM a LEFT JOIN m USING (node) GROUP BY 1")
def agg12_subtree_counts(spark, d):
    marked = b.table(spark, d, "supplier").filter("s_acctbal > 5000").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node"))
    return taxonomy.subtree_counts(taxonomy.paths(b.taxa(spark, d)), marked)


@query(f"""
WITH {PATHS}, m AS (SELECT 'S' || s_suppkey AS node FROM supplier WHERE s_nationkey < 12), l AS (SELECT 'S' || s_suppkey AS node FROM supplier)
SELECT ancestor AS node, CASE WHEN count(m.node) = 0 THEN 0 WHEN count(m.node) = count(l.node) THEN 2 ELSE 1 END AS state
FROM a LEFT JOIN m USING (node) LEFT JOIN l USING (node) GROUP BY 1""")
def agg13_tri_state(spark, d):
    s = b.table(spark, d, "supplier")
    node = F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node")
    return taxonomy.tri_state(taxonomy.paths(b.taxa(spark, d)), s.select(node), s.filter("s_nationkey < 12").select(node))


@query(f"""
WITH {PATHS}, h AS (SELECT node FROM t WHERE contains(lower(name), 'ric')), s AS (SELECT DISTINCT ancestor AS node FROM a WHERE node IN (SELECT node FROM h))
SELECT node, node IN (SELECT node FROM h) AS matched FROM s""")
def flt16_name_filter(spark, d):
    t = b.taxa(spark, d)
    return taxonomy.filter_names(t, taxonomy.paths(t), "RIC")


@query(f"""
WITH t AS ({T}), n AS (SELECT n_nationkey AS line, 'x' || n_nationkey AS taxid, upper(n_name) AS name FROM nation UNION ALL SELECT 100 + n_nationkey, 'y' || n_nationkey, lower(n_name) FROM nation WHERE n_nationkey < 5),
l AS (SELECT lower(name) AS key, arg_max(taxid, line) AS taxid FROM n GROUP BY 1)
SELECT node, parent, name, l.taxid, coalesce(l.taxid IN ('x7', 'y2'), false) AS is_db FROM t LEFT JOIN l ON l.key = lower(name)""")
def join11_annotated_tree(spark, d):
    n = b.table(spark, d, "nation")
    k = F.col("n_nationkey")
    names = n.select(k.alias("line"), F.concat(F.lit("x"), k.cast("string")).alias("taxid"), F.upper("n_name").alias("name"))
    names = names.union(n.filter("n_nationkey < 5").select(k + 100, F.concat(F.lit("y"), k.cast("string")), F.lower("n_name")))
    return taxonomy.annotate(b.taxa(spark, d), names, spark.createDataFrame([("x7",), ("y2",)], "taxid string")).select("node", "parent", "name", "taxid", "is_db")


# -- scalar functions ---------------------------------------------------------------------------------------


@query("SELECT event_id, event_type, (props::JSON->>'$.k')::BIGINT AS k FROM events")
def fn6_json_extract(spark, d):
    return b.table(spark, d, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""
SELECT p_partkey AS id, list_filter(string_split_regex(p_name || ', ' || p_brand || ';' || p_type, '[\\s,;]+'), lambda x: x <> '') AS tokens,
  regexp_replace(p_brand, '[^A-Za-z0-9._-]', '_', 'g') AS safe, greatest(p_size, 7) / least(p_size, 7) AS ratio FROM part""")
def fn4_text_functions(spark, d):
    p = b.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("id"), fn.tokens(F.concat_ws(";", F.concat_ws(", ", "p_name", "p_brand"), "p_type")).alias("tokens"), fn.safe_name(F.col("p_brand")).alias("safe"), fn.length_ratio(F.col("p_size"), F.lit(7)).alias("ratio"))
