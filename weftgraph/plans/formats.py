"""Queries of readers, writers, checks, small functions and the catalog. Files are written from whole tables into
the shared folder and read back; the SQL says what must come back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import columns as fn
from ..functions import validation
from ..operators import alignment, communities, editing, networks, signal_calls, sji, views
from ..session import ship
from ..shared import TASK_ROWS, shared_dir, stage, tasks
from ..sources import adjacency, readers, writers
from ..streaming import reload
from . import bindings as b
from .catalogue import SJI, E, H, N, P, PE, query

PER_FILE = 100_000  # lines of a file that a reader takes whole


def _text(df: DataFrame, name: str, per_file: int = PER_FILE, **options) -> str:
    path = shared_dir(df.sparkSession, name)
    df.write.options(**options).option("maxRecordsPerFile", per_file).text(path)
    return path


def _csv(df: DataFrame, name: str, header: bool = False, per_file: int = PER_FILE, sep: str = ",") -> str:
    path = shared_dir(df.sparkSession, name)
    df.write.option("maxRecordsPerFile", per_file).csv(path, header=header, sep=sep)
    return path


def _line(*cells) -> DataFrame:
    return F.concat_ws("", *[F.lit(c) if isinstance(c, str) else c.cast("string") for c in cells]).alias("value")


# -- readers ------------------------------------------------------------------------------------------------


@query("SELECT 'S' || l_suppkey AS node1, 'P' || l_partkey AS node2, l_discount AS weight FROM lineitem")
def src1_network_lines(spark, d):
    x = b.table(spark, d, "lineitem")
    odd = F.lit("\n  \nonly,two\n")  # blank and short lines are skipped
    path = _text(x.select(_line(" S", F.col("l_suppkey"), " ,P", F.col("l_partkey"), ", ", F.col("l_discount"), ",more", F.when(F.col("l_linenumber") == 1, odd).otherwise(""))), "network")
    return readers.network(spark, path).select("node1", "node2", "weight")


@query("SELECT 'S' || s_suppkey AS id, s_nationkey::VARCHAR AS taxid, NULLIF(CASE WHEN s_acctbal > 0 THEN 'c1' ELSE '' END, '') AS nh_id, '7' AS nh_size FROM supplier")
def src2_node_attributes(spark, d):
    x = b.table(spark, d, "supplier")
    rest = [F.lit("").alias(f"c{i}") for i in range(5)]
    own = x.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("node_id"), F.col("s_nationkey").alias("NCBI_txID"), F.when(F.col("s_acctbal") > 0, "c1").alias("NH_ID"), F.lit(7).alias("NH_Size"), *rest)
    return readers.node_attributes(spark, _csv(own, "attributes", header=True)).select("id", "taxid", "nh_id", "nh_size")


@query("SELECT min(n_name) AS first FROM nation")
def src3_first_line(spark, d):
    path = _text(b.table(spark, d, "nation").select(F.col("n_name").alias("value")).coalesce(1).sortWithinPartitions("value"), "lines")
    return spark.createDataFrame([(readers.first_line(spark, readers.one_file(spark, path, "*.txt")),)], "first string")


@query("SELECT 'one' AS found, count(*) AS n FROM region UNION ALL SELECT 'none refused', 0 UNION ALL SELECT 'several refused', 0")
def src4_one_file(spark, d):
    x = b.table(spark, d, "region").select(F.col("r_name").alias("value"))
    one, several = _text(x.coalesce(1), "one"), _text(x.coalesce(1), "several", per_file=1)
    out = [("one", spark.read.text(readers.one_file(spark, one, "*.txt")).count())]
    for name, folder, pattern in (("none refused", one, "*.csv"), ("several refused", several, "*.txt")):
        try:
            readers.one_file(spark, folder, pattern)
        except ValueError:
            out.append((name, 0))
    return spark.createDataFrame(out, "found string, n long")


@query("SELECT n_nationkey::VARCHAR AS taxid, n_name AS name FROM nation WHERE n_regionkey <> 2")
def src5_taxon_names(spark, d):
    x = b.table(spark, d, "nation").select(F.when(F.col("n_regionkey") != 2, F.col("n_name")).alias("name_txt"), F.lit("x").alias("other"), F.col("n_nationkey").alias("tax_id"))
    return readers.taxon_names(spark, _csv(x, "taxa", header=True)).select("taxid", "name")


@query("SELECT n_nationkey::VARCHAR AS ncbi_txid, n_name AS species_name FROM nation UNION ALL SELECT 'ncbi_txid', 'species_name'")
def src6_species_with_header_row(spark, d):
    x = b.table(spark, d, "nation").select(F.col("n_nationkey").alias("ncbi_txid"), F.col("n_name").alias("species_name"))
    return readers.species(spark, _csv(x.coalesce(1), "species", header=True))


_SEQ = "regexp_replace(upper(p_name || '1' || p_type), '[^ABCDEFGHIKLMNPQRSTVWXYZ]', '', 'g')"


@query(f"SELECT CASE WHEN p_size < 20 THEN 'P' || p_partkey ELSE 'gb|P' || p_partkey END AS name, {_SEQ} AS seq FROM part")
def src8_fasta(spark, d):
    x = b.table(spark, d, "part")
    head = F.when(F.col("p_size") < 20, _line("sp|P", F.col("p_partkey"), "|", F.col("p_brand"))).otherwise(_line("gb|P", F.col("p_partkey"), "\tmore"))
    path = _text(x.select(_line(">", head, " part\n", F.col("p_name"), "1\n", F.col("p_type"))), "fasta")
    return readers.check_sequences(readers.fasta(spark, path)).select("name", "seq")


@query("SELECT p_partkey AS id, CASE WHEN p_size < 20 THEN 'A' || p_partkey ELSE 'one|two' || p_partkey END AS accession FROM part")
def src9_accessions(spark, d):
    x = b.table(spark, d, "part")
    head = F.when(F.col("p_size") < 20, _line("tr|A", F.col("p_partkey"), "|x y z")).otherwise(_line("  one|two", F.col("p_partkey"), " z"))
    return x.select(F.col("p_partkey").alias("id"), readers.fasta_accession(head).alias("accession"))


@query("SELECT p_partkey AS id, substr(repeat('n', p_size) || p_partkey || repeat('x', 40), 1, 64) AS name FROM part")
def src10_fasta_names(spark, d):
    x = b.table(spark, d, "part")
    return x.select(F.col("p_partkey").alias("id"), readers.fasta_name(_line(F.repeat(F.lit("n"), F.col("p_size").cast("int")), F.col("p_partkey"), "x" * 40, "\tmore text")).alias("name"))


FLAGS = """s AS (SELECT l_returnflag AS a, ['A', 'N', 'R'][l_linenumber % 3 + 1] AS b, (count(*) % 20 - 5)::INTEGER AS score FROM lineitem GROUP BY ALL)"""


def _flag_matrix(spark, d) -> str:
    """A matrix text of three symbols: how often return flags meet places of a line, folded to small scores."""
    x = b.table(spark, d, "lineitem").withColumn("b", F.element_at(F.array(*map(F.lit, "ANR")), (F.col("l_linenumber") % 3 + 1).cast("int")))
    n = {(r["l_returnflag"], r["b"]): r["count"] % 20 - 5 for r in x.groupBy("l_returnflag", "b").count().collect()}  # nine rows
    return "# of lineitem\n\n  A N R\n" + "\n".join(" ".join([p, *(str(n.get((p, q), -5)) for q in "ANR")]) for p in "ANR")


@query(f"WITH {FLAGS} SELECT a, b, score FROM s")
def src11_matrix(spark, d):
    symbols, scores = alignment.parse_matrix(_flag_matrix(spark, d))
    return spark.createDataFrame([(x, y, int(scores[i, j])) for i, x in enumerate(symbols) for j, y in enumerate(symbols)], "a string, b string, score int")


@query(f"""
WITH {FLAGS}, m AS (SELECT min(score) AS low, greatest(1, max(score) - min(score)) AS wide FROM s), n AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE (score - low) / wide::DOUBLE END AS v FROM s, m)
SELECT a, b, v AS similar, 100 - floor(v * 100 + 0.5)::BIGINT AS cost FROM n""")
def alg2_similarity_table(spark, d):
    m = alignment.make_matrix(*alignment.parse_matrix(_flag_matrix(spark, d)))
    at = lambda x: ord(x) - 65
    return spark.createDataFrame([(x, y, float(m.similar[at(x), at(y)]), int(m.cost[at(x), at(y)])) for x in "ANR" for y in "ANR"], "a string, b string, similar double, cost long")


@query(f"SELECT query_id::VARCHAR AS query_id, query_len::INTEGER AS query_len, hit_id::VARCHAR AS hit_id, score, hit_len::INTEGER AS hit_len FROM ({H})")
def src12_hit_files(spark, d):
    x = b.hits(spark, d).select(*[F.col(c).alias(name) for c, name in zip(("query_id", "query_len", "hit_id", "score", "hit_len"), readers.HIT_HEADER, strict=True)])
    good, bad = readers.hits(spark, _csv(x, "hits", header=True))
    return good.select("query_id", "query_len", "hit_id", "score", "hit_len").union(bad.select("file", "line", F.lit("bad"), F.lit(0.0), F.lit(0)))


@query("SELECT p_partkey::VARCHAR AS hit_id, p_size::DOUBLE AS x, p_retailprice AS y FROM part")
def src14_point_lines(spark, d):
    x = b.table(spark, d, "part")
    sep = F.when(F.col("p_size") < 15, "\t").when(F.col("p_size") < 30, ",").otherwise("  ")
    head = F.when(F.col("p_size") == 3, "name x y\n").otherwise("")  # a header is no point
    return readers.points(spark, _text(x.select(_line(head, F.col("p_partkey"), sep, F.col("p_size"), sep, F.col("p_retailprice"))), "points")).select("hit_id", "x", "y")


@query("SELECT 'NA' || l_suppkey AS node1, 'P' || l_partkey AS node2, l_tax::FLOAT::DOUBLE AS weight FROM lineitem")
def src16_edge_list(spark, d):
    x = b.table(spark, d, "lineitem").select(F.concat(F.lit("NA"), F.col("l_suppkey").cast("string")), F.concat(F.lit("P"), F.col("l_partkey").cast("string")), "l_tax", F.lit("x"))
    return readers.edge_list(spark, _csv(x, "edges", sep="\t")).select("node1", "node2", F.col("weight").cast("double").alias("weight"))


@query("SELECT l_suppkey AS src, l_partkey AS dst, l_tax::FLOAT::DOUBLE AS weight FROM lineitem")
def src18_integer_edges(spark, d):
    x = b.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_tax")
    return readers.integer_edges(spark, _csv(x, "integers")).select("src", "dst", F.col("weight").cast("double").alias("weight"))


@query("SELECT 'P' || p_partkey AS node, p_brand AS cluster_id FROM part")
def src19_partition_file(spark, d):
    return readers.partition(spark, _csv(b.partition(spark, d), "partition"))


@query("SELECT p_brand AS cluster_id, count(*) AS size, 0::BIGINT AS internal_edges, sum(p_size)::DOUBLE AS internal_weight_sum, sum(p_size) / 5::DOUBLE AS weighted_density FROM part GROUP BY 1")
def src20_metrics_file(spark, d):
    x = b.table(spark, d, "part").groupBy(F.col("p_brand").alias("community")).agg(F.count(F.lit(1)).alias("size"), F.sum("p_size").alias("internal_weight_sum"), F.lit(5).alias("max_internal_edges"))
    return readers.metrics(spark, _csv(x, "metrics", header=True)).select("cluster_id", "size", "internal_edges", "internal_weight_sum", "weighted_density")


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def src21_mapping_file(spark, d):
    return readers.mapping(spark, _csv(b.table(spark, d, "supplier").select("s_suppkey", "s_name"), "mapping"))


@query("SELECT p_brand || '.2' AS cluster_id FROM part WHERE false UNION ALL SELECT DISTINCT p_size || CASE WHEN p_size < 20 THEN '.3' ELSE '' END FROM part WHERE p_size < 40")
def src24_numeric_clusters(spark, d):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") < 20, F.concat(size, F.lit(".3"))).when(F.col("p_size") < 40, size).otherwise(F.concat(size, F.lit(".x")))
    return readers.numeric_clusters(b.table(spark, d, "part").select(name.alias("cluster_id")).distinct())


@query("SELECT n_regionkey || ':' || n_name AS text FROM nation")
def src25_folders_below(spark, d):
    x = b.table(spark, d, "nation").select(F.col("n_regionkey").alias("region"), _line(F.col("n_regionkey"), ":", F.col("n_name")))
    path = shared_dir(spark, "below")
    x.write.partitionBy("region").text(path)
    return readers.lines(spark, path, recursive=True).select("text")


@query("SELECT DISTINCT upper(l_returnflag || l_linestatus) AS id FROM lineitem")
def src26_id_list(spark, d):
    x = b.table(spark, d, "lineitem").select(_line("  ", F.lower("l_returnflag"), F.lower("l_linestatus"), " a comment\n# none\n"))
    return readers.id_list(spark, _text(x, "ids")).select("id").distinct()


def _empty_files(files: DataFrame, name: str) -> str:
    """A folder with an empty file for each name of `files`, made by the tasks that hold the names."""
    spark = files.sparkSession
    path = shared_dir(spark, name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(folder)

    def create(batches):
        to, at = adjacency.store(path)
        for x in batches:
            for n in x["file"]:
                to.open_output_stream(f"{at}/{n}").close()
            yield pd.DataFrame({"made": [len(x)]})

    ship(spark)
    files.select(F.col(files.columns[0]).alias("file")).mapInPandas(create, "made long").agg(F.sum("made")).collect()
    return path


@query("SELECT 'net.' || s_suppkey AS prefix FROM supplier WHERE s_nationkey % 3 = 0 AND s_acctbal > 0")
def src23_complete_indexes(spark, d):
    """A supplier's files: the offsets are missing for most nations, the names for those in debt."""
    kinds = [F.lit(".adj.bin"), F.when(F.col("s_nationkey") % 3 == 0, ".adj.index.bin"), F.when(F.col("s_acctbal") > 0, ".node_ids.tsv")]
    x = b.table(spark, d, "supplier").select("s_suppkey", F.explode(F.array_compact(F.array(*kinds))).alias("kind"))
    files = x.select(F.concat(F.lit("net."), F.col("s_suppkey").cast("string"), "kind").alias("file")).repartition(tasks(spark, x.count(), 20_000))
    return readers.complete_indexes(spark, _empty_files(files, "indexes"))


@query("SELECT name FROM (SELECT CASE WHEN n_nationkey % 2 = 0 THEN upper(n_name) ELSE lower(n_name) END || '.csv' AS name, n_name FROM nation) ORDER BY lower(name), name LIMIT 7")
def srt8_first_files(spark, d):
    names = b.table(spark, d, "nation").select(F.concat(F.when(F.col("n_nationkey") % 2 == 0, F.upper("n_name")).otherwise(F.lower("n_name")), F.lit(".csv")).alias("n"))
    path = _empty_files(names, "some")
    return spark.createDataFrame([(n,) for n in readers.first_files(spark, path, 7)], "name string")


# -- writers ------------------------------------------------------------------------------------------------


@query(f"SELECT source, node1, node2, weight FROM ({E}) WHERE source <> 'A.csv' OR weight >= 5")
def snk1_replaced_network(spark, d):
    path = shared_dir(spark, "replaced")
    e = b.edges(spark, d)
    writers.replace_sources(e, path)
    writers.replace_sources(e.filter("source = 'A.csv' AND weight >= 5"), path)
    return spark.read.parquet(path).select("source", "node1", "node2", "weight")


@query(f"SELECT id, taxid FROM ({N}) UNION ALL SELECT 'C' || c_custkey, NULL FROM customer")
def snk3_upserted_nodes(spark, d):
    path = shared_dir(spark, "upserted")
    n = b.nodes(spark, d).select("id", "taxid")
    c = b.table(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("id"))
    writers.upsert_nodes(n.select("id").union(c), n, path)
    return spark.read.parquet(path).select("id", "taxid")


@query("SELECT 'S' || l_suppkey || ',P' || l_partkey || ',' || printf('%.4f', l_discount) AS value FROM lineitem")
def snk6_network_lines(spark, d):
    x = b.table(spark, d, "lineitem").select(_line("S", F.col("l_suppkey")).alias("node1"), _line("P", F.col("l_partkey")).alias("node2"), F.col("l_discount").alias("weight"))
    path = shared_dir(spark, "written")
    writers.write_network(x, path)
    return spark.read.text(path)


@query(f"""
WITH h AS ({H}) SELECT 'csv' AS form, query_id || ',' || query_len || ',' || hit_id || ',' || printf('%.2f', score) || ',' || hit_len AS value FROM h
UNION ALL SELECT 'markdown', '| ' || query_id || ' | ' || query_len || ' | ' || hit_id || ' | ' || printf('%.2f', score) || ' | ' || hit_len || ' |' FROM h""")
def snk8_hit_lines(spark, d):
    x = b.hits(spark, d).withColumns({c: F.col(c).cast("string") for c in ("query_id", "hit_id")})
    return writers.hit_lines(x).select(F.lit("csv").alias("form"), "value").union(writers.hit_lines(x, "markdown").select(F.lit("markdown"), "value"))


@query(f"SELECT query_id, hit_id::VARCHAR AS hit_id, printf('%.3f', x) AS x, y FROM ({P})")
def snk9_point_files(spark, d):
    path = shared_dir(spark, "point-files")
    writers.write_points(b.points(spark, d).withColumn("q", F.lit("all")), path)
    return spark.read.schema("hit_id string, x string, y double, q string, query_id string").csv(path).select("query_id", "hit_id", "x", "y")


@query(f"SELECT query_id, hit_id::VARCHAR AS signal FROM ({P}) WHERE x > 20")
def snk10_signal_files(spark, d):
    path = shared_dir(spark, "signal-files")
    writers.write_signals(b.points(spark, d).withColumn("signal", F.col("x") > 20), path)
    return spark.read.text(f"{path}/signals").select("query_id", F.col("value").alias("signal"))


@query("SELECT p_brand AS cluster_id, count(*) AS size, round(sum(p_size) / count(*)::DOUBLE / 7, 5) AS density FROM part GROUP BY 1")
def snk13_metrics_version(spark, d):
    path = shared_dir(spark, "versions")
    m = b.table(spark, d, "part").groupBy(F.col("p_brand").alias("cluster_id")).agg(F.count(F.lit(1)).alias("size"), (F.sum("p_size") / F.count(F.lit(1)) / 7).alias("density"))
    for version in ("1", "2"):
        writers.write_partition(b.partition(spark, d), m, path, version)
    return spark.read.schema("cluster_id string, size long, density double").option("header", "true").csv(f"{path}/1/metrics")


@query("SELECT 'P' || p_partkey || ',' || p_size || ',net.' || p_brand || ',' || count(*) OVER (PARTITION BY p_brand) || ',,,,,' AS value FROM part")
def snk16_attribute_lines(spark, d):
    t = b.table(spark, d, "part").select(_line("P", F.col("p_partkey")).alias("accession"), F.col("p_size").cast("string").alias("taxid"))
    return writers.attribute_lines(communities.attributes(b.partition(spark, d), t, "net"))


@query(f"""
WITH e AS ({E}), a AS (SELECT node1 AS src, node2 AS dst, weight FROM e WHERE source = 'N.csv' UNION ALL SELECT node2, node1, weight FROM e WHERE source = 'N.csv')
SELECT src, dst, weight, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS place FROM a""")
def win5_sorted_adjacency(spark, d):
    """Read back as it lies on disk: a node's neighbours are together, by falling weight."""
    path = shared_dir(spark, "adjacency")
    writers.write_sorted_adjacency(networks.adjacency(b.edges(spark, d).filter("source = 'N.csv'")), path)
    x = spark.read.parquet(path).withColumns({"file": F.col("_metadata.file_name"), "at": F.col("_metadata.row_index")})
    return x.select("src", "dst", "weight", F.row_number().over(Window.partitionBy("src").orderBy("file", "at")).cast("long").alias("place"))


# -- checks and orders --------------------------------------------------------------------------------------


@query("""
SELECT node, CASE WHEN p_size < 25 THEN p_size::VARCHAR ELSE '' END AS taxid, 'net.' || p_brand AS nh_id, count(*) OVER (PARTITION BY p_brand) AS nh_size
FROM (SELECT 'P' || p_partkey AS node, * FROM part)""")
def val7_missing_taxids(spark, d):
    t = b.table(spark, d, "part").filter("p_size < 25").select(_line("P", F.col("p_partkey")).alias("accession"), F.col("p_size").cast("string").alias("taxid"))
    try:
        communities.attributes(b.partition(spark, d), t, "net", allow_missing=False)
        raise AssertionError("missing taxids were not refused")
    except ValueError:
        return communities.attributes(b.partition(spark, d), t, "net")


@query("""
WITH p AS (SELECT p_partkey AS id, p_size, trim(p_name) AS n, p_brand AS b FROM part)
SELECT id, 'edge' AS kind, CASE WHEN p_size % 5 = 0 THEN 'refused' ELSE least(n, b) || '|' || greatest(n, b) END AS result FROM p
UNION ALL SELECT id, 'nodes', CASE WHEN p_size * 100 > 2500 THEN 'refused' ELSE (p_size * 100)::VARCHAR END FROM p
UNION ALL SELECT id, 'range', CASE WHEN p_size >= 25 THEN 'refused' ELSE printf('%.2f', p_size / 100) || '-0.25' END FROM p
UNION ALL SELECT id, 'texts', CASE WHEN p_size % 2 = 1 THEN 'refused' ELSE n || ',' || b END FROM p""")
def val9_request_checks(spark, d):
    """VAL-9 to VAL-12: what the checks of requests give, or that they refuse; requests are made of all parts."""

    def run(batches):
        for p in batches:
            out = []
            for i, size, name, brand in zip(p["p_partkey"], p["p_size"], p["p_name"], p["p_brand"], strict=True):
                checks = {
                    "edge": lambda: validation.edge_ids([f" {name}|{brand} " + "|x" * (size % 5 == 0)])[0],  # noqa: B023
                    "nodes": lambda: str(validation.max_nodes(int(size) * 100)),  # noqa: B023
                    "range": lambda: "-".join(f"{x:.2f}" for x in validation.ranges([(size / 100, 0.25)])[0]),  # noqa: B023
                    "texts": lambda: ",".join(validation.strings([name, brand], 1 if size % 2 else 2)),  # noqa: B023
                }
                for kind, check in checks.items():
                    try:
                        out.append((i, kind, check()))
                    except ValueError:
                        out.append((i, kind, "refused"))
            yield pd.DataFrame(out, columns=["id", "kind", "result"])

    ship(spark)
    return b.table(spark, d, "part").select("p_partkey", "p_size", "p_name", "p_brand").mapInPandas(run, "id long, kind string, result string")


@query(SJI.replace("SELECT i.a,", "SELECT seed, neighbour, printf('%.4f', sji) AS sji, row_number() OVER (PARTITION BY seed ORDER BY sji DESC, neighbour) AS place FROM (SELECT i.a AS seed, i.b AS neighbour, i.inter / (n1.k + n2.k - i.inter) AS sji FROM (SELECT i.a,", 1).replace("SELECT i.a, i.b, i.inter, n1.k + n2.k - i.inter AS uni, i.inter / (n1.k + n2.k - i.inter) AS sji\nFROM i", "SELECT * FROM i) i") + ")")
def srt4_seed_edge_order(spark, d):
    x = sji.network(b.signals(spark, d, repeats=True)).select(F.col("a").alias("seed"), F.col("b").alias("neighbour"), "sji")
    place = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("sji"), "neighbour"))
    return x.select("seed", "neighbour", fn.fixed(F.col("sji"), 4).alias("sji"), place.cast("long").alias("place"))


@query(f"""
WITH n AS ({N}), e AS ({PE}), z AS (SELECT nh_id, count(*) AS size FROM n GROUP BY 1),
i AS (SELECT a.id AS x, b.id AS y, weight FROM e JOIN n a ON a.id = node1 JOIN n b ON b.id = node2 WHERE a.nh_id = b.nh_id),
t AS (SELECT id, sum(weight)::BIGINT AS total FROM (SELECT x AS id, weight FROM i UNION ALL SELECT y, weight FROM i) GROUP BY 1)
SELECT nh_id, n.id, row_number() OVER (PARTITION BY nh_id ORDER BY CASE WHEN size > 1 THEN coalesce(total, 0) / size ELSE 0 END DESC, n.id) AS place
FROM n LEFT JOIN t USING (id) JOIN z USING (nh_id)""")
def srt7_centrality_order(spark, d):
    n = b.nodes(spark, d)
    sizes = n.groupBy("nh_id").agg(F.count(F.lit(1)).alias("nh_size"))
    c = views.centrality(n.join(sizes, "nh_id", "left"), b.part_edges(spark, d)).select("id", "centrality")
    return views.by_centrality(c.join(n.filter("nh_id IS NOT NULL").select("id", "nh_id"), "id")).select("nh_id", "id", F.col("place").cast("long").alias("place"))


@query("SELECT 'S' || s_suppkey AS id FROM supplier WHERE s_acctbal > 5000 OR s_nationkey = 7")
def set9_hidden_ids(spark, d):
    s = b.table(spark, d, "supplier")
    some = lambda c: s.filter(c).select(_line("S", F.col("s_suppkey")).alias("id"))
    return editing.Edit.none(spark).hide_nodes(some("s_acctbal > 5000")).hide_nodes(some("s_nationkey = 7")).nodes


# -- functions ----------------------------------------------------------------------------------------------


@query("SELECT p_partkey AS id, list_filter(list_transform(string_split_regex(p_name || ';' || p_brand || ', ' || p_type || '-' || p_size, '[\\s,;]+'), lambda x: regexp_replace(x, '[^A-Za-z0-9]', '', 'g')), lambda x: x <> '') AS tokens FROM part")
def fn5_accession_tokens(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.accession_tokens(_line(F.col("p_name"), ";", F.col("p_brand"), ", ", F.col("p_type"), "-", F.col("p_size"), " (0.25)"), scores=True).alias("tokens"))


@query("""
SELECT p_partkey AS id, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS h,
  list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(p_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296) % 64 AS bucket FROM part""")
def fn9_hash_buckets(spark, d):
    h = fn.hash32(F.col("p_name"))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), h.alias("h"), (h % 64).alias("bucket"))


@query()
def fn12_cluster_seeds(spark, d):
    """The seed of every brand's cluster; the digest has no SQL, tests hold it against hashlib."""
    seed = F.udf(lambda c: communities.cluster_seed(42, c), "long")
    ship(spark)
    return b.table(spark, d, "part").select(F.col("p_brand").alias("cluster")).distinct().select("cluster", seed("cluster").alias("seed"))


@query("""
SELECT p_partkey AS id, round(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name || '|' || p_type, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) / 4294967296.0::DOUBLE * 2 * pi(), 9) AS angle FROM part""")
def fn13_string_angles(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.round(fn.string_angle(F.col("p_name"), F.col("p_type")), 9).alias("angle"))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey < 3 THEN n_nationkey::VARCHAR ELSE 'u' || n_regionkey END AS taxid, CASE WHEN n_regionkey < 2 THEN n_name END AS upid FROM nation")
def fn16_json_paths(spark, d):
    r, k = F.col("n_regionkey"), F.col("n_nationkey").cast("string")
    doc = F.to_json(F.struct(F.when(r < 3, F.struct(k.alias("taxonId"))).alias("organism"), F.concat(F.lit("u"), r.cast("string")).alias("taxid"), F.when(r < 2, F.col("n_name")).alias("upid")))
    return b.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), fn.json_first(doc, "$.organism.taxonId", "$.taxid").alias("taxid"), fn.json_first(doc, "$.upid").alias("upid"))


@query("SELECT n_nationkey AS id, CASE WHEN n_regionkey = 4 THEN '' ELSE n_name || ' does ' || n_regionkey END AS text FROM nation")
def fn17_function_comments(spark, d):
    text = lambda *c: F.struct(_line(*c).alias("value"))
    one = F.struct(F.lit("FUNCTION").alias("commentType"), F.when(F.col("n_regionkey") != 4, F.array(text(" ", F.col("n_name"), " "), text("does ", F.col("n_regionkey")), text(" "))).alias("texts"))
    two = F.struct(F.lit("OTHER").alias("commentType"), F.array(text("no")).alias("texts"))
    return b.table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), fn.flatten_comments(F.to_json(F.struct(F.array(one, two).alias("comments")))).alias("text"))


@query("SELECT p_partkey AS id, p_name || '_edited' AS name FROM part")
def fn18_edited_names(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.edited_name(F.concat("p_name", F.when(F.col("p_size") < 20, ".CSV").when(F.col("p_size") < 40, ".csv").otherwise(""))).alias("name"))


@query("SELECT p_partkey AS id, replace(replace(replace(replace(replace(p_name || '<' || p_type || '>&\"''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS html FROM part")
def fn15_html_cells(spark, d):
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), fn.html_text(_line(F.col("p_name"), "<", F.col("p_type"), ">&\"'")).alias("html"))


# -- signal calls -------------------------------------------------------------------------------------------


@query(f"""
WITH p AS ({P}), m AS (SELECT query_id, median(x) AS mx, median(y) AS my FROM p GROUP BY 1),
s AS (SELECT query_id, mx, my, median(abs(x - mx)) AS sx, median(abs(y - my)) AS sy FROM p JOIN m USING (query_id) GROUP BY ALL)
SELECT query_id, hit_id, round((x - mx) / (1.4826::DOUBLE * CASE WHEN sx < 1e-12 THEN 1 ELSE sx END), 6) AS zx, round((y - my) / (1.4826::DOUBLE * CASE WHEN sy < 1e-12 THEN 1 ELSE sy END), 6) AS zy FROM p JOIN s USING (query_id)""")
def son1_zscores(spark, d):
    def run(p: pd.DataFrame) -> pd.DataFrame:
        z = signal_calls.zscore(p[["x", "y"]].to_numpy(float))
        return p[["query_id", "hit_id"]].assign(zx=z[:, 0], zy=z[:, 1])

    x = b.points(spark, d).groupBy("query_id").applyInPandas(run, "query_id string, hit_id long, zx double, zy double")
    return x.select("query_id", "hit_id", F.round("zx", 6).alias("zx"), F.round("zy", 6).alias("zy"))


@query(f"""
WITH v AS (SELECT query_id, y AS v, row_number() OVER (PARTITION BY query_id ORDER BY y DESC, hit_id) AS i FROM ({P})),
g AS (SELECT a.query_id, a.i, a.v - b.v AS gap FROM v a JOIN v b ON b.query_id = a.query_id AND b.i = a.i + 1),
m AS (SELECT a.query_id, a.i, a.gap, median(b.gap) AS med FROM g a JOIN g b ON b.query_id = a.query_id AND b.i <> a.i GROUP BY ALL),
s AS (SELECT m.query_id, m.i, m.gap, med, median(abs(b.gap - med)) AS mad FROM m JOIN g b ON b.query_id = m.query_id AND b.i <> m.i GROUP BY ALL),
z AS (SELECT query_id, i, (gap - med) / (1.4826::DOUBLE * greatest(mad, 1e-12)) AS z FROM s),
t AS (SELECT query_id, max(z) AS top FROM z GROUP BY 1)
SELECT query_id, CASE WHEN top > 0 THEN min(i) ELSE 1 END AS k FROM z JOIN t USING (query_id) WHERE z = top GROUP BY query_id, top""")
def win7_eigengap_clusters(spark, d):
    """The number of clusters that a falling row of values speaks for; the rows here are the prices of a brand."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        v = p.sort_values(["y", "hit_id"], ascending=[False, True])["y"].to_numpy(float)
        return pd.DataFrame({"query_id": p["query_id"][:1], "k": [signal_calls.choose_k(v)]})

    return b.points(spark, d).groupBy("query_id").applyInPandas(run, "query_id string, k long")


@query(f"""WITH e AS (SELECT node1, node2, max(weight) AS w FROM ({E}) GROUP BY ALL), a AS (SELECT node1 AS src, node2 AS dst, w FROM e UNION ALL SELECT node2, node1, w FROM e),
i AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS id FROM (SELECT DISTINCT src FROM a))
SELECT i.id AS src, j.id AS dst, w AS weight FROM a JOIN i USING (src) JOIN i j ON j.src = a.dst""")
def snk11_binary_adjacency(spark, d):
    """All edges written as binary adjacency and read back."""
    e = b.edges(spark, d).groupBy("node1", "node2").agg(F.max("weight").alias("weight"))
    names = e.select(F.explode(F.array("node1", "node2")).alias("name"))
    x = networks.encode(e, stage(networks.dense_ids(names, order="name"), "ids"))
    folder = shared_dir(spark, "adjacency")
    adjacency.write_adjacency_files(x.union(x.select("dst", "src", "weight")), folder, parts=8)
    return adjacency.read_adjacency_files(spark, folder).withColumn("weight", F.col("weight").cast("long"))


@query(f"""WITH e AS (SELECT node1, node2, max(weight) AS w FROM ({E}) GROUP BY ALL), a AS (SELECT node1 AS src, node2 AS dst, w FROM e UNION ALL SELECT node2, node1, w FROM e),
i AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS id FROM (SELECT DISTINCT src FROM a))
SELECT i.id AS src, sum(w)::BIGINT AS weight, count(*) AS n FROM a JOIN i USING (src) WHERE src IN (SELECT DISTINCT 'S' || s_suppkey FROM supplier WHERE s_nationkey = 7) GROUP BY 1""")
def src22_adjacency_of_nodes(spark, d):
    """The neighbours of one nation's suppliers, by offset."""
    e = b.edges(spark, d).groupBy("node1", "node2").agg(F.max("weight").alias("weight"))
    ids = stage(networks.dense_ids(e.select(F.explode(F.array("node1", "node2")).alias("name")), order="name"), "ids")
    x, folder = networks.encode(e, ids), shared_dir(spark, "adjacency")
    adjacency.write_adjacency_files(x.union(x.select("dst", "src", "weight")), folder, parts=8)
    own = b.table(spark, d, "supplier").filter("s_nationkey = 7").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("name"))
    asked = [r["id"] for r in ids.join(own, "name", "left_semi").collect()]
    return adjacency.read_adjacency_files(spark, folder, asked).groupBy("src").agg(F.sum("weight").cast("long").alias("weight"), F.count(F.lit(1)).alias("n"))


@query("SELECT least('S' || l_suppkey, 'P' || l_partkey) AS node1, greatest('S' || l_suppkey, 'P' || l_partkey) AS node2, max(l_linenumber) / 8 AS weight FROM lineitem WHERE l_returnflag <> 'N' AND (l_returnflag <> 'R' OR l_linenumber > 3) GROUP BY ALL")
def str3_changed_folder(spark, d):
    """A folder followed twice: between, one network's files change, one's go and one's stay; a file has a bounded
    number of lines."""
    x = b.raw_edges(spark, d).withColumn("line", F.col("row") % 10)
    folder, progress, c = shared_dir(spark, "changing"), shared_dir(spark, "progress"), Catalog(spark, shared_dir(spark, "followed"))
    files = max(1, -(-x.count() // TASK_ROWS))

    def take(flag: str) -> None:
        for k in range(files):
            fs, where = c._fs(f"{folder}/in/{flag}-{k}.csv")
            fs.delete(where, False)

    def put(flag: str, rows: DataFrame) -> None:
        best = rows.groupBy(F.least("u", "v").alias("node1"), F.greatest("u", "v").alias("node2")).agg((F.max("line") / 8).alias("weight"))
        best.repartition(files, "node1", "node2").write.mode("overwrite").csv(f"{folder}/{flag}")
        fs, where = c._fs(f"{folder}/{flag}")
        parts = [f.getPath() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-")]
        fs.mkdirs(c._fs(f"{folder}/in")[1])
        take(flag)
        for k, part in enumerate(parts):
            fs.rename(part, c._fs(f"{folder}/in/{flag}-{k}.csv")[1])

    go = lambda: reload.follow(c, f"{folder}/in", progress, once=True, settle=0).awaitTermination()
    for flag in "ANR":
        put(flag, x.filter(F.col("source") == f"{flag}.csv"))
    go()
    put("R", x.filter("source = 'R.csv' AND line > 3"))
    take("N")
    go()
    return c.edges.groupBy("node1", "node2").agg(F.max("weight").alias("weight"))


# -- the catalog --------------------------------------------------------------------------------------------


def _catalog(spark, d) -> Catalog:
    c = Catalog(spark, shared_dir(spark, "catalog"))
    c.ingest_edges(b.edges(spark, d).withColumn("weight", F.col("weight") / 100))
    return c


@query(f"SELECT source, node1, node2, CASE WHEN source = 'R.csv' THEN 0.5::DOUBLE ELSE weight / 100 END AS weight FROM ({E}) WHERE source <> 'R.csv' OR weight > 6")
def dml2_replaced_network(spark, d):
    c = _catalog(spark, d)
    c.ingest_edges(b.edges(spark, d).filter("source = 'R.csv' AND weight > 6").withColumn("weight", F.lit(0.5)))
    return c.edges.select("source", "node1", "node2", "weight")


@query(f"SELECT source, count(*) AS edges FROM ({E}) WHERE source <> 'N.csv' GROUP BY 1")
def dml3_dropped_network(spark, d):
    c = _catalog(spark, d)
    c.drop("N.csv")
    return c.edges.groupBy("source").agg(F.count(F.lit(1)).alias("edges"))


@query(f"WITH e AS ({E}) SELECT node1, node2, weight / 100 AS weight FROM e WHERE source = 'A.csv' AND node1 <> 'P1' AND node2 <> 'P1' AND node1 <> 'P2' AND node2 <> 'P2' AND NOT (weight / 100 >= 0.02::DOUBLE AND weight / 100 < 0.05::DOUBLE)")
def dml5_saved_edit(spark, d):
    c = _catalog(spark, d)
    edit = editing.Edit.none(spark).hide_nodes(spark.createDataFrame([("P1",), ("P2",)], "id string")).hide_range(0.02, 0.05)
    name = c.save_edit("A.csv", "mine", edit)["source"]
    return c.edges.filter(F.col("source") == name).select("node1", "node2", "weight")


@query(f"WITH e AS ({E}) SELECT DISTINCT id FROM (SELECT node1 AS id FROM e WHERE source = 'A.csv' UNION SELECT node2 FROM e WHERE source = 'A.csv') WHERE id <> 'P1'")
def dml6_saved_members(spark, d):
    c = _catalog(spark, d)
    name = c.save_edit("A.csv", "mine", editing.Edit.none(spark).hide_nodes(spark.createDataFrame([("P1",)], "id string")))["source"]
    return c.members.filter(F.col("source") == name).select("id")


@query(f"""
WITH e AS (SELECT node1 || '|' || node2 AS id, weight FROM ({E}) WHERE source = 'A.csv') SELECT id FROM e WHERE weight >= 3 AND weight < 6 AND id NOT IN (SELECT id FROM e WHERE weight = 4)""")
def dml7_shown_edges(spark, d):
    """A range is hidden, then some of its edges are shown: the others become hidden by id."""
    e = b.edges(spark, d).filter("source = 'A.csv'").withColumn("id", fn.edge_id(F.col("node1"), F.col("node2")))
    return editing.Edit.none(spark).hide_range(3, 6).show_edges(e.filter("weight = 4").select("id"), e).edges


@query(f"SELECT node1, node2, max(weight) / 100 AS weight FROM ({E}) GROUP BY 1, 2")
def str2_followed_folder(spark, d):
    x = b.edges(spark, d).groupBy("node1", "node2").agg((F.max("weight") / 100).alias("weight"))
    folder, c = _csv(x, "watched"), Catalog(spark, shared_dir(spark, "followed"))
    reload.follow(c, folder, shared_dir(spark, "progress"), once=True, settle=0).awaitTermination()
    return c.edges.select("node1", "node2", "weight")
