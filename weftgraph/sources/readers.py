"""Readers of the text formats: networks, attributes, names, trees, sequences, hits, points, signals, lists,
edges, partitions, metrics, mappings, matrices, binary adjacency. Schemas are explicit; nothing is inferred.
"""

from __future__ import annotations

from fnmatch import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite_number
from .adjacency import read_adjacency_files

#: Header cells (fixed values).
ATTRIBUTE_HEADER = ["node_id", "NCBI_txID", "NH_ID", "NH_Size"]
HIT_HEADER = ["Query ID", "Query Length", "Hit ID", "Hit Score", "Hit Length"]
#: The 23 residue letters (fixed values).
RESIDUES = "ABCDEFGHIKLMNPQRSTVWXYZ"


def lines(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """file, text of every line that is not blank."""
    x = spark.read.option("recursiveFileLookup", str(recursive).lower()).text(path)
    return x.select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text")).filter(F.trim("text") != "")


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text with line numbers: each file is one row on its way, so only for files that fit a task."""
    x = spark.read.text(path, wholetext=True)
    each = x.select(F.col("_metadata.file_name").alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("line", "text"))
    return each.select("file", (F.col("line") + 1).alias("line"), "text")


def fields(text: Column) -> Column:
    """Cells of a CSV line, quotes doubled inside quotes, trimmed; ragged lines keep their number of cells."""
    cells = F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(r',\s*("(?:[^"]|"")*"|[^,]*)'), F.lit(1))

    def plain(c: Column) -> Column:
        t = F.trim(c)
        quoted = F.startswith(t, F.lit('"')) & F.endswith(t, F.lit('"')) & (F.length(t) > 1)
        return F.when(quoted, F.replace(F.substr(t, F.lit(2), F.length(t) - 2), F.lit('""'), F.lit('"'))).otherwise(t)

    return F.transform(cells, plain)


def file_names(spark: SparkSession, folder: str) -> list[str]:
    """Names of the files in a folder, empty ones too, from its store's listing. The listing comes as two texts, paths and
    states, not by a few calls for each file; a path holds no zero character."""
    path, jvm = spark._jvm.org.apache.hadoop.fs.Path(folder), spark._jvm
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    if not len(found):
        return []
    joined = lambda array: jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(array).mkString("\0").split("\0")
    paths = joined(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
    is_file = lambda p, state: state.partition(f"path={p}; isDirectory=")[2].startswith("false")
    return sorted(p.rpartition("/")[2] for p, state in zip(paths, joined(found), strict=True) if is_file(p, state))


def first_files(spark: SparkSession, folder: str, most: int | None = None) -> list[str]:
    """Names of a folder's files without regard to case, the first `most` of them (a limit the caller asks for)."""
    return sorted(file_names(spark, folder), key=lambda n: (n.lower(), n))[:most]


def network(spark: SparkSession, path: str) -> DataFrame:
    """source, node1, node2, weight: lines of three cells or more, a finite weight and two ends."""
    c = fields(F.col("text"))
    x = lines(spark, path).select(F.col("file").alias("source"), c.alias("c")).filter(F.size("c") >= 3)
    x = x.select("source", F.trim(F.get("c", F.lit(0))).alias("node1"), F.trim(F.get("c", F.lit(1))).alias("node2"), finite_number(F.get("c", F.lit(2))).alias("weight"))
    return x.filter("node1 <> '' AND node2 <> '' AND weight IS NOT NULL")


def first_line(spark: SparkSession, path: str) -> str | None:
    got = lines(spark, path).limit(1).collect()
    return got[0]["text"] if got else None


def one_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """The only file of a folder that fits; any other number is an error."""
    names = [n for n in file_names(spark, folder) if fnmatch(n, pattern)]
    if len(names) != 1:
        raise ValueError(f"{'no' if not names else 'more than one'} file {pattern} in {folder}")
    return f"{folder}/{names[0]}"


def node_attributes(spark: SparkSession, path: str) -> DataFrame:
    """file, line, id, taxid, nh_id, nh_size: nine cells by place, the first four named in the header."""
    x = numbered(spark, path)
    heads = x.filter("line = 1").select("file", F.transform(F.split("text", ","), lambda t: F.trim(t)).alias("h"))
    bad = heads.filter(F.slice("h", 1, 4) != F.array(*map(F.lit, ATTRIBUTE_HEADER))).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['file']}: the header does not begin with {', '.join(ATTRIBUTE_HEADER)}")
    x = x.filter("line > 1").filter(F.trim("text") != "").select("file", "line", fields(F.col("text")).alias("c"))
    cell = lambda i: F.nullif(F.trim(F.try_element_at("c", F.lit(i))), F.lit(""))
    return x.select("file", "line", cell(1).alias("id"), cell(2).alias("taxid"), cell(3).alias("nh_id"), cell(4).alias("nh_size")).filter("id IS NOT NULL")


def taxon_names(spark: SparkSession, path: str) -> DataFrame:
    """line, taxid, name: a header names the columns, in either of two spellings; bad rows are skipped."""
    x = numbered(spark, path)
    head = x.filter("line = 1").select(fields(F.col("text")).alias("h")).collect()
    if not head:
        return spark.createDataFrame([], "line int, taxid string, name string")
    names = [h.strip() for h in head[0]["h"]]
    at = lambda *options: next((names.index(o) for o in options if o in names), None)
    t, n = at("ncbi_txid", "tax_id"), at("species_name", "name_txt")
    if t is None or n is None:
        raise ValueError("the header names no taxid or no name")
    c = x.filter("line > 1").select("line", fields(F.col("text")).alias("c"))
    cell = lambda i: F.nullif(F.trim(F.try_element_at("c", F.lit(i + 1))), F.lit(""))
    return c.select("line", cell(t).alias("taxid"), cell(n).alias("name")).filter("taxid IS NOT NULL AND name IS NOT NULL")


def species(spark: SparkSession, path: str, header_as_row: bool = True) -> DataFrame:
    """ncbi_txid, species_name by place; the header is a row like any other, unless told otherwise."""
    x = spark.read.schema("ncbi_txid string, species_name string").option("header", str(not header_as_row).lower()).option("enforceSchema", "true").csv(path)
    return x


def tree_lines(spark: SparkSession, path: str) -> DataFrame:
    return numbered(spark, path).select("line", "text")


def fasta_name(header: Column) -> Column:
    """Name of a header: up to white space, the accession of sp|X| and tr|X| names, 64 letters at most."""
    word = F.substring_index(F.regexp_replace(header, "\t", " "), " ", 1)
    parts = F.split(word, "\\|")
    named = (F.size(parts) == 3) & F.get(parts, F.lit(0)).isin("sp", "tr")
    return F.substring(F.when(named, F.try_element_at(parts, F.lit(2))).otherwise(word), 1, 64)


def fasta_accession(header: Column) -> Column:
    """The second part of a header of three or more parts between bars, else its first word."""
    word = F.split(F.trim(header), "\\s+")[0]
    parts = F.split(word, "\\|")
    return F.when(F.size(parts) >= 3, F.try_element_at(parts, F.lit(2))).otherwise(word)


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """file, header, name, seq: records are cut at lines that begin with >, so a large file is split."""
    x = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", "^>", "").alias("r"))
    x = x.filter(F.trim("r") != "")
    head = F.trim(F.substring_index("r", "\n", 1))
    body = F.when(F.instr("r", "\n") > 0, F.substr("r", F.instr("r", "\n") + 1)).otherwise("")
    seq = F.regexp_replace(F.upper(body), f"[^{RESIDUES}]", "")
    return x.select("file", head.alias("header"), fasta_name(head).alias("name"), seq.alias("seq"))


def check_sequences(sequences: DataFrame) -> DataFrame:
    """The sequences, if none is empty."""
    empty = sequences.filter("seq = ''").limit(1).collect()
    if empty:
        raise ValueError(f"{empty[0]['file']}: {empty[0]['name']} has no residues")
    return sequences


def file_key(name: Column, part: int) -> Column:
    """Query (1) or target (2) of a file name, cut at its first underscore."""
    return F.regexp_extract(F.regexp_replace(name, r"\.[^.]*$", ""), "^([^_]+)_(.+)$", part)


def hits(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Hits (q, t, query_id, query_len, hit_id, score, hit_len, line) of the files all of whose rows are good,
    and the files that are not (file, line); with strict, one bad row is an error."""
    x = numbered(spark, path).filter(F.trim("text") != "")
    x = x.select("file", "line", fields(F.col("text")).alias("c"))
    head = F.col("c") == F.array(*map(F.lit, HIT_HEADER))
    x = x.filter(~(head & (F.col("line") == 1)))
    cell = lambda i: F.trim(F.try_element_at("c", F.lit(i)))
    y = x.select("file", "line", F.size("c").alias("n"), cell(1).alias("query_id"), cell(2).try_cast("int").alias("query_len"), cell(3).alias("hit_id"), finite_number(F.nullif(cell(4), F.lit(""))).alias("score"), cell(5).try_cast("int").alias("hit_len"))
    good = (F.col("n") == 5) & (F.col("query_id") != "") & (F.col("hit_id") != "") & F.col("query_len").isNotNull() & F.col("score").isNotNull() & F.col("hit_len").isNotNull()
    bad = y.filter(~F.coalesce(good, F.lit(False))).groupBy("file").agg(F.min("line").alias("line"))
    if strict and not bad.isEmpty():
        raise ValueError(f"bad row: {bad.first()}")
    kept = y.join(bad, "file", "left_anti")
    return kept.select(file_key(F.col("file"), 1).alias("q"), file_key(F.col("file"), 2).alias("t"), "query_id", "query_len", "hit_id", "score", "hit_len", "line"), bad


def points(spark: SparkSession, path: str) -> DataFrame:
    """query_id (file name), hit_id, x, y: tabs, commas or spaces, by line; other lines are headers."""
    t = F.trim("text")
    parts = F.when(F.contains(t, F.lit("\t")), F.split(t, "\t")).when(F.contains(t, F.lit(",")), F.split(t, ",")).otherwise(F.split(t, "\\s+"))
    x = lines(spark, path).select(F.regexp_replace("file", r"\.(csv|tsv|txt)$", "").alias("query_id"), F.transform(parts, lambda t: F.trim(t)).alias("c")).filter(F.size("c") >= 3)
    x = x.select("query_id", F.get("c", F.lit(0)).alias("hit_id"), finite_number(F.nullif(F.get("c", F.lit(1)), F.lit(""))).alias("x"), finite_number(F.nullif(F.get("c", F.lit(2)), F.lit(""))).alias("y"))
    return x.filter("x IS NOT NULL AND y IS NOT NULL")


def signals(spark: SparkSession, folder: str, hidden: bool = False) -> tuple[DataFrame, DataFrame]:
    """protein, signal of a folder of one file per protein, and protein, status (ok or empty) of every file."""
    names = [n for n in file_names(spark, folder) if hidden or not n.startswith(".")]
    files = spark.createDataFrame([(n,) for n in names], "protein string")
    x = spark.read.text([f"{folder}/{n}" for n in names if n[0] in "._"] + [folder]).select(F.col("_metadata.file_name").alias("protein"), F.trim("value").alias("signal")).filter("signal <> ''").distinct()
    some = x.select("protein").distinct().withColumn("some", F.lit(True))
    status = files.join(some, "protein", "left").select("protein", F.when(F.col("some").isNull(), "empty").otherwise("ok").alias("status"))
    return x, status


def delimiter(line: str) -> str:
    return "," if "," in line else "\t" if "\t" in line else " "


def edge_list(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """node1, node2, weight (32 bits), by the delimiter of the first line; ids that spell a null stay ids."""
    sep = delimiter(first_line(spark, path) or ",")
    x = spark.read.schema("node1 string, node2 string, weight float").csv(path, sep=sep, header=header, nullValue="\u0000", mode="PERMISSIVE", enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return x.filter("node1 IS NOT NULL AND node2 IS NOT NULL AND weight IS NOT NULL")


def integer_edges(spark: SparkSession, path: str) -> DataFrame:
    """src, dst, weight; any other row is an error."""
    sep = delimiter(first_line(spark, path) or ",")
    return spark.read.schema("src bigint, dst bigint, weight float").csv(path, sep=sep, mode="FAILFAST")


def partition(spark: SparkSession, path: str) -> DataFrame:
    """node, cluster_id; a header or a node that occurs twice is an error."""
    x = spark.read.schema("node string, cluster_id string").csv(path)
    if not x.filter("lower(node) IN ('node', 'node_id')").isEmpty():
        raise ValueError("a partition has no header")
    twice = x.groupBy("node").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0]['node']} occurs more than once")
    return x


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Community metrics with their usual names; nulls are 0, a missing weighted density is worked out."""
    x = spark.read.option("header", "true").csv(path)
    if "community" in x.columns:
        x = x.withColumnRenamed("community", "cluster_id")
    for c in ("size", "internal_edges", "internal_weight_sum", "avg_internal_weight", "internal_density", "max_internal_edges"):
        kind = "double" if c not in ("size", "internal_edges", "max_internal_edges") else "long"
        x = x.withColumn(c, F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast(kind) if c in x.columns else F.lit(0).cast(kind))
    density = F.col("internal_weight_sum") / F.greatest(F.lit(1), F.col("max_internal_edges"))
    given = F.col("weighted_density").try_cast("double") if "weighted_density" in x.columns else F.lit(None).cast("double")
    return x.withColumn("weighted_density", F.coalesce(given, density))


def mapping(spark: SparkSession, path: str, names: str = "id bigint, name string", header: bool = False) -> DataFrame:
    return spark.read.schema(names).csv(path, header=header, enforceSchema=True)


def id_list(spark: SparkSession, path: str, upper: bool = True) -> DataFrame:
    """line, id: first words of lines that are no comments, each id once, in order."""
    first = F.split(F.trim("text"), "\\s+")[0]
    x = numbered(spark, path).filter((F.trim("text") != "") & ~F.trim("text").startswith("#")).select("line", (F.upper(first) if upper else first).alias("id"))
    return x.groupBy("id").agg(F.min("line").alias("line")).select("line", "id")


def complete_indexes(spark: SparkSession, folder: str) -> DataFrame:
    """prefix of the indexes all of whose three files are there, in order."""
    x = spark.createDataFrame(pd.DataFrame({"f": file_names(spark, folder)}, dtype=object), "f string")
    kind = F.regexp_extract("f", r"\.(adj\.bin|adj\.index\.bin|node_ids\.tsv)$", 1)
    y = x.select(kind.alias("kind"), F.regexp_replace("f", r"\.(adj\.bin|adj\.index\.bin|node_ids\.tsv)$", "").alias("prefix")).filter("kind <> ''")
    return y.groupBy("prefix").agg(F.countDistinct("kind").alias("n")).filter("n = 3").select("prefix").orderBy("prefix")


def binary_adjacency(spark: SparkSession, prefix: str, names: list[str] | None = None) -> DataFrame:
    """src, dst, weight of a binary index and its node_ids.tsv, by name; of some nodes only, if given."""
    folder, _, pair = prefix.rpartition("/")
    ids = spark.read.schema("id bigint, name string").csv(prefix + ".node_ids.tsv", sep="\t")
    asked = None if names is None else [r["id"] for r in ids.filter(F.col("name").isin(names)).collect()]
    x = read_adjacency_files(spark, folder or ".", asked, pair=pair)
    a, b = ids.select(F.col("id").alias("src"), F.col("name").alias("s")), ids.select(F.col("id").alias("dst"), F.col("name").alias("d"))
    return x.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"), "weight")


def numeric_clusters(metrics_: DataFrame) -> DataFrame:
    """Clusters whose dotted id is numeric."""
    return metrics_.filter(F.col("cluster_id").rlike(r"^\d+(\.\d+)*$"))
