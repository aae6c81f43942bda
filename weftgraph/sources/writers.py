"""Writers: networks, seeds, hits, points, signals, partitions, attributes, group texts; and output names."""

from __future__ import annotations

import os
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import csv_cell, fixed, markdown_cell


def csv_line(*cells: Column) -> Column:
    return F.concat_ws(",", *[csv_cell(c.cast("string")) for c in cells])


def network_lines(edges: DataFrame, digits: int = 4) -> DataFrame:
    """value: node1,node2,weight with a fixed number of decimals, cells quoted where needed."""
    return edges.select(csv_line(F.col("node1"), F.col("node2"), fixed(F.col("weight"), digits)).alias("value"))


def write_network(edges: DataFrame, path: str, digits: int = 4) -> None:
    network_lines(edges, digits).write.mode("overwrite").text(path)


def replace_sources(edges: DataFrame, path: str) -> None:
    """Rewrite the networks that `edges` holds and leave the others: whole partitions by source, atomically."""
    edges.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def upsert_nodes(nodes: DataFrame, attributes: DataFrame, path: str) -> None:
    """The node table with new attributes and placeholders, rewritten as a whole."""
    nodes.select("id").join(attributes, "id", "full").write.mode("overwrite").parquet(path)


def placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id of ends that the node table lacks."""
    ends = edges.select(F.explode(F.array("node1", "node2")).alias("id")).distinct()
    return ends.join(nodes.select("id"), "id", "left_anti")


def write_seed_edges(edges: DataFrame, status: DataFrame, path: str) -> None:
    """A folder per seed, neighbours by descending index, and the statuses."""
    out = edges.select(F.col("a").alias("seed"), F.col("b").alias("neighbour"), fixed(F.col("sji"), 4).alias("sji"))
    out.repartition("seed").sortWithinPartitions("seed", F.desc("sji"), "neighbour").write.mode("overwrite").partitionBy("seed").csv(f"{path}/edges")
    status.write.mode("overwrite").option("sep", "\t").csv(f"{path}/status")


def hit_lines(hits: DataFrame, form: str = "csv") -> DataFrame:
    """value: a line per hit as csv, markdown or json; scores with two decimals, quotes leave the ids."""
    plain = lambda c: F.replace(F.col(c), F.lit('"'), F.lit(""))
    score = fixed(F.col("score"), 2)
    cells = [plain("query_id"), F.col("query_len").cast("string"), plain("hit_id"), score, F.col("hit_len").cast("string")]
    if form == "csv":
        return hits.select(F.concat_ws(",", *cells).alias("value"))
    if form == "markdown":
        return hits.select(F.concat(F.lit("| "), F.concat_ws(" | ", *map(markdown_cell, cells)), F.lit(" |")).alias("value"))
    return hits.select(F.to_json(F.struct(F.col("query_id").alias("query"), F.col("hit_id").alias("hit"), score.cast("double").alias("score"), "hit_len")).alias("value"))


def write_points(points: DataFrame, path: str) -> None:
    """Folders by query proteome and query; a rerun replaces what was there."""
    out = points.select("q", "query_id", "hit_id", fixed(F.col("x"), 3).alias("x"), F.col("y"))
    out.write.mode("overwrite").partitionBy("q", "query_id").csv(path)


def write_signals(called: DataFrame, path: str) -> None:
    called.filter("signal").select("query_id", F.col("hit_id").cast("string").alias("value")).write.mode("overwrite").partitionBy("query_id").text(f"{path}/signals")
    called.write.mode("overwrite").option("sep", "\t").csv(f"{path}/labels")


def write_partition(partition: DataFrame, metrics: DataFrame, path: str, version: str) -> None:
    """Partition and metrics (five decimals) of one version; older versions stay as they are."""
    rounded = [F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in metrics.dtypes]
    partition.write.mode("overwrite").csv(f"{path}/{version}/partition")
    metrics.select(*rounded).write.mode("overwrite").option("header", "true").csv(f"{path}/{version}/metrics")


def write_clusters(edges: DataFrame, path: str) -> None:
    """Edges (cluster_id, node1, node2, weight) in a folder per cluster."""
    edges.select("cluster_id", "node1", "node2", "weight").write.mode("overwrite").partitionBy("cluster_id").csv(path)


def attribute_lines(attributes: DataFrame) -> DataFrame:
    """value: nine cells, the last five blank."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("node", "taxid", "nh_id", "nh_size")]
    return attributes.select(F.concat(csv_line(*cells), F.lit(",,,,,")).alias("value"))


def write_adjacency(adjacency: DataFrame, table: str, buckets: int = 64) -> None:
    """A table bucketed and sorted by source node: later joins on it need no shuffle."""
    adjacency.write.mode("overwrite").bucketBy(buckets, "src").sortBy("src").saveAsTable(table)


def write_sorted_adjacency(adjacency: DataFrame, path: str) -> None:
    """Adjacency by ranges of the source node, a node's neighbours together and by falling weight."""
    dealt = adjacency.repartitionByRange("src").sortWithinPartitions("src", F.desc("weight"), "dst")
    dealt.select("src", "dst", "weight").write.mode("overwrite").parquet(path)


def group_texts(groups: DataFrame) -> DataFrame:
    """name, text: the accessions of each group, one a line, in order. groups: name, place, accession."""
    got = groups.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("place", "accession"))).alias("a"))
    return got.select("name", F.array_join(F.transform("a", lambda a: a["accession"]), "\n").alias("text"))


def merge_points(existing: DataFrame, new: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points of the listed queries, old before new, and the reports: queries missing on a side."""
    both = existing.join(ids, "query_id", "left_semi").withColumn("age", F.lit(0)).unionByName(new.join(ids, "query_id", "left_semi").withColumn("age", F.lit(1)))
    have = lambda x, name: x.select("query_id").distinct().withColumn(name, F.lit(True))
    report = ids.join(have(existing, "old"), "query_id", "left").join(have(new, "new"), "query_id", "left")
    missing = F.when(F.col("old").isNull() & F.col("new").isNull(), "both").when(F.col("old").isNull(), "existing").when(F.col("new").isNull(), "new")
    return both, report.select("query_id", missing.alias("missing")).filter("missing IS NOT NULL")


def reserve_name(folder: str, name: str, stale_s: float = 600, tries: int = 1000) -> str:
    """A free file name in a driver's folder: `_1`, `_2`, ... after the stem, cases alike; a lock file holds
    it, and one older than `stale_s` is void."""
    stem, dot, suffix = name.rpartition(".")
    if not dot:
        stem, suffix = name, ""
    taken = {x.lower() for x in os.listdir(folder)}
    for k in range(tries):
        got = f"{stem}{f'_{k}' if k else ''}{dot}{suffix}"
        lock = os.path.join(folder, f".{got.lower()}.lock")
        if got.lower() in taken:
            continue
        if os.path.exists(lock) and time.time() - os.path.getmtime(lock) > stale_s:
            os.unlink(lock)
        try:
            os.close(os.open(lock, os.O_CREAT | os.O_EXCL))
            return got
        except FileExistsError:
            continue
    raise RuntimeError(f"no free name for {name}")


def release_name(folder: str, name: str) -> None:
    lock = os.path.join(folder, f".{name.lower()}.lock")
    if os.path.exists(lock):
        os.unlink(lock)
