"""Merging of repeated nodes and edges, edges by component, accession derivations, presence reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import looked_up, numbered


def merge_nodes(nodes: DataFrame, order: str, key: str = "id") -> DataFrame:
    """One row per id: of every attribute the last value that is not null."""
    own = [c for c in nodes.columns if c not in (key, order)]
    return nodes.groupBy(key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in own])


def component_edges(edges: DataFrame, components: DataFrame) -> DataFrame:
    """edges with their component; both ends must lie in the same."""
    a = components.select(F.col("node").alias("node1"), "component")
    b = components.select(F.col("node").alias("node2"), F.col("component").alias("other"))
    return edges.join(looked_up(a), "node1").join(looked_up(b), "node2").filter("component = other").drop("other")


def targets(signals: DataFrame, queries: DataFrame, size: int = 5000) -> DataFrame:
    """id, chunk: signals that are no query protein, dealt in order into chunks."""
    ids = signals.select(F.col("signal").alias("id")).distinct().join(queries.select("id"), "id", "left_anti")
    return numbered(ids, "id").select("id", F.floor((F.col("line") - 1) / size).cast("long").alias("chunk"))


def presence(wanted: DataFrame, old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key, in_old, in_new for every wanted key."""
    have = lambda x, name: x.select(key).distinct().withColumn(name, F.lit(True))
    x = wanted.select(key).distinct().join(have(old, "in_old"), key, "left").join(have(new, "in_new"), key, "left")
    return x.select(key, F.coalesce("in_old", F.lit(False)).alias("in_old"), F.coalesce("in_new", F.lit(False)).alias("in_new"))


def single_cluster(partition: DataFrame, members: DataFrame) -> DataFrame:
    """cluster_id, members, clusters: of each stored cluster file, how many of its nodes there are and in how
    many clusters they lie now; stale unless that is 1. members: cluster_id, node."""
    now = partition.select("node", F.col("cluster_id").alias("now"))
    x = members.join(now, "node", "left")
    return x.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("members"), F.countDistinct("now").alias("clusters"))


def accession_taxids(sequences: DataFrame, proteomes: DataFrame) -> DataFrame:
    """accession, taxid: first-seen pairs of the sequences' proteomes. sequences: accession, proteome, position."""
    x = sequences.join(proteomes.select("proteome", "taxid"), "proteome").filter("taxid IS NOT NULL")
    return x.groupBy("accession", "taxid").agg(F.min("position").alias("position"))
