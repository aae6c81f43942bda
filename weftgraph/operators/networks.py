"""Networks by source: canonical edges, members, scoped search, counts, payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import edge_id
from ..shared import looked_up, numbered


def canonicalize(edges: DataFrame, how: str = "max", keys: tuple[str, ...] = (), u: str = "u", v: str = "v", w: str = "w", order: str = "row") -> DataFrame:
    """keys, node1, node2, weight: ends in order, no self loops, one row per pair. how: max, mean, sum or
    first by `order`."""
    agg = {"max": F.max(w), "mean": F.avg(w), "sum": F.sum(w), "first": F.min_by(w, order) if how == "first" else F.max(w)}[how]
    kept = edges.filter(F.col(u) != F.col(v))
    return kept.groupBy(*keys, F.least(u, v).alias("node1"), F.greatest(u, v).alias("node2")).agg(agg.alias("weight"))


def with_ids(edges: DataFrame) -> DataFrame:
    return edges.withColumn("id", edge_id(F.col("node1"), F.col("node2")))


def duplicate_edges(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """source, node1, node2, n of pairs that occur more than once in a network: such a network is refused."""
    return edges.groupBy("source", F.least(u, v).alias("node1"), F.greatest(u, v).alias("node2")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def scoped_nodes(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """source, id: members and ends of edges."""
    ends = edges.select("source", F.explode(F.array("node1", "node2")).alias("id"))
    both = ends if members is None else ends.union(members.select("source", "id"))
    return both.distinct()


def list_networks(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    names = edges.select("source")
    return (names if members is None else names.union(members.select("source"))).distinct().orderBy("source")


def network_counts(edges: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """source, nodes, edges, ready: ready networks have edges."""
    n = scoped_nodes(edges, members).groupBy("source").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.groupBy("source").agg(F.count(F.lit(1)).alias("edges"))
    return n.join(e, "source", "left").select("source", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), (F.coalesce("edges", F.lit(0)) > 0).alias("ready"))


def search_ids(nodes: DataFrame, scope: DataFrame, source: str, ids: DataFrame) -> DataFrame:
    """id, nh_id of the asked ids that lie in the network."""
    own = scope.filter(F.col("source") == source).select("id")
    return nodes.join(ids.select("id").distinct(), "id", "left_semi").join(own, "id", "left_semi").select("id", "nh_id")


def search_taxids(nodes: DataFrame, scope: DataFrame, source: str, taxids: list[str]) -> DataFrame:
    """id, taxid, nh_id of the network's nodes of some taxa."""
    own = scope.filter(F.col("source") == source).select("id")
    return nodes.filter(F.col("taxid").isin([str(t) for t in taxids])).join(own, "id", "left_semi").select("id", "taxid", "nh_id")


def attributes_json(columns: dict[str, Column]) -> Column:
    """JSON object of the values that are not blank."""
    return F.to_json(F.struct(*[F.nullif(F.trim(c), F.lit("")).alias(k) for k, c in columns.items()]))


def load(nodes: DataFrame, edges: DataFrame, source: str, members: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes of a network, with attributes where known, and its edges with ids."""
    own = edges.filter(F.col("source") == source)
    mine = scoped_nodes(own, None if members is None else members.filter(F.col("source") == source)).select("id")
    return mine.join(nodes, "id", "left"), with_ids(own)


def payload(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text per element, group nodes or edges: the shape of the web payload, one row each."""
    n = nodes.select(F.lit("nodes").alias("group"), F.to_json(F.struct(F.struct("*").alias("data"))).alias("element"))
    e = edges.select(F.lit("edges").alias("group"), F.to_json(F.struct(F.struct("id", F.col("node1").alias("source"), F.col("node2").alias("target"), "weight").alias("data"))).alias("element"))
    return n.union(e)


def adjacency(edges: DataFrame, top_k: int | None = None, u: str = "node1", v: str = "node2", w: str = "weight") -> DataFrame:
    """src, dst, weight in both directions; with top_k the heaviest of each node, ties by dst, so it need not
    be symmetric any more."""
    both = edges.select(F.col(u).alias("src"), F.col(v).alias("dst"), F.col(w).alias("weight")).union(edges.select(v, u, w))
    if top_k is None:
        return both
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    return both.withColumn("rank", rank).filter(F.col("rank") <= top_k).drop("rank")


def degrees(adj: DataFrame) -> DataFrame:
    """src, degree."""
    return adj.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))


def dense_ids(names: DataFrame, name: str = "name", order: str = "position") -> DataFrame:
    """name, id from 0 in order of first appearance, names that appear together in their own order."""
    first = names.groupBy(name).agg(F.min(order).alias("position"))
    return numbered(first, "position", name).select(name, (F.col("line") - 1).cast("long").alias("id"))


def encode(edges: DataFrame, ids: DataFrame, u: str = "node1", v: str = "node2", w: str = "weight") -> DataFrame:
    """src, dst, weight by dense ids."""
    a = ids.select(F.col("name").alias(u), F.col("id").alias("src"))
    b = ids.select(F.col("name").alias(v), F.col("id").alias("dst"))
    return edges.join(looked_up(a), u).join(looked_up(b), v).select("src", "dst", w)


def check_dense(ids: DataFrame, column: str = "id") -> DataFrame:
    """least, most, distinct, dense: whether the ids are 0 to n - 1."""
    got = ids.agg(F.min(column).alias("least"), F.max(column).alias("most"), F.countDistinct(column).alias("ids"))
    return got.withColumn("dense", (F.col("least") == 0) & (F.col("most") == F.col("ids") - 1))


def duplicate_nodes(attributes: DataFrame, order: str = "line") -> DataFrame:
    """id, first_at, again_at: each repeat beside the first place of its node."""
    w = Window.partitionBy("id").orderBy(order)
    x = attributes.withColumns({"first_at": F.first(order).over(w), "again_at": F.col(order), "k": F.row_number().over(w)})
    return x.filter("k > 1").select("id", "first_at", "again_at")


def conflicts(mapping: DataFrame, key: str = "accession", value: str = "taxid") -> DataFrame:
    """key, n, values: keys with more than one value, the values sorted and joined by semicolons."""
    values = F.array_join(F.array_sort(F.collect_set(value)), ";")
    return mapping.groupBy(key).agg(F.countDistinct(value).alias("n"), values.alias("values")).filter("n > 1")


def overlap(a: DataFrame, b: DataFrame, key: str) -> int:
    return a.select(key).distinct().join(b.select(key), key, "left_semi").count()


def missing(wanted: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Keys of `wanted` that `have` lacks."""
    return wanted.select(key).distinct().join(have.select(key), key, "left_anti")


def override(base: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Rows of `newer`, and those of `base` whose key it does not have."""
    return base.join(newer.select(key).distinct(), key, "left_anti").unionByName(newer)


def reconcile(nodes: DataFrame, attributes: DataFrame) -> DataFrame:
    """All nodes with the attributes of one file set: others lose theirs, new ones come in."""
    return nodes.select("id").join(attributes, "id", "full")


def first_rows(rows: DataFrame, order: str) -> DataFrame:
    """Distinct rows with the place of their first appearance, in that order."""
    own = [c for c in rows.columns if c != order]
    return rows.groupBy(*own).agg(F.min(order).alias(order)).orderBy(order)
