"""Roll-up views of a clustered network, cluster members, centrality, highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import looked_up


def view(nodes: DataFrame, edges: DataFrame, expanded: DataFrame | None = None, hidden_nodes: DataFrame | None = None, hidden_edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """View nodes (id, kind, size) and edges (a, b, total, pairs, weight).

    A visible node stands for itself if it has no cluster or its cluster is expanded, else its cluster stands
    for it. Edges between representatives are added up (null weights are 0) and divided by the product of
    their sizes; a protein's size is 1, a cluster's the number of its visible members."""
    seen = nodes if hidden_nodes is None else nodes.join(hidden_nodes.select("id"), "id", "left_anti")
    seen = seen.select("id", "nh_id")
    if expanded is None:
        open_ = seen.withColumn("open", F.lit(False))
    else:
        open_ = seen.join(expanded.select("nh_id").distinct().withColumn("open", F.lit(True)), "nh_id", "left")
    alone = F.col("nh_id").isNull() | F.coalesce("open", F.lit(False))
    rep = open_.select("id", F.when(alone, F.col("id")).otherwise(F.col("nh_id")).alias("rep"), F.when(alone, "protein").otherwise("cluster").alias("kind"))
    shown = rep.groupBy(F.col("rep").alias("id"), "kind").agg(F.count(F.lit(1)).alias("size"))
    kept = edges if hidden_edges is None else edges.join(hidden_edges.select("id"), "id", "left_anti")
    a = rep.select(F.col("id").alias("node1"), F.col("rep").alias("ra"))
    b = rep.select(F.col("id").alias("node2"), F.col("rep").alias("rb"))
    linked = kept.select("node1", "node2", "weight").join(a, "node1").join(b, "node2").filter("ra <> rb")
    total = linked.groupBy(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).agg(F.sum(F.coalesce("weight", F.lit(0))).alias("total"))
    sizes = shown.groupBy("id").agg(F.sum("size").alias("size"))
    out = total.join(sizes.select(F.col("id").alias("a"), F.col("size").alias("sa")), "a").join(sizes.select(F.col("id").alias("b"), F.col("size").alias("sb")), "b")
    pairs = F.col("sa") * F.col("sb")
    return shown, out.select("a", "b", "total", pairs.alias("pairs"), (F.col("total") / pairs).alias("weight"))


def members(nodes: DataFrame, cluster: str, hidden: DataFrame | None = None) -> DataFrame:
    """Nodes of a cluster, the visible ones if `hidden` is given."""
    own = nodes.filter(F.col("nh_id") == cluster)
    return own if hidden is None else own.join(hidden.select("id"), "id", "left_anti")


def resolve(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """id: asked ids that are nodes, and the members of those that are clusters instead."""
    asked = ids.select("id").distinct()
    direct = asked.join(nodes.select("id"), "id", "left_semi")
    rest = asked.join(nodes.select("id"), "id", "left_anti").withColumnRenamed("id", "nh_id")
    return direct.union(nodes.join(rest, "nh_id", "left_semi").select("id")).distinct()


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, total, centrality: weights to neighbours of the node's own cluster over the cluster's stated size
    (nh_size); 0 without a cluster or with a size of at most 1. `edges` holds the visible edges only."""
    n = nodes.select("id", "nh_id")
    a = n.select(F.col("id").alias("node1"), F.col("nh_id").alias("ca"))
    b = n.select(F.col("id").alias("node2"), F.col("nh_id").alias("cb"))
    inner = edges.filter("node1 <> node2").join(looked_up(a), "node1").join(looked_up(b), "node2").filter("ca = cb")
    both = inner.select(F.explode(F.array("node1", "node2")).alias("id"), "weight")
    total = both.groupBy("id").agg(F.sum("weight").alias("total"))
    out = nodes.join(total, "id", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    size = F.col("nh_size").try_cast("double") if dict(nodes.dtypes)["nh_size"] == "string" else F.col("nh_size").cast("double")
    good = F.col("nh_id").isNotNull() & (size > 1) & (size < float("inf"))
    return out.select("id", "total", F.when(good, F.col("total") / size).otherwise(0.0).alias("centrality"))


def derived_highlights(matches: DataFrame, nodes: DataFrame, expanded: DataFrame) -> DataFrame:
    """id, colors: a matched node's colors show on the node, or on its cluster while that is collapsed; each
    color once, in the order of the layers. matches: id, layer, color."""
    x = matches.join(nodes.select("id", "nh_id"), "id").join(expanded.select("nh_id").distinct().withColumn("open", F.lit(True)), "nh_id", "left")
    shown = F.when(F.col("nh_id").isNull() | F.col("open").isNotNull(), F.col("id")).otherwise(F.col("nh_id"))
    first = x.groupBy(shown.alias("id"), "color").agg(F.min("layer").alias("layer"))
    colors = F.transform(F.sort_array(F.collect_list(F.struct("layer", "color"))), lambda s: s["color"])
    return first.groupBy("id").agg(colors.alias("colors"))


def selected_taxids(selected: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct taxids of the selected nodes, clusters standing for their members."""
    return resolve(selected, nodes).join(nodes.select("id", "taxid"), "id").filter("taxid IS NOT NULL").select("taxid").distinct()


def greatest_weight(edges: DataFrame) -> DataFrame:
    """One row: the largest finite weight, clamped to 0 and 1."""
    finite = F.when(F.abs(F.col("weight").cast("double")) < float("inf"), F.col("weight").cast("double"))
    return edges.agg(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.max(finite), F.lit(0.0)))).alias("greatest"))


def export_rows(nodes: DataFrame, per_line: int = 5) -> DataFrame:
    """nh_id, line, ids: members in order, a few on a line."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("nh_id").orderBy("id")) - 1
    x = nodes.filter("nh_id IS NOT NULL").select("nh_id", "id", k.alias("k"))
    lines = x.groupBy("nh_id", F.floor(F.col("k") / per_line).cast("long").alias("line")).agg(F.sort_array(F.collect_list(F.struct("k", "id"))).alias("s"))
    return lines.select("nh_id", "line", F.array_join(F.transform("s", lambda s: s["id"]), ", ").alias("ids"))


def by_centrality(members: DataFrame) -> DataFrame:
    """Members of clusters (id, nh_id, centrality) with their place: the most central first, then by id."""
    return members.withColumn("place", F.row_number().over(Window.partitionBy("nh_id").orderBy(F.desc("centrality"), "id")))
