"""Edits of a network: what is hidden, what stays visible, and how an edit is stored."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import intervals


@dataclass(frozen=True)
class Edit:
    """Hidden node ids (id), hidden edge ids (id), hidden ranges (low, high)."""

    nodes: DataFrame
    edges: DataFrame
    ranges: DataFrame

    @staticmethod
    def none(spark) -> "Edit":
        return Edit(spark.createDataFrame([], "id string"), spark.createDataFrame([], "id string"), spark.createDataFrame([], "low double, high double"))

    def hide_nodes(self, ids: DataFrame) -> "Edit":
        return replace(self, nodes=self.nodes.union(ids.select("id")).distinct())

    def show_nodes(self, ids: DataFrame) -> "Edit":
        return replace(self, nodes=self.nodes.join(ids.select("id"), "id", "left_anti"))

    def hide_edges(self, ids: DataFrame) -> "Edit":
        return replace(self, edges=self.edges.union(ids.select("id")).distinct())

    def show_edges(self, ids: DataFrame, all_edges: DataFrame) -> "Edit":
        """Explicit showing ends the ranges: what they hid and is not shown becomes hidden by id."""
        by_range = intervals.hidden(all_edges, self.ranges).select("id")
        left = self.edges.union(by_range).distinct().join(ids.select("id"), "id", "left_anti")
        return replace(self, edges=left, ranges=self.ranges.limit(0))

    def hide_range(self, low: float, high: float) -> "Edit":
        new = self.ranges.sparkSession.createDataFrame([(float(low), float(high))], "low double, high double")
        return replace(self, ranges=intervals.merge(self.ranges.union(new)))

    def show_range(self, low: float, high: float) -> "Edit":
        return replace(self, ranges=intervals.subtract(self.ranges, low, high))

    def hide_below(self, weight: float) -> "Edit":
        return self.hide_range(0.0, weight)

    def show_all_edges(self) -> "Edit":
        return replace(self, edges=self.edges.limit(0), ranges=self.ranges.limit(0))


def visible_edges(edges: DataFrame, edit: Edit) -> DataFrame:
    """Edges (id, node1, node2, weight, ...) that are not hidden and whose ends are not."""
    by_range = intervals.hidden(edges, edit.ranges).select("id")
    gone = edit.edges.select("id").union(by_range).distinct()
    ends = edit.nodes.select("id")
    out = edges.join(gone, "id", "left_anti")
    return out.join(ends.withColumnRenamed("id", "node1"), "node1", "left_anti").join(ends.withColumnRenamed("id", "node2"), "node2", "left_anti").select(*edges.columns)


def edited_network(nodes: DataFrame, edges: DataFrame, edit: Edit) -> tuple[DataFrame, DataFrame]:
    """Members (all visible nodes, isolated ones too) and edges of the edited network; refused if empty."""
    members = nodes.select("id").join(edit.nodes.select("id"), "id", "left_anti")
    if members.isEmpty():
        raise ValueError("the edit hides every node")
    return members, visible_edges(edges, edit)


def payload(edges: DataFrame, edit: Edit) -> DataFrame:
    """id of the edges that are hidden by id and not by a range: with the ranges, all an edit needs."""
    by_range = intervals.hidden(edges, edit.ranges).select("id")
    return edit.edges.join(by_range, "id", "left_anti")


def statistics(nodes: DataFrame, edges: DataFrame, edit: Edit) -> DataFrame:
    """One row: nodes, hidden_nodes, edges, visible_edges."""
    one = F.count(F.lit(1))
    hidden_nodes = nodes.join(edit.nodes, "id", "left_semi").agg(one).scalar()
    return nodes.agg(one.alias("nodes")).select(
        "nodes", hidden_nodes.alias("hidden_nodes"), edges.agg(one).scalar().alias("edges"), visible_edges(edges, edit).agg(one).scalar().alias("visible_edges")
    )


def below(edges: DataFrame, weight: float) -> DataFrame:
    """Edges lighter than `weight`, which lies strictly between 0 and 1 on the scale of the weights."""
    return edges.filter(F.col("weight") < weight)


def restorable(edges: DataFrame, edit: Edit, weight: float) -> DataFrame:
    """Edges heavier than `weight` that a range hides."""
    return intervals.hidden(edges, edit.ranges).filter(F.col("weight") > weight)
