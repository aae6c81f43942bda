"""Taxonomy trees as flat tables: parsing, names, paths, statistics, selection."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import in_ranges, numbered, stage  # noqa: F401

NODE = "node string, parent string, name string, taxid string"


def parse_lines(lines: DataFrame) -> DataFrame:
    """line, depth, name of a drawn tree. lines: line (number), text. A name starts at the first letter, digit
    or bracket; what stands before it gives the depth; blank lines and rules are skipped."""
    at = F.regexp_instr("text", F.lit("[A-Za-z0-9\\[]"))
    x = lines.filter(~F.trim("text").rlike("^-*$")).withColumn("at", at).filter("at > 0")
    before = F.col("at") - 1
    depth = F.when(before < 2, 0).otherwise(F.floor((before - 2) / 2) + 1)
    return x.select("line", depth.cast("int").alias("depth"), F.trim(F.substr("text", F.col("at"))).alias("name"))


def _latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last `over` above each row that asks (`own`), among the rows of its keys."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("found", F.last("over", ignorenulls=True).over(w)).filter("own").drop("own", "over")


def build(parsed: DataFrame) -> DataFrame:
    """line, depth, name, parent (line): the parent is the latest line above of one depth less, wherever that
    is; depth 0 has none.

    A scan in three steps: lines lie in ranges; of each range the last line of each depth is all that later ranges
    need to know of it; a line takes its parent from its own range, or else from the last range that has one."""
    none = F.lit(None).cast(dict(parsed.dtypes)["line"])
    ranged = in_ranges(parsed.select("line", "depth", "name"), "line")
    child = ranged.select("part", "line", "depth", "name", F.col("depth").alias("level"), none.alias("over"), F.lit(True).alias("own"))
    above = ranged.select("part", "line", "depth", "name", (F.col("depth") + 1).alias("level"), F.col("line").alias("over"), F.lit(False).alias("own"))
    local = _latest(child.union(above), ["part", "level"], ["line"])
    # as many rows as ranges have depths, whatever the number of lines
    last = ranged.groupBy("part", (F.col("depth") + 1).alias("level")).agg(F.max("line").alias("over")).withColumn("own", F.lit(False))
    asked = ranged.select("part", F.col("depth").alias("level")).distinct().select("part", "level", none.alias("over"), F.lit(True).alias("own"))
    carried = _latest(last.union(asked), ["level"], ["part", F.desc("own")]).withColumnRenamed("found", "carried")
    out = local.join(carried, ["part", "level"], "left")
    return out.select("line", "depth", "name", F.coalesce("found", "carried").alias("parent"))


def without_orphans(parsed: DataFrame) -> DataFrame:
    """The lines that have a parent, or need none; the others are named in a warning. What hangs on a line that
    is left out goes too, so there are at most as many rounds as depths."""
    while True:
        orphans = stage(build(parsed).filter("depth > 0 AND parent IS NULL").select("line", "name"), "orphans")
        some = orphans.orderBy("line").limit(20).collect()
        if not some:
            return parsed
        warnings.warn("lines without a parent are left out: " + ", ".join(f"{r['line']} {r['name']}" for r in some), stacklevel=2)
        parsed = parsed.join(orphans.select("line"), "line", "left_anti")


def paths(tree: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, ancestor, steps: each node with itself (0) and all above it, for nodes under a root (no parent).
    Levels are joined from the roots down, as many joins as the tree is deep."""
    t = tree.select(F.col(node).alias("node"), F.col(parent).alias("parent"))
    level = stage(t.filter("parent IS NULL").select("node", F.array("node").alias("path")), "level")
    out = level
    while True:
        level = stage(t.join(level.withColumnRenamed("node", "parent"), "parent").select("node", F.concat(F.array("node"), "path").alias("path")), "level")
        if level.isEmpty():
            break
        out = out.union(level)
    return out.select("node", F.posexplode("path").alias("steps", "ancestor"))


def annotate(tree: DataFrame, names: DataFrame, database: DataFrame) -> DataFrame:
    """tree with taxid by lower-case name (the last line of a name counts) and is_db, whether the database has
    that taxid. names: line, taxid, name. database: taxid."""
    last = names.groupBy(F.lower("name").alias("key")).agg(F.max_by("taxid", "line").alias("taxid"))
    x = tree.drop("taxid").withColumn("key", F.lower("name")).join(last, "key", "left").drop("key")
    db = database.select("taxid").distinct().withColumn("is_db", F.lit(True))
    return x.join(db, "taxid", "left").withColumn("is_db", F.coalesce("is_db", F.lit(False)))


def statistics(annotated: DataFrame) -> DataFrame:
    """One row: total, annotated, database."""
    return annotated.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("taxid").isNotNull()).alias("annotated"), F.count_if(F.col("is_db")).alias("database"))


def subtree_counts(ancestry: DataFrame, marked: DataFrame) -> DataFrame:
    """node, n: marked nodes at and below each node."""
    x = ancestry.join(marked.select("node").distinct(), "node", "left_semi")
    n = x.groupBy(F.col("ancestor").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return ancestry.select("node").distinct().join(n, "node", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def tri_state(ancestry: DataFrame, selectable: DataFrame, selected: DataFrame) -> DataFrame:
    """node, state: 0 none, 1 some, 2 all of the selectable nodes at and below a node are selected."""
    s = subtree_counts(ancestry, selectable).withColumnRenamed("n", "all")
    c = subtree_counts(ancestry, selected.join(selectable.select("node"), "node", "left_semi")).withColumnRenamed("n", "own")
    state = F.when(F.col("own") == 0, 0).when(F.col("own") == F.col("all"), 2).otherwise(1)
    return s.join(c, "node").select("node", state.alias("state"))


def set_subtree(ancestry: DataFrame, selectable: DataFrame, selected: DataFrame, root: str, on: bool) -> DataFrame:
    """Selection after a subtree was switched on or off."""
    below = ancestry.filter(F.col("ancestor") == root).select("node").join(selectable.select("node"), "node", "left_semi")
    return selected.select("node").union(below).distinct() if on else selected.select("node").join(below, "node", "left_anti")


def filter_names(tree: DataFrame, ancestry: DataFrame, text: str) -> DataFrame:
    """node, matched: nodes whose name has the text, in any case, and all above them."""
    hit = tree.filter(F.contains(F.lower("name"), F.lit(text.lower()))).select("node")
    shown = ancestry.join(hit, "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()
    return shown.join(hit.withColumn("m", F.lit(True)), "node", "left").select("node", F.coalesce("m", F.lit(False)).alias("matched"))
