"""Half-open weight ranges [low, high): union, difference, and the edges they hide."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(ranges: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Overlapping and touching ranges become one."""
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    order = over.orderBy("low", "high")
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("new", F.when(reach.isNull() | (F.col("low") > reach), 1).otherwise(0))
    marked = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.min("low").alias("low"), F.max("high").alias("high")).drop("island")


def subtract(ranges: DataFrame, low: float, high: float) -> DataFrame:
    """Ranges without [low, high); one that holds it is split in two."""
    own = [c for c in ranges.columns if c not in ("low", "high")]
    a, b = F.col("low"), F.col("high")
    left = F.struct(a.alias("low"), F.least(b, F.lit(low)).alias("high"))
    right = F.struct(F.greatest(a, F.lit(high)).alias("low"), b.alias("high"))
    rest = F.filter(F.array(left, right), lambda r: r["low"] < r["high"])
    apart = (b <= low) | (a >= high)
    kept = F.when(apart, F.array(F.struct("low", "high"))).otherwise(rest)
    return ranges.select(*own, F.explode(kept).alias("r")).select(*own, "r.low", "r.high")


def hidden(edges: DataFrame, ranges: DataFrame, weight: str = "weight") -> DataFrame:
    """Edges whose weight lies in a range; other columns as they are. The ranges are merged first and are few
    (at most a thousand by the rules of an edit), so they go to all edges as one array."""
    few = merge(ranges).agg(F.collect_list(F.struct("low", "high"))).scalar()
    w = F.col(weight)
    held = edges.withColumn("__ranges", few)
    return held.filter(F.exists("__ranges", lambda r: (w >= r["low"]) & (w < r["high"]))).drop("__ranges")


def highlight(edges: DataFrame, layers: DataFrame, weight: str = "weight") -> DataFrame:
    """Edges with the color of the last layer whose closed range [low, high] holds their weight, else null."""
    few = layers.agg(F.sort_array(F.collect_list(F.struct("layer", "low", "high", "color")))).scalar()
    w = F.col(weight)
    fits = F.filter("__layers", lambda r: (w >= r["low"]) & (w <= r["high"]))
    return edges.withColumn("__layers", few).withColumn("color", F.try_element_at(fits, F.lit(-1))["color"]).drop("__layers")
