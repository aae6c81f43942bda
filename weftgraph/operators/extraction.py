"""Seeded subnetworks: reach, paths, joining of parts, induced edges.

Frontiers grow by joins on the adjacency table; only what a node budget bounds comes to the driver. Weights
are compared as 32-bit floats, ties go to the smaller id.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import TASK_ROWS, discard, stage, tasks


def reach(adj: DataFrame, seeds: DataFrame, hops: int | None = None) -> DataFrame:
    """id, hop: nodes within `hops` of the seeds (all that can be reached, if None), with their distance."""
    found = stage(seeds.select("id").distinct().withColumn("hop", F.lit(0)), "reach")
    edge, k = found, 0
    while hops is None or k < hops:
        k += 1
        nxt = adj.join(edge.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        before, edge = edge, stage(nxt.join(found.select("id"), "id", "left_anti").withColumn("hop", F.lit(k)), "frontier")
        if edge.isEmpty():
            break
        older, found = found, stage(found.union(edge), "reach")
        discard(before, older)
    return found


def component_of(adj: DataFrame, root) -> DataFrame:
    """id of the nodes connected to `root`."""
    return reach(adj, adj.sparkSession.createDataFrame([(root,)], f"id {dict(adj.dtypes)['src']}")).select("id")


#: Nodes of a batch up to which their ids are handed to the reader, ten to a list (longer ones it takes for a range).
PUSHED = 300


def _by_source(narrow: DataFrame) -> DataFrame:
    """src, near: the adjacency staged as one list for each node, in tasks of a bounded number of edges, sorted by src:
    a batch is joined with a row for each node and not for each edge."""
    plain = stage(narrow, "edges-both-ways")
    dealt = plain.repartition(tasks(narrow.sparkSession, plain.count()), "src")
    out = stage(dealt.groupBy("src").agg(F.collect_list(F.struct("dst", "weight")).alias("near")).sortWithinPartitions("src"), "adjacency")
    discard(plain)
    return out


class Neighbours:
    """Neighbour lists on demand, a batch per join, kept on the driver; heaviest first, then by id."""

    def __init__(self, adj: DataFrame, stored: bool = False):
        """stored: adj is a table (bucketed by src, at best) and need not be staged."""
        narrow = adj.select("src", "dst", F.col("weight").cast("float").alias("weight"))
        self.adj, self.listed = (narrow, False) if stored else (_by_source(narrow), True)
        self.kind = dict(adj.dtypes)["src"]
        self.held: dict = {}

    def fetch(self, ids) -> None:
        want = [(i,) for i in sorted(set(ids)) if i not in self.held]
        if not want:
            return
        asked = self.adj.sparkSession.createDataFrame(want, f"src {self.kind}")
        lists: dict = defaultdict(dict)
        rows = self.adj
        if len(want) <= PUSHED:  # the reader skips what has none of them
            ids = [i for (i,) in want]
            rows = rows.filter(reduce(or_, (F.col("src").isin(ids[i : i + 10]) for i in range(0, len(ids), 10))))
        met = rows.join(F.broadcast(asked), "src")
        # one job for a batch, all parts at once: an iterator would start a job for each part of the table
        for r in (met.select("src", F.inline("near")) if self.listed else met).collect():
            lists[r["src"]][r["dst"]] = max(r["weight"], lists[r["src"]].get(r["dst"], -np.inf))
        for (i,) in want:
            self.held[i] = sorted(lists.get(i, {}).items(), key=lambda x: (-x[1], x[0]))

    def __getitem__(self, node) -> list[tuple]:
        if node not in self.held:
            self.fetch([node])
        return self.held[node]

    def ahead(self, node, heap: list, most: int = 256) -> list[tuple]:
        """The node's list; if it must be fetched, the best of the heap come along in the same join."""
        if node not in self.held:
            self.fetch([node, *(y for _, y in heapq.nsmallest(most, heap))])
        return self.held[node]


def shortest_link(near: Neighbours, a: set, b: set, budget: int) -> list | None:
    """Nodes between the sets on a path of fewest steps (the ends, which the sets have, left out); None if it
    needs more than the budget, or more than max(10000, 1000 * budget) nodes were seen. The smaller frontier
    grows; parents are the smallest ids."""
    if a & b:
        return []
    most = max(10_000, 1000 * budget)
    parent = ({x: None for x in a}, {x: None for x in b})
    edge = [set(a), set(b)]
    steps = 0
    while edge[0] and edge[1] and sum(map(len, parent)) <= most and steps <= budget:
        k = 0 if len(edge[0]) <= len(edge[1]) else 1
        near.fetch(edge[k])
        nxt: set = set()
        for x in sorted(edge[k]):
            for y, _ in sorted(near[x]):
                if y not in parent[k]:
                    parent[k][y] = x
                    nxt.add(y)
        meet = sorted(y for y in nxt if y in parent[1 - k])
        if meet:
            path = []
            for side in (0, 1):
                x, own = meet[0], []
                while x is not None:
                    own.append(x)
                    x = parent[side][x]
                path = own[::-1] if side == 0 else path + own[1:]
            inner = [x for x in path if x not in a and x not in b]
            return inner if len(inner) <= budget else None
        edge[k] = nxt
        steps += 1
    return None


def shortest_path(adj: DataFrame, a: DataFrame, b: DataFrame, budget: int, most: int | None = None) -> DataFrame:
    """step, id: the nodes between two sets (`id`) on a path of fewest steps, as `shortest_link` gives them, with labels and
    frontiers as tables: the smaller frontier grows by a join, a node's parent is the least of those that reach it.
    What the driver sees are counts, the node where the sides meet, and the path. Empty if the sets share a node, or if
    there is no path within the budget, or, where `most` is given, none before so many nodes were seen."""
    spark, kind = adj.sparkSession, dict(adj.dtypes)["src"]
    near = stage(adj.select("src", "dst").distinct(), "neighbours")
    start = [x.select(F.col("id").cast(kind).alias("id")).distinct() for x in (a, b)]
    labels = [stage(x.withColumn("parent", F.lit(None).cast(kind)), "labels") for x in start]
    edge, size = list(labels), [x.count() for x in labels]
    seen, steps, path = list(size), 0, []
    if not labels[0].join(labels[1], "id", "left_semi").isEmpty():
        size = [0, 0]
    while all(size) and (most is None or sum(seen) <= most) and steps <= budget:
        k = 0 if size[0] <= size[1] else 1
        reached = edge[k].select(F.col("id").alias("src")).join(near, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
        edge[k] = stage(reached.join(labels[k].select("id"), "id", "left_anti"), "frontier")
        labels[k] = stage(labels[k].unionByName(edge[k]), "labels")
        size[k] = edge[k].count()
        seen[k] += size[k]
        meet = edge[k].join(labels[1 - k].select("id"), "id", "left_semi").agg(F.min("id").alias("id")).first()["id"]
        if meet is not None:
            sides = []
            for side in labels:
                own = [meet]
                while (up := side.filter(F.col("id") == own[-1]).first()["parent"]) is not None:
                    own.append(up)  # one lookup for each step, which the budget bounds
                sides.append(own)
            inner = [*sides[0][::-1], *sides[1][1:]]
            ends = {r["id"] for x in start for r in x.filter(F.col("id").isin(inner)).collect()}
            inner = [x for x in inner if x not in ends]
            path = inner if len(inner) <= budget else []
            break
        steps += 1
    return spark.createDataFrame(list(enumerate(path)), f"step int, id {kind}")


def parts_of(near: Neighbours, nodes: set) -> list[set]:
    """Connected parts of the graph between the nodes, the largest first, ties by smallest id."""
    left, out = set(nodes), []
    near.fetch(nodes)
    while left:
        todo, own = [min(left)], set()
        while todo:
            x = todo.pop()
            if x in own:
                continue
            own.add(x)
            todo += [y for y, _ in near[x] if y in left and y not in own]
        left -= own
        out.append(own)
    return sorted(out, key=lambda s: (-len(s), min(s)))


@dataclass
class Extraction:
    """Chosen nodes with the seeds they belong to, and messages."""

    nodes: dict = field(default_factory=dict)
    missing: list = field(default_factory=list)


def _stitch(near: Neighbours, chosen: dict, budget: int) -> int:
    """Join parts to the largest one over bridges that fit the budget; a bridge belongs to both sides' seeds."""
    parts = parts_of(near, set(chosen))
    main = parts[0]
    for part in parts[1:]:
        if budget <= 0:
            break
        link = shortest_link(near, main, part, budget)
        if link is None:
            continue
        seeds = set().union(*(chosen[x] for x in part), *(chosen[x] for x in main))
        for x in link:
            chosen[x] = set(seeds)
        budget -= len(link)
        main = main | part | set(link)
    return budget


def extract_nodes(adj: DataFrame, seeds: list, max_nodes: int = 500, local_fraction: float = 0.3, stitch: bool = True, stored: bool = False) -> Extraction:
    """Nodes around the seeds: first each seed in turn takes its best neighbours up to a quota, then parts are
    stitched, then the rest of the budget goes to the nodes whose best weights to the seeds add up highest."""
    near = Neighbours(adj, stored)
    near.fetch(seeds)
    out = Extraction()
    seeds = list(dict.fromkeys(seeds))
    out.missing = [s for s in seeds if not near[s]]
    seeds = [s for s in seeds if near[s]]
    if not seeds:
        raise ValueError("no seed is in the network")
    chosen = {s: {s} for s in seeds}
    budget = max_nodes - len(seeds)
    score: dict = defaultdict(dict)  # node -> seed -> best weight
    heaps: dict = {}

    def see(node, owners, weight) -> None:
        for s in owners:
            score[node][s] = max(weight, score[node].get(s, -np.inf))

    for s in seeds:
        heaps[s] = [(-w, y) for y, w in near[s]]
        heapq.heapify(heaps[s])
        for y, w in near[s]:
            see(y, [s], w)
    quota = {s: max(5, int(local_fraction * max_nodes / len(seeds))) for s in seeds}
    active = list(seeds)
    while budget > 0 and active:
        idle = True
        for s in list(active):
            if budget <= 0:
                break
            while heaps[s] and heaps[s][0][1] in chosen:
                heapq.heappop(heaps[s])
            if not heaps[s] or quota[s] <= 0:
                active.remove(s)
                continue
            _, y = heapq.heappop(heaps[s])
            chosen[y] = {s}
            budget, quota[s], idle = budget - 1, quota[s] - 1, False
            for z, w in near.ahead(y, heaps[s]):
                see(z, [s], w)
                if z not in chosen:
                    heapq.heappush(heaps[s], (-w, z))
        if idle:
            break
    for x in chosen:
        chosen[x] |= set(score.get(x, {}))
    if budget > 0 and stitch and len(seeds) > 1:
        budget = _stitch(near, chosen, budget)
    if budget > 0:
        near.fetch(chosen)
        for x in list(chosen):
            for y, w in near[x]:
                see(y, chosen[x], w)
        heap = [(-sum(v.values()), y) for y, v in score.items() if y not in chosen]
        heapq.heapify(heap)
        while budget > 0 and heap:
            negative, y = heapq.heappop(heap)
            if y in chosen or -negative != sum(score[y].values()):
                continue  # an older entry of a node whose score has grown
            chosen[y] = set(score[y])
            budget -= 1
            for z, w in near.ahead(y, heap):
                if z not in chosen:
                    before = sum(score[z].values())
                    see(z, chosen[y], w)
                    if sum(score[z].values()) != before:
                        heapq.heappush(heap, (-sum(score[z].values()), z))
        if stitch and len(seeds) > 1 and budget > 0:
            _stitch(near, chosen, budget)
    if len(seeds) == 1:
        own = next(p for p in parts_of(near, set(chosen)) if seeds[0] in p)
        chosen = {x: v for x, v in chosen.items() if x in own}
    out.nodes = chosen
    return out


def induced(adj: DataFrame, ids: DataFrame) -> DataFrame:
    """node1, node2, weight of the edges between the nodes, each once, its heaviest duplicate; an edge counts
    if the smaller end lists it."""
    i = ids.select("id")
    x = adj.filter(F.col("dst") > F.col("src")).join(i.withColumnRenamed("id", "src"), "src", "left_semi").join(i.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return x.groupBy(F.col("src").alias("node1"), F.col("dst").alias("node2")).agg(F.max("weight").alias("weight"))


def extract(adj: DataFrame, seeds: list, max_nodes: int = 500, local_fraction: float = 0.3, stitch: bool = True, stored: bool = False) -> tuple[DataFrame, Extraction]:
    """Edges of the extracted subnetwork, and what was chosen."""
    got = extract_nodes(adj, seeds, max_nodes, local_fraction, stitch, stored)
    ids = adj.sparkSession.createDataFrame([(x,) for x in got.nodes], f"id {dict(adj.dtypes)['src']}")
    return induced(adj, F.broadcast(ids)), got


def candidate_scores(adj: DataFrame, owners: DataFrame) -> DataFrame:
    """id, seeds, score: for each node next to chosen ones, the best weight to each seed, added over seeds.
    owners: id, seed of the chosen nodes."""
    x = adj.join(owners.withColumnRenamed("id", "src"), "src").join(owners.select(F.col("id").alias("dst")).distinct(), "dst", "left_anti")
    best = x.groupBy(F.col("dst").alias("id"), "seed").agg(F.max("weight").alias("best"))
    return best.groupBy("id").agg(F.count(F.lit(1)).alias("seeds"), F.sum("best").alias("score"))
