"""Providers, derivations, alignment end to end, refinement, and properties that hold for any input."""

import math
import random
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.functions import validation
from weftgraph.operators import alignment, communities, extraction, graphs, kmer_index, networks, ranking, sji
from weftgraph.sources import providers


def test_batches_are_halved_and_errors_stay_single():
    asked = []

    def service(ids):
        asked.append(len(ids))
        if "bad" in ids:
            raise providers.Refused
        return {i: i.upper() for i in ids if i != "none"}

    got = providers.map_ids(["a", "b", "bad", "none", "c"], service, batch=4)
    assert got == {"a": "A", "b": "B", "bad": providers.ERROR, "none": providers.NOT_FOUND, "c": "C"} and max(asked) == 4


def test_cache_ends_by_time_and_number():
    now, calls = [0.0], []

    def service(ids):
        calls.append(list(ids))
        return {i: 1 for i in ids}

    c = providers.Cache(service, seconds=10, most=2, clock=lambda: now[0])
    c.get(["a", "b"])
    c.get(["a"])
    assert calls == [["a", "b"]]
    c.get(["c"])  # b goes: a was used later
    c.get(["a", "b"])
    assert calls[-1] == ["b"]
    now[0] = 11
    c.get(["a"])
    assert calls[-1] == ["a"]


def test_provider_over_a_table(spark):
    t = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, taxid string")
    service = providers.static_provider(spark, t, "id", "taxid")
    got = providers.map_table(spark.createDataFrame([("a",), ("x",), ("a",)], "id string"), service)
    assert sorted(map(tuple, got.collect())) == [("a", "1"), ("x", providers.NOT_FOUND)]


def test_target_chunks_are_full_and_in_order(spark):
    s = spark.createDataFrame([(0, i) for i in range(95)], "protein long, signal long").repartition(7)
    got = sorted(map(tuple, graphs.targets(s, spark.createDataFrame([(3,), (4,)], "id long"), 10).collect()))
    ids = [i for i in range(95) if i not in (3, 4)]
    assert got == [(x, k // 10) for k, x in enumerate(ids)]


def test_top_targets_equal_plain_search(spark):
    rng = random.Random(2)
    base = "".join(rng.choices("ACDEFGHIK", k=40))
    seqs = {"a": base, "b": base[:20] + "W" + base[21:], "c": "".join(rng.choices("ACDEFGHIK", k=40)), "d": base[:30], "short": "A"}
    df = spark.createDataFrame(list(seqs.items()), "id string, seq string")
    m = alignment.simple_matrix()
    got = {(r["query"], r["target"]): r["similarity"] for r in alignment.top_targets(df, df, m, 5).collect()}
    assert got["a", "a"] == 100.0 and got["a", "b"] == pytest.approx(97.5) and ("a", "short") not in got
    for (q, t), s in got.items():
        assert s == pytest.approx(alignment.similarity(alignment.clean(seqs[q]), alignment.clean(seqs[t]), m)) and s >= 27


def test_weak_pairs_and_attributes(spark):
    p = spark.createDataFrame([("10", "c"), ("9", "c"), ("x", "d")], "node string, cluster_id string")
    m = communities.metrics(spark.createDataFrame([("9", "10", 0.1)], "node1 string, node2 string, weight double"), p)
    q, m2 = communities.weak_pairs(p, m, 0.5)
    assert sorted(map(tuple, q.collect())) == [("10", "c.1"), ("9", "c.0"), ("x", "d")] and m2.count() == 3
    with pytest.raises(ValueError):
        communities.attributes(p, spark.createDataFrame([("9", "1")], "accession string, taxid string"), "n", allow_missing=False)
    with pytest.raises(ValueError):
        communities.restore(p, spark.createDataFrame([("9", "nine")], "id string, name string"))
    assert communities.cluster_seed(42, "0.1") == communities.cluster_seed(42, "0.1") != communities.cluster_seed(42, "0.2")


def test_shortest_link_budget_and_ties(spark):
    e = [("a", "c", 1.0), ("a", "b", 1.0), ("b", "z", 1.0), ("c", "z", 1.0), ("q", "r", 1.0)]
    near = extraction.Neighbours(networks.adjacency(spark.createDataFrame(e, "node1 string, node2 string, weight double")))
    assert extraction.shortest_link(near, {"a"}, {"z"}, 5) == ["b"]
    assert extraction.shortest_link(near, {"a"}, {"z"}, 0) is None and extraction.shortest_link(near, {"a"}, {"q"}, 5) is None
    assert extraction.shortest_link(near, {"a"}, {"a", "z"}, 0) == []
    assert extraction.parts_of(near, set("abqr")) == [{"a", "b"}, {"q", "r"}]


def test_shortest_path_by_joins_equals_the_search(spark):
    rng = random.Random(8)
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    for n, m in ((30, 35), (40, 90)):
        e = list({tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)})
        adj = networks.adjacency(spark.createDataFrame([(*x, 1.0) for x in e], "node1 long, node2 long, weight double"))
        near = extraction.Neighbours(adj)
        for budget in (10, 1):
            a, b = set(rng.sample(range(n), 2)), set(rng.sample(range(n), 3))
            got = [r["id"] for r in extraction.shortest_path(adj, ids(a), ids(b), budget).orderBy("step").collect()]
            assert got == (extraction.shortest_link(near, a, b, budget) or [])
    assert extraction.shortest_path(adj, ids([1]), ids([1, 2]), 5).count() == 0 and extraction.shortest_path(adj, ids([]), ids([2]), 5).count() == 0


def test_prefilter_ties_at_the_cut(spark):
    rows = [("q", f"t{i}", 10 - min(i, 3)) for i in range(9)]
    got = ranking.prefilter_keep(spark.createDataFrame(rows, "query string, target string, score int"), 2)
    assert sorted(r["target"] for r in got.collect()) == ["t0", "t1", "t2", "t3"]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.text("ab |", max_size=4), st.text("ab |", max_size=4)), max_size=5))
def test_edge_ids_are_ordered_or_refused(pairs):
    for a, b in pairs:
        try:
            (got,) = validation.edge_ids([f"{a}|{b}"])
        except ValueError:
            assert "|" in a or "|" in b or not a.strip() or not b.strip()
        else:
            x, y = got.split("|")
            assert x <= y and {x, y} == {a.strip(), b.strip()}


def test_alignment_queries_take_the_whole_table(spark, tmp_path):
    from pyspark.sql import functions as F

    from weftgraph.plans import catalogue

    p = spark.read.parquet("/root/testdata/sf0.01/part.parquet").filter("p_partkey >= 260").limit(120)
    p = p.withColumn("p_partkey", F.col("p_partkey") + 1000)
    p.write.parquet(f"{tmp_path}/part.parquet")
    p = spark.read.parquet(f"{tmp_path}/part.parquet")
    seqs = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("seq"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    top = catalogue.alg4_top_targets(spark, str(tmp_path))
    assert rows(top) == rows(alignment.top_targets(seqs, seqs, alignment.simple_matrix(), 5)) and top.select("query").distinct().count() == 120
    pairs = rows(catalogue.alg1_diagonals_whole(spark, str(tmp_path)))
    assert pairs == rows(alignment.diagonals(seqs, seqs)) and len({x[0] for x in pairs}) == 120


@pytest.mark.parametrize("name", ["win8_tree_parents", "fn3_fixed_decimals", "src13_file_keys"])
def test_line_queries_take_the_whole_table(spark, name):
    from weftgraph.plans import catalogue, inventory  # noqa: F401

    d = "/root/testdata/sf0.001"
    assert catalogue.QUERIES[f"{name}_whole"](spark, d).count() == spark.read.parquet(f"{d}/lineitem.parquet").count()


def test_network_queries_take_all_proteins(spark):
    from weftgraph.plans import bindings, catalogue, inventory  # noqa: F401

    d = "/root/testdata/sf0.001"
    proteins = {x[0] for x in bindings.signals(spark, d).select("protein").distinct().collect()}
    brand = {x[0] for x in bindings.table(spark, d, "part").filter("p_brand = 'Brand#23'").select("p_partkey").collect()}
    one_way = catalogue.QUERIES["graph16_sji_oneway_whole"](spark, d).select("a").distinct().collect()
    assert {x[0] for x in one_way} == proteins
    ends = catalogue.QUERIES["join5_missing_neighbours_whole"](spark, d).select("a", "b").collect()
    assert {x for e in ends for x in e} == proteins and brand and not {e[0] for e in ends} & brand


def plain_diagonal(q, t, k=2, ratio=1.5):
    """Best diagonal and votes by the definition; None where lengths do not fit or no k-mer is shared."""
    if min(len(q), len(t)) < k or max(len(q), len(t)) > ratio * min(len(q), len(t)):
        return None
    votes = Counter(j - i for i in range(len(q) - k + 1) for j in range(len(t) - k + 1) if q[i : i + k] == t[j : j + k])
    return max(((n, -abs(d), d) for d, n in votes.items()), default=None)


def proteins(seed, n, sets="abc"):
    rng = random.Random(seed)
    base = ["".join(rng.choices("ACDE", k=rng.choice([1, 2, 3, 9, 20, 31, 47]))) for _ in range(n)]
    return [(rng.choice(sets), f"p{i:03}", s if rng.random() < 0.7 else s.lower() + "-") for i, s in enumerate(base)]


def test_k_mer_index_equals_brute_force(spark):
    rows = proteins(3, 90)
    seqs = spark.createDataFrame(rows, "set string, id string, seq string")
    whole = {i: s.upper().strip("-") for _, i, s in rows}
    want = {(q, t): best for q, s in whole.items() for t, u in whole.items() if (best := plain_diagonal(s, u))}
    for letters in (40, 10_000):  # many chunks, or one of each band
        index = kmer_index.build_index(seqs, chunk_letters=letters)
        got = {(r["query"], r["target"]): (r["votes"], -abs(r["diagonal"]), r["diagonal"]) for r in kmer_index.search(index, index).collect()}
        assert got == want
    assert index.filter("octet_length(letters) > 10000").isEmpty()
    assert kmer_index.search(kmer_index.build_index(seqs.limit(0)), index).count() == 0


def test_proteome_and_reference_drivers_equal_brute_force(spark, tmp_path):
    rows, m = proteins(4, 60), alignment.simple_matrix()
    seqs = spark.createDataFrame(rows, "set string, id string, seq string")
    whole = {i: alignment.clean(s) for _, i, s in rows}
    own = {i: s for s, i, _ in rows}
    text = {i: "".join(chr(65 + x) for x in w) for i, w in whole.items()}

    def targets(q, among, n):
        """The n best of a query among some targets: prefilter by rank and cap, alignment, threshold, rank."""
        found = []
        for t in among:
            best = plain_diagonal(text[q], text[t])
            if best:
                d = best[2]
                same = sum(text[q][i] == text[t][i + d] for i in range(len(text[q])) if 0 <= i + d < len(text[t]))
                score = same / min(len(text[q]), len(text[t]))
                if score >= 0.05:
                    found.append((-score, t))
        found.sort()
        edge = math.ceil(1.5 * n) + 1
        kept = [t for i, (s, t) in enumerate(found) if 1 + sum(x[0] < s for x in found) <= edge and i < math.ceil(1.6 * n)]
        aligned = sorted((-alignment.similarity(whole[q], whole[t], m), t) for t in kept)
        return [(t, -s) for s, t in aligned if -s >= 27][:n]

    def got(df):
        out = defaultdict(list)
        for r in df.orderBy("query", "target_set", "rank").collect():
            out[r["query"], r["target_set"]].append((r["target"], r["similarity"]))
        return dict(out)

    def want(asked, sets_of):
        each = {(q, s): targets(q, [t for t in whole if own[t] == s], 3) for q in asked for s in sets_of(q)}
        return {k: v for k, v in each.items() if v}

    assert got(alignment.proteome_targets(seqs, m, 3)) == want(whole, lambda q: "abc")
    assert got(alignment.proteome_targets(seqs, m, 3, own_only=True)) == want(whole, lambda q: own[q])
    kmer_index.store_index(kmer_index.build_index(seqs.filter("set <> 'a'"), chunk_letters=100), f"{tmp_path}/index")
    asked = seqs.filter("set = 'a'")
    found = alignment.reference_targets(asked, kmer_index.stored_index(spark, f"{tmp_path}/index"), seqs.filter("set <> 'a'"), m, 3)
    assert got(found) == want([i for i in whole if own[i] == "a"], lambda q: "bc")


@pytest.mark.parametrize("block", [1, 7, 8192])
def test_sets_meet_block_by_block(spark, block):
    rng = random.Random(5)
    pairs = {(0, i) for i in range(1, 200)} | {(i, 0) for i in range(1, 200)} | {(1, i) for i in range(150)} | {(rng.randrange(60), rng.randrange(70)) for _ in range(500)}
    sets = defaultdict(set)
    for p, s in pairs:
        sets[p].add(s)
    df = spark.createDataFrame([*pairs, (300, None)], "protein long, signal long").union(spark.createDataFrame([(0, 1)], "protein long, signal long"))

    def index(a, b, left, right):
        x, y = left[a], right.get(b, {b})
        return (len(x & y), len(x | y))

    want = {}
    for a, b in pairs:
        if a != b and not ((b, a) in pairs and b < a and a in sets and b in sets):
            want[a, b] = index(a, b, sets, sets)
    got = {(r["a"], r["b"]): (r["inter"], r["uni"]) for r in sji.network(df, block=block).collect()}
    assert got == {k: v for k, v in want.items() if v[0]}
    less = {p: s - {p} for p, s in sets.items()}
    one_way = {(r["a"], r["b"]): (r["inter"], r["uni"]) for r in sji.network_oneway(df, df, block=block).collect()}
    assert one_way == {(a, b): v for a, b in pairs if a != b and (v := index(a, b, less, sets))[0]}


def test_no_row_grows_with_a_hub(spark):
    """A star of 5,000 leaves whose sets are the hub: the hub's set is on no row of a pair, and its blocks are bounded."""
    n, block = 5000, 256
    df = spark.range(1, n + 1).selectExpr("0L AS protein", "id AS signal").union(spark.range(1, n + 1).selectExpr("id AS protein", "0L AS signal"))
    held = sji.set_blocks(df, -(-n // block))
    assert held.selectExpr("max(size(part))").first()[0] < 1.5 * block and held.filter("protein = 0").count() == -(-n // block)
    small = sji.set_sizes(df).filter("n = 1").select("protein")
    assert held.join(small, "protein").selectExpr("sum(size(part))").first()[0] == n  # what the pairs take along: a signal each
    assert sji.network(df, min_jaccard=-1, block=block).count() == n


def test_ordinary_sets_are_one_row_whatever_the_corpus(spark):
    """Sets of two signals out of 30,000, beside one hub: only the hub's pairs are cut into blocks, and all are found."""
    n = 30_000
    ring = spark.range(n).selectExpr("id AS protein", "(id + 1) % 30000 AS signal").union(spark.range(n).selectExpr("id AS protein", "(id + 2) % 30000 AS signal"))
    df = ring.union(spark.range(1, 200).selectExpr("-1L AS protein", "id * 7 AS signal"))
    seen = []
    before, sji.set_blocks = sji.set_blocks, lambda x, blocks: seen.append(blocks) or before(x, blocks)
    try:
        out = sji.network(df, block=64)
        pairs = out.filter("a >= 0 AND b >= 0").count()
        hub = out.filter("a = -1").count()
    finally:
        sji.set_blocks = before
    assert sorted(seen) == [1, 4] and pairs == n and hub == 0


def test_pair_statuses_of_missing_neighbours_and_empty_sets(spark):
    rows = [("a", "b"), ("b", "a"), ("a", "a"), ("a", "z"), ("b", "c"), ("c", None), ("b", "c")]
    got = sji.pair_statuses(spark.createDataFrame(rows, "protein string, signal string"))
    assert {r["status"]: r["n"] for r in got.collect()} == {"scored": 2, "reciprocal_pruned": 1, "self": 1, "neighbor_missing": 2}


def test_shortest_path_from_many_nodes(spark):
    """Twelve thousand ends, more than any count of seen nodes that would have ended the search before it began."""
    n = 6000
    star = lambda base: spark.range(n).selectExpr(f"id + {base} AS node1", "-1L AS node2", "1.0 AS weight")
    adj = networks.adjacency(star(0).union(star(n)))
    ends = [spark.range(k * n, (k + 1) * n).select("id") for k in (0, 1)]
    assert [r["id"] for r in extraction.shortest_path(adj, *ends, 2).collect()] == [-1]
    assert extraction.shortest_path(adj, *ends, 2, most=100).count() == 0


def test_pairs_of_parts_are_counted_in_tasks_that_grow_with_the_lines(spark, monkeypatch):
    from weftgraph import shared
    from weftgraph.plans import bindings

    monkeypatch.setattr(bindings, "tasks", lambda spark, rows: shared.tasks(spark, rows, 1000))
    d = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{d}/lineitem.parquet").count()
    assert bindings.part_edges(spark, d).rdd.getNumPartitions() == -(-4 * lines // 1000)


def test_fixed_decimals_by_whole_numbers_equal_those_by_decimals(spark):
    from weftgraph.functions import columns as fn

    rng = random.Random(3)
    v = [0.0, -0.0, 0.5, 1.5, 2.5, 0.125, 0.375, 0.03125, 0.26875, 1e-7, 5e-8, 5e-324, 0.005, 0.015, 0.025, -0.005, 1e12, 99999.995, 123456.785, float("nan"), float("inf"), None, 1e17, 0.5 + 2**-53, 0.5 - 2**-54]
    v += [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 9) for _ in range(600)] + [rng.randint(0, 10**7) / 2 ** rng.randint(0, 40) for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in v], "v double")
    near = F.when(F.abs("v") < 1e8, F.abs("v")).otherwise(0.0)
    for digits in (0, 2, 4, 6):
        bad = df.filter(fn._units(near, digits) != fn._units_wide(near, digits))
        assert bad.count() == 0, bad.first()
    large = [1e12, 999999999999.5, -6165117920094.01, 178753913351.54767, 0.005, -0.001]
    got = [r["t"] for r in spark.createDataFrame(list(enumerate(large)), "i int, v double").orderBy("i").select(fn.fixed(F.col("v"), 2).alias("t")).collect()]
    assert got == ["1000000000000.00", "999999999999.50", "-6165117920094.01", "178753913351.55", "0.01", "0.00"]
    plan = df.select(fn.fixed(F.col("v"), 2).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert "decimal(38,0)" not in plan  # the sums are done without decimals


def test_cluster_number_of_a_long_row():
    import tracemalloc

    import numpy as np

    from weftgraph.operators import signal_calls

    v = np.sort(np.random.default_rng(1).random(20_000))[::-1].copy()
    v[:7] += 5
    tracemalloc.start()
    assert signal_calls.choose_k(v) == 7
    assert tracemalloc.get_traced_memory()[1] < 20e6  # a table of all pairs of drops would have 3.2 GB
    tracemalloc.stop()


def test_search_hands_on_pairs_in_bounded_batches(spark, monkeypatch):
    monkeypatch.setattr(kmer_index, "BATCH_ROWS", 50)
    df = spark.range(40).selectExpr("id", "'ABCABCAB' AS seq")
    index = kmer_index.build_index(df)
    index = spark.createDataFrame(index.collect(), index.schema)
    held = {}
    monkeypatch.setattr(type(index), "mapInPandas", lambda self, run, schema: (held.update(run=run, rows=self.toPandas()), self)[1])
    kmer_index.search(index, index)
    sizes = [len(x) for x in held["run"](iter([held["rows"]]))]
    assert sum(sizes) == 1600 and max(sizes) <= 50 + 40


def test_communities_take_every_edge(spark, tmp_path):
    """Parts that share one order only are linked too."""
    from weftgraph.plans import catalogue

    lines = [(1, 1), (1, 2), (1, 3), (2, 4), (2, 5), (3, 1), (3, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r["node"]: r["cluster_id"] for r in catalogue.graph11_communities(spark, str(tmp_path)).collect()}
    assert set(got) == {"P1", "P2", "P3", "P4", "P5"} and got["P4"] == got["P5"] and got["P1"] == got["P2"] and got["P1"] != got["P4"]


def test_copies_of_sequences_are_compared_once(spark, monkeypatch):
    seen, search = [], kmer_index.search
    monkeypatch.setattr(alignment, "COPIES", 4)
    monkeypatch.setattr(kmer_index, "search", lambda queries, index, *more: (seen.append([x.selectExpr("sum(size(ids))").first()[0] for x in (queries, index)]), search(queries, index, *more))[1])
    texts = ["ABCABCAB", "abc-abc", "BCABCA", "ABC ABC", "B", None]
    rows = [("xy"[i % 2], i, texts[i % 6]) for i in range(60)]
    df = spark.createDataFrame(rows, "set string, id long, seq string")
    clean = {i: "".join(c for c in (s or "").upper() if c.isalpha()) for _, i, s in rows}
    want = sorted((q, t, d[2], d[0]) for q in clean for t in clean if (d := plain_diagonal(clean[q], clean[t])))
    assert sorted(map(tuple, alignment.diagonals(df, df).collect())) == want
    part = df.filter("id % 3 <> 1")
    assert sorted(map(tuple, alignment.diagonals(part, df).collect())) == [r for r in want if r[0] % 3 != 1]
    assert seen == [[3, 3], [3, 3]] and want


def test_a_prefilter_needs_few_copies_of_a_set(spark):
    rng = random.Random(9)
    rows = [(rng.choice("ab"), i, rng.choice(["ABCABC", "ABCABD", "ABDABD", "BBCABC"])) for i in range(200)]
    df = spark.createDataFrame(rows, "set string, id long, seq string")
    few = alignment.least_copies(df, 3)
    assert few.count() == 8 * 5
    asked = kmer_index.build_index(df.filter("id < 20"))
    got = [sorted(map(tuple, alignment.prefilter_sets(asked, kmer_index.build_index(x), alignment.simple_matrix(), 3, 2, 1.5, 0.05).collect())) for x in (df, few)]
    assert got[0] == got[1] and got[0]
