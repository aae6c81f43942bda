"""Small cases with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import columns as fn
from weftgraph.functions import validation
from weftgraph.operators import alignment, communities, components, editing, extraction, intervals, networks, signal_calls, sji, taxonomy, views


def rows(df, *cols):
    return sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())


def test_centrality(spark):
    n = spark.createDataFrame([("P1", "NH1", 3), ("P2", "NH1", 3), ("P3", "NH1", 3), ("P4", "NH2", 2), ("P5", None, 9), ("P6", "NH3", 1)], "id string, nh_id string, nh_size int")
    e = spark.createDataFrame([("P1", "P2", 0.6), ("P1", "P3", 0.3), ("P1", "P4", 0.9), ("P6", "P5", 0.5)], "node1 string, node2 string, weight double")
    got = {r["id"]: round(r["centrality"], 6) for r in views.centrality(n, e).collect()}
    assert got == {"P1": 0.3, "P2": 0.2, "P3": 0.1, "P4": 0.0, "P5": 0.0, "P6": 0.0}


def test_ranges_merge_and_split(spark):
    r = spark.createDataFrame([(0.4, 0.6), (0.1, 0.2), (0.2, 0.3), (0.45, 0.55)], "low double, high double")
    assert rows(intervals.merge(r)) == [(0.1, 0.3), (0.4, 0.6)]
    whole = spark.createDataFrame([(0.0, 0.8)], "low double, high double")
    once = intervals.subtract(whole, 0.2, 0.5)
    assert rows(once) == [(0.0, 0.2), (0.5, 0.8)]
    assert rows(intervals.subtract(once, 0.4, 0.7)) == [(0.0, 0.2), (0.7, 0.8)]


def edit_source(spark):
    e = spark.createDataFrame([("P1", "P2", 0.2), ("P2", "P3", 0.4), ("P3", "P4", 0.8)], "node1 string, node2 string, weight double")
    n = spark.createDataFrame([(f"P{i}",) for i in range(1, 5)], "id string")
    return n, networks.with_ids(e)


def test_edit_by_range_and_node_and_edge(spark):
    n, e = edit_source(spark)
    none = editing.Edit.none(spark)
    members, kept = editing.edited_network(n, e, none.hide_range(0.0, 0.5))
    assert rows(kept, "node1", "node2") == [("P3", "P4")] and members.count() == 4
    assert intervals.hidden(e, none.hide_range(0.0, 0.5).ranges).count() == 2
    members, kept = editing.edited_network(n, e, none.hide_nodes(spark.createDataFrame([("P2",)], "id string")))
    assert rows(members) == [("P1",), ("P3",), ("P4",)] and rows(kept, "node1") == [("P3",)]
    edit = none.hide_edges(spark.createDataFrame([("P1|P2",)], "id string"))
    assert editing.visible_edges(e, edit).count() == 2
    both = edit.hide_range(0.3, 0.5)
    assert rows(editing.payload(e, both)) == [("P1|P2",)]
    shown = both.show_edges(spark.createDataFrame([("P1|P2",)], "id string"), e)
    assert rows(shown.edges) == [("P2|P3",)] and shown.ranges.count() == 0
    with pytest.raises(ValueError):
        editing.edited_network(n, e, none.hide_nodes(n))


def test_view_sizes_and_weights(spark):
    n = spark.createDataFrame([("a", "X"), ("b", "X"), ("c", "Y"), ("d", None)], "id string, nh_id string")
    e = spark.createDataFrame([("a", "c", 1.0), ("b", "c", 0.5), ("a", "b", 9.0), ("c", "d", None)], "node1 string, node2 string, weight double")
    shown, linked = views.view(n, e)
    assert rows(shown) == [("X", "cluster", 2), ("Y", "cluster", 1), ("d", "protein", 1)]
    assert rows(linked) == [("X", "Y", 1.5, 2, 0.75), ("Y", "d", 0.0, 1, 0.0)]


def test_sji_missing_neighbour_is_itself(spark):
    s = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "z"), ("b", "a"), ("b", "b")], "protein string, signal string")
    got = {(r["a"], r["b"]): round(r["sji"], 6) for r in sji.network(s).collect()}
    assert got == {("a", "b"): round(2 / 3, 6), ("a", "z"): round(1 / 3, 6)}
    assert set(rows(sji.network(s, missing_as_empty=True), "a", "b")) == {("a", "b")}
    assert set(rows(sji.network(s, keep_reciprocal=True), "a", "b")) == {("a", "b"), ("b", "a"), ("a", "z")}


def test_components_against_union_find(spark):
    rng = np.random.default_rng(3)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))]
    root = {x: x for p in e for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in e:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = dict(rows(components.connected_components(spark.createDataFrame(e, "node1 long, node2 long"))))
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "node1 long, node2 long")).count() == 0


def test_leiden_finds_planted_groups(spark):
    rng = np.random.default_rng(1)
    e = [(f"n{a:02}", f"n{b:02}", 1.0) for a in range(40) for b in range(a + 1, 40) if rng.random() < (0.6 if a // 10 == b // 10 else 0.03)]
    df = spark.createDataFrame(e, "node1 string, node2 string, weight double")
    got = communities.communities(df)
    groups = {}
    for r in got.collect():
        groups.setdefault(r["cluster_id"], set()).add(int(r["node"][1:]) // 10)
    assert len(groups) == 4 and all(len(g) == 1 for g in groups.values())
    assert communities.modularity(df, got) > 0.5
    p, m = communities.refine(df, spark.createDataFrame([(f"n{a:02}", "0") for a in range(40)], "node string, cluster_id string"), 5, 0.9)
    assert sorted({r["cluster_id"] for r in p.collect()}) == ["0.0", "0.1", "0.2", "0.3"]
    assert m.agg(F.sum("size")).collect()[0][0] == 40


def test_extraction_budget_and_bridges(spark):
    e = [("a", "b", 0.9), ("b", "c", 0.8), ("c", "d", 0.7), ("d", "e", 0.6), ("e", "f", 0.9), ("x", "y", 0.5)]
    adj = networks.adjacency(spark.createDataFrame(e, "node1 string, node2 string, weight double"))
    got = extraction.extract_nodes(adj, ["a", "f"], max_nodes=6)
    assert set(got.nodes) == set("abcdef")
    got = extraction.extract_nodes(adj, ["a", "nobody"], max_nodes=3)
    assert got.missing == ["nobody"] and set(got.nodes) == {"a", "b", "c"}
    with pytest.raises(ValueError):
        extraction.extract_nodes(adj, ["nobody"])
    edges, _ = extraction.extract(adj, ["x"], max_nodes=5)
    assert rows(edges, "node1", "node2") == [("x", "y")]


def test_tree_parsing_and_annotation(spark):
    text = ["root", "+-Alpha", "| +-Beta", "| | \\-Gamma", "| \\-Delta", "", "---", "\\-Epsilon"]
    parsed = taxonomy.parse_lines(spark.createDataFrame(list(enumerate(text, 1)), "line int, text string"))
    tree = taxonomy.build(parsed)
    by = {r["line"]: (r["name"], r["parent"]) for r in tree.collect()}
    assert by[2] == ("Alpha", 1) and by[3] == ("Beta", 2) and by[4] == ("Gamma", 3) and by[8] == ("Epsilon", 1)
    names = spark.createDataFrame([(1, "1", "Alpha"), (2, "2", "gamma"), (3, "9", "alpha")], "line int, taxid string, name string")
    a = taxonomy.annotate(tree, names, spark.createDataFrame([("9",)], "taxid string"))
    assert tuple(taxonomy.statistics(a).collect()[0]) == (6, 2, 1)
    named = a.select(F.col("name").alias("node"), "line", "parent").alias("t")
    up = tree.select(F.col("line").alias("l"), F.col("name").alias("up"))
    flat = named.join(up, named["parent"] == up["l"], "left").select("node", F.col("up").alias("parent"))
    assert taxonomy.paths(flat).filter("node = 'Gamma'").count() == 4


def test_numbers_and_texts(spark):
    cases = {"": 0.0, " 1.5 ": 1.5, "0x1F": 31.0, "1d": None, "NaN": None, "Infinity": None, "1abc": None, "1e3": 1000.0, ".5": 0.5}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", fn.finite_number(F.col("t")).alias("v")).collect()} == cases
    x = spark.createDataFrame([(0.03125,), (0.8,), (1 / 3,)], "v double")
    assert [r[0] for r in x.select(fn.fixed(F.col("v"), 4)).collect()] == ["0.0312", "0.8000", "0.3333"]
    one = spark.createDataFrame([("b | a", "A(0.33), b-2;c", "1.2.10")], "e string, t string, c string")
    r = one.select(fn.normalise_edge_id(F.col("e")), fn.accession_tokens(F.col("t"), True), fn.parent_id(F.col("c")), fn.hash32(F.lit("a"))).collect()[0]
    assert tuple(r) == ("a|b", ["A", "b2", "c"], "1.2", 0xE40C292C)


def test_alignment_against_plain_dynamic_programming():
    m = alignment.simple_matrix()
    rng = np.random.default_rng(5)

    def plain(a, b, go=120, ge=80):
        inf = 1 << 40
        n, k = len(a), len(b)
        H = [[inf] * (k + 1) for _ in range(n + 1)]
        E = [[inf] * (k + 1) for _ in range(n + 1)]
        Fm = [[inf] * (k + 1) for _ in range(n + 1)]
        H[0][0] = 0
        for i in range(n + 1):
            for j in range(k + 1):
                if i:
                    Fm[i][j] = min(H[i - 1][j] + go, Fm[i - 1][j] + ge)
                if j:
                    E[i][j] = min(H[i][j - 1] + go, E[i][j - 1] + ge)
                if i and j:
                    H[i][j] = H[i - 1][j - 1] + m.cost[a[i - 1], b[j - 1]]
                H[i][j] = min(H[i][j], E[i][j], Fm[i][j])
        return 100 - H[n][k] / max(n, k)

    for _ in range(30):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 12))
        assert alignment.similarity(a, b, m) == pytest.approx(plain(a, b))
    assert alignment.similarity(alignment.clean(""), alignment.clean("A"), m) == 0.0
    symbols, scores = alignment.parse_matrix("# note\n A B\nA 4 -1\nB -1 5\n")
    assert symbols == ["A", "B"] and scores.tolist() == [[4, -1], [-1, 5]]


def test_signal_calls(spark):
    rng = np.random.default_rng(2)
    noise = [(f"h{i}", 1.0 + 0.4 * rng.random(), 30 + 4 * rng.random()) for i in range(60)]
    top = [("self", 1.0, 100.0), ("near", 1.02, 80.0), ("near2", 1.03, 78.0), ("near3", 1.01, 82.0)]
    df = spark.createDataFrame([("q", *p) for p in noise + top] + [("tiny", "a", 1.0, 1.0)], "query_id string, hit_id string, x double, y double")
    got = {r["hit_id"]: r["signal"] for r in signal_calls.call_signals(df).collect() if r["query_id"] == "q"}
    assert {k for k, v in got.items() if v} == {"self", "near", "near2", "near3"}
    s = {r["query_id"]: (r["points"], r["signals"]) for r in signal_calls.summary(signal_calls.call_signals(df)).collect()}
    assert s == {"q": (64, 4), "tiny": (1, 0)}
    square = np.array([[0, 0], [4, 0], [4, 4], [0, 4], [2, 2]], float)
    assert signal_calls.inside(np.array([[1, 1], [5, 1]]), square).tolist() == [True, False]
    assert signal_calls.upper_bound(np.array([2.0, 9.0]), square).tolist() == [4.0, 4.0]


def test_validation():
    assert validation.seeds("a, b;a\nc") == ["a", "b", "c"]
    assert validation.csv_name("x") == "x.csv" and validation.edge_ids(["b|a", " a | b "]) == ["a|b"]
    assert validation.ranges([{"min": 0, "max": 0.5}]) == [(0.0, 0.5)]
    assert validation.groups([{"name": "g", "accessions": "P1, P-2"}]) == [("g", ["P1", "P2"])]
    for bad in (lambda: validation.seeds(""), lambda: validation.max_nodes(9999), lambda: validation.csv_name("../x"), lambda: validation.ranges([(0.5, 0.5)]), lambda: validation.edge_ids(["a"]), lambda: validation.groups([{"name": "g"}])):
        with pytest.raises(ValueError):
            bad()


def test_coarsened_communities_equal_planted_groups(spark):
    rng = np.random.default_rng(1)
    e = [(f"n{a:02}", f"n{b:02}", 1.0) for a in range(60) for b in range(a + 1, 60) if rng.random() < (0.6 if a // 15 == b // 15 else 0.02)]
    df = spark.createDataFrame(e + [("x", "y", 1.0)], "node1 string, node2 string, weight double")
    got = communities.communities(df, local_edges=100)
    groups = {}
    for r in got.collect():
        groups.setdefault(r["cluster_id"], set()).add(r["node"][0] + (str(int(r["node"][1:]) // 15) if r["node"][0] == "n" else ""))
    assert got.count() == 62 and all(len({g[0] + g[1:] for g in v} - {"y"}) == 1 for v in groups.values() if v != {"x", "y"})
    assert communities.modularity(df, got) > 0.5


def test_cluster_number_equals_a_plain_loop_and_spectrum_a_full_solution():
    import numpy as np

    from weftgraph.operators import signal_calls

    rng = np.random.default_rng(5)
    for _ in range(200):
        v = np.sort(rng.choice([rng.random(int(rng.integers(2, 21))), np.round(rng.random(12), 1)][int(rng.integers(0, 2))], int(rng.integers(2, 12))))[::-1]
        drops, z = v[:-1] - v[1:], []
        for i, g in enumerate(drops):
            rest = np.array([x for j, x in enumerate(drops) if j != i])
            if len(rest):
                m = np.median(rest)
                z.append((g - m) / (1.4826 * max(np.median(np.abs(rest - m)), 1e-12)))
        assert signal_calls.choose_k(v) == (int(np.argmax(z)) + 1 if len(drops) > 1 and max(z) > 0 else 1)
    p = np.concatenate([rng.normal(c, 0.3, (90, 2)) for c in ((0, 0), (4, 0), (0, 4))])
    p = np.concatenate([p, p[:5]])
    w = signal_calls.affinity(p)
    near = np.array([np.median(r[r > 0]) for r in np.sqrt(((p[:, None] - p[None]) ** 2).sum(axis=2))])
    assert np.isclose(w[3, 100], np.exp(-((p[3] - p[100]) ** 2).sum() / (near[3] * near[100])))
    values, vectors = signal_calls.spectrum(p)
    root = w.sum(axis=1) ** -0.5
    full = np.linalg.eigvalsh(root[:, None] * w * root)[::-1]
    assert np.allclose(values, full[:20]) and np.allclose(root[:, None] * w * root @ vectors, vectors * values, atol=1e-8)
