"""Readers, writers, the catalog and the stream, over small files."""

import os
import subprocess
import sys
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph import catalog
from weftgraph.catalog import Catalog
from weftgraph.operators import editing
from weftgraph.sources import adjacency, readers, writers
from weftgraph.streaming import folder_events, mapping_jobs, reload


def put(folder, name, text):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(text)
    return str(folder / name)


NETWORK = "node1,node2,0.8\nnode1,node3,0.5\nnode2,node4,0.3\nnode3,node4,0.9\nnode1,node5,0.7\n"
MALFORMED = "source,target,weight\na,b\nc\n,d,0.1\ne,,0.2\nf,g,notanum\nh,i,Infinity\nj,k,1abc\n\n"


def test_network_reader(spark, tmp_path):
    assert readers.network(spark, put(tmp_path, "net.csv", NETWORK)).count() == 5
    assert readers.network(spark, put(tmp_path, "bad.csv", MALFORMED)).count() == 0
    odd = put(tmp_path, "odd.csv", '"a ""x"", y",b,0x1F,more\nc,d,\n')
    got = sorted(tuple(r) for r in readers.network(spark, odd).select("node1", "weight").collect())
    assert got == [('a "x", y', 31.0), ("c", 0.0)]


def test_attributes_and_duplicates(spark, tmp_path):
    head = "node_id,NCBI_txID,NH_ID,NH_Size,r1,r2,r3,r4,r5\n"
    a = put(tmp_path / "a", "a.nodes.attr", head + "P1,9606,NH1,3,,,,,\nP2,,NH1,3,,,,,\n ,1,2,3,,,,,")
    assert sorted(tuple(r) for r in readers.node_attributes(spark, a).select("id", "taxid").collect()) == [("P1", "9606"), ("P2", None)]
    with pytest.raises(ValueError):
        readers.node_attributes(spark, put(tmp_path / "b", "b.nodes.attr", "x,y\nP1,2\n"))
    c = Catalog(spark, str(tmp_path / "store"))
    put(tmp_path / "dup", "d.nodes.attr", head + "D1,1,,,,,,,\nD2,1,,,,,,,\nD1,2,,,,,,,\n")
    with pytest.raises(ValueError, match="D1"):
        c.ingest_attributes(str(tmp_path / "dup"))
    c.ingest_attributes(a)
    assert c.nodes.count() == 2


def test_fasta_hits_points_lists(spark, tmp_path):
    f = put(tmp_path / "f", "x.fasta", ">sp|Q1|NAME words\nACDx\nEF*\n>plain more\nGHIK\n")
    assert [(r["name"], r["seq"]) for r in readers.fasta(spark, f).orderBy("name").collect()] == [("Q1", "ACDXEF"), ("plain", "GHIK")]
    assert readers.fasta(spark, f).select(readers.fasta_accession(F.col("header")).alias("a")).orderBy("a").collect()[0]["a"] == "Q1"
    with pytest.raises(ValueError):
        readers.check_sequences(readers.fasta(spark, put(tmp_path / "g", "x.fasta", ">a\n\n>b\nAC\n")))
    put(tmp_path / "h", "q1_t1", "Query ID,Query Length,Hit ID,Hit Score,Hit Length\na,10,b,99.5,12\n")
    put(tmp_path / "h", "q1_t2", "a,10,b,x,12\n")
    good, bad = readers.hits(spark, str(tmp_path / "h"))
    assert [(r["q"], r["t"], r["score"]) for r in good.collect()] == [("q1", "t1", 99.5)] and bad.collect()[0]["file"] == "q1_t2"
    p = put(tmp_path / "p", "Q.csv", "id,x,y\na,1.0,100\n")
    put(tmp_path / "p", "R.csv", "b\t1.2\t50\n")
    assert sorted((r["query_id"], r["y"]) for r in readers.points(spark, str(tmp_path / "p")).collect()) == [("Q", 100.0), ("R", 50.0)] and p
    i = put(tmp_path / "i", "l.txt", "# c\nup1 x\nUP2\nup1\n\n")
    assert [r["id"] for r in readers.id_list(spark, i).orderBy("line").collect()] == ["UP1", "UP2"]
    put(tmp_path / "s", "P1", "P1\nP2\nP2\n")
    put(tmp_path / "s", "P3", "")
    x, status = readers.signals(spark, str(tmp_path / "s"))
    assert x.count() == 2 and dict(map(tuple, status.collect())) == {"P1": "ok", "P3": "empty"}


def test_edges_partitions_and_metrics(spark, tmp_path):
    e = put(tmp_path, "e.tsv", "a\tNA\t0.5\nb\tc\t0.25\n")
    assert sorted((r["node1"], r["node2"]) for r in readers.edge_list(spark, e).collect()) == [("a", "NA"), ("b", "c")]
    p = put(tmp_path, "p.csv", "1,0\n2,0.1\n")
    assert readers.partition(spark, p).count() == 2
    for bad in ("node,cluster\n1,0\n", "1,0\n1,1\n"):
        with pytest.raises(ValueError):
            readers.partition(spark, put(tmp_path, "bad.csv", bad))
    m = put(tmp_path, "m.csv", "community,size,internal_weight_sum,max_internal_edges\nc,3,1.5,3\nd,,,\n")
    got = {r["cluster_id"]: r["weighted_density"] for r in readers.metrics(spark, m).collect()}
    assert got == {"c": 0.5, "d": 0.0}
    names = put(tmp_path, "n.csv", "ncbi_txid,species_name\n1,Alpha\n,none\n")
    assert [r["name"] for r in readers.taxon_names(spark, names).collect()] == ["Alpha"]
    assert readers.species(spark, names).count() == 3


def test_binary_adjacency(spark, tmp_path):
    body = np.array([(1, 0.5), (2, 0.25), (0, 0.5), (0, 0.25)], np.dtype([("n", "<u4"), ("w", "<f4")]))
    head = np.array([(0, 2), (16, 1), (24, 1)], np.dtype([("o", "<u8"), ("d", "<u4")]))
    (tmp_path / "g.adj.bin").write_bytes(body.tobytes())
    (tmp_path / "g.adj.index.bin").write_bytes(np.array([3], "<u4").tobytes() + head.tobytes())
    (tmp_path / "g.node_ids.tsv").write_text("0\ta\n1\tb\n2\tc\n")
    (tmp_path / "h.adj.bin").write_bytes(b"")
    got = sorted(tuple(r) for r in readers.binary_adjacency(spark, str(tmp_path / "g")).collect())
    assert got == [("a", "b", 0.5), ("a", "c", 0.25), ("b", "a", 0.5), ("c", "a", 0.25)]
    assert [r["prefix"] for r in readers.complete_indexes(spark, str(tmp_path)).collect()] == ["g"]


def test_writers(spark, tmp_path):
    e = spark.createDataFrame([("P1", 'x "y", z', 0.03125)], "node1 string, node2 string, weight double")
    assert [r[0] for r in writers.network_lines(e).collect()] == ['P1,"x ""y"", z",0.0312']
    h = spark.createDataFrame([('a"', 10, "b|c", 99.456, 12)], "query_id string, query_len int, hit_id string, score double, hit_len int")
    assert writers.hit_lines(h).collect()[0][0] == "a,10,b|c,99.46,12"
    assert writers.hit_lines(h, "markdown").collect()[0][0] == "| a | 10 | b\\|c | 99.46 | 12 |"
    old = spark.createDataFrame([("q", "a"), ("r", "b")], "query_id string, hit_id string")
    new = spark.createDataFrame([("q", "c")], "query_id string, hit_id string")
    both, report = writers.merge_points(old, new, spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string"))
    assert both.count() == 3 and dict(map(tuple, report.collect())) == {"r": "new", "s": "both"}
    (tmp_path / "X.csv").write_text("")
    assert writers.reserve_name(str(tmp_path), "x.csv") == "x_1.csv"
    assert writers.reserve_name(str(tmp_path), "x.csv") == "x_2.csv"
    writers.release_name(str(tmp_path), "x_1.csv")
    assert writers.reserve_name(str(tmp_path), "x.csv") == "x_1.csv"


def test_catalog_replaces_refuses_edits_and_drops(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    c.ingest_file(put(tmp_path / "in", "net.csv", NETWORK))
    c.ingest_file(put(tmp_path / "in", "canary.csv", "a,b,0.5\n"))
    assert c.status("net.csv") == {"source": "net.csv", "nodes": 5, "edges": 5, "ready": True}
    c.ingest_file(put(tmp_path / "in", "net.csv", "node1,node2,0.8\n"))
    assert c.status("net.csv")["edges"] == 1 and c.status("canary.csv")["edges"] == 1
    with pytest.raises(ValueError, match="occurs 2 times"):
        c.ingest_file(put(tmp_path / "in", "dup.csv", "a,b,0.5\nb,a,0.6\n"))
    assert [r["source"] for r in c.list_networks().collect()] == ["canary.csv", "net.csv"]
    assert [r["id"] for r in c.search("canary.csv", ["a", "node1"]).collect()] == ["a"]
    got = c.save_edit("canary.csv", "copy", editing.Edit.none(spark).hide_edges(spark.createDataFrame([("a|b",)], "id string")))
    assert got == {"nodes": 2, "edges": 0, "source": "copy.csv"} and not c.status("copy.csv")["ready"]
    c.drop("canary.csv")
    with pytest.raises(KeyError):
        c.status("canary.csv")
    assert [r["text"] for r in c.export_groups([{"name": "g", "accessions": "b,a"}]).collect()] == ["b\na"]


def following(c, tmp_path, **how):
    reload.follow(c, str(tmp_path / "in"), str(tmp_path / "cp"), once=True, **({"settle": 0} | how)).awaitTermination(120)


def sources(c):
    return [r["source"] for r in c.list_networks().orderBy("source").collect()]


def test_stream_follows_a_folder(spark, tmp_path):
    c, told = Catalog(spark, str(tmp_path / "store")), []
    put(tmp_path / "in", "net.csv", NETWORK)
    put(tmp_path / "in", "a.csv", "x,y,0.5\n")
    following(c, tmp_path)
    assert sources(c) == ["a.csv", "net.csv"]
    (tmp_path / "in" / "net.csv").unlink()
    put(tmp_path / "in", "a.csv", "x,y,0.9\nx,z,0.4\n")  # the file changes, the stream restarts from its offset
    put(tmp_path / "in", "bad.csv", "p,q,0.5\nq,p,0.5\n")
    put(tmp_path / "in", "new.csv", "x,y,0.5\n")
    following(c, tmp_path, changed=lambda kind, name: told.append((kind, name)))
    assert sources(c) == ["a.csv", "new.csv"]  # one that is refused does not stop the others
    assert sorted(map(tuple, c.edges.filter("source = 'a.csv'").select("node1", "node2", "weight").collect())) == [("x", "y", 0.9), ("x", "z", 0.4)]
    assert told == [("network", n) for n in ("a.csv", "bad.csv", "net.csv", "new.csv")]  # and nothing else came again
    put(tmp_path / "in", "a.csv", "")
    put(tmp_path / "in", "n.nodes.attr", "node_id,NCBI_txID,NH_ID,NH_Size,,,,,\nx,9606,,,,,,,\n")
    put(tmp_path / "in", "taxonomy.txt", "root\n")
    told.clear()
    following(c, tmp_path, changed=lambda kind, name: told.append((kind, name)))
    assert sources(c) == ["new.csv"] and c.nodes.filter("id = 'x'").collect()[0]["taxid"] == "9606"
    assert told == [("network", "a.csv"), ("attributes", "n.nodes.attr"), ("taxonomy", "taxonomy.txt")]


def test_a_running_stream_sees_changes_once_they_settle(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    put(tmp_path / "in", "a.csv", "x,y,0.5\n")
    q = reload.follow(c, str(tmp_path / "in"), str(tmp_path / "cp"), every="200 milliseconds", settle=1)

    def until(true):
        for _ in range(300):
            if true():
                return True
            time.sleep(0.2)
        return False

    edges = lambda: sorted(map(tuple, c.edges.select("node1", "node2", "weight").collect()))
    try:
        assert until(lambda: edges() == [("x", "y", 0.5)])
        for text, want in (("x,y,0.9\nx,z,0.4\n", [("x", "y", 0.9), ("x", "z", 0.4)]), ("x,z,0.1\n", [("x", "z", 0.1)])):
            put(tmp_path / "in", "a.csv", text)
            assert until(lambda: edges() == want)  # noqa: B023
        (tmp_path / "in" / "a.csv").unlink()
        assert until(lambda: not edges())
    finally:
        q.stop()


def test_offsets_of_a_folder(tmp_path):
    r = folder_events.FolderReader({"path": str(tmp_path), "settle": "5", "most": "2"})
    start = r.initialOffset()
    for n in "abc":
        put(tmp_path, n, n)
        os.utime(tmp_path / n, (0, 0))
    one = r.latestOffset()
    assert [e[:2] for e in folder_events.difference(start, one)] == [("a", "added"), ("b", "added")]  # `most` a batch
    two = r.latestOffset()
    put(tmp_path, "a", "more")
    put(tmp_path, "d", "new")
    (tmp_path / "b").unlink()
    three = r.latestOffset()
    assert [e[:2] for e in folder_events.difference(one, two)] == [("c", "added")]
    assert [e[:2] for e in folder_events.difference(two, three)] == [("b", "deleted")]  # a and d have not settled
    again = folder_events.FolderReader({"path": str(tmp_path), "settle": "5"})  # after a restart, told of nothing yet
    four = again.latestOffset()
    assert folder_events.difference(three, four) == []
    again.settle = 0
    assert [e[:2] for e in folder_events.difference(four, again.latestOffset())] == [("a", "changed"), ("d", "changed")]


def test_own_writes_are_left_out_by_number_and_time_and_across_restarts(spark, tmp_path):
    c, told = Catalog(spark, str(tmp_path / "store"), str(tmp_path / "in")), []
    go = lambda **how: (told.clear(), following(c, tmp_path, changed=lambda kind, name: told.append(name), **how))
    c.ingest_file(put(tmp_path / "in", "a.csv", NETWORK))
    c.save_edit("a.csv", "own", editing.Edit.none(spark))
    go(own_events=2)
    assert told == ["a.csv"] and c.own_writes == ["own.csv"]
    put(tmp_path / "in", "own.csv", "x,y,0.5\n")
    go(own_events=2)  # the second event, after a restart
    assert told == [] and c.status("own.csv")["edges"] == 5
    put(tmp_path / "in", "own.csv", "x,y,0.25\n")
    go(own_events=2)
    assert told == ["own.csv"] and c.status("own.csv")["edges"] == 1
    c.save_edit("a.csv", "late", editing.Edit.none(spark))
    time.sleep(1.1)
    (tmp_path / "cp").rename(tmp_path / "cp-before")
    go(own_seconds=1)
    assert "late.csv" in told


def test_saved_networks_get_names_of_their_own_and_survive_the_stream(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    c.ingest_file(put(tmp_path / "in", "a.csv", NETWORK))
    c.ingest_file(put(tmp_path / "in", "b.csv", "x,y,0.5\n"))
    none = editing.Edit.none(spark)
    assert [c.save_edit("a.csv", n, none)["source"] for n in ("B.csv", "mine", "mine", "Mine.csv")] == ["B_1.csv", "mine.csv", "mine_1.csv", "Mine_2.csv"]
    assert c.status("b.csv")["edges"] == 1 and c.status("mine.csv")["edges"] == 5
    assert c.extract("a.csv", "node1", "mine")["source"] == "mine_3.csv"
    put(tmp_path / "in", "late.csv", "p,q,0.25\n")
    following(c, tmp_path)
    assert [r["source"] for r in c.list_networks().orderBy("source").collect()] == ["B_1.csv", "Mine_2.csv", "a.csv", "b.csv", "late.csv", "mine.csv", "mine_1.csv", "mine_3.csv"]


def test_saved_networks_are_files_of_the_folder(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", NETWORK)
    c = Catalog(spark, str(tmp_path / "store"), str(tmp_path / "in"))
    c.ingest_file(path)
    assert c.save_edit("a.csv", "A.csv", editing.Edit.none(spark))["source"] == "A_1.csv" and c.own_writes == ["A_1.csv"]
    assert len((tmp_path / "in" / "A_1.csv").read_text().splitlines()) == 5
    following(c, tmp_path)
    assert [r["source"] for r in c.list_networks().orderBy("source").collect()] == ["A_1.csv", "a.csv"]


def test_a_save_that_fails_leaves_nothing(spark, tmp_path, monkeypatch):
    def no(self, name, rows):
        raise OSError("disk full")

    monkeypatch.setattr(Catalog, "_write_file", no)
    c = Catalog(spark, str(tmp_path / "store"), str(tmp_path / "in"))
    c.ingest_file(put(tmp_path / "in", "a.csv", NETWORK))
    with pytest.raises(OSError):
        c.save_edit("a.csv", "mine", editing.Edit.none(spark))
    assert [r["source"] for r in c.list_networks().collect()] == ["a.csv"] and c.members.filter("source = 'mine.csv'").isEmpty()
    assert c.reserve("mine.csv") == "mine.csv"


def test_a_file_that_became_empty_leaves_no_network(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "store"))
    c.ingest_file(put(tmp_path / "in", "a.csv", NETWORK))
    c.ingest_file(put(tmp_path / "in", "b.csv", "x,y,0.5\n"))
    c.ingest_file(put(tmp_path / "in", "a.csv", "\n"))
    assert [r["source"] for r in c.list_networks().collect()] == ["b.csv"]


def test_taxonomy_tree_leaves_orphans_out(spark, tmp_path):
    from weftgraph.operators import taxonomy

    rows = [(1, 0, "root"), (2, 2, "orphan"), (3, 3, "its child"), (4, 1, "kept"), (5, 2, "leaf")]
    parsed = spark.createDataFrame(rows, "line int, depth int, name string")
    with pytest.warns(UserWarning, match="2 orphan"):
        got = taxonomy.without_orphans(parsed)
    assert sorted(r["name"] for r in got.collect()) == ["kept", "leaf", "root"]


CRASH = """
import os, signal, sys
sys.path.insert(0, {repo!r})
from weftgraph import catalog
from weftgraph.catalog import Catalog
from weftgraph.session import local_session
from weftgraph.snapshots import Snapshots
s = local_session(cpus="2", memory="1g")
c = Catalog(s, {store!r})
write, publish = Snapshots.write, Snapshots._publish
die = lambda *a, **k: os.kill(os.getpid(), signal.SIGKILL)
count = [0]
def dying(self, table, *a, **k):
    count[0] += 1
    return die() if {between} and table == "members" else write(self, table, *a, **k)
Snapshots.write = dying
if not {between}:
    Snapshots._publish = die
e = s.createDataFrame([("p", "q", 0.5, "a.csv"), ("p", "r", 0.5, "b.csv")], "node1 string, node2 string, weight double, source string")
c.ingest_edges(e, members=s.createDataFrame([("lone", "a.csv")], "id string, source string"))
"""


@pytest.mark.parametrize("between", [True, False])
def test_a_killed_driver_leaves_the_old_snapshot(spark, tmp_path, between):
    store = str(tmp_path / "store")
    c = Catalog(spark, store)
    c.ingest_edges(spark.createDataFrame([("x", "y", 0.5, "a.csv")], catalog.EDGES), members=spark.createDataFrame([("z", "a.csv")], catalog.MEMBERS))
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-c", CRASH.format(repo=repo, store=store, between=between)], capture_output=True, timeout=300)
    assert done.returncode == -9, done.stderr[-2000:]
    assert len(os.listdir(f"{store}/data")) > 2  # something was written, and nobody sees it
    assert [tuple(r) for r in c.edges.collect()] == [("x", "y", 0.5, "a.csv")] and sorted(r["id"] for r in c.members.collect()) == ["x", "y", "z"]
    c.ingest_edges(spark.createDataFrame([("x", "w", 0.5, "a.csv")], catalog.EDGES))
    assert sorted(r["id"] for r in c.members.collect()) == ["w", "x"]
    assert c.snapshots.vacuum(keep=1, seconds=0) > 0 and [r["node1"] for r in c.edges.collect()] == ["w"]


def test_two_writers_and_old_snapshots(spark, tmp_path):
    c, other = Catalog(spark, str(tmp_path / "store")), Catalog(spark, str(tmp_path / "store"))
    edges = lambda *rows: spark.createDataFrame(rows, catalog.EDGES)
    c.ingest_edges(edges(("a", "b", 0.5, "x.csv"), ("a", "b", 0.5, "o d=d/%.csv")))
    before = c.snapshots.manifest()
    change = c._replacement(edges(("c", "d", 0.5, "x.csv")))
    other.ingest_edges(edges(("e", "f", 0.5, "y.csv")))  # a commit between the write and the commit of the first
    published, first = c.snapshots._publish, [True]

    def late(manifest):  # and one between reading the manifest and publishing it
        if first.pop() if first else False:
            other.ingest_edges(edges(("g", "h", 0.5, "z.csv")))
        return published(manifest)

    c.snapshots._publish = late
    c.snapshots.commit(change)
    assert sources(c) == ["o d=d/%.csv", "x.csv", "y.csv", "z.csv"] and c.status("x.csv")["nodes"] == 2
    assert [r["node1"] for r in c.snapshots.read("edges", catalog.EDGES, ["x.csv"], before).collect()] == ["a"]  # a reader keeps its snapshot
    assert c.snapshots.versions() == [1, 2, 3, 4]
    c.drop("x.csv", "y.csv")
    assert sources(c) == ["o d=d/%.csv", "z.csv"]


def test_binary_adjacency_round_trip_by_parts(spark, tmp_path):
    rng = np.random.default_rng(2)
    edges = {(int(a), int(b)) for a, b in rng.integers(0, 500, (4000, 2)) if a % 7}
    rows = [(a, b, float(np.float32(rng.random()))) for a, b in sorted(edges)]
    folder = str(tmp_path / "adjacency")
    adjacency.write_adjacency_files(spark.createDataFrame(rows, adjacency.COLUMNS).repartition(3), folder, parts=5)
    files = adjacency.Files(folder)
    assert len(files.parts()) > 1
    for step in (adjacency.NODES_AT_ONCE, 13):
        assert sorted(map(tuple, adjacency.read_adjacency_files(spark, folder, nodes_at_once=step).collect())) == rows
    asked = [0, 7, 8, 9, 30, 31, 250, 251, 499, 600]
    df = adjacency.read_adjacency_files(spark, folder, asked)
    assert sorted(map(tuple, df.collect())) == [r for r in rows if r[0] in asked]
    reader = adjacency.AdjacencyReader({"path": folder})  # what a query for ten nodes reads: their entries and their edges
    assert list(reader.pushFilters([adjacency.In(("src",), tuple(asked)), adjacency.EqualTo(("dst",), 1)])) == [adjacency.EqualTo(("dst",), 1)]
    planned = reader.partitions()
    reader.files.bytes_read = 0
    got = sum(b.num_rows for p in planned for b in reader.read(p))
    there = [n for n in asked if any(p["first"] <= n < p["first"] + p["nodes"] for p in files.parts())]
    assert got == sum(r[0] in asked for r in rows) and reader.files.bytes_read == 8 * got + 12 * len(there)
    again = [(1, 2, 0.5)]  # the new parts take the place of the old in one step
    adjacency.write_adjacency_files(spark.createDataFrame(again, adjacency.COLUMNS), folder)
    assert list(map(tuple, adjacency.read_adjacency_files(spark, folder).collect())) == again


def test_a_failed_adjacency_write_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "adjacency"
    bad = spark.range(1000).selectExpr("id AS src", "id AS dst", "CASE WHEN id = 990 THEN raise_error('no') ELSE 1.0 END AS weight")
    with pytest.raises(Exception, match="no"):
        adjacency.write_adjacency_files(bad, str(folder))
    assert not folder.exists() or not os.listdir(folder)
    twice = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5)], adjacency.COLUMNS).repartition(2, "dst")
    adjacency.register(spark)
    folder.mkdir(exist_ok=True)
    with pytest.raises(Exception, match="two parts"):
        twice.write.format(adjacency.FORMAT).mode("append").option("path", str(folder)).save()
    assert not os.listdir(folder)
    with pytest.raises(Exception, match="no finished"):
        adjacency.Files(str(folder)).parts()


def test_binary_adjacency_of_one_file_pair(spark, tmp_path):
    degree = np.array([2, 0, 1])
    head = np.array([(0, 2), (16, 0), (16, 1)], adjacency.ENTRY)
    (tmp_path / "net.adj.index.bin").write_bytes(np.array([3], "<u4").tobytes() + head.tobytes())
    (tmp_path / "net.adj.bin").write_bytes(np.array([(1, 0.5), (2, 0.25), (0, 0.75)], adjacency.PAIR).tobytes())
    got = adjacency.read_adjacency_files(spark, str(tmp_path)).collect()
    assert list(map(tuple, got)) == [(0, 1, 0.5), (0, 2, 0.25), (2, 0, 0.75)] and degree.sum() == len(got)


def fake_service(folder):
    class FakeService:
        """Jobs as files: finished at the third poll, `bad` ids fail their job, `slow` ones never end."""

        def __init__(self, folder):
            self.folder = str(folder)

        def _note(self, name, text):
            with open(f"{self.folder}/{name}", "a") as f:
                f.write(text + "\n")

        def submit(self, ids):
            name = f"job-{ids[0]}"
            self._note("submitted", f"{name} {len(ids)}")
            self._note(name, ",".join(ids))
            return name

        def poll(self, job):
            self._note(f"{job}.polls", "poll")
            if "slow" in job or "bad" in job:
                return "running" if "slow" in job else "failed"
            if sum(1 for _ in open(f"{self.folder}/{job}.polls")) == 2:
                raise OSError("try again")
            return "finished" if sum(1 for _ in open(f"{self.folder}/{job}.polls")) >= 3 else "running"

        def page(self, job, cursor, size):
            ids = [i for i in open(f"{self.folder}/{job}").readline().strip().split(",") if i != "none"]
            at = int(cursor or 0)
            self._note("pages", f"{job} {at}")
            return [(i, i.upper()) for i in ids[at : at + size]], str(at + size) if at + size < len(ids) else None

    return FakeService(folder)  # a class of its own, which goes to the workers by value


def test_mapping_jobs_submit_poll_page_and_survive_a_restart(spark, tmp_path):
    folder = tmp_path / "service"
    folder.mkdir()
    ids = [f"a{i}" for i in range(7)] + ["bad1", "bad2", "none", "slow"]
    chunks = mapping_jobs.job_chunks(spark.createDataFrame([(i,) for i in [*ids, "a0", None]], "id string"), 4)
    assert [len(r["ids"]) for r in chunks.orderBy("chunk").collect()] == [4, 4, 3]
    rows = [(0, ["a0", "a1", "a2", "a3"]), (1, ["a4", "a5", "none"]), (2, ["bad1"]), (3, ["slow"])]
    spark.createDataFrame(rows, mapping_jobs.CHUNKS).write.parquet(str(tmp_path / "in"))
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")

    def start():
        stream = spark.readStream.schema(mapping_jobs.CHUNKS).parquet(str(tmp_path / "in"))
        out = mapping_jobs.mapping_jobs(stream, fake_service(folder), every=0.2, polls=6, page=3)
        return out.writeStream.option("checkpointLocation", str(tmp_path / "cp")).format("parquet").option("path", str(tmp_path / "out")).start()

    lines = lambda name: (folder / name).read_text().splitlines() if (folder / name).exists() else []
    try:
        q = start()
        for _ in range(300):
            if len(lines("submitted")) == 4 and lines("job-slow.polls"):
                break
            time.sleep(0.2)
        q.stop()
        q = start()  # from the state
        got = []
        for _ in range(300):
            if (tmp_path / "out" / "_spark_metadata").exists():
                got = sorted(map(tuple, spark.read.schema(mapping_jobs.ANSWERS).parquet(str(tmp_path / "out")).collect()), key=str)
            if len(got) == 9:
                break
            time.sleep(0.3)
        q.stop()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    want = [(0, f"a{i}", f"A{i}", "ok") for i in range(4)] + [(1, "a4", "A4", "ok"), (1, "a5", "A5", "ok"), (1, "none", None, "not_found"), (2, "bad1", None, "error"), (3, "slow", None, "error")]
    assert got == sorted(want, key=str)
    assert sorted(lines("submitted")) == ["job-a0 4", "job-a4 3", "job-bad1 1", "job-slow 1"]  # none twice
    assert [x for x in lines("pages") if "a0" in x] == ["job-a0 0", "job-a0 3"]
    assert len(lines("job-slow.polls")) in (6, 7)  # the batch that was stopped midway may have asked once more


def test_a_folder_is_listed_by_a_few_calls(spark, tmp_path, monkeypatch):
    names = [f"net.{i}.adj.bin" for i in range(300)] + ["with, comma", "; isDirectory=true; x", ".hidden", "_under", "a b", "ü"]
    for n in names:
        (tmp_path / n).touch()
    (tmp_path / "folder").mkdir()
    (tmp_path / "empty").mkdir()
    client, calls = spark._jvm._gateway_client, []
    send = client.send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **k: (calls.append(1), send(*a, **k))[1])
    got = readers.file_names(spark, str(tmp_path))
    assert got == sorted(names) and len(calls) < 100
    assert readers.file_names(spark, str(tmp_path / "empty")) == []
    assert readers.complete_indexes(spark, str(tmp_path / "empty")).count() == 0


def test_empty_files_are_made_by_tasks(spark):
    from weftgraph.plans import formats

    files = spark.range(50).selectExpr("concat('n', id) AS file").repartition(4)
    assert readers.file_names(spark, formats._empty_files(files, "made")) == sorted(f"n{i}" for i in range(50))
