"""Networks kept as tables: list, load, status, search, edit, extract, export. The functions behind the
service's routes; the store is a folder of parquet tables that every executor can reach."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import validation
from .operators import editing, extraction, networks, taxonomy
from .snapshots import Snapshots
from .sources import readers, writers

EDGES = "node1 string, node2 string, weight double, source string"
NODES = "id string, taxid string, nh_id string, nh_size string"
MEMBERS = "id string, source string"


class Catalog:
    """Networks, nodes and members below one folder, as snapshots: whatever a call changes becomes visible in one commit.

    A network's members are the ends of its edges, and isolated nodes that are stored beside them. Saved and extracted
    networks get a name of their own (`_1`, `_2`, ... after the stem). With `files`, a folder of network files, they
    are written there too; without, they are marked as made here, so that the absence of a file does not drop them."""

    def __init__(self, spark: SparkSession, folder: str, files: str | None = None):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), files and files.rstrip("/")
        self.snapshots = Snapshots(spark, self.folder)

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _touch(self, path: str) -> bool:
        """Whether the empty file was not there and is now."""
        fs, where = self._fs(path)
        fs.mkdirs(where.getParent())
        return fs.createNewFile(where)

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return readers.file_names(self.spark, path) if fs.exists(where) else []

    def reserve(self, name: str, tries: int = 1000) -> str:
        """A name that no stored network and no file has, cases alike, held until `release`."""
        stem, manifest = name[:-4], self.snapshots.manifest()
        taken = {s.lower() for t in ("edges", "members") for s in manifest["tables"].get(t, {})} | {n.lower() for n in (self._names(self.files) if self.files else [])}
        for k in range(tries):
            got = f"{stem}_{k}.csv" if k else name
            if got.lower() not in taken and self._touch(f"{self.folder}/reserved/{got.lower()}"):
                return got
        raise RuntimeError(f"no free name for {name}")

    def release(self, name: str) -> None:
        self._delete(f"{self.folder}/reserved/{name.lower()}")

    def notes_folder(self) -> str:
        """Where a note lies for every file that is written by us: `<id>~<name>`, for whoever follows the folder."""
        path = f"{self.folder}/own"
        fs, where = self._fs(path)
        fs.mkdirs(where)
        return path

    @property
    def own_writes(self) -> list[str]:
        """Names of the files written by us."""
        return sorted({n.split("~", 1)[1] for n in self._names(self.notes_folder()) if "~" in n})

    def _store(self, name: str, edges: DataFrame, members: DataFrame | None = None) -> None:
        """Store a network under a reserved name: its edges, its members and its file, or nothing."""
        wrote = False
        try:
            rows = edges.select("node1", "node2", F.col("weight").cast("double").alias("weight"), F.lit(name).alias("source"))
            change = self._replacement(rows, [name], None if members is None else members.select("id", F.lit(name).alias("source")))
            if self.files:
                wrote = True
                self._touch(f"{self.notes_folder()}/{uuid.uuid4().hex}~{name}")
                self._write_file(name, rows)
            else:
                inner = change

                def change(manifest: dict) -> None:
                    inner(manifest)
                    manifest["marks"][name] = "made"

            self.snapshots.commit(change)
        except Exception:
            if wrote:
                self._delete(f"{self.files}/{name}")
            raise
        finally:
            self.release(name)

    def _write_file(self, name: str, rows: DataFrame) -> None:
        """One file, as the format wants it: written aside, then renamed."""
        aside = f"{self.folder}/aside/{name}"
        writers.write_network(rows.coalesce(1), aside)
        part = next(n for n in readers.file_names(self.spark, aside) if n.startswith("part-"))
        fs, where = self._fs(f"{aside}/{part}")
        if not fs.rename(where, self._fs(f"{self.files}/{name}")[1]):
            raise OSError(f"{name} cannot be written to {self.files}")
        if fs.getScheme() == "file":  # a checksum beside it would speak against whoever edits the file
            fs.getRaw().delete(self._fs(f"{self.files}/.{name}.crc")[1], False)
        self._delete(aside)

    def _edges_of(self, source: str) -> DataFrame:
        """The files of one network, and no others."""
        return self.snapshots.read("edges", EDGES, [source])

    def _members_of(self, manifest: dict, sources: list[str] | None = None) -> DataFrame:
        ends = self.snapshots.read("edges", EDGES, sources, manifest).select(F.explode(F.array("node1", "node2")).alias("id"), "source")
        return ends.union(self.snapshots.read("members", MEMBERS, sources, manifest)).distinct()

    @property
    def edges(self) -> DataFrame:
        return self.snapshots.read("edges", EDGES)

    @property
    def nodes(self) -> DataFrame:
        return self.snapshots.read("nodes", NODES)

    @property
    def members(self) -> DataFrame:
        """Of one snapshot, edges and isolated nodes alike."""
        return self._members_of(self.snapshots.manifest())

    def _replacement(self, edges: DataFrame, sources: list[str] | None = None, members: DataFrame | None = None) -> Callable[[dict], None]:
        """Write the networks of `edges` aside, and give the change that replaces them and drops those of `sources`
        that have neither edges nor members. A pair that occurs twice in a network refuses all."""
        ordered = edges.select(F.least("node1", "node2").alias("node1"), F.greatest("node1", "node2").alias("node2"), "weight", "source")
        twice = networks.duplicate_edges(ordered, "node1", "node2").limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0]['node1']}|{twice[0]['node2']} occurs {twice[0]['n']} times in {twice[0]['source']}")
        fresh = {"edges": self.snapshots.write("edges", ordered), "members": self.snapshots.write("members", members) if members is not None else {}}
        replaced = {*fresh["edges"], *fresh["members"], *(sources or ())}

        def change(manifest: dict) -> None:
            for table, held in fresh.items():
                kept = {s: p for s, p in manifest["tables"].get(table, {}).items() if s not in replaced}
                manifest["tables"][table] = kept | held

        return change

    def ingest_edges(self, edges: DataFrame, sources: list[str] | None = None, members: DataFrame | None = None) -> None:
        """Replace the networks that `edges` (source, node1, node2, weight) holds, with isolated nodes `members` (source,
        id), and those of `sources`: one of these without edges goes. One commit for edges and members."""
        self.snapshots.commit(self._replacement(edges, sources, members))

    def ingest_files(self, paths: list[str]) -> None:
        """Replace the networks of these files, all in one commit; a file without a usable line leaves none."""
        self.ingest_edges(readers.network(self.spark, paths), [p.rsplit("/", 1)[-1] for p in paths])

    def ingest_file(self, path: str) -> None:
        """Replace the networks of a file or a folder of files; a file without a usable line leaves none."""
        fs, where = self._fs(path)
        names = [where.getName()] if fs.getFileStatus(where).isFile() else [n for n in readers.file_names(self.spark, path) if n.endswith(".csv")]
        self.ingest_edges(readers.network(self.spark, path), names)

    def ingest_attributes(self, path: str | list[str]) -> None:
        """Attributes of all files together: a node that occurs twice refuses all; others lose theirs."""
        rows = readers.node_attributes(self.spark, path)
        twice = networks.duplicate_nodes(rows.withColumn("at", F.concat_ws(":", "file", F.col("line").cast("string"))), "at").limit(20).collect()
        if twice:
            raise ValueError("; ".join(f"{r['id']}: {r['first_at']} and {r['again_at']}" for r in twice))
        ends = self.edges.select(F.explode(F.array("node1", "node2")).alias("id")).distinct()
        held = self.snapshots.write("nodes", ends.join(rows.select("id", "taxid", "nh_id", "nh_size"), "id", "full"), by_source=False)
        self.snapshots.commit(lambda manifest: manifest["tables"].update(nodes=held))

    def drop(self, *sources: str) -> None:
        """Remove networks, all in one commit."""

        def change(manifest: dict) -> None:
            for table in ("edges", "members"):
                manifest["tables"][table] = {s: p for s, p in manifest["tables"].get(table, {}).items() if s not in sources}
            manifest["marks"] = {s: m for s, m in manifest["marks"].items() if s not in sources}

        self.snapshots.commit(change)

    def list_networks(self) -> DataFrame:
        return networks.list_networks(self.edges, self.members)

    def status(self, source: str) -> dict:
        """nodes, edges, ready; a network without both does not exist."""
        own = networks.network_counts(self._edges_of(source), self._members_of(self.snapshots.manifest(), [source])).collect()
        if not own:
            raise KeyError(source)
        return own[0].asDict()

    def load(self, source: str) -> tuple[DataFrame, DataFrame]:
        now = self.snapshots.manifest()
        return networks.load(self.snapshots.read("nodes", NODES, None, now), self.snapshots.read("edges", EDGES, [source], now), source, self._members_of(now, [source]))

    def _scope(self) -> DataFrame:
        return networks.scoped_nodes(self.edges, self.members)

    def search(self, source: str, accessions: list[str]) -> DataFrame:
        asked = self.spark.createDataFrame([(x,) for x in validation.strings(accessions, 20_000)], "id string")
        known = self.nodes.join(self.members.select("id").distinct(), "id", "full")
        return networks.search_ids(known, self._scope(), source, asked)

    def search_species(self, source: str, taxids: list[str]) -> DataFrame:
        return networks.search_taxids(self.nodes, self._scope(), source, validation.strings(taxids, 500))

    def save_edit(self, source: str, name: str, edit: editing.Edit) -> dict:
        """Store the edited copy of a network under a new name, isolated nodes as members."""
        name = self.reserve(validation.csv_name(name))
        try:
            nodes, edges = self.load(source)
            members, kept = editing.edited_network(nodes, edges, edit)
            counts = {"nodes": members.count(), "edges": kept.count()}
        except Exception:
            self.release(name)
            raise
        self._store(name, kept, members)
        return counts | {"source": name}

    @staticmethod
    def limits() -> dict:
        """What an extraction may ask for."""
        return {"default_nodes": 500, "max_nodes": 2500, "max_seeds": 10}

    def extract(self, source: str, seeds: str | list[str], name: str, max_nodes: int | None = None) -> dict:
        """Extract a subnetwork around seeds and store it under a new name."""
        name, limit = validation.csv_name(name), validation.max_nodes(max_nodes)
        adj = networks.adjacency(self._edges_of(source))
        edges, got = extraction.extract(adj, validation.seeds(seeds), limit)
        if edges.isEmpty():
            raise ValueError("the subnetwork has no edges")
        name = self.reserve(name)
        self._store(name, edges)
        return {"source": name, "nodes": len(got.nodes), "missing": got.missing}

    def taxonomy_names(self, path: str) -> DataFrame:
        """ncbi_txid, species_name of the names file."""
        return readers.species(self.spark, path)

    def taxonomy_tree(self, tree_path: str, names_path: str) -> DataFrame:
        """The tree of a line file, with taxids and whether the stored nodes have them. A line without a parent,
        other than the first, is left out with a warning."""
        tree = taxonomy.build(taxonomy.without_orphans(taxonomy.parse_lines(readers.tree_lines(self.spark, tree_path))))
        known = self.nodes.select("taxid").filter("taxid IS NOT NULL").distinct()
        return taxonomy.annotate(tree, readers.taxon_names(self.spark, names_path), known)

    def export_groups(self, groups: list[dict]) -> DataFrame:
        rows = [(name, i, x) for name, own in validation.groups(groups) for i, x in enumerate(own)]
        return writers.group_texts(self.spark.createDataFrame(rows, "name string, place int, accession string"))

    def orphans(self, files: DataFrame) -> DataFrame:
        """source of stored networks whose file is gone; those made here never had one. files: source."""
        made = self.spark.createDataFrame([(n,) for n, mark in self.snapshots.manifest()["marks"].items() if mark == "made"], "source string")
        return networks.missing(networks.missing(self.list_networks(), files, "source"), made, "source")

    def unknown(self, files: DataFrame) -> DataFrame:
        """source of files that are not stored."""
        return networks.missing(files, self.list_networks(), "source")
