"""Binary adjacency as a data source: neighbours of numbered nodes, read by offset and written in parts.

A file pair is `<name>.adj.index.bin` (a 4-byte count, then 8 bytes of offset and 4 of degree for each node) and
`<name>.adj.bin` (4 bytes of neighbour and 4 of weight for each edge), all little-endian. A folder holds such pairs,
one for each writing task, and `parts.json`, which says what node each part begins with and which parts count; it is
written last, so a folder without it holds nothing. A pair by itself is a folder of one part.

    spark.read.format("binary_adjacency").option("path", folder).load()
    write_adjacency_files(adjacency, folder)

A read plans from the counts alone; with a filter on src (=, IN) it reads the ranges of these nodes and no others."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..session import ship

FORMAT = "binary_adjacency"
COLUMNS = "src long, dst long, weight float"
ENTRY = np.dtype([("offset", "<u8"), ("degree", "<u4")])
PAIR = np.dtype([("dst", "<u4"), ("weight", "<f4")])
HEAD = 4
#: Nodes, and bytes of edges, that a task reads at once.
NODES_AT_ONCE, BYTES_AT_ONCE = 1 << 20, 16 << 20
INDEX, PAIRS, MANIFEST = ".adj.index.bin", ".adj.bin", "parts.json"


def store(path: str):
    """The store of a path that all executors share, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class Files:
    """The files of a folder; `bytes_read` counts what is read of them."""

    def __init__(self, path: str):
        self.fs, self.folder = store(path.rstrip("/"))
        self.bytes_read = 0

    def read(self, name: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(f"{self.folder}/{name}") as f:
            f.seek(at)
            got = f.read(size)
        self.bytes_read += len(got)
        if len(got) != size:
            raise OSError(f"{name} ends before byte {at + size}")
        return got

    def parts(self, name: str | None = None) -> list[dict]:
        """name, first (its first node), nodes of every part that counts; or the one file pair of a name."""
        from pyarrow import fs

        found = {f.base_name: f.size for f in self.fs.get_file_info(fs.FileSelector(self.folder))}
        if MANIFEST in found and name is None:
            return json.loads(self.read(MANIFEST, 0, found[MANIFEST]))
        alone = [n[: -len(INDEX)] for n in found if n.endswith(INDEX) and n[: -len(INDEX)] + PAIRS in found and not n.startswith("part-")]
        alone = [n for n in alone if name in (None, n)]
        if len(alone) != 1:
            raise FileNotFoundError(f"{self.folder} holds no finished binary adjacency")
        return [{"name": alone[0], "first": 0, "nodes": int(np.frombuffer(self.read(alone[0] + INDEX, 0, HEAD), "<u4")[0])}]

    def entries(self, part: str, start: int, count: int) -> np.ndarray:
        return np.frombuffer(self.read(part + INDEX, HEAD + start * ENTRY.itemsize, count * ENTRY.itemsize), ENTRY)


@dataclass
class Nodes(InputPartition):
    """Nodes of one part, by their place in it: a range, or single ones."""

    name: str
    first: int
    start: int
    stop: int
    single: tuple[int, ...] | None = None


class AdjacencyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files, self.asked = Files(options["path"]), None
        self.step, self.pair = int(options.get("nodes", NODES_AT_ONCE)), options.get("pair")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("src",):
                self._narrow({f.value})
            elif isinstance(f, In) and f.attribute == ("src",):
                self._narrow(set(f.value))
            else:
                yield f

    def _narrow(self, ids: set) -> None:
        ids = {int(i) for i in ids if i is not None}
        self.asked = ids if self.asked is None else self.asked & ids

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        for p in self.files.parts(self.pair):
            if self.asked is None:
                out += [Nodes(p["name"], p["first"], a, min(a + self.step, p["nodes"])) for a in range(0, p["nodes"], self.step)]
            else:
                own = sorted(i - p["first"] for i in self.asked if 0 <= i - p["first"] < p["nodes"])
                out += [Nodes(p["name"], p["first"], 0, 0, tuple(own[k : k + 1000])) for k in range(0, len(own), 1000)]
        return out or [Nodes("", 0, 0, 0, ())]

    def read(self, p: Nodes) -> Iterator[pa.RecordBatch]:
        if p.single is not None:
            places = np.array(p.single, np.int64)
            head = np.concatenate([self.files.entries(p.name, i, 1) for i in p.single]) if p.single else np.empty(0, ENTRY)
        else:
            places, head = np.arange(p.start, p.stop), self.files.entries(p.name, p.start, p.stop - p.start)
        offset, size = head["offset"].astype(np.int64), head["degree"].astype(np.int64) * PAIR.itemsize
        k = 0
        while k < len(head):
            # nodes whose edges follow one another are one read, up to a bound; a longer node is read in pieces
            more = k + 1
            while more < len(head) and offset[more] == offset[more - 1] + size[more - 1] and offset[more] + size[more] - offset[k] <= BYTES_AT_ONCE:
                more += 1
            begin, end = int(offset[k]), int(offset[more - 1] + size[more - 1])
            src = np.repeat(places[k:more] + p.first, head["degree"][k:more])
            for at in range(begin, end, BYTES_AT_ONCE):
                pairs = np.frombuffer(self.files.read(p.name + PAIRS, at, min(BYTES_AT_ONCE, end - at)), PAIR)
                own = src[(at - begin) // PAIR.itemsize :][: len(pairs)]
                yield pa.record_batch([pa.array(own), pa.array(pairs["dst"].astype(np.int64)), pa.array(np.ascontiguousarray(pairs["weight"]))], ["src", "dst", "weight"])
            k = more


@dataclass
class Written(WriterCommitMessage):
    name: str
    first: int
    nodes: int


class AdjacencyWriter(DataSourceArrowWriter):
    """Rows come by ranges of src, in order of it. A task writes a part; parts count once the manifest names them."""

    def __init__(self, options: dict[str, str]):
        self.path, self.run = options["path"].rstrip("/"), uuid.uuid4().hex[:12]

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written | None:
        files, name = Files(self.path), f"part-{self.run}-{uuid.uuid4().hex}"
        nodes: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        before = -1
        with files.fs.open_output_stream(f"{files.folder}/{name}{PAIRS}") as out:
            for b in batches:
                if not b.num_rows:
                    continue
                src, pairs = b.column(0).to_numpy(), np.empty(b.num_rows, PAIR)
                if src[0] < before or (np.diff(src) < 0).any():
                    raise ValueError("rows must come in order of src")
                before = src[-1]
                pairs["dst"], pairs["weight"] = b.column(1).to_numpy(), b.column(2).to_numpy()
                out.write(pairs.tobytes())
                own, count = np.unique(src, return_counts=True)
                nodes.append(own)
                counts.append(count)
        if not nodes:
            files.fs.delete_file(f"{files.folder}/{name}{PAIRS}")
            return None
        first = int(nodes[0][0])
        degree = np.bincount(np.concatenate(nodes) - first, weights=np.concatenate(counts)).astype(np.int64)
        head = np.empty(len(degree), ENTRY)
        head["offset"], head["degree"] = (np.cumsum(degree) - degree) * PAIR.itemsize, degree
        with files.fs.open_output_stream(f"{files.folder}/{name}{INDEX}") as out:
            out.write(np.array([len(degree)], "<u4").tobytes() + head.tobytes())
        return Written(name, first, len(degree))

    def commit(self, messages: list[Written | None]) -> None:
        files, parts = Files(self.path), sorted((m.first, m.nodes, m.name) for m in messages if m)
        for (a, n, _), (b, _, _) in zip(parts, parts[1:], strict=False):
            if a + n > b:
                self.abort(messages)
                raise ValueError("a node lies in two parts; write by ranges of src")
        with files.fs.open_output_stream(f"{files.folder}/{MANIFEST}.{self.run}") as out:
            out.write(json.dumps([{"name": m, "first": a, "nodes": n} for a, n, m in parts]).encode())
        files.fs.move(f"{files.folder}/{MANIFEST}.{self.run}", f"{files.folder}/{MANIFEST}")
        self._clean(keep={m for _, _, m in parts})

    def abort(self, messages: list[Written | None]) -> None:
        self._clean(keep=set())

    def _clean(self, keep: set[str]) -> None:
        """Delete what tasks of this run have written, also those that failed or ran twice."""
        from pyarrow import fs

        files = Files(self.path)
        for f in files.fs.get_file_info(fs.FileSelector(files.folder, allow_not_found=True)):
            own = f.base_name.startswith(f"part-{self.run}-") or f.base_name == f"{MANIFEST}.{self.run}"
            if own and f.base_name.split(".")[0] not in keep:
                files.fs.delete_file(f.path)


class BinaryAdjacency(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return COLUMNS

    def reader(self, schema) -> DataSourceReader:
        return AdjacencyReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return AdjacencyWriter(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(BinaryAdjacency)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_adjacency_files(spark: SparkSession, folder: str, nodes: list[int] | None = None, nodes_at_once: int = NODES_AT_ONCE, pair: str | None = None) -> DataFrame:
    """src, dst, weight of a folder, or of one file pair in it; of some nodes only, if given: their ranges are all that
    is read."""
    register(spark)
    read = spark.read.format(FORMAT).option("path", folder).option("nodes", str(nodes_at_once))
    rows = (read.option("pair", pair) if pair else read).load()
    return rows if nodes is None else rows.filter(F.col("src").isin(nodes))


def write_adjacency_files(adjacency: DataFrame, folder: str, parts: int | None = None) -> None:
    """Write src, dst, weight (src and dst from 0, below 2^32) by ranges of the source, a node's neighbours by falling
    weight. A folder that exists gets the new parts in one step; a write that fails leaves nothing."""
    register(adjacency.sparkSession)
    files = Files(folder)
    files.fs.create_dir(files.folder, recursive=True)
    dealt = adjacency.select(F.col("src").cast("long"), F.col("dst").cast("long"), F.col("weight").cast("float")).repartitionByRange(*([parts] if parts else []), "src").sortWithinPartitions("src", F.desc("weight"), "dst")
    dealt.write.format(FORMAT).mode("append").option("path", folder).save()
