"""WARC archives: writing with revisit records, reading back, and the capture index.

Writing: a record is a string of built-in expressions, and Spark's text writer puts it into gzip files in the
shared folder; the line separator CR LF after a record's own CR LF is the WARC record end. A file's bytes are
bounded: payloads are written by size class, each with its own number of records a file. Reading: every
archive file is streamed through gzip and cut by Content-Length, so no payload can be mistaken for a record.
Index: each file gives a run sorted by URL key, timestamp and page; the runs are cut at common range bounds
and a loser tree merges the runs of a range, so the ranges in order are all captures in order.

Defined results: a null html is an empty payload; a null url has no Target-URI and the empty URL key; a null
page_id is kept, and refers to nothing; any 64-bit page_id will do; rows that share the largest page_id of equal
payloads are all responses; repeated rows are records of their own, with their own record ids; without a capture
time (no column, or null) a page has that of `FIRST_CAPTURE`, and captures of one time go by page_id; years beyond
9999 come after it; an empty table gives no archive and an empty index; extra columns are ignored.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterable, Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from .common import shared_dir, stage

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
INDEX = "url_key string, ts string, page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, file string, at long"
FIRST_CAPTURE = 1_600_000_000  # seconds; the capture time of pages without one
_SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64()}[x.split()[1]]) for x in INDEX.split(", ")])
#: Payload bytes of a size class (the last has no end), and records a file: 64 MB, or one record, at most.
SIZE_CLASSES = ((16 << 10, 4000), (1 << 20, 64), (None, 1))


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 5 hex digits are 4 base32 digits."""
    hexed = F.sha1(payload)
    parts = []
    for g in range(8):
        v = F.conv(F.substring(hexed, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substr(F.lit(ALPHABET), F.shiftright(v, k).bitwiseAND(31) + 1, F.lit(1)) for k in (15, 10, 5, 0)]
    return F.concat(*parts)


def _one_line(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def record(payload: Column, page: Column, url: Column, ts: Column, digest: Column, refers_to: Column, revisit: Column, number: Column) -> Column:
    """One WARC record without the last CR LF. The record id is the page id and a number of its own; a revisit
    names the page it refers to, as any of that page's records has the payload."""
    page_text, refers = F.coalesce(page.cast("string"), F.lit("")), F.coalesce(refers_to.cast("string"), F.lit(""))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"), F.lit(CRLF * 2))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.octet_length(payload))
    return F.concat(
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(CRLF + "WARC-Record-ID: <urn:capture:"), page_text, F.lit(":"), number, F.lit(">" + CRLF + "WARC-Date: "), ts,
        F.coalesce(F.concat(F.lit(CRLF + "WARC-Target-URI: "), _one_line(url)), F.lit("")),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), digest,
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + CRLF + "Capture-Refers-To-Page: "), refers)).otherwise(""),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), length.cast("string"),
        F.lit(CRLF * 2), http, F.when(revisit, "").otherwise(payload), F.lit(CRLF),
    )


def capture_time(pages: DataFrame, time_col: str | None) -> Column:
    """The capture time in UTC as WARC writes it, whatever the session's time zone."""
    seconds = F.lit(FIRST_CAPTURE) if time_col is None else F.coalesce(F.unix_seconds(F.col(time_col).cast("timestamp")), F.lit(FIRST_CAPTURE))
    utc = F.to_utc_timestamp(F.timestamp_seconds(seconds), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> None:
    """Write one record per page below `path`, a folder for each size class that occurs.

    Digests are counted first, without the payloads; only those that occur more than once are joined to the
    pages again, so a hot payload costs a split join of that one key, and never a window or a list.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    page = F.col(page_col).cast("long")
    made = pages.select(page.alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), base32_sha1(html).alias("digest"), capture_time(pages, time_col).alias("ts"))
    size = F.octet_length("html")
    counted = stage(
        made.groupBy(F.col("digest").alias("__digest")).agg(F.max("page_id").alias("__first"), F.count(F.lit(1)).alias("__n"), F.max(size).alias("__size")).filter("__n > 1 OR __size > 16384"),
        "payloads",
    )
    many = counted.filter(F.col("__n") > 1).filter(F.col("__size") >= min_bytes).select("__digest", "__first")
    largest = counted.agg(F.max("__size")).first()[0] or 0
    joined = made.join(many, F.col("digest") == F.col("__digest"), "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("__first")), F.lit(False)) & F.col("__digest").isNotNull()
    low = 0
    for k, (high, per_file) in enumerate(SIZE_CLASSES):
        if k and largest <= low:
            break
        some = joined.filter(size > low) if k else joined
        some = some.filter(size <= high) if high else some
        number = F.concat(F.lit(f"{k}-"), F.monotonically_increasing_id().cast("string"))
        out = some.select(record(F.col("html"), F.col("page_id"), F.col("url"), F.col("ts"), F.col("digest"), F.col("__first"), revisit, number))
        out.write.mode("overwrite").option("lineSep", CRLF).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(f"{path}/size={k}")
        low = high


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels in reverse, then path and query, lower case, without fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host = (u.hostname or "").split(".")
    except ValueError:
        return url.lower()
    return (",".join(reversed(host)) + ")" + (u.path or "/") + (f"?{u.query}" if u.query else "")).lower()


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset, headers and block of each record of an uncompressed archive."""
    at = 0
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        size, head = len(line), {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            name, _, value = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[name.lower()] = value
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"the record at {at} is cut off")
        yield at, head, block
        at += size + 2 + n + 4


def _number(digits: str | None) -> int | None:
    return int(digits) if digits else None


def time_order(ts: str) -> tuple[int, str]:
    """Sort key of a WARC date; a year of more digits has a sign and comes later."""
    plain = ts.lstrip("+")
    return len(plain), plain


_LOWEST = -(2**63) - 1  # a missing page id comes before all others


def read_archives(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """Index entries of all archives below `path`: each file's run is sorted. With `verify`, the digest of
    every stored payload is taken again and compared."""
    import base64
    import hashlib

    def entries(name: str, content: bytes) -> list[tuple]:
        run = []
        for at, h, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content))):
            head, _, payload = block.partition(b"\r\n\r\n")
            n = int(head.decode("latin-1").rpartition("Content-Length: ")[2].split("\r\n")[0])
            digest = h["warc-payload-digest"].removeprefix("sha1:")
            if h["warc-type"] == "response" and verify and (len(payload) != n or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                raise ValueError(f"{name} at {at}: the payload does not match its digest")
            url = h.get("warc-target-uri")
            run.append((url_key(url), h["warc-date"], _number(h["warc-record-id"].split(":")[2]), url, h["warc-type"], digest, n, _number(h.get("capture-refers-to-page")), name, at))
        run.sort(key=lambda e: (e[0], time_order(e[1]), _LOWEST if e[2] is None else e[2], e[9], name))
        return run

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                run = entries(name, content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in run], f.type) for i, f in enumerate(_SCHEMA)], schema=_SCHEMA)

    ship(spark)
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").option("recursiveFileLookup", "true").load(path)
        return files.select("path", "content").mapInArrow(read, INDEX)
    except Exception as e:  # an empty table leaves no archive
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], INDEX)
        raise


class LoserTree:
    """Merge of k sorted runs: inner nodes keep the loser of their match, the root's winner is next."""

    def __init__(self, runs: list[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head: list = [next(r, None) for r in self.runs] or [None]
        self.loser = [-1] * self.k
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node:
            if self.loser[node] < 0:
                self.loser[node] = i
                return
            if self._beats(self.loser[node], i):
                i, self.loser[node] = self.loser[node], i
            node //= 2
        self.loser[0] = i

    def __iter__(self) -> Iterator:
        while (item := self.head[i := self.loser[0]]) is not None:
            yield item
            self.head[i] = next(self.runs[i], None)
            node = (i + self.k) // 2
            while node:
                if self._beats(self.loser[node], i):
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.loser[0] = i


def _ascending(keys: list[tuple]) -> list[list[tuple]]:
    """The stretches of a list that ascend: one if it is sorted."""
    breaks = [0, *(i for i in range(1, len(keys)) if keys[i] < keys[i - 1]), len(keys)]
    return [keys[a:b] for a, b in zip(breaks, breaks[1:], strict=False)]


def merge_runs(index: DataFrame, per_range: int = 50_000) -> DataFrame:
    """All captures, ordered: `range_no` and `place` in it. Bounds are sampled by repartitionByRange; page and
    place are part of the key, so the captures of one URL can be split over ranges. Spark may fetch the blocks
    of a run in any order: every ascending stretch that arrives is a run of the merge."""
    ranges = max(1, -(-index.count() // per_range))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        url, ts, page, at, file = (rows.column(c).to_pylist() for c in ("url_key", "ts", "page_id", "at", "file"))
        keys = list(zip(url, map(time_order, ts), [_LOWEST if x is None else x for x in page], at, file, range(len(url)), strict=True))
        merged = rows.take(pa.array([k[-1] for k in LoserTree(_ascending(keys))], pa.int64()))
        yield from merged.append_column("place", pa.array(range(len(url)), pa.int64())).to_batches()

    plain = F.ltrim(F.lit("+"), F.col("ts"))
    dealt = index.repartitionByRange(ranges, "url_key", F.length(plain), plain, "page_id", "at", "file").withColumn("range_no", F.spark_partition_id())
    ship(index.sparkSession)
    return dealt.select("range_no", *index.columns).mapInArrow(merge, "range_no int, " + INDEX + ", place long")


def capture_histories(pages: DataFrame, path: str | None = None, min_bytes: int = 0, page_col: str = "page_id", url_col: str = "url", html_col: str = "html", time_col: str | None = None) -> DataFrame:
    """Write the archives, read them back and merge their index runs."""
    spark = pages.sparkSession
    path = path or shared_dir(spark, "archives")
    write_archives(pages, path, min_bytes, page_col, url_col, html_col, time_col)
    return merge_runs(stage(read_archives(spark, path), "index-runs"))
