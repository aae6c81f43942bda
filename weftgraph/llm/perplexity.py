"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes, five at a time, so no word is unknown and it serves all languages. It is fitted on all trusted
documents but a fifth of them, by CRC-32, which is left for the limits (or, where a caller gives `sample_bytes`, on a
sample of that size). Their n-grams are counted by tasks, added up by latest byte and fitted there: continuation counts
and back-off weights of orders above the first need no other n-grams, discounts and the first order only counts of a
fixed size. No task holds more than the n-grams after one byte, and the driver no more than a block.

Scoring joins counts block by block: the model is cut by its two latest context bytes into blocks of at most about
`BLOCK_GRAMS` n-grams (those after two bytes stay together), each a broadcast, so the count join is done where the text
is. A slice of documents is reduced to its distinct n-grams, sorted; the stretch of them that a block covers is merged
with it, and the code lengths go back to the documents. No text is shuffled. Texts are scanned once for each block, which
is once unless they have more different n-grams than a block.

A document is kept if its perplexity lies between two quantiles of its language, taken over the trusted
documents the model has not seen: a fifth of them at least. The limits are widened by `slack`, and for short
texts, whose mean is less certain, by 10 ** (spread / sqrt(bytes)).

Defined results: a null text counts as empty, which is one end byte; a null language is a language of its
own; a language with fewer than `least_trusted` unseen trusted documents has the limits of all; without any
trusted document nothing is refused; a null id is never trusted; repeated rows are judged each for itself,
repeated labels count once, and a document with one untrusted label is untrusted; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import slices, stage, trimmed
from .packed import merge_counts, pack_counts, pack_sorted, unpack_counts, unpack_sorted

ORDER = 5
SHARDS = 8
SLICE_BYTES = 1_000_000
#: N-grams of the highest order that a counting task holds, that share a row of the model, and that share a broadcast.
HELD_GRAMS, ROW_GRAMS, BLOCK_GRAMS = 2_000_000, 250_000, 2_000_000
#: Ids of trusted documents that share a broadcast.
IDS = 500_000
_U = np.uint64


def plain(text: str | None) -> bytes:
    return b" ".join(text.encode().split()) + b"\n" if text else b"\n"


def grams(docs: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each byte with the bytes before it, the latest first, then the byte; and the document of each."""
    pad = b"\n" * (order - 1)
    raw = np.frombuffer(b"".join(x for d in docs for x in (pad, d)), np.uint8).astype(_U)
    sizes = np.array([len(d) for d in docs], np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes)
    key = raw.copy()
    for k in range(1, order):
        key[k:] |= raw[:-k] << _U(8 * (order - k))
    return key[np.arange(int(sizes.sum())) + (order - 1) * (doc + 1)], doc


@dataclass
class Table:
    """One order: sorted n-grams with their discounted share, sorted contexts with their back-off weight."""

    ids: np.ndarray
    share: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray


def counts_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(seen: list[int]) -> np.ndarray:
    """Discounts of counts 1, 2 and 3 or more, from counts of counts."""
    n1, n2, n3, n4 = (max(1, k) for k in seen)
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])


def shorter(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams without their oldest byte, and in how many contexts one byte longer each occurs."""
    return merge_counts([(keys >> _U(16)) << _U(8) | keys & _U(255)], [np.ones(len(keys), np.int64)])


def fit_table(keys: np.ndarray, counts: np.ndarray, rates: np.ndarray) -> Table:
    d = rates[np.minimum(counts, 3)]
    context = keys >> _U(8)
    head = np.flatnonzero(np.append(True, context[1:] != context[:-1])) if len(keys) else np.empty(0, int)
    total = np.add.reduceat(counts, head) if len(head) else counts
    taken = np.add.reduceat(d, head) if len(head) else d
    spread = np.diff(np.append(head, len(keys)))
    return Table(keys, ((counts - d) / np.repeat(total, spread)).astype(np.float32), context[head], (taken / np.maximum(total, 1)).astype(np.float32))


def fit_tables(keys: np.ndarray, counts: np.ndarray, order: int = ORDER, rates: list[np.ndarray] | None = None, lowest: int = 1) -> list[Table]:
    """Tables of order `lowest` to `order` from the sorted n-grams of the highest order and their counts; the discounts of
    each of them come from these counts, unless they are given."""
    tables = []
    for n in range(order, lowest - 1, -1):
        if n < order:
            keys, counts = shorter(keys)
        tables.append(fit_table(keys, counts, discounts(counts_of_counts(counts)) if rates is None else rates[n - lowest]))
    return tables[::-1]


def _find(sorted_ids: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_ids, ids), max(0, len(sorted_ids) - 1))
    return at, sorted_ids[at] == ids if len(sorted_ids) else np.zeros(len(ids), bool)


def probability(tables: list[Table], keys: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Interpolated probability of each n-gram's byte."""
    p = np.full(len(keys), 1 / 256)
    for n, t in enumerate(tables, 1):
        ids = (keys >> _U(8 * (order - n + 1))) << _U(8) | keys & _U(255)
        at, known = _find(t.contexts, ids >> _U(8))
        p = np.where(known, (t.backoff[at] if len(t.backoff) else 1) * p, p)
        at, known = _find(t.ids, ids)
        if len(t.ids):
            p += np.where(known, t.share[at], 0)
    return p


def shard_tables(tables: list[Table], shards: int = SHARDS, order: int = ORDER) -> list[tuple[int, int, list[Table]]]:
    """First and last latest byte of each shard, and the parts of all tables it needs."""
    latest = (tables[-1].ids >> _U(8 * (order - 1))).astype(np.int64)
    edges = np.unique(np.concatenate([[0], np.quantile(latest, np.arange(1, shards) / shards).astype(int) if len(latest) else [], [256]]))
    out = []
    for low, high in zip(edges[:-1], edges[1:], strict=True):
        part = [tables[0]]
        for n, t in enumerate(tables[1:], 2):
            a, b = np.searchsorted(t.ids, [_U(int(low) << 8 * (n - 1)), _U(int(high) << 8 * (n - 1))])
            c, d = np.searchsorted(t.contexts, [_U(int(low) << 8 * (n - 2)), _U(int(high) << 8 * (n - 2))])
            part.append(Table(t.ids[a:b], t.share[a:b], t.contexts[c:d], t.backoff[c:d]))
        out.append((int(low), int(high), part))
    return out


def count_grams(docs: DataFrame) -> DataFrame:
    """latest, keys, counts: the n-grams of `docs` added up, a row for each latest byte."""

    def rows(keys: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
        edge = np.searchsorted(keys, np.arange(257, dtype=np.uint64) << _U(8 * (ORDER - 1)))
        return pd.DataFrame([(x, pack_sorted(keys[i:j]), pack_counts(counts[i:j])) for x, (i, j) in enumerate(zip(edge, edge[1:])) if j > i], columns=["latest", "keys", "counts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = [], []
        for b in batches:
            docs_ = [plain(t) for t in b["text"]]
            for cut in slices([len(d) for d in docs_], SLICE_BYTES):
                k, c = np.unique(grams(docs_[cut])[0], return_counts=True)
                keys.append(k)
                counts.append(c)
                if sum(map(len, keys)) > HELD_GRAMS:
                    k, c = merge_counts(keys, counts)
                    keys, counts = [k], [c]
                    if len(k) > HELD_GRAMS // 2:
                        yield rows(k, c)
                        keys, counts = [], []
        if keys:
            yield rows(*merge_counts(keys, counts))

    def add(p: pd.DataFrame) -> pd.DataFrame:
        keys, counts = np.empty(0, np.uint64), np.empty(0, np.int64)
        for k, c in zip(p["keys"], p["counts"]):
            keys, counts = merge_counts([keys, unpack_sorted(k)], [counts, unpack_counts(c)])
        return pd.DataFrame({"latest": p["latest"][:1], "keys": [pack_sorted(keys)], "counts": [pack_counts(counts)]})

    kind = "latest int, keys binary, counts binary"
    return stage(docs.select("text").mapInPandas(trimmed(run), kind).groupBy("latest").applyInPandas(add, kind), "counts")


def fit(counted: DataFrame) -> tuple[Table, DataFrame]:
    """The table of the first order, and low, high, n, tables: the others, for the n-grams whose two latest bytes, as one
    number, lie from low to high, n of them of the highest order."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for packed, times in zip(b["keys"], b["counts"]):
                keys, counts, seen = unpack_sorted(packed), unpack_counts(times), []
                for n in range(ORDER, 1, -1):
                    if n < ORDER:
                        keys, counts = shorter(keys)
                    seen += counts_of_counts(counts)
                yield pd.DataFrame({"seen": [seen], "first": [np.bincount((keys & _U(255)).astype(int), minlength=256).tolist()]})

    found = counted.mapInPandas(measure, "seen array<long>, first array<long>").collect()  # one row of a fixed size for each byte
    seen = np.sum([r["seen"] for r in found], axis=0, dtype=int).reshape(-1, 4)[::-1] if found else np.zeros((ORDER - 1, 4), int)
    rates = [discounts(x.tolist()) for x in seen]
    first = np.sum([r["first"] for r in found], axis=0, dtype=np.int64) if found else np.zeros(256, np.int64)
    bytes_ = np.flatnonzero(first)
    lowest = fit_table(bytes_.astype(np.uint64), first[bytes_], discounts(counts_of_counts(first[bytes_])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for packed, times, latest in zip(b["keys"], b["counts"], b["latest"]):
                tables = fit_tables(unpack_sorted(packed), unpack_counts(times), ORDER, rates, 2)
                pair = (tables[-1].ids >> _U(8 * (ORDER - 2))).astype(np.int64) - 256 * latest
                upto = np.cumsum(np.bincount(pair, minlength=256))
                low = 0
                while low < 256:  # as many second bytes as have few enough n-grams, one at least
                    high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + ROW_GRAMS, side="right")))
                    part = _between(tables, 256 * latest + low, 256 * latest + high)
                    n = len(part[-1].ids)
                    if n:
                        yield pd.DataFrame({"low": [256 * latest + low], "high": [256 * latest + high], "n": [n], "tables": [_packed(part)]})
                    low = high

    return lowest, stage(counted.mapInPandas(trimmed(run), "low int, high int, n long, tables binary"), "model")


def _between(tables: list[Table], low: int, high: int) -> list[Table]:
    """The parts of the tables of order 2 and more for two latest bytes from low to high; order 2 has the latest only."""
    out = []
    for n, t in enumerate(tables, 2):  # n-grams of order n are numbers of n bytes, the latest of their context first
        shift = 8 * (n - 2)
        a, b = np.searchsorted(t.ids, [_U(x << shift) for x in ((low >> 8) << 8, ((high - 1 >> 8) + 1) << 8)] if n == 2 else [_U(low << shift), _U(high << shift)])
        c, d = np.searchsorted(t.contexts, [_U(low >> 8), _U((high - 1 >> 8) + 1)] if n == 2 else [_U(low << shift - 8), _U(high << shift - 8)])
        out.append(Table(t.ids[a:b], t.share[a:b], t.contexts[c:d], t.backoff[c:d]))
    return out


def _packed(tables: list[Table]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **{f"{name}{n}": getattr(t, name) for n, t in enumerate(tables) for name in ("ids", "share", "contexts", "backoff")})
    return out.getvalue()


def _unpacked(data: bytes) -> list[Table]:
    with np.load(io.BytesIO(data)) as z:
        return [Table(*(z[f"{name}{n}"] for name in ("ids", "share", "contexts", "backoff"))) for n in range(ORDER - 1)]


def model_blocks(model: DataFrame) -> list[tuple[int, int]]:
    """First and last two latest bytes of the blocks; between them there is no n-gram of the model left out."""
    blocks, held = [], 0
    for r in model.select("low", "high", "n").orderBy("low").collect():  # a row for ROW_GRAMS n-grams
        if blocks and held + r["n"] <= BLOCK_GRAMS:
            blocks[-1], held = (blocks[-1][0], r["high"]), held + r["n"]
        else:
            blocks.append((r["low"], r["high"]))
            held = r["n"]
    edges = [0, *(low for low, _ in blocks[1:]), 1 << 16]
    return list(zip(edges, edges[1:]))


def trusted_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents all of whose labels say quality 1 and not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    return labels.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.min(F.coalesce(good, F.lit(False))).alias("good")).filter("good").select("doc_id")


def sample_ids(docs: DataFrame, trusted: DataFrame, sample_bytes: int, id_col: str, text_col: str) -> DataFrame:
    """Ids of a sample of the trusted documents, a fifth of which (by CRC-32) is left for the limits. A document
    counts for its bytes, and for 64 at least, so the sample has at most sample_bytes / 64 ids; what is put in
    order for it is about four times the sample, whatever the input's size."""
    sizes = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.octet_length(text_col), F.lit(64)).cast("long").alias("size")).join(trusted, "doc_id", "left_semi")
    sizes = sizes.groupBy("doc_id").agg(F.sum("size").alias("size")).filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    sizes = stage(sizes.withColumn("place", place), "trusted-sizes")
    fitting = sizes.filter(F.col("size") <= sample_bytes // 4)
    whole = fitting.agg(F.sum("size")).first()[0]
    if not whole:
        least = sizes.agg(F.min(F.struct("size", "place", "doc_id")).alias("m")).filter("m IS NOT NULL")
        return least.select(F.col("m.doc_id").alias("doc_id"))
    some = fitting.filter(F.col("place") < 4 * sample_bytes / whole) if whole > sample_bytes else fitting
    return some.withColumn("filled", F.sum("size").over(Window.orderBy("place", "doc_id"))).filter(F.col("filled") <= sample_bytes).select("doc_id")


def texts_of(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """text of the documents whose id is one of `ids`. Texts stay where they are: ids go to them, a bounded number at a time."""
    rows, out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), None
    blocks = max(1, -(-ids.count() // IDS))
    for i in range(blocks):
        some = ids.filter(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i)
        part = rows.join(F.broadcast(some), "doc_id", "left_semi").select("text")
        out = part if out is None else out.union(part)
    return out


def perplexities(docs: DataFrame, lowest: Table, model: DataFrame, keep: list[str], id_col: str, text_col: str) -> DataFrame:
    """doc_id, the columns `keep`, bytes and byte perplexity of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("text"))
    blocks = model_blocks(model)
    if len(blocks) == 1:
        return _code_lengths(rows, lowest, model, *blocks[0]).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("total") / F.col("n_bytes"))).drop("total")
    # the same row is told from others by all it has, a digest of its text too; equal rows have equal lengths
    rows, own = rows.withColumn("digest", F.sha2(F.coalesce("text", F.lit("")), 256)), ["doc_id", *keep, "digest", "n_bytes"]
    each = None
    for low, high in blocks:
        part = stage(_code_lengths(rows, lowest, model, low, high), "code-lengths")
        each = part if each is None else each.union(part)
    total = each.groupBy(*own).agg(F.sum("total").alias("total"), (F.count(F.lit(1)) / len(blocks)).cast("int").alias("copies"))
    total = total.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("total") / F.col("copies") / F.col("n_bytes")))
    return total.withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("doc_id", *keep, "n_bytes", "perplexity")


def _code_lengths(rows: DataFrame, lowest: Table, model: DataFrame, low: int, high: int) -> DataFrame:
    """The rows without their text, n_bytes and total: the sum of log10 of the probabilities of the bytes after two latest
    bytes from low to high."""
    parts = sorted(model.filter((F.col("low") >= low) & (F.col("low") < high)).collect(), key=lambda r: r["low"])  # a block
    edges = [low, *(r["low"] for r in parts[1:]), high]
    held = rows.sparkSession.sparkContext.broadcast((lowest, [(a, b, r["tables"]) for a, b, r in zip(edges, edges[1:], parts)] or [(low, high, None)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, packed = held.value
        nothing = [Table(*(np.empty(0, t) for t in (np.uint64, np.float32, np.uint64, np.float32)))] * (ORDER - 1)
        parts = [(a, b, [first, *(nothing if x is None else _unpacked(x))]) for a, b, x in packed]
        whole = low == 0 and high == 1 << 16
        for b in batches:
            docs_ = [plain(t) for t in b["text"]]
            for cut in slices([len(d) for d in docs_], SLICE_BYTES):
                key, doc = grams(docs_[cut])
                if not whole:
                    here = (key >= _U(low << 8 * (ORDER - 2))) & (key < _U(high << 8 * (ORDER - 2)))
                    key, doc = key[here], doc[here]
                order = np.argsort(key)
                ranked = key[order]
                head = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.empty(0, int)
                asked, value = ranked[head], np.empty(len(head))
                for x, y, part in parts:
                    i, j = np.searchsorted(asked, [_U(x << 8 * (ORDER - 2)), _U(y << 8 * (ORDER - 2))])
                    value[i:j] = np.log10(probability(part, asked[i:j]))
                each = np.repeat(value, np.diff(np.append(head, len(ranked))))
                own = b.iloc[cut]
                n = np.array([len(d) for d in docs_[cut]])
                total = np.bincount(doc[order], weights=each, minlength=len(n))
                yield own.drop(columns="text").assign(doc_id=own["doc_id"].astype("Int64"), n_bytes=n, total=total)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInPandas(trimmed(run), schema + ", n_bytes long, total double")


def quality_by_perplexity(
    docs: DataFrame, labels: DataFrame, low: float = 0.002, high: float = 0.99, slack: float = 1.15, spread: float = 2.0,
    sample_bytes: int | None = None, least_trusted: int = 50,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """One row per document: doc_id, lang, n_bytes, perplexity, least, most, kept."""
    ship(docs.sparkSession)
    trusted = stage(trusted_ids(labels, id_col), "trusted")
    fitted = trusted.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0) if sample_bytes is None else sample_ids(docs, trusted, sample_bytes, id_col, text_col)
    sample = stage(fitted, "sample")
    lowest, model = fit(count_grams(texts_of(docs, sample, id_col, text_col)))
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(lang_col).alias("lang"), F.col(text_col).alias("__text"))
    scored = stage(perplexities(rows, lowest, model, ["lang"], "__doc", "__text"), "perplexities")
    unseen = scored.join(trusted.join(sample, "doc_id", "left_anti"), "doc_id", "left_semi")
    limits = lambda g: g.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("perplexity", [low, high], 100_000).alias("q"))
    overall = limits(unseen).collect()[0]
    least, most = (float(x) for x in overall["q"]) if overall["n"] else (0.0, float("inf"))
    by_lang = limits(unseen.groupBy(F.col("lang").alias("__lang"))).filter(F.col("n") >= least_trusted)
    by_lang = stage(by_lang.select("__lang", F.col("q")[0].alias("least"), F.col("q")[1].alias("most")), "limits")
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang")
    out = out.withColumns({"least": F.coalesce("least", F.lit(least)), "most": F.coalesce("most", F.lit(most))})
    wide = F.lit(slack) * F.pow(F.lit(10.0), F.lit(spread) / F.sqrt("n_bytes"))
    return out.withColumn("kept", F.col("perplexity").between(F.col("least") / wide, F.col("most") * wide))
