"""Context-tree weighting over bytes.

Each bit of a byte is predicted in the context of the bytes before it; a node of the context tree holds
zeros and ones, its Krichevsky-Trofimov estimate, and the weight of stopping there against going one byte
deeper. Block probabilities depend on counts only, so the tree of the whole corpus is fitted from counts of
(context, next byte): counted by partition, added up by shard of the two latest context bytes, which hold
whole subtrees from depth 2 on. The two upper levels need sums over all subtrees: at most 256 x 255 numbers.

Scoring never moves the model to all executors: documents are dealt to blocks of about `block_bytes`; a block
asks each shard for its distinct (context, byte) pairs and words, gets their code lengths back, and adds them
up by document.

The text scored is its words in lower case (A-Z), a space between words and a line end after the last. The
word base line is counted and looked up in the same way, by 64-bit word hashes.

Defined results: a null text counts as empty, which is one end token; a null id is in training; repeated rows
count each; with no training documents every bit has probability one half and the base is log10(1) per token;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import slices, stage
from .packed import merge_counts, pack_counts, pack_floats, pack_sorted, unpack_counts, unpack_floats, unpack_sorted

DEPTH = 6  # context bytes; with the next byte a pair takes 56 bits, the latest context byte first
SLICE_BYTES = 2_000_000
END_WORD = np.uint64(1)
COUNTED = "shard int, keys binary, counts binary, words binary, word_counts binary"
SHARD = "shard int, keys binary, counts binary, words binary, word_counts binary, tokens long, types long, bytes long, node array<int>, zeros array<long>, ones array<long>, below array<double>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"
_U = np.uint64


def held_out(doc: Column) -> Column:
    return F.coalesce(F.crc32(doc.cast("string")) % 5 == 1, F.lit(False))


def canonical(text: str | None) -> bytes:
    return b" ".join(text.encode().lower().split()) + b"\n" if text else b"\n"


def pairs(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every byte of the documents in turn, and the document of each."""
    pad = b"\n" * DEPTH
    raw = b"".join([b"\n" * (7 - DEPTH), *(x for d in docs for x in (pad, d))])
    sizes = np.array([len(d) for d in docs], np.int64)
    if not len(sizes):
        return np.empty(0, _U), np.empty(0, np.int32)
    # eight bytes at every place as one number: the byte itself is on top, the one before it next, and so on
    wide = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    real = np.ones(len(wide), bool)
    begins = np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]]) - 7 + 7 - DEPTH
    for k in range(DEPTH):
        at = begins + k
        real[at[at >= 0]] = False
    wide = wide[real]
    byte = wide >> _U(56)
    wide &= _U((1 << 56) - (1 << 8 * (7 - DEPTH)))
    wide |= byte
    return wide, np.repeat(np.arange(len(docs), dtype=np.int32), sizes)


_TABLE = np.random.default_rng(20).integers(1, 2**63, 256).astype(_U) * _U(2) + _U(1)
_STEP = 0x9E3779B97F4A7C15
_powers = [np.ones(1, _U), np.ones(1, _U)]


def powers(n: int) -> list[np.ndarray]:
    """The first n powers of the step and of its inverse, modulo 2 ** 64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_STEP, pow(_STEP, -1, 2**64))):
            steps = np.full(n, base, _U)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def word_hashes(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token and its document; the words of all documents come first, then their ends. A word's
    hash is a difference of running sums, moved back to place zero."""
    raw = np.frombuffer(b"".join(docs), np.uint8)
    sizes = np.array([len(d) for d in docs], np.int64)
    gap = np.flatnonzero((raw == 32) | (raw == 10))
    start, stop = np.append(0, gap[:-1] + 1)[: len(gap)], gap
    real = stop > start
    start, stop = start[real], stop[real]
    doc = np.searchsorted(np.cumsum(sizes), start, "right").astype(np.int32)
    up, down = powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[stop] - sums[start]) * down[start]
    h = (h ^ (h >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    return np.concatenate([h, np.full(len(docs), END_WORD)]), np.concatenate([doc, np.arange(len(docs), dtype=np.int32)])


class Ranked:
    """The distinct keys of a slice, sorted, and how to add up values of theirs by document."""

    def __init__(self, keys: np.ndarray, doc: np.ndarray):
        order = np.argsort(keys)
        ranked = keys[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1]) if len(ranked) else np.empty(0, bool)
        self.keys, self.which, self.doc = ranked[fresh], np.cumsum(fresh, dtype=np.int32) - 1, doc[order]

    def add(self, value: np.ndarray, docs: int) -> np.ndarray:
        """Sums by document; value: of each distinct key."""
        return np.bincount(self.doc, weights=value[self.which], minlength=docs)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of a pair, by its two latest context bytes."""
    return ((keys >> _U(8 * (DEPTH - 1))) * _U(0x9E3779B1) >> _U(7)) % _U(shards)


def by_shard(keys: np.ndarray, shard: np.ndarray, shards: int) -> list[np.ndarray]:
    """Places of the keys of each shard, in the order of the keys."""
    order = np.argsort(shard, kind="stable")
    return np.split(order, np.searchsorted(shard[order], np.arange(1, shards).astype(shard.dtype)))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x >= 1/2: shift to x + 8, then Stirling's series."""
    shift = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov block probability."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - np.log(np.pi)


@dataclass
class Level:
    """Nodes of one depth and bit: sorted ids (context, bits so far), chance of a one, weight of stopping."""

    ids: np.ndarray
    one: np.ndarray
    stop: np.ndarray


def _nodes(keys: np.ndarray, counts: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = keys >> _U(8 - bit)
    head = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    set_ = ((keys >> _U(7 - bit)) & _U(1)).astype(np.int64) * counts
    total, ones = np.add.reduceat(counts, head), np.add.reduceat(set_, head)
    return ids[head], total - ones, ones


class Subtrees:
    """All nodes of depth 2 and more of one shard, from its counts."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels: dict[tuple[int, int], Level] = {}
        self.top: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        below: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for depth in range(DEPTH, 0, -1):
            if depth < DEPTH:  # drop the oldest context byte
                keys, counts = merge_counts([(keys >> _U(16)) << _U(8) | keys & _U(255)], [counts])
            if not len(keys):
                continue
            for bit in range(8):
                ids, zeros, ones = _nodes(keys, counts, bit)
                deeper = np.zeros(len(ids))
                if bit in below:
                    lower, weighted = below[bit]
                    parent = (lower >> _U(8 + bit)) << _U(bit) | lower & _U((1 << bit) - 1)
                    np.add.at(deeper, np.searchsorted(ids, parent), weighted)
                if depth == 1:  # its weights need all shards
                    self.top.append(((ids >> _U(bit)) << _U(8) | _U(1 << bit) | ids & _U((1 << bit) - 1), zeros, ones, deeper))
                    continue
                kt = log_kt(zeros, ones)
                whole = kt if depth == DEPTH else np.logaddexp(kt, deeper) - np.log(2)
                stop = np.ones(len(ids)) if depth == DEPTH else np.exp(kt - np.log(2) - whole)
                self.levels[depth, bit] = Level(ids, (ones + 0.5) / (zeros + ones + 1.0), stop)
                below[bit] = ids, whole

    def ones(self, keys: np.ndarray, bit: int) -> np.ndarray:
        """Chance of a one at a bit under the mixture from depth 2 on."""
        chance, rest = np.zeros(len(keys)), np.ones(len(keys))
        for depth in range(2, DEPTH + 1):
            level = self.levels.get((depth, bit))
            if level is None:
                break
            ids = (keys >> _U(8 * (DEPTH - depth + 1))) << _U(bit) | (keys & _U(255)) >> _U(8 - bit)
            at = np.minimum(np.searchsorted(level.ids, ids), len(level.ids) - 1)
            seen = level.ids[at] == ids
            here = np.where(seen, level.stop[at], 1.0)  # nothing was seen here or deeper: one half
            chance += rest * here * np.where(seen, level.one[at], 0.5)
            rest *= 1 - here
        return chance + rest * 0.5


@dataclass
class Top:
    """Depths 0 and 1: chance of a one and weight of stopping, by bits so far, and by latest byte and bits."""

    one0: np.ndarray
    stop0: np.ndarray
    one1: np.ndarray
    stop1: np.ndarray

    @staticmethod
    def fit(node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> "Top":
        z1, o1, d1 = np.zeros(65536), np.zeros(65536), np.zeros(65536)
        z1[node], o1[node], d1[node] = zeros, ones, below
        kt1 = log_kt(z1, o1)
        whole1 = np.logaddexp(kt1, d1) - np.log(2)
        seen = z1 + o1 > 0
        z0, o0 = z1.reshape(256, 256).sum(axis=0), o1.reshape(256, 256).sum(axis=0)
        kt0 = log_kt(z0, o0)
        whole0 = np.logaddexp(kt0, np.where(seen, whole1, 0.0).reshape(256, 256).sum(axis=0)) - np.log(2)
        stop0 = np.where(z0 + o0 > 0, np.exp(kt0 - np.log(2) - whole0), 1.0)
        stop1 = np.where(seen, np.exp(kt1 - np.log(2) - whole1), 1.0)
        return Top((o0 + 0.5) / (z0 + o0 + 1), stop0, (o1 + 0.5) / (z1 + o1 + 1), stop1)

    def log10(self, keys: np.ndarray, trees: Subtrees) -> np.ndarray:
        """log10 of the chance of each pair's byte in its context."""
        out = np.zeros(len(keys))
        latest = (keys >> _U(8 * DEPTH)).astype(np.int64)
        byte = (keys & _U(255)).astype(np.int64)
        for bit in range(8):
            node = 1 << bit | byte >> (8 - bit)
            at = latest << 8 | node
            s0, s1 = self.stop0[node], self.stop1[at]
            one = s0 * self.one0[node] + (1 - s0) * (s1 * self.one1[at] + (1 - s1) * trees.ones(keys, bit))
            out += np.log10(np.where(byte >> (7 - bit) & 1, one, 1 - one))
        return out


def distinct(*parts: np.ndarray) -> np.ndarray:
    """Sorted distinct keys. np.unique would hash them first, which takes many times as long as sorting."""
    k = np.sort(np.concatenate(parts)) if parts else np.empty(0, _U)
    return k[np.append(True, k[1:] != k[:-1])] if len(k) else k


def count_pairs(docs: DataFrame, shards: int) -> DataFrame:
    """Counts of pairs and words by shard, one row for each partition and shard (or more, if a partition has
    very many distinct ones)."""

    def rows(held: list, words: list) -> pd.DataFrame:
        keys, counts = merge_counts(*map(list, zip(*held)))
        names, times = merge_counts(*map(list, zip(*words)))
        a, b = by_shard(keys, shard_of(keys, shards), shards), by_shard(names, names % _U(shards), shards)
        out = [(s, pack_sorted(keys[i]), pack_counts(counts[i]), pack_sorted(names[j]), pack_counts(times[j])) for s, (i, j) in enumerate(zip(a, b, strict=True)) if len(i) or len(j)]
        return pd.DataFrame(out, columns=["shard", "keys", "counts", "words", "word_counts"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, words, size = [], [], 0
        for b in batches:
            docs_ = [canonical(t) for t in b["text"]]
            for cut in slices([len(d) for d in docs_], SLICE_BYTES):
                held.append(np.unique(pairs(docs_[cut])[0], return_counts=True))
                words.append(np.unique(word_hashes(docs_[cut])[0], return_counts=True))
                size += len(held[-1][0]) + len(words[-1][0])
                if size > 6_000_000:
                    held, words = [merge_counts(*map(list, zip(*held)))], [merge_counts(*map(list, zip(*words)))]
                    size = len(held[0][0]) + len(words[0][0])
                    if size > 3_000_000:
                        yield rows(held, words)
                        held, words, size = [], [], 0
        if held:
            yield rows(held, words)

    return docs.select("text").mapInPandas(run, COUNTED)


def merge_parts(counted: DataFrame, parts: int) -> DataFrame:
    """counted, added up within `parts` groups of partitions first, so that no task gets a hot shard's rows
    from every partition."""

    def add(p: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merge_counts([unpack_sorted(x) for x in p["keys"]], [unpack_counts(x) for x in p["counts"]])
        words, times = merge_counts([unpack_sorted(x) for x in p["words"]], [unpack_counts(x) for x in p["word_counts"]])
        return pd.DataFrame([(p["shard"].iloc[0], pack_sorted(keys), pack_counts(counts), pack_sorted(words), pack_counts(times))], columns=["shard", "keys", "counts", "words", "word_counts"])

    if parts < 2:
        return counted
    part = F.pmod(F.spark_partition_id(), F.lit(parts))
    return counted.withColumn("part", part).groupBy("shard", "part").applyInPandas(add, COUNTED)


def fit_shards(counted: DataFrame) -> DataFrame:
    """Each shard's counts, its token and word-type numbers, and what depth 1 needs of it."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        keys, counts = merge_counts([unpack_sorted(x) for x in p["keys"]], [unpack_counts(x) for x in p["counts"]])
        words, times = merge_counts([unpack_sorted(x) for x in p["words"]], [unpack_counts(x) for x in p["word_counts"]])
        top = Subtrees(keys, counts).top
        node, zeros, ones, below = (np.concatenate(x) for x in zip(*top)) if top else (np.empty(0),) * 4
        return pd.DataFrame({
            "shard": p["shard"][:1], "keys": [pack_sorted(keys)], "counts": [pack_counts(counts)], "words": [pack_sorted(words)], "word_counts": [pack_counts(times)],
            "tokens": [int(times.sum())], "types": [len(words)], "bytes": [int(counts.sum())], "node": [node.astype(np.int32)], "zeros": [zeros.astype(np.int64)], "ones": [ones.astype(np.int64)], "below": [below.astype(float)],
        })

    return counted.groupBy("shard").applyInPandas(run, SHARD)


def fit_top(fitted: DataFrame) -> tuple[Top, int, int]:
    """The two upper levels (at most 256 x 255 rows come to the driver), training tokens and types."""
    each = fitted.select(F.explode(F.arrays_zip("node", "zeros", "ones", "below")).alias("x"))
    rows = each.groupBy("x.node").agg(F.sum("x.zeros"), F.sum("x.ones"), F.sum("x.below")).collect()
    cols = [np.array([r[i] for r in rows], kind) for i, kind in enumerate((np.int64, float, float, float))]
    t = fitted.agg(F.sum("tokens"), F.sum("types")).collect()[0]
    return Top.fit(*cols), t[0] or 0, t[1] or 0


def score_documents(docs: DataFrame, train: Column | None = None, block_bytes: int = 5_000_000, salt_bytes: int = 1_000_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: tokens, known tokens, base score, log10 probability under the tree.

    train: which rows the model learns from; by default those that are not held out. A shard that holds more
    than `salt_bytes` bytes of training text answers its blocks in several tasks, each with a copy of it.
    """
    spark = docs.sparkSession
    ship(spark)
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), (~held_out(doc) if train is None else train).alias("train"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    blocks = max(1, -(-size // block_bytes))
    shards = int(min(65536, max(8, blocks // 4)))
    counted = merge_parts(count_pairs(rows.filter("train"), shards), -(-blocks // 1024))
    fitted = stage(fit_shards(counted), "tree-shards")
    copies = F.greatest(F.lit(1), F.ceil(F.col("bytes") / salt_bytes)).cast("int")
    salts = {r["shard"]: r["n"] for r in fitted.select("shard", copies.alias("n")).filter("n > 1").collect()}  # fewer than the shards
    top, tokens, types = fit_top(fitted)
    unseen = np.log10(0.5 / (tokens + 0.5 * (types + 1)))

    def canonical_docs(p: pd.DataFrame) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        docs_ = [canonical(t) for t in p["text"]]
        for cut in slices([len(d) for d in docs_], SLICE_BYTES):
            yield np.arange(cut.start, cut.stop), docs_[cut]

    def ask(p: pd.DataFrame) -> pd.DataFrame:
        keys, words = [], []
        for _, docs_ in canonical_docs(p):
            keys.append(distinct(pairs(docs_)[0]))
            words.append(distinct(word_hashes(docs_)[0]))
        keys, words = distinct(*keys), distinct(*words)
        a, b = by_shard(keys, shard_of(keys, shards), shards), by_shard(words, words % _U(shards), shards)
        block = int(p["block"].iloc[0])
        out = [(s, block % salts.get(s, 1), pack_sorted(keys[i]), pack_sorted(words[j]), block) for s, (i, j) in enumerate(zip(a, b, strict=True)) if len(i) or len(j)]
        return pd.DataFrame(out, columns=["shard", "salt", "keys", "words", "block"])

    def answer(asked: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        blank = (np.empty(0, _U), np.empty(0, np.int64))
        keys, counts = (unpack_sorted(model["keys"].iloc[0]), unpack_counts(model["counts"].iloc[0])) if len(model) else blank
        words, times = (unpack_sorted(model["words"].iloc[0]), unpack_counts(model["word_counts"].iloc[0])) if len(model) else blank
        wanted = [unpack_sorted(x) for x in asked["keys"]]
        every = distinct(*wanted)
        trees = Subtrees(keys, counts)
        value = np.concatenate([top.log10(every[i : i + 500_000], trees) for i in range(0, len(every), 500_000)]) if len(every) else np.empty(0)
        out = []
        for block, own, w in zip(asked["block"], wanted, asked["words"], strict=True):
            w = unpack_sorted(w)
            at = np.minimum(np.searchsorted(words, w), max(0, len(words) - 1))
            seen = words[at] == w if len(words) else np.zeros(len(w), bool)
            c = np.where(seen, times[at], 0) if len(words) else np.zeros(len(w), np.int64)
            out.append((block, asked["shard"].iloc[0], pack_floats(value[np.searchsorted(every, own)]), pack_counts(c)))
        return pd.DataFrame(out, columns=["block", "shard", "values", "times"])

    def add_up(p: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        answered = {r.shard: (r.values_, r.times) for r in answers.rename(columns={"values": "values_"}).itertuples()}
        parts = [(at, [len(d) for d in docs_], Ranked(*pairs(docs_)), Ranked(*word_hashes(docs_))) for at, docs_ in canonical_docs(p)]
        keys, words = distinct(*(k.keys for _, _, k, _ in parts)), distinct(*(w.keys for _, _, _, w in parts))
        value, times = np.zeros(len(keys)), np.zeros(len(words), np.int64)
        places = zip(by_shard(keys, shard_of(keys, shards), shards), by_shard(words, words % _U(shards), shards), strict=True)
        for s, (i, j) in enumerate(places):
            if len(i) or len(j):
                value[i], times[j] = unpack_floats(answered[s][0]), unpack_counts(answered[s][1])
        n = len(p)
        score, base, n_tokens, n_known, n_bytes = (np.zeros(n) for _ in range(5))
        log_base = np.where(times > 0, np.log10((times + 0.5) / (tokens + 0.5 * (types + 1))), unseen)
        for at, sizes, k, w in parts:
            found = np.searchsorted(words, w.keys)
            score[at] = k.add(value[np.searchsorted(keys, k.keys)], len(at))
            base[at] = w.add(log_base[found], len(at))
            n_known[at] = w.add((times[found] > 0).astype(float), len(at))
            n_tokens[at] = np.bincount(w.doc, minlength=len(at))
            n_bytes[at] = sizes
        return pd.DataFrame({
            "doc_id": p["doc_id"].astype("Int64"), "held_out": p["held_out"], "n_tokens": n_tokens.astype(np.int64), "n_known": n_known.astype(np.int64),
            "train_tokens": tokens, "base_score": base, "score": score, "n_bytes": n_bytes.astype(np.int64),
        })

    dealt = rows.select("doc_id", "held_out", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).alias("block"))
    asked = dealt.groupBy("block").applyInPandas(ask, "shard int, salt int, keys binary, words binary, block long")
    model = fitted.select("shard", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"), "keys", "counts", "words", "word_counts")
    answers = asked.groupBy("shard", "salt").cogroup(model.groupBy("shard", "salt")).applyInPandas(answer, "block long, shard int, values binary, times binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(add_up, SCORED)


def code_length_per_byte(scored: DataFrame) -> DataFrame:
    """scored with bits_per_byte, the code length of the tree for each byte of the text."""
    return scored.withColumn("bits_per_byte", -F.col("score") / F.log10(F.lit(2.0)) / F.col("n_bytes"))
