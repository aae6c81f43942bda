"""Benchmark decontamination by suffix arrays of the training documents.

Documents are taken in shards (slices of a partition's record batches). A shard's suffix array holds, sorted, the
suffixes at which a match can begin: positions whose next words are benchmark words in benchmark order, pair
by pair, for at least the shortest window, each read to the end of that run. Every benchmark suffix is looked up in it
by binary search, which gives all places where its first `window` words stand; neighbouring places on one diagonal are
one longest verbatim match, with its locations (`matches`). The words of these places, which are those of the longest
matches, are hit, their items are found, their documents removed. No document word is left out and no match is lost: a match of a window has only
benchmark pairs, so its position is in the array.

The benchmark goes to the executors in blocks of at most `block_words` words, one broadcast each; every shard
is searched for every block, and hits are united by document, so the benchmark may have any size.

Words: ASCII letters in lower case, digits, and everything beyond ASCII; all else separates.

Defined results: a null text has no words, and neither hits nor is hit; an item of no words is never found,
one of fewer than `window` words is a window of its own; rows with the same item_id are one item, a null
item_id is the item with the empty id; repeated documents are judged row by row; empty tables give an empty
result or no hits; extra columns are ignored, or kept by `remove_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import slices, trimmed

REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Characters of a shard, or of one document that is longer by itself.
SHARD_CHARS = 2_000_000
MATCHES = "doc_id long, item_id string, start long, item_start long, n_words long"
_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def split_words(text: str | None) -> list[bytes]:
    return text.encode().translate(_TO_WORDS).split() if text else []


@dataclass
class Block:
    """Some of the benchmark's items: word numbers from 1, the windows, and where each window stands."""

    vocabulary: dict[bytes, int]
    pairs: np.ndarray  # sorted numbers of neighbouring words, first * base + second
    windows: np.ndarray  # sorted distinct windows, as padded bytes
    lengths: np.ndarray  # words of each window
    shown: np.ndarray  # item, place, text (items may have several) of each place of a window, sorted by window
    first: np.ndarray  # where a window's rows in `shown` begin
    before: np.ndarray  # of each row of `shown`, the window that begins one word earlier in the text, or -1
    after: np.ndarray  # and one word later
    found: np.ndarray  # window, item: each pair once, sorted
    items: list[str]
    window: int

    @property
    def base(self) -> int:
        return len(self.vocabulary) + 1


def _keys(rows: np.ndarray) -> np.ndarray:
    """Fixed-width byte strings that order like the rows of word numbers."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


def make_block(items: list[tuple[str, list[bytes]]], window: int) -> Block:
    """About 60 bytes for each word and distinct window of the items, besides the vocabulary."""
    vocabulary: dict[bytes, int] = {}
    names: dict[str, int] = {}
    rows, shown, pairs = [np.empty((0, window), ">u4")], [np.empty((0, 3), np.int64)], [np.empty((0, 2), np.int64)]
    for text, (name, words) in enumerate(items):
        ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words], np.int64)
        pairs.append(np.unique(np.stack([ids[:-1], ids[1:]], axis=1), axis=0))
        item, n = names.setdefault(name, len(names)), max(1, len(ids) - window + 1)
        own = np.zeros((n, window), ">u4")
        if len(ids) >= window:
            own[:] = np.lib.stride_tricks.sliding_window_view(ids, window)
        else:
            own[0, : len(ids)] = ids
        rows.append(own)
        shown.append(np.stack([np.full(n, item), np.arange(n), np.full(n, text)], axis=1))
    base = len(vocabulary) + 1
    matrix, places, two = np.concatenate(rows).astype(">u4"), np.concatenate(shown), np.concatenate(pairs)
    keys, back = np.unique(matrix.view(f"S{4 * window}").ravel(), return_inverse=True)
    order = np.argsort(back, kind="stable")
    lengths = np.zeros(len(keys), np.int64)
    lengths[back] = (matrix > 0).sum(axis=1)
    same = np.zeros(len(places) + 1, bool)  # whether a row and the one before it are neighbours in a text
    same[1:-1] = places[1:, 2] == places[:-1, 2]
    before = np.where(same[:-1], np.append(-1, back[:-1]), -1)
    after = np.where(same[1:], np.append(back[1:], -1), -1)
    found = np.unique(np.stack([back, places[:, 0]], axis=1), axis=0) if len(back) else np.empty((0, 2), np.int64)
    return Block(
        vocabulary, np.unique(two[:, 0] * base + two[:, 1]), keys, lengths,
        places[order], np.searchsorted(back[order], np.arange(len(keys) + 1)), before[order], after[order], found, list(names), window,
    )


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count times, for each of them."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(int(count.sum()))


def sorted_suffixes(keys: np.ndarray, suffix: np.ndarray, run: np.ndarray, read) -> np.ndarray:
    """The order of suffixes whose first words are `keys`, each read to the end of its run, by doubling: suffixes in
    order of their first n words are put in order of 2 n by the order of those that begin n words later. The rounds
    grow with the logarithm of the longest run. read(positions, lengths) gives the keys of the words that follow."""
    if not len(suffix):
        return np.empty(0, np.int64)
    n = int((suffix + run).max())
    edge, end = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    np.add.at(edge, suffix, 1)
    np.add.at(edge, suffix + run, -1)
    np.maximum.at(end, suffix, suffix + run)
    at = np.flatnonzero(np.cumsum(edge)[:n] > 0)  # every position of a run, since a suffix goes on at any of them
    left = np.maximum.accumulate(end)[at] - at
    where = np.zeros(n + 1, np.int64)
    where[at] = np.arange(len(at))
    if len(at) == len(suffix):
        first = np.empty(len(at), keys.dtype)
        first[where[suffix]] = keys
    else:
        first = read(at, left)
    _, rank = np.unique(first, return_inverse=True)
    width = read.window
    while True:
        open_ = (np.bincount(rank)[rank] > 1) & (left > width)
        if not open_.any():
            return np.argsort(rank[where[suffix]], kind="stable")
        then = np.zeros(len(at), np.int64)
        then[open_] = rank[where[at[open_] + width]] + 1
        _, rank = np.unique(rank * (len(at) + 1) + then, return_inverse=True)
        width *= 2


class Reader:
    """Keys of the window that begins at each position, cut at its run's end."""

    def __init__(self, ids: np.ndarray, window: int):
        self.ids, self.window = ids, window

    def __call__(self, positions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        places = np.arange(self.window)
        words = self.ids[np.minimum(positions[:, None] + places, len(self.ids) - 1)]
        return _keys(np.where(places < lengths[:, None], words, 0))


def search(block: Block, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of windows in a shard: document, first word, window. One binary search per suffix."""
    none = np.empty(0, np.int64)
    get, sizes = block.vocabulary.get, np.array([len(d) for d in docs], np.int64)
    total = int(sizes.sum())
    if not total or not len(block.windows):
        return none, none, none
    ids = np.fromiter((get(w, 0) for d in docs for w in d), np.int64, total)
    doc = np.repeat(np.arange(len(docs)), sizes)
    known = np.flatnonzero(ids)
    # how many words from here on follow one another in the benchmark too
    linked = np.zeros(total, bool)
    if len(block.pairs):
        two = known[known < total - 1]
        two = two[(ids[two + 1] > 0) & (doc[two] == doc[two + 1])]
        pair = ids[two] * block.base + ids[two + 1]
        at = np.minimum(np.searchsorted(block.pairs, pair), len(block.pairs) - 1)
        linked[two[block.pairs[at] == pair]] = True
    ends = np.append(np.flatnonzero(~linked), total)
    run = np.where(ids[known] > 0, ends[np.searchsorted(ends, known)] - known + 1, 0)
    keep = run >= block.lengths.min()
    suffix, run = known[keep], run[keep]
    if not len(suffix):
        return none, none, none
    read = Reader(ids, block.window)
    keys = read(suffix, run)
    order = sorted_suffixes(keys, suffix, run, read)
    array, keys = suffix[order], keys[order]
    low = np.searchsorted(keys, block.windows, "left")
    raw = block.windows.astype(f"S{4 * block.window}")
    last = np.frombuffer(raw.tobytes(), np.uint8).reshape(len(raw), -1).copy()
    last[np.arange(last.shape[1]) >= 4 * block.lengths[:, None]] = 255
    high = np.searchsorted(keys, last.view(f"S{4 * block.window}").ravel(), "right")
    found = high - low
    which = np.repeat(np.arange(len(found)), found)
    start = array[np.repeat(low - np.concatenate([[0], np.cumsum(found)[:-1]]), found) + np.arange(int(found.sum()))]
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return doc[start], start - offsets[doc[start]], which


def _unlike(which: np.ndarray, own: np.ndarray, first: np.ndarray, beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of an occurrence of window `which` and a place of it (a row of `shown`) that are not both beside one and
    the same window: `own` beside the occurrence, `beside` beside the place. Nothing else is listed, so that a word
    repeated m times in a text and n times in an item gives m + n pairs and not their product."""
    order = np.lexsort((beside, np.repeat(np.arange(len(first) - 1), np.diff(first))))
    key = np.repeat(np.arange(len(first) - 1), np.diff(first)) * (len(first) + 1) + beside[order] + 1
    ask = which * (len(first) + 1) + own + 1
    low, high = np.searchsorted(key, ask, "left"), np.searchsorted(key, ask, "right")
    low, high = (np.where(own < 0, first[which], x) for x in (low, high))
    head, tail = low - first[which], first[which + 1] - high
    at = np.concatenate([_ranges(first[which], head), _ranges(high, tail)])
    return np.concatenate([np.repeat(np.arange(len(which)), head), np.repeat(np.arange(len(which)), tail)]), order[at]


def longest(block: Block, docs: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Longest verbatim matches in a shard: document, item, first word in either, words. On each diagonal of a text and
    an item's text, matches begin where no window lies before both, and end where none follows both."""
    doc, start, which = search(block, docs)
    if not len(doc):
        return tuple(np.empty(0, np.int64) for _ in range(5))
    whole = block.lengths[which] == block.window
    width = max(map(len, docs)) + 2
    place = np.sort(doc[whole] * width + start[whole])
    window_at = which[whole][np.argsort(doc[whole] * width + start[whole], kind="stable")]

    def beside(step: int) -> np.ndarray:
        ask = doc * width + start + step
        at = np.minimum(np.searchsorted(place, ask), max(len(place) - 1, 0))
        there = whole & (place[at] == ask) if len(place) else np.zeros(len(doc), bool)
        return np.where(there & (start + step >= 0), window_at[at] if len(place) else -1, -1)

    def ends(step: int, shown_beside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        occurrence, row = _unlike(which, beside(step), block.first, shown_beside)
        text, at = block.shown[row, 2], block.shown[row, 1]
        order = np.lexsort((start[occurrence], start[occurrence] - at, text, doc[occurrence]))
        return occurrence[order], row[order]

    (head, row), (tail, _) = ends(-1, block.before), ends(1, block.after)
    return doc[head], block.shown[row, 0], start[head], block.shown[row, 1], start[tail] + block.lengths[which[tail]] - start[head]


class Shard:
    """What all blocks find in one shard of documents."""

    def __init__(self, texts: list[str | None]):
        self.words = [split_words(t) for t in texts]
        self.offsets = np.concatenate([[0], np.cumsum([len(w) for w in self.words])]).astype(np.int64)
        self.edge = np.zeros(int(self.offsets[-1]) + 1, np.int64)
        self.items: dict[int, set[str]] = {}

    def take(self, block: Block) -> None:
        """The words of every window's places are hit, which are those of the longest matches; their items are found."""
        doc, start, which = search(block, self.words)
        at, n = self.offsets[doc] + start, block.lengths[which] if len(which) else which
        np.add.at(self.edge, at, 1)
        np.add.at(self.edge, at + n, -1)
        if not len(doc):
            return
        pair = np.unique(doc * len(block.lengths) + which)
        own, window = pair // len(block.lengths), pair % len(block.lengths)
        low, high = (np.searchsorted(block.found[:, 0], window, side) for side in ("left", "right"))
        items = block.found[_ranges(low, high - low), 1]
        for d, i in np.unique(np.stack([np.repeat(own, high - low), items]), axis=1).T.tolist():
            self.items.setdefault(d, set()).add(block.items[i])

    def report(self) -> pd.DataFrame:
        hit = np.concatenate([[0], np.cumsum(np.cumsum(self.edge[:-1]) > 0)])
        ids = [sorted(self.items.get(d, ())) for d in range(len(self.words))]
        n_hit = hit[self.offsets[1:]] - hit[self.offsets[:-1]]
        return pd.DataFrame({
            "n_words": np.diff(self.offsets), "n_hit": n_hit, "n_items": [len(i) for i in ids],
            "items_sha256": [hashlib.sha256(",".join(i).encode()).hexdigest() for i in ids], "contaminated": n_hit > 0,
        })


def blocks_of(benchmark: DataFrame, window: int, block_words: int, item_col: str, text_col: str) -> list:
    """The benchmark as broadcasts of bounded size; the driver holds one block at a time."""
    sc, out, held, n = benchmark.sparkSession.sparkContext, [], [], 0
    ship(benchmark.sparkSession)
    for row in benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        words = split_words(row["t"])
        if words:
            held.append((row["i"], words))
            n += len(words)
        if n >= block_words:
            out.append(sc.broadcast(make_block(held, window)))
            held, n = [], 0
    if held:
        out.append(sc.broadcast(make_block(held, window)))
    return out


def _each(blocks: list) -> Iterator[Block]:
    for b in blocks:
        yield b.value
        if len(blocks) > 1:
            vars(b).pop("_value", None)  # one block in memory at a time


def _reports(texts: list[str | None], blocks: list) -> pd.DataFrame:
    """Reports of a record batch, in shards; each block is loaded once for all of them."""
    shards = [Shard(texts[cut]) for cut in slices([len(t or "") for t in texts], SHARD_CHARS)]
    for block in _each(blocks):
        for shard in shards:
            shard.take(block)
    return pd.concat([s.report() for s in shards], ignore_index=True)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document: words, hit words, items found, digest of their ids, contaminated."""
    blocks = blocks_of(benchmark, window, block_words, item_col, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                out = _reports(b["text"].tolist(), blocks)
                out.insert(0, "doc_id", b["doc_id"].astype("Int64").array)
                yield out

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(trimmed(run), REPORT)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The longest verbatim matches: document, item, first word in either, words. A short item's match is
    the whole item. Nested shorter matches on other diagonals stand for themselves."""
    blocks = blocks_of(benchmark, window, block_words, item_col, "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = (b.iloc[cut] for b in batches for cut in slices([len(t or "") for t in b["text"]], SHARD_CHARS))
        for b in parts:
            words = [split_words(t) for t in b["text"]]
            ids = b["doc_id"].astype("Int64").array
            for block in _each(blocks):
                d, item, start, place, n = longest(block, words)
                if len(d):
                    yield pd.DataFrame({"doc_id": ids[d], "item_id": [block.items[i] for i in item], "start": start, "item_start": place, "n_words": n})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(trimmed(run), MATCHES)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 1_000_000, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The input rows, all columns, without those that hold a window of the benchmark."""
    blocks = blocks_of(benchmark, window, block_words, item_col, "text")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array((~_reports(b.column(at).to_pylist(), blocks)["contaminated"]).tolist(), pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
