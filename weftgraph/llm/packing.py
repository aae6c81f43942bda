"""Packing of token sequences by the linear grouping scheme.

Pieces are dealt to shards by a hash; a shard holds about `shard_pieces` pieces whatever the input's size,
so memory is bounded and each shard's packing is independent (the loss is a few sequences a shard). In a
shard, lengths above `large` are sorted and cut into groups of equal cardinality, each rounded up to its
largest; the configurations of these few sizes are optimised by column generation; actual documents take
the places of the rounded ones; what is left over and all small pieces go in by best fit.

Token ids are those of the tokenizers library with the vocabulary file (`tokenizer`) as it is. Plain text is merged
by tiktoken with ranks read from that file, which gives the same ids (tested) at five times the speed; texts that
spell an added token such as <|endoftext|>, or hold very long white space, go through the library itself.

Defined results: a null text is empty and gives the end id alone; repeated rows and ids are packed each for
itself; null ids are kept, and their pieces are dealt out like all others; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import stage, trimmed

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 0
LONG_SPACE = 50_000
_SPACES = re.compile(rf"\s{{{LONG_SPACE}}}")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A function from text to ids, from the vocabulary file at `path`, once for each worker."""
    import tiktoken

    # the printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest from U+0100 on
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    spec = json.load(open(path, encoding="utf-8"))
    special = sorted(t["content"] for t in spec.get("added_tokens", []))
    ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    spelt = re.compile("|".join(map(re.escape, special))) if special else None

    def encode(text: str) -> list[int]:
        if (spelt is None or not spelt.search(text)) and (len(text) <= LONG_SPACE or not _SPACES.search(text)):
            return fast(text)
        return library(path).encode(text, add_special_tokens=False).ids  # the fast loop's pattern overflows on very long white space

    return encode


@functools.lru_cache(maxsize=2)
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cut(n: int, limit: int) -> list[tuple[int, int]]:
    """Start and length of the pieces of n tokens; only the first may be shorter than the limit."""
    first = n % limit or min(n, limit)
    return [(0, first)] + [(s, limit) for s in range(first, n, limit)]


def tokenise(docs: DataFrame, limit: int, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece, without the ids themselves: their CRC-32 stands for them. `row` numbers the pieces of
    a partition; it deals rows that are equal in all else to different shards."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, n_rows = encoder(tokenizer), 0
        for b in batches:
            rows: list[tuple] = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                ids = np.array([*(encode(text) if text else ()), END_ID], "<u4")
                rows += [(doc, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cut(len(ids), limit))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"), row=np.arange(n_rows, n_rows + len(out)))
            n_rows += len(out)

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(trimmed(run), PIECES + ", row long")


def configurations(sizes: np.ndarray, demand: np.ndarray, limit: int, rounds: int = 4000) -> list[tuple[np.ndarray, int]]:
    """Counts of each configuration (copies of each size in a sequence), from the linear relaxation of the
    configuration problem by column generation, rounded down. sizes: distinct, descending."""
    k = len(sizes)
    basis = np.diag(limit // sizes).astype(float)  # a column: copies of each size
    x = demand / np.diag(basis)
    inverse = np.diag(1.0 / np.diag(basis))
    for step in range(rounds):
        dual = inverse.sum(axis=0)  # every configuration costs one sequence
        value, last = np.zeros(limit + 1), np.full(limit + 1, -1)
        low = int(sizes.min())
        for c in range(low, limit + 1):
            fit = np.searchsorted(-sizes, -c)  # sizes are descending; those from here on fit
            with_item = value[c - sizes[fit:]] + dual[fit:]
            j = int(with_item.argmax())
            if with_item[j] > value[c - 1]:
                value[c], last[c] = with_item[j], fit + j
            else:
                value[c] = value[c - 1]
        if value[limit] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), limit
        while c >= low:
            if last[c] < 0:
                c -= 1
                continue
            column[last[c]] += 1
            c -= int(sizes[last[c]])
        move = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(move > 1e-9, x / move, np.inf)
        out = int(ratio.argmin())
        theta = ratio[out]
        x = np.maximum(x - theta * move, 0)
        x[out] = theta
        basis[:, out] = column
        if step % 64 == 63:
            inverse = np.linalg.inv(basis)
        else:
            inverse[out] /= move[out]
            move[out] = 0
            inverse -= np.outer(move, inverse[out])
    return [(basis[:, i].astype(int), int(x[i] + 1e-6)) for i in range(k) if x[i] + 1e-6 >= 1]


class BestFit:
    """Open sequences by room left; the fullest that still takes a piece is found with one bit scan."""

    def __init__(self, limit: int):
        self.limit, self.by_room, self.mask, self.opened = limit, [[] for _ in range(limit + 1)], 0, 0

    def put_back(self, seq: int, room: int) -> None:
        if room:
            self.by_room[room].append(seq)
            self.mask |= 1 << room

    def place(self, n: int) -> tuple[int, int]:
        """Sequence and offset of a piece of n tokens."""
        fit = self.mask >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            seq = self.by_room[room].pop()
            if not self.by_room[room]:
                self.mask ^= 1 << room
        else:
            seq, room = self.opened, self.limit
            self.opened += 1
        self.put_back(seq, room - n)
        return seq, self.limit - room


class Waiting:
    """Pieces by length; the largest of at most a given length is found with one bit scan."""

    def __init__(self, pieces: np.ndarray, lengths: np.ndarray):
        self.by_length: dict[int, list[int]] = {}
        for i in pieces[::-1].tolist():
            self.by_length.setdefault(int(lengths[i]), []).append(i)
        self.mask = sum(1 << n for n in self.by_length)

    def largest(self, most: int) -> int | None:
        n = (self.mask & ((2 << most) - 1)).bit_length() - 1
        if n < 0:
            return None
        i = self.by_length[n].pop()
        if not self.by_length[n]:
            self.mask ^= 1 << n
        return i


def pack(lengths: np.ndarray, limit: int = 2048, groups: int = 32, large: int = 512, loose: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset for each length (1 to limit). Sequences that are left with a share of more than
    `loose` empty (by rounded places and rounded counts) are opened again and their pieces best-fitted."""
    n = len(lengths)
    seq, offset = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    order = np.argsort(-lengths, kind="stable")
    best = BestFit(limit)
    full = int((lengths == limit).sum())
    seq[order[:full]] = np.arange(full)
    best.opened = full
    order = order[full:]
    big = order[: int((lengths[order] > large).sum())]
    if len(big):
        per = -(-len(big) // groups)
        group = np.arange(len(big)) // per
        top = lengths[big[np.arange(0, len(big), per)]]  # a group's largest comes first
        sizes = np.array(sorted(set(top.tolist()), reverse=True))
        which = np.searchsorted(-sizes, -top)[group]
        waiting = Waiting(big, lengths)
        for counts, times in configurations(sizes, np.bincount(which, minlength=len(sizes)).astype(float), limit):
            places = np.repeat(sizes, counts).tolist()
            for _ in range(times):
                at, s = 0, best.opened
                for j, size in enumerate(places):  # the last place takes the largest piece that the room allows
                    i = waiting.largest(size if j + 1 < len(places) else limit - at)
                    if i is not None:
                        seq[i], offset[i], at = s, at, at + int(lengths[i])
                if at:
                    best.opened += 1
                    best.put_back(s, limit - at)
    for i in order[seq[order] < 0]:
        seq[i], offset[i] = best.place(int(lengths[i]))
    filled = np.bincount(seq, weights=lengths, minlength=best.opened)
    open_again = filled < limit * (1 - loose)
    names = np.cumsum(~open_again) - 1
    again = open_again[seq]
    seq = np.where(again, -1, names[seq])
    best = BestFit(limit)
    best.opened = int((~open_again).sum())
    for i in np.flatnonzero(again)[np.argsort(-lengths[again], kind="stable")]:
        seq[i], offset[i] = best.place(int(lengths[i]))
    return seq, offset


def pack_pieces(pieces: DataFrame, n_pieces: int, limit: int = 2048, shard_pieces: int = 20_000, groups: int = 32) -> DataFrame:
    """Pieces (with their `row`) with sequence_id and offset. n_pieces sets the number of shards."""
    shards = max(1, -(-n_pieces // shard_pieces))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "piece", "ids_crc32", "row"], ascending=[False, True, True, True, True], kind="stable")
        seq, offset = pack(p["length"].to_numpy(), limit, groups)
        return p.drop(columns=["shard", "row"]).assign(sequence_id=seq + (int(key[0]) << 40), offset=offset)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, PACKED)


def best_fit_packing(docs: DataFrame, limit: int = 2048, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text", shard_pieces: int = 20_000, groups: int = 32) -> DataFrame:
    """Documents packed into sequences of at most `limit` tokens: one row per piece."""
    pieces = stage(tokenise(docs, limit, tokenizer or default_tokenizer(), id_col, text_col), "pieces")
    return pack_pieces(pieces, pieces.count(), limit, shard_pieces, groups)
