"""Alignment of two tokenizers by a group dictionary.

Byte offsets where a token of A and a token of B end together cut a text's tokens into groups. A slice of
texts writes its distinct groups once, with how often each of its texts holds them; the slices' dictionaries
meet in one table of distinct groups with corpus frequencies. Links are expanded once for each distinct group
and counted by those frequencies, the best count of each B id is found, and the answers go back by group key
to the slices, where they add up for each text. No pair of tokens is ever shuffled by itself.

Defined results: a null or empty text, and one whose tokens do not spell space+text in both vocabularies, has no
tokens: zeros and an empty digest; special tokens inside texts are plain text; repeated rows and ids are aligned
each for itself and all counted; null ids are kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import stage, trimmed
from .packed import pack_counts, unpack_counts
from .packing import LONG_SPACE, PATTERN, default_tokenizer

#: Characters of the texts that share one dictionary, or one text that is longer.
SLICE_CHARS = 8_000_000
SLICES = (
    "slice long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, "
    "kinds array<int>, at binary, times binary, groups array<string>, uses array<long>"
)
ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_SPACES = re.compile(rf"\s{{{LONG_SPACE}}}")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ByteLevel:
    """Byte-level BPE from a vocabulary file; special tokens inside texts are plain text."""

    def __init__(self, path: str):
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the rest from U+0100 on
        rest = sorted(set(range(256)) - set(plain))
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        spec = json.load(open(path, encoding="utf-8"))
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self.path = path
        self.spelt = [b""] * (max([*spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for token, i in ranks.items():
            self.spelt[i] = token
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_SPACE or not _SPACES.search(text):
            return self.fast(text)
        from tokenizers import Tokenizer  # the fast loop's pattern overflows on very long white space

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = True
        return whole.encode(text, add_special_tokens=False).ids


class Pieces:
    """A sentence-piece model, which puts a space before a text."""

    def __init__(self, path: str):
        import sentencepiece as spm

        self.model = spm.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.spelt = [bytes([int(x[3:5], 16)]) if self.model.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(names)]

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1) if text else []


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.a_length, self.b_length = (np.array([len(x) for x in v.spelt], np.int64) for v in (self.a, self.b))
        self.size = max(len(self.a.spelt), len(self.b.spelt))
        #: Decimal ids with what follows them: another id, the end of A's side, the end of a group.
        self.said = [f"{i}{mark}" for mark in ",|;" for i in range(self.size)]

    def groups(self, text: str) -> tuple[int, int, str]:
        """Tokens of A and of B, and the groups as `a1,a2|b1;a3|b2`; nothing where a side does not spell the text."""
        whole = (" " + text).encode()
        a_ids, b_ids = (self.a.encode(" " + text), self.b.encode(text)) if text else ([], [])
        if not text or b"".join(map(self.a.spelt.__getitem__, a_ids)) != whole or b"".join(map(self.b.spelt.__getitem__, b_ids)) != whole:
            return 0, 0, ""
        a, b = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
        a_end, b_end = np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b])
        ends = np.zeros(len(whole) + 1, np.int8)
        ends[a_end] = 1
        ends[b_end] += 2
        a_cut, b_cut = ends[a_end] == 3, ends[b_end] == 3
        group = np.concatenate([np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut])
        order = np.argsort(2 * group + np.repeat([0, 1], [len(a), len(b)]), kind="stable")  # by group, A first
        marked = np.concatenate([a + self.size * a_cut, b + 2 * self.size * b_cut])[order]
        return len(a), len(b), "".join(map(self.said.__getitem__, marked.tolist()))[:-1]


@functools.lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def slice_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per slice: its texts' counts and digests, its distinct groups with their uses, and which groups each
    text holds how often (`kinds` of them a text, numbers in `groups` and times, packed)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        both, part = aligner(a_path, b_path), TaskContext.get().partitionId()
        docs_of: list[tuple] = []
        at: list[np.ndarray] = []
        times: list[np.ndarray] = []
        number: dict[str, int] = {}
        chars = count = 0

        def row() -> pd.DataFrame:
            nonlocal chars, count
            places, n = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (at, times))
            uses = np.bincount(places, weights=n, minlength=len(number)).astype(np.int64)
            ids, n_a, n_b, n_groups, digests, kinds = map(list, zip(*docs_of, strict=True))
            out = pd.DataFrame({
                "slice": [(part << 32) + count], "doc_id": [ids], "n_a": [n_a], "n_b": [n_b], "n_groups": [n_groups], "groups_sha256": [digests], "kinds": [kinds],
                "at": [pack_counts(np.diff(places, prepend=0))], "times": [pack_counts(n)], "groups": [list(number)], "uses": [uses],
            })
            for x in (docs_of, at, times, number):
                x.clear()
            chars, count = 0, count + 1
            return out

        for b in batches:
            ids = b["doc_id"].astype("Int64")
            for doc, text in zip(ids, b["text"], strict=True):
                n_a, n_b, said = both.groups(text or "")
                held = Counter(said.split(";")) if said else Counter()
                docs_of.append((None if doc is pd.NA else int(doc), n_a, n_b, sum(held.values()), hashlib.sha256(said.encode()).hexdigest() if said else "", len(held)))
                for g in held:
                    number.setdefault(g, len(number))
                places = np.fromiter((number[g] for g in held), np.int64, len(held))
                order = np.argsort(places)
                at.append(places[order])
                times.append(np.fromiter(held.values(), np.int64, len(held))[order])
                chars += len(text or "")
                if chars >= slice_chars:
                    yield row()
        if docs_of:
            yield row()

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(trimmed(run), SLICES)


def dictionary(sliced: DataFrame) -> DataFrame:
    """group, uses: the distinct groups of the corpus."""
    return sliced.select(F.explode(F.arrays_zip("groups", "uses")).alias("g")).groupBy(F.col("g.groups").alias("group")).agg(F.sum("g.uses").alias("uses"))


def expand_links(groups: DataFrame) -> DataFrame:
    """group, a, b: the links of each distinct group, which are its last tokens: no others end together."""
    last = lambda side: F.substring_index(F.substring_index("group", "|", side), ",", -1).cast("int")
    return groups.select("group", last(1).alias("a"), last(-1).alias("b"), *[c for c in groups.columns if c != "group"])


def link_counts(groups: DataFrame) -> DataFrame:
    """a, b, count, best: how many links of the corpus join two ids, and whether no other id is joined to b more often."""
    pairs = stage(expand_links(groups).groupBy("a", "b").agg(F.sum("uses").alias("count")), "links")
    highest = pairs.groupBy("b").agg(F.max("count").alias("highest"))
    return pairs.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best"))


def _finish(sliced: pa.Table, answers: pa.Table) -> pa.Table:
    """The texts of one slice, with the answers to its groups added up."""
    names = ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    row = {c: sliced[c][0].as_py() for c in (*names, "kinds", "at", "times")} if sliced.num_rows else {c: [] for c in names}
    n = len(row["doc_id"])
    n_best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if answers.num_rows:
        place = answers["pos"].to_numpy()
        count, best = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        count[place], best[place] = answers["count"].to_numpy(), answers["best"].to_numpy()
        at, times = np.cumsum(unpack_counts(row["at"])), unpack_counts(row["times"])
        owner = np.repeat(np.arange(n), row["kinds"])
        np.add.at(n_best, owner, times * best[at])
        np.add.at(total, owner, times * count[at])
    of = {**row, "n_links": row["n_groups"], "n_best": n_best, "count_sum": total}
    kinds = [c.split() for c in ALIGNED.split(", ")]
    return pa.table({c: pa.array(of[c], pa.string() if kind == "string" else pa.int64()) for c, kind in kinds})


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", slice_chars: int = SLICE_CHARS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    sliced = stage(slice_groups(docs, a_path or default_tokenizer(), b_path or default_pieces(), id_col, text_col, slice_chars), "slices")
    groups = stage(dictionary(sliced), "groups")
    answers = expand_links(groups.select("group")).join(link_counts(groups), ["a", "b"]).select("group", "count", "best")
    asked = sliced.select(F.col("slice").alias("of"), F.posexplode("groups").alias("pos", "group"))
    back = asked.join(answers, "group").select("of", "pos", "count", "best")
    texts = sliced.drop("groups", "uses")
    return texts.groupBy("slice").cogroup(back.groupBy("of")).applyInArrow(_finish, ALIGNED)
