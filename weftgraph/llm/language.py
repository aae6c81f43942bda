"""Language identification of spans.

Learning counts, for each language label, hashed three- and four-letter windows and the scripts of its
words, over every training document; the tables add up across partitions and have a fixed size per label.
Prediction scores each word under the languages whose learned scripts include the word's script, and a
Viterbi pass with a switching penalty labels spans; the language with most letters is the document's.

Words are runs of letters and marks, in lower case. Nothing but the text enters a prediction.

Defined results: a text that is null or has no letter is ``und`` with score 0; with no training documents
everything is ``und``; a null id is never held out; equal scores go to the label that sorts first; repeated
rows are judged each for itself; an empty table gives an empty result; extra columns are ignored, or kept by
`keep_identified`.
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import slices, trimmed

BITS = 16  # of a window's bucket
CELLS = 2 << BITS  # three-letter windows, then four-letter ones
BLOCKS = 32  # parts of a table that are added up separately
SHARES = 1024  # tasks that add up a part, before one does
SCORE_CHARS, PATH_CHARS = 1_000_000, 10_000_000
PREDICTED = "doc_id long, held_out boolean, lang_pred string, score double"
SPANS = "doc_id long, span int, lang string, first_word int, n_words int, letters int"

#: First code point of each stretch and its script (fixed values).
SCRIPTS = [
    (0x0000, "Latin"), (0x0250, "other"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"), (0x0700, "other"),
    (0x0750, "Arabic"), (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"),
    (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "other"), (0x1780, "Khmer"),
    (0x1800, "Mongolian"), (0x18B0, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x2C60, "Latin"), (0x2C80, "other"), (0x3040, "Kana"),
    (0x3100, "other"), (0x3130, "Hangul"), (0x3190, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
    (0x20000, "Han"), (0x30000, "other"),
]
NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([s for s, _ in SCRIPTS])
_SCRIPT = np.array([NAMES.index(name) for _, name in SCRIPTS])


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] in "LM" if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


@functools.lru_cache(maxsize=1)
def _real_letters() -> np.ndarray:
    return np.array([unicodedata.category(chr(c))[0] == "L" if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])


@dataclass
class Words:
    """The words of some texts: text of each, first letter's place among the letters, letters, script; and
    the bucket pair of every letter; and which texts have a letter."""

    text: np.ndarray
    start: np.ndarray
    size: np.ndarray
    script: np.ndarray
    three: np.ndarray
    four: np.ndarray
    known: np.ndarray


def find_words(texts: list[str | None]) -> Words:
    lowered = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n\n".join(["", *lowered, ""]).encode("utf-32-le", "replace"), "<u4").astype(np.int64)
    ends = np.cumsum([len(t) + 2 for t in lowered]) + 2
    inside = _letters()[points]
    space = np.where(inside, points, 32).astype(np.uint64)
    at = np.flatnonzero(inside)
    a, b, c, d = space[at - 2], space[at - 1], space[at], space[at + 1]
    a = np.where(b == 32, np.uint64(32), a)
    three = (b * np.uint64(0x9E3779B1) ^ c * np.uint64(0x85EBCA6B) ^ d * np.uint64(0xC2B2AE35)) * np.uint64(0x9E3779B97F4A7C15)
    four = (three ^ (a + np.uint64(7)) * np.uint64(0x27D4EB2F165667C5)) * np.uint64(0x94D049BB133111EB)
    first = ~inside[at - 1]
    start = np.flatnonzero(first)
    head = at[start]
    real = np.unique(np.searchsorted(ends, np.flatnonzero(_real_letters()[points]), "right"))
    known = np.zeros(len(texts), bool)
    known[real] = True
    shift = np.uint64(64 - BITS)
    return Words(
        np.searchsorted(ends, head, "right"), start, np.diff(np.append(start, len(at))), _SCRIPT[np.searchsorted(_STARTS, points[head], "right") - 1],
        (three >> shift).astype(np.int64), (four >> shift).astype(np.int64) + (1 << BITS), known,
    )


@dataclass
class Model:
    """langs, sorted; logp: cells x langs; scripts: script x langs, whether the language is written in it."""

    langs: list[str]
    logp: np.ndarray
    scripts: np.ndarray
    penalty: float = 12.0

    def score(self, w: Words) -> np.ndarray:
        """Log-probability of each word under each language; far below all others outside its scripts."""
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.add.reduceat(self.logp[w.three] + self.logp[w.four], w.start, axis=0)
        fits = self.scripts[w.script]
        return np.where(fits | ~fits.any(axis=1, keepdims=True), out, out - 1e4)

    def paths(self, scores: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The best language of each word; texts run in step, the longest first, so each step is one
        vector operation over all texts that still have words."""
        k, n = len(self.langs), len(scores)
        order = np.argsort(-sizes, kind="stable")
        starts = (np.cumsum(sizes) - sizes)[order]
        steps = int(sizes.max()) if len(sizes) else 0
        active = np.searchsorted(-sizes[order], -np.arange(steps), "left")
        back = np.empty((n, k), np.int8 if k < 128 else np.int32)
        value = np.zeros((len(sizes), k), np.float64)
        stay = np.arange(k)
        for t in range(steps):
            v, rows = value[: active[t]], starts[: active[t]] + t
            best = v.argmax(axis=1)
            jump = v[np.arange(len(v)), best][:, None] - self.penalty
            leave = jump > v
            back[rows] = np.where(leave, best[:, None], stay)
            v[:] = np.where(leave, jump, v) + scores[rows]
        label = np.empty(n, np.int64)
        now = value.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            rows = starts[: active[t]] + t
            label[rows] = now[: active[t]]
            now[: active[t]] = back[rows, now[: active[t]]]
        return label

    def label(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, letters and language of each word, and which texts have a letter."""
        text, size, score, known, base = [], [], [], [], 0
        for cut in slices([len(t or "") for t in texts], SCORE_CHARS):
            w = find_words(texts[cut])
            text.append(w.text + base)
            size.append(w.size)
            score.append(self.score(w).astype(np.float32))
            known.append(w.known)
            base += cut.stop - cut.start
        if not text:
            return np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0, bool)
        t, s = np.concatenate(text), np.concatenate(size)
        return t, s, self.paths(np.concatenate(score), np.bincount(t, minlength=len(texts))), np.concatenate(known)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, share = [], []
        for cut in slices([len(t or "") for t in texts], PATH_CHARS):
            part = texts[cut]
            text, size, label, known = self.label(part)
            k = len(self.langs)
            held = np.bincount(text * k + label, weights=size, minlength=len(part) * k).reshape(-1, k)
            top, whole = held.argmax(axis=1), held.sum(axis=1)
            langs += [self.langs[i] if ok else "und" for i, ok in zip(top, known, strict=True)]
            share += np.where(known & (whole > 0), held.max(axis=1) / np.maximum(whole, 1), 0.0).tolist()
        return langs, np.array(share, float)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_langs: int = 512) -> Model:
    """A model of the labelled texts in `docs`: every row counts. A label's table has a fixed size, so what
    the driver gets is bounded by the number of labels; more than `max_langs` are refused as a mistake."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tables: dict[str, np.ndarray] = {}
        for b in batches:
            for cut in slices([len(t) for t in b["text"]], SCORE_CHARS):
                part = b.iloc[cut]
                w = find_words(part["text"].tolist())
                lang = part["lang"].to_numpy()
                owner = np.repeat(w.text, w.size)
                for name in dict.fromkeys(lang):
                    t = tables.setdefault(name, np.zeros(CELLS + len(NAMES), np.int64))
                    mine = lang == name
                    letters, words = mine[owner], mine[w.text]
                    t[:CELLS] += np.bincount(np.concatenate([w.three[letters], w.four[letters]]), minlength=CELLS)
                    t[CELLS:] += np.bincount(w.script[words], minlength=len(NAMES))
        edges = [CELLS * i // BLOCKS for i in range(BLOCKS)] + [CELLS + len(NAMES)]
        rows = [(name, i, t[edges[i] : edges[i + 1]].tobytes()) for name, t in tables.items() for i in range(BLOCKS)]
        yield pd.DataFrame(rows, columns=["lang", "block", "counts"])

    def total(p: pd.DataFrame) -> pd.DataFrame:
        counts = sum(np.frombuffer(x, np.int64) for x in p["counts"])
        return pd.DataFrame({"lang": p["lang"][:1], "block": p["block"][:1], "counts": [counts.tobytes()]})

    ship(docs.sparkSession)
    kept = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    # added up in two steps: of however many partitions, a task adds up a share first
    kind = "lang string, block int, counts binary"
    shares = kept.mapInPandas(trimmed(count), kind).groupBy("lang", "block", F.pmod(F.spark_partition_id(), F.lit(SHARES)).alias("share")).applyInPandas(lambda p: total(p), kind)
    parts = shares.groupBy("lang", "block").applyInPandas(total, kind)
    tables: dict[str, dict[int, np.ndarray]] = {}
    for row in parts.toLocalIterator():
        tables.setdefault(row["lang"], {})[row["block"]] = np.frombuffer(row["counts"], np.int64)
        if len(tables) > max_langs:
            raise ValueError(f"more than {max_langs} language labels; is {lang_col} a language?")
    langs = sorted(tables)
    whole = np.array([np.concatenate([tables[x][i] for i in range(BLOCKS)]) for x in langs], float).reshape(len(langs), CELLS + len(NAMES))
    cells = whole[:, :CELLS].reshape(len(langs), 2, 1 << BITS)
    logp = np.log((cells + 0.5) / (cells.sum(axis=2, keepdims=True) + 0.5 * (1 << BITS)))
    scripts = whole[:, CELLS:]
    used = scripts >= 0.01 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(langs, np.ascontiguousarray(0.5 * logp.reshape(len(langs), CELLS).T.astype(np.float32)), used.T.copy())


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score (share of the letters in its spans)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            langs, score = shared.value.predict(b["text"].tolist()) if shared.value.langs else (["und"] * len(b), 0.0)
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "held_out": b["held_out"], "lang_pred": langs, "score": score})

    ship(docs.sparkSession)
    doc = F.col(id_col).cast("long")
    return docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), F.col(text_col).alias("text")).mapInPandas(trimmed(run), PREDICTED)


def spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The labelled spans of every document, in order, by words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cut in slices([len(t or "") for t in b["text"]], PATH_CHARS):
                part = b.iloc[cut]
                text, size, label, _ = shared.value.label(part["text"].tolist())
                if not len(text):
                    continue
                fresh = np.ones(len(text), bool)
                fresh[1:] = (text[1:] != text[:-1]) | (label[1:] != label[:-1])
                head = np.flatnonzero(fresh)
                owner = text[head]
                begin = np.searchsorted(text, owner)
                yield pd.DataFrame({
                    "doc_id": part["doc_id"].astype("Int64").array[owner], "span": np.arange(len(head)) - np.searchsorted(owner, owner),
                    "lang": [shared.value.langs[i] for i in label[head]], "first_word": head - begin,
                    "n_words": np.diff(np.append(head, len(text))), "letters": np.add.reduceat(size, head),
                })

    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(trimmed(run), SPANS)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learn from the labelled documents that are not held out, then predict all."""
    return predict(docs, learn(docs.filter(~held_out(F.col(id_col))), text_col, lang_col), id_col, text_col)


def keep_identified(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The input rows, all columns, whose text is in one language: at least `least` of its letters are."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(~held_out(F.col(id_col))), text_col, lang_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score = shared.value.predict(b.column(at).to_pylist()) if shared.value.langs else (["und"] * b.num_rows, np.zeros(b.num_rows))
            yield b.filter(pa.array([x != "und" and s >= least for x, s in zip(langs, score, strict=True)], pa.bool_()))

    ship(docs.sparkSession)
    return docs.mapInArrow(trimmed(run), docs.schema)
