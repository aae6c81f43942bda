"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

A lexicon is learned from a bounded sample of labelled rows: words and word beginnings whose document frequency
among toxic texts exceeds that among others beyond chance. One scan of all whole texts gives each a row of dense
features: densities of learned and given words, nearness to second-person words, capitals, punctuation and
obfuscation. Trees are boosted on three quarters of the sample, and the last quarter calibrates their
probabilities by isotonic regression (Spark's own learners). Nothing but the text enters a score.

Defined results: a null or empty text is scored like any text, with all features zero; a null id is never held
out; a document with several labels is toxic if one of them says so; without labels of both kinds the score is
the share of toxic labels (0 without any); repeated rows are scored each for itself; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import string
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from ..shared import discard
from .common import stage, trimmed

#: Insults that count as such whatever the labels say, by themselves (a parameter).
GIVEN = (
    "idiot idiots idiotic moron morons moronic imbecile stupid dumb dumbass scum scumbag trash loser losers pathetic worthless disgusting filthy vermin bastard bitch "
    "asshole retard creep freak garbage clown hate kill idiota imbécil estúpido basura asqueroso crétin connard salope débile dégoûtant dummkopf arschloch abschaum widerlich trottel"
).split()
#: Words that address the reader (a parameter).
SECOND = "you your yours yourself u ur du dich dir dein deine euch ihr sie tu te toi ton ta tes vous votre vos usted ustedes tú ti vosotros".split()
STEMS = (4, 5, 6, 7, 8)
NEAR = 6  # words
FOLDS = 4
SWAPS = str.maketrans("013457@$!|+€", "oieastasilte")
FEATURES = (
    "learned", "learned_n", "learned_sum", "learned_max", "learned_kinds", "given", "given_sum", "second", "near", "near_sum", "capitals", "shouted", "marks", "calls", "mark_runs",
    "obfuscated", "unmasked", "unmasked_sum", "stretched", "n_words", "word_chars",
)


@dataclass
class Lexicon:
    """Weights (log odds) of words and of word beginnings; given and second-person words."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    given: frozenset[str] = frozenset(GIVEN)
    second: frozenset[str] = frozenset(SECOND)

    def __post_init__(self):
        self.heads = {w[:4] for w in (*self.words, *self.stems, *self.given)}
        self.starred = {w[:i] + "*" + w[i + 1 :] for w in {*self.words, *self.given} if len(w) > 3 for i in range(1, len(w))}

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in STEMS if len(word) >= k)])

    def listed(self, word: str) -> bool:
        return word in self.words or word in self.given


#: What is cut off the ends of a token.
EDGES = string.punctuation + "“”„‘’‚«»‹›¡¿…–—·•、。，！？"
_STRETCH = re.compile(r"(\w)\1{2,}")


def core(token: str) -> str:
    """A token in lower case, without what stands before and after its letters and digits."""
    return token.lower().strip(EDGES)


def unmask(word: str, lexicon: Lexicon) -> bool:
    """Whether a word that is not in the lexicon is one of its words in disguise."""
    if len(word) > 60:
        return False
    if "*" in word:
        return re.sub(r"\*+", "*", word) in lexicon.starred
    plain = [re.sub(r"[\W\d_]", "", w.translate(SWAPS)) for w in (word, word.replace("1", "l"))] if not word.isalpha() else [word]
    plain += [_STRETCH.sub(r"\1" * k, w) for w in plain for k in (1, 2)]
    return any(w != word and lexicon.listed(w) for w in plain)


class Tokens(dict):
    """What is known of each token met so far, as a row of `table`: worked out once for each distinct token. Tokens
    with nothing to them share the first row, or the second if they are shouted."""

    COLUMNS = ("weight", "given", "second", "shouted", "obfuscated", "unmasked", "stretched", "letter")

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon
        self.rows = [[0.0] * len(self.COLUMNS), [0.0] * 3 + [1.0] + [0.0] * 4]

    def __missing__(self, token: str) -> int:
        word, lex = core(token), self.lexicon
        alpha = word.isalpha()
        shouted = len(word) > 2 and token.isupper()
        plain = len(word) < 2 and not alpha
        stretched = len(word) - len(set(word)) > 1 and bool(_STRETCH.search(word))
        if plain or (alpha and not stretched and len(word) > 1 and word[:4] not in lex.heads and word not in lex.second):
            self[token] = int(shouted)
            return int(shouted)
        inner = not alpha and bool(re.search(r"[^\W\d_][\W\d_]+[^\W\d_]", word)) and not re.fullmatch(r"[^\W\d_]+(?:['’-][^\W\d_]+)+", word)
        weight = lex.weight(word)
        masked = not weight and word not in lex.given and (stretched or not alpha) and unmask(word, lex)
        self.rows.append([weight, word in lex.given, word in lex.second, shouted, inner, masked, stretched, len(word) == 1 and alpha])
        self[token] = len(self.rows) - 1
        return len(self.rows) - 1


@functools.lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """Of every character: 1 a capital, 2 a mark, 3 an exclamation mark, 0 anything else."""
    kind = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        of = unicodedata.category(chr(c))
        kind[c] = 1 if of == "Lu" else 2 if of[0] in "PS" and c != 0x5F else 0
    kind[ord("!")] = 3
    return kind


def features(text: str, known: Tokens) -> list[float]:
    """The features of one whole text, in the order of FEATURES."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    ids = np.array(list(map(known.__getitem__, tokens)))
    times = np.bincount(ids)
    kinds = np.flatnonzero(times)
    times = times[kinds]
    t = np.array([known.rows[i] for i in kinds.tolist()], float)
    weight, given, second, shouted, obfuscated, unmasked, stretched, letter = (times @ t).tolist()
    insult = (t[:, 0] > 0) | (t[:, 1] > 0) | (t[:, 5] > 0)
    near, spelt = 0.0, 0
    if second and insult.any():
        you = np.flatnonzero(np.isin(ids, kinds[t[:, 2] > 0]))
        at = np.flatnonzero(np.isin(ids, kinds[insult]))
        after = np.searchsorted(you, at)
        gap = np.minimum(np.abs(at - you[np.minimum(after, len(you) - 1)]), np.abs(at - you[np.maximum(after - 1, 0)]))
        near = float((gap <= NEAR).sum())
    if letter > 3:  # letters with spaces between them
        single = np.isin(ids, kinds[t[:, 7] > 0])
        edges = np.flatnonzero(np.diff(np.concatenate([[0], single.view(np.int8), [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            run = "".join(core(x) for x in tokens[a:b]) if 4 <= b - a <= 40 else ""
            spelt += any(known.lexicon.listed(x) for x in (run, run[1:], run[:-1]))  # an article may stand beside it
    letters = sum(map(len, tokens))
    kind = _kinds()[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")]
    capitals, marks, calls = np.bincount(kind, minlength=4)[1:].tolist()
    mark = kind > 1
    runs = int((mark[1:] & mark[:-1] & ~np.concatenate([[False], mark[:-2]])[: max(len(mark) - 1, 0)]).sum())
    hit = t[:, 0] > 0
    hits = float(hit @ times)
    unmasked += spelt
    return [
        hits / n, np.log1p(hits), np.log1p(weight), float(t[:, 0].max()), np.log1p(float(hit.sum())), given / n, np.log1p(given), second / n, near / n, np.log1p(near),
        capitals / letters, shouted / n, (marks + calls) / letters, calls / n, runs / n, (obfuscated + spelt) / n, unmasked / n, np.log1p(unmasked), stretched / n, np.log1p(n), letters / n,
    ]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def sample_labels(labels: DataFrame, most: int, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """doc_id, label: labelled rows that are not held out, at most half of `most` of each label, in the order of a hash."""
    doc = F.col(id_col).cast("long")
    said = labels.filter(F.col(label_col).isNotNull() & doc.isNotNull() & ~held_out(doc)).groupBy(doc.alias("doc_id")).agg(F.max((F.col(label_col) == 1).cast("int")).alias("label"))
    half = lambda k: said.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most // 2)
    return half(0).union(half(1))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit("lexicon")), F.lit(FOLDS)).cast("int")


def learn_lexicons(texts: DataFrame, most_entries: int = 4000, least_docs: int = 3, least_z: float = 3.0, least_weight: float = 3.0) -> list[Lexicon]:
    """From rows of text, label and fold: for each fold the lexicon of all other folds, then that of all.

    A word that a lexicon took from a text says more of that text than of any other, so trees are fitted to texts
    of a fold by the lexicon that has not seen them. An entry's weight is the log of its odds ratio, `least_weight` or
    more; entries stand out by `least_z` standard errors and occur in `least_docs` toxic texts; of each lexicon at
    most `most_entries`, the surest first, reach the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, Counter] = defaultdict(Counter)  # by kind of entry, label and fold

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(kind + e, label, part, n) for (kind, label, part), c in seen.items() for e, n in c.items()], columns=["entry", "label", "fold", "n"])
            seen.clear()
            return out

        for b in batches:
            for text, label, part in zip(b["text"], b["label"], b["fold"], strict=True):
                words = {core(w) for w in set(text.split())}
                seen["w", label, part].update(w for w in words if 0 < len(w) <= 60)
                for k in STEMS:
                    seen["s", label, part].update({w[:k] for w in words if len(w) >= k})
                if sum(map(len, seen.values())) > 1_000_000:
                    yield rows()
        yield rows()

    n = defaultdict(int)
    for r in texts.groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n")).collect():  # two rows a fold
        n[r["label"], r["fold"]] = r["n"]
    columns = [(k, f) for k in (0, 1) for f in range(FOLDS)]
    counts = texts.select("text", "label", "fold").mapInPandas(trimmed(count), "entry string, label int, fold int, n long").groupBy("entry")
    counts = counts.agg(*[F.sum(F.when((F.col("label") == k) & (F.col("fold") == f), F.col("n")).otherwise(0)).alias(f"n{k}{f}") for k, f in columns])
    counts = stage(counts.filter(sum(F.col(f"n1{f}") for f in range(FOLDS)) >= least_docs), "toxic-words")

    def select(folds: list[int]) -> Lexicon:
        clean, toxic = (sum(n[k, f] for f in folds) for k in (0, 1))
        if not (clean and toxic):
            return Lexicon()
        had, seen = (sum((F.col(f"n{k}{f}") for f in folds), F.lit(0)) for k in (1, 0))
        df = counts.select("entry", had.alias("had"), (had + 0.5).alias("t"), (toxic - had + 0.5).alias("no_t"), (seen + 0.5).alias("c"), (clean - seen + 0.5).alias("no_c")).filter(F.col("had") >= least_docs)
        scored = df.withColumn("weight", F.expr("ln(t / no_t) - ln(c / no_c)")).withColumn("z", F.expr("weight / sqrt(1 / t + 1 / no_t + 1 / c + 1 / no_c)"))
        best = scored.filter((F.col("z") >= least_z) & (F.col("weight") >= least_weight)).orderBy(F.desc("z"), "entry").limit(most_entries).collect()
        pick = lambda kind: {r["entry"][1:]: r["weight"] for r in best if r["entry"][0] == kind}
        return Lexicon(pick("w"), pick("s"))

    out = [select([f for f in range(FOLDS) if f != left]) for left in range(FOLDS)] + [select(list(range(FOLDS)))]
    discard(counts)
    return out


def _features_of(lexicons: list[Lexicon], most_tokens: int = 300_000):
    """A batch function that turns text into features, by the lexicon that column `by` numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = [Tokens(x) for x in lexicons]
        for b in batches:
            out = []
            for text, by in zip(b["text"], b["by"], strict=True):
                out.append(features(text or "", known[by]))
                if len(known[by]) > most_tokens:
                    known[by] = Tokens(lexicons[by])
            yield b.drop(columns=["text", "by"]).assign(doc_id=b["doc_id"].astype("Int64"), features=out)

    return trimmed(run)


def feature_rows(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, features of every document."""
    ship(docs.sparkSession)
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), held_out(doc).alias("held_out"), F.col(text_col).alias("text"), F.lit(0).alias("by"))
    return rows.mapInPandas(_features_of([lexicon]), "doc_id long, held_out boolean, features array<double>")


@dataclass
class Model:
    """Boosted trees and the calibration of their probabilities; `share` alone where there was nothing to learn."""

    share: float
    trees: object = None
    calibration: object = None

    def score(self, rows: DataFrame) -> DataFrame:
        """doc_id, held_out, score of rows with features."""
        from pyspark.ml.functions import array_to_vector

        if self.trees is None:
            return rows.select("doc_id", "held_out", F.lit(self.share).alias("score"))
        out = self.calibration.transform(_probability(self.trees.transform(rows.withColumn("vector", array_to_vector("features")))))
        return out.select("doc_id", "held_out", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("calibrated"))).alias("score"))


def _probability(df: DataFrame) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return df.withColumn("raw", vector_to_array("probability")[1])


def fit(rows: DataFrame, iterations: int = 20, depth: int = 3, rate: float = 0.2, seed: int = 7) -> Model:
    """From rows of doc_id, features and label (a bounded sample)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import IsotonicRegression

    last = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)) == 3
    data = rows.select(array_to_vector("features").alias("vector"), F.col("label").cast("double").alias("label"), last.alias("last"))
    n = {(r["last"], r["label"]): r["n"] for r in data.groupBy("last", "label").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    of = lambda k: n.get((False, k), 0) + n.get((True, k), 0)
    if not (of(0.0) and of(1.0)):
        return Model(1.0 if of(1.0) else 0.0)
    both = lambda part: n.get((part, 0.0), 0) and n.get((part, 1.0), 0)
    split = both(False) and both(True)
    trees = GBTClassifier(featuresCol="vector", labelCol="label", maxIter=iterations, maxDepth=depth, stepSize=rate, minInstancesPerNode=5, seed=seed).fit(data.filter(~F.col("last")) if split else data)
    raw = _probability(trees.transform(data.filter("last") if split else data))
    return Model(of(1.0) / (of(0.0) + of(1.0)), trees, IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(raw.select("raw", "label")))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 100_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Labels are learned from at most `sample_rows`
    labelled rows; their ids and labels, 2 MB, go to every executor, and no text is shuffled but theirs."""
    ship(docs.sparkSession)
    doc = F.col(id_col).cast("long")
    chosen = stage(sample_labels(labels, sample_rows, id_col, label_col), "toxic-labels")
    mine = F.broadcast(chosen.select("doc_id", "label"))
    texts = docs.select(doc.alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(mine, "doc_id").withColumn("fold", fold(F.col("doc_id")))
    # exact copies say nothing new of a word
    fresh = texts.groupBy(F.xxhash64("text"), "label").agg(F.min_by(F.struct("text", "fold"), "doc_id").alias("first"))
    *others, lexicon = learn_lexicons(fresh.select("first.*", "label"))
    sample = texts.withColumnRenamed("fold", "by").mapInPandas(_features_of(others), "doc_id long, label int, features array<double>")
    sample = stage(sample.repartition(8, "doc_id"), "toxic-sample")
    scored = fit(sample).score(stage(feature_rows(docs, lexicon, id_col, text_col), "toxic-features"))
    discard(chosen)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
