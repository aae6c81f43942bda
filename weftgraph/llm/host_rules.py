"""Quality rules at host level.

Every document gets rule counts; a host's failures are added up, its failure rate is shrunk towards the
corpus by a beta prior that is fitted to all hosts, and the host's verdict goes back to its documents.
All steps are built-in expressions.

Defined results: a null or empty text has no words and fails the base rule; a null source is one host of
its own; repeated rows and repeated ids are judged row by row; an empty table gives an empty result; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, private, stage, words_of

#: The characters that count as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    """min_words, max_repeat_pct: the base rule. The others are graded rules, and host_limit is the
    shrunk failure rate from which a host as a whole is refused."""

    min_words: int = 50
    max_repeat_pct: int = 50
    max_symbols_per_100_words: int = 20
    max_dup_line_pct: int = 30
    min_mean_word: float = 1.5
    max_mean_word: float = 40.0
    host_limit: float = 0.6


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more; n log n in the text's words."""
    n = F.size(words)
    later = lambda k: F.slice(words, k, F.greatest(n - 2, F.lit(0)))
    grams = F.transform(F.arrays_zip(later(1).alias("a"), later(2).alias("b"), later(3).alias("c")), lambda z: F.concat_ws(" ", z["a"], z["b"], z["c"]))

    def covered(ws: Column) -> Column:
        ordered = F.sort_array(F.transform(ws, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

        def runs(s: Column) -> Column:
            m = F.size(s)
            none = F.array(F.struct(F.lit(None).cast("string").alias("w"), F.lit(-1).alias("i")))
            near = F.arrays_zip(s.alias("x"), F.concat(none, F.slice(s, 1, m - 1)).alias("y"), F.concat(F.slice(s, 2, m - 1), none).alias("z"))
            twice = F.filter(near, lambda z: z["x"]["w"].eqNullSafe(z["y"]["w"]) | z["x"]["w"].eqNullSafe(z["z"]["w"]))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda z: F.array(z["x"]["i"], z["x"]["i"] + 1, z["x"]["i"] + 2)))))

        return F.when(F.size(F.array_distinct(ws)) == F.size(ws), F.lit(0)).otherwise(let(ordered, runs))

    return F.when(n < 4, F.lit(0)).otherwise(let(grams, covered))


def rule_counts(text: Column) -> Column:
    """Struct of the five counts of a whole text."""
    body = F.coalesce(text, F.lit(""))
    size = lambda c: F.length(c).cast("long")
    lines = F.filter(F.split(body, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(
        words_of(text),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            size(F.translate(body, SPACES, "")).alias("word_chars"),
            (size(body) - size(F.translate(body, SYMBOLS, ""))).alias("n_symbols"),
            let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            _repeat_words(ws).cast("long").alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
        ),
    )


def base_failed(c: Column, r: Rules) -> Column:
    return (c["n_words"] < r.min_words) | (100 * c["n_repeat_words"] > r.max_repeat_pct * c["n_words"])


def rule_failed(c: Column, r: Rules) -> Column:
    """Any rule, the base rule among them."""
    return (
        base_failed(c, r)
        | (100 * c["n_symbols"] > r.max_symbols_per_100_words * c["n_words"])
        | (100 * c["n_dup_lines"] > r.max_dup_line_pct * c["n_lines"])
        | (c["word_chars"] < r.min_mean_word * c["n_words"])
        | (c["word_chars"] > r.max_mean_word * c["n_words"])
    )


def host_counts(judged: DataFrame, host: str = "source", failed: str = "failed") -> DataFrame:
    """host, n, f: documents and failures."""
    return judged.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(failed).cast("long")).alias("f"))


def host_rates(counts: DataFrame, limit: float = Rules.host_limit) -> DataFrame:
    """Per host: documents, failures, shrunk rate, refused.

    The prior Beta(m*s, (1-m)*s) takes its mean m from all documents and its strength s from the spread of
    the hosts' rates beyond binomial noise (moments). One host, or no spread beyond noise, gives the
    strongest prior, 1e6 documents: every host then has about the corpus rate.
    """
    hosts = stage(counts, "hosts")
    t = hosts.agg(
        F.sum("n").alias("n"), F.sum("f").alias("f"), F.count(F.lit(1)).alias("h"),
        F.sum(F.col("f") * F.col("f") / F.col("n")).alias("ff"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    ).collect()[0]  # one row
    m, strength = 0.0, 1e6
    if t["n"]:
        m = t["f"] / t["n"]
        between = t["ff"] - t["f"] * m  # weighted sum of squared deviations of the rates
        spread = t["n"] - t["nn"] / t["n"]
        var = (between - (t["h"] - 1) * m * (1 - m)) / spread if spread > 0 else 0.0
        if var > 0:
            strength = min(1e6, max(1e-3, m * (1 - m) / var - 1))
    rate = (F.col("f") + m * strength) / (F.col("n") + strength)
    return hosts.select("host", "n", "f", rate.alias("rate"), (rate >= limit).alias("refused"))


def _refuse(rows: DataFrame, host: str, hosts: DataFrame) -> DataFrame:
    """rows with host_refused and host_rate. Hosts stand once each in `hosts`, so the join adds no rows;
    Spark broadcasts them only below its size threshold and splits a hot host otherwise."""
    verdicts = hosts.select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), F.col("refused").alias("host_refused"))
    return rows.join(verdicts, F.col(host).eqNullSafe(F.col("__host")), "left").drop("__host")


def host_rules(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, the counts, base_failed, rule_failed, host_rate, host_refused, kept.
    The texts are read once; only counts are stored."""
    c = F.col("c")
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host_of"), rule_counts(F.col(text_col)).alias("c"))
    judged = counted.select("doc_id", "host_of", *[c[x].alias(x) for x in (*COUNTS, "n_lines")])
    judged = stage(judged, "rule-counts")
    flat = {x: F.col(x) for x in (*COUNTS, "n_lines")}
    judged = judged.withColumns({"base_failed": base_failed(flat, rules), "failed": rule_failed(flat, rules)})
    hosts = host_rates(host_counts(judged, "host_of"), rules.host_limit)
    out = _refuse(judged, "host_of", hosts)
    return out.select(
        "doc_id", *COUNTS, "base_failed", F.col("failed").alias("rule_failed"), "host_rate", "host_refused",
        (~F.col("failed") & ~F.coalesce("host_refused", F.lit(False))).alias("kept"),
    )


def keep_good(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The input rows, all columns, that pass. The rules run once: rows that pass them are staged, and a host's
    failures are its documents less those; no text is shuffled."""
    good = stage(docs.filter(let(rule_counts(F.col(text_col)), lambda c: ~rule_failed(c, rules))), "good-rows")
    each = lambda rows, f: rows.select(F.col(host_col).alias("host"), F.lit(f).alias("one"))
    both = each(docs, 1).union(each(good, -1)).groupBy("host")
    counts = both.agg(F.count_if(F.col("one") > 0).alias("n"), F.sum("one").alias("f"))
    (name,) = private(docs, "refused_host")
    refused = host_rates(counts, rules.host_limit).filter("refused").select(F.col("host").alias(name))
    return good.join(refused, F.col(host_col).eqNullSafe(F.col(name)), "left_anti")
