"""How five filters act on each other: which documents each removes, in every order.

A document fails A when it has few words, B when its words repeat, C when it has many capitals, D when it holds
a symbol, and E when its text is that of a smaller id. One scan gives the mask of A to D, the length and the
hashes of successive blocks of every text. Duplicates come by partition refinement: classes of equal length are
split by one block's hash after the other and classes of one are dropped; the texts of what survives are
compared in full with that of the least id. The audit is then arithmetic on the counts of the 32 masks of a part.

Defined results: a null text is empty; a null source is the part named by the empty string; a null id is nobody's
duplicate and has no duplicates; rows that repeat id and text are not duplicates of each other, and all of them
are duplicates of a smaller id's; a document with several labels is good (or toxic) if one of them says so; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import bit_table, cells_for, may_hold
from .common import let, stage, words_of
from ..shared import discard

LETTERS = "ABCDE"
#: Code points of the first block; each further block is eight times as long as the one before.
BLOCK, GROWTH = 64, 8
#: Copies that one copy of a class's text is compared with.
COPIES = 512


@dataclass(frozen=True)
class Filters:
    min_words: int = 50
    min_distinct_pct: int = 65
    max_capital_pct: int = 5
    symbols: str = "[#$%&*|]"


def mask(text: Column, f: Filters = Filters()) -> Column:
    """Bits 1, 2, 4 and 8 for the failures of A to D."""
    body = F.coalesce(text, F.lit(""))
    capitals = F.length(F.regexp_replace(body, "[^A-Z]+", ""))
    bit = lambda failed, k: F.when(failed, F.lit(1 << k)).otherwise(F.lit(0))
    of_words = let(
        words_of(text),
        lambda w: bit(F.size(w) < f.min_words, 0) + bit(F.lit(100).cast("long") * F.size(F.array_distinct(w)) < F.lit(f.min_distinct_pct).cast("long") * F.size(w), 1),
    )
    return of_words + bit(F.lit(100).cast("long") * capitals > F.lit(f.max_capital_pct).cast("long") * F.length(body), 2) + bit(body.rlike(f.symbols), 3)


def block_hashes(text: Column, length: Column) -> Column:
    """The hash of each block of a text, in order; a text of n code points has about log n of them."""
    starts, size, at = [], BLOCK, 0
    while at < 2**31 - 1:
        starts.append((at, min(size, 2**31 - 1)))
        at, size = at + size, size * GROWTH
    blocks = F.filter(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(n).alias("n")) for a, n in starts]), lambda b: b["a"] < length)
    return F.transform(blocks, lambda b: F.xxhash64(F.substring(text, b["a"] + 1, b["n"])))


def refine(rows: DataFrame) -> DataFrame:
    """id, length, signature of the rows whose class still has two ids when every block is read.

    rows: id, length, hashes. Each round splits the classes by one more block and drops classes of one id; texts
    that end leave the rounds with the class they have reached."""
    rows = rows.select("id", "length", "hashes", F.xxhash64("length").alias("cls"))
    done, old, k = [], [], 0
    while True:
        sizes = rows.groupBy("cls").agg((F.min("id") < F.max("id")).alias("several")).filter("several").select("cls")
        kept = stage(rows.join(sizes, "cls", "left_semi"), "refined")
        done.append(kept.filter(F.size("hashes") <= k).select("id", "length", F.col("cls").alias("signature")))
        open_ = kept.filter(F.size("hashes") > k)
        old.append(kept)
        if not open_.take(1):
            break
        rows = open_.withColumn("cls", F.xxhash64("cls", F.col("hashes")[k]))
        k += 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    out = stage(out.distinct(), "refined-classes")
    out = stage(with_first(out), "survivors")
    discard(*old)
    return out


def with_first(rows: DataFrame) -> DataFrame:
    """Rows of classes of several ids, with the least id of the class and the number of tasks its copies are dealt to."""
    classes = rows.groupBy("signature").agg(F.min("id").alias("least"), F.ceil(F.count(F.lit(1)) / COPIES).cast("int").alias("salts"), F.max("id").alias("most"))
    return rows.join(classes.filter("least < most").drop("most"), "signature")


def signature(length: Column, hashes: Column) -> Column:
    """The class that refinement ends at: the hashes folded one after the other."""
    return F.aggregate(hashes, F.xxhash64(length), lambda s, h: F.xxhash64(s, h))


def duplicates(docs: DataFrame, hashed: DataFrame, judged: Column, part: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, part, mask of every row whose text is also the text of a smaller id.

    hashed: id, length, hashes of every row. Rows that refinement leaves are read again, and their texts compared
    in full: with that of the least id of the class, dealt to as many tasks as the class is large. What differs
    from it, which only equal hashes can bring about, is compared once more among itself."""
    survivors = refine(hashed.filter("id IS NOT NULL"))
    cells = cells_for(survivors.count())
    wanted = bit_table(survivors, "id", cells)
    text, doc = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    rows = may_hold(docs.select(doc.alias("id"), part.alias("part"), text.alias("text")), F.col("id"), stage(wanted, "wanted"), cells)
    rows = rows.withColumn("length", F.length("text")).withColumn("signature", signature(F.col("length"), block_hashes(F.col("text"), F.col("length"))))
    rows = rows.join(survivors, ["id", "length", "signature"]).select("id", "part", "text", "signature", "least", "salts", judged.alias("mask"))
    rows = stage(rows, "suspects")
    found, old = [], [survivors, rows]
    while True:
        # a repeated id may have several texts in one class: the least of them in order of text is the first
        first = rows.filter("id = least").groupBy("signature", "salts").agg(F.min("text").alias("first"))
        first = first.select("signature", "first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        asked = rows.withColumn("salt", F.pmod(F.xxhash64("id", "part"), F.col("salts")).cast("int"))
        same = F.col("text") == F.col("first")
        met = asked.join(first, ["signature", "salt"]).select("id", "part", "mask", "signature", "least", same.alias("same"), F.when(~same, F.col("text")).alias("text"))
        met = stage(met, "compared")
        found.append(met.filter("same AND id > least").select("id", "part", "mask"))
        rest = met.filter("NOT same").select("id", "part", "mask", "signature", "text")
        old.append(met)
        if not rest.take(1):
            break
        rows = stage(with_first(rest), "suspects")
        old.append(rows)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = stage(out, "duplicates")
    discard(*old)
    return out


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Filters = Filters(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask (bits of A to E), n, good, toxic: documents with exactly these failures, none if zero."""
    doc, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col), F.lit(""))
    cut = docs.select(doc.alias("id"), part.alias("part"), text.alias("text"))
    cut = cut.select("id", "part", mask(F.col("text"), filters).alias("mask"), F.length("text").alias("length"), block_hashes(F.col("text"), F.length("text")).alias("hashes"))
    scanned = stage(cut, "masks")
    copies = duplicates(docs, scanned.select("id", "length", "hashes"), mask(F.col("text"), filters), part, id_col, text_col)
    # a copy's row moves from its mask without E to that with it
    signed = scanned.select("id", "part", "mask", F.lit(1).alias("n")).unionByName(copies.select("id", "part", "mask", F.lit(-1).alias("n"))).unionByName(copies.select("id", "part", (F.col("mask") + 16).alias("mask"), F.lit(1).alias("n")))
    signed = signed.groupBy("id", "part", "mask").agg(F.sum("n").alias("n"))
    said = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = signed.join(said, "id", "left")
    counted = joined.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    out = stage(counted.filter("n > 0"), "mask-counts")
    discard(scanned, copies)
    return out


def audit(counts: DataFrame) -> DataFrame:
    """600 rows for each part, from its mask counts: every order of the five filters, every step."""
    steps = [
        (order, k + 1, 1 << LETTERS.index(letter), sum(1 << LETTERS.index(x) for x in order[:k]))
        for order in map("".join, permutations(LETTERS))
        for k, letter in enumerate(order)
    ]
    grid = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(p).alias("before")) for o, s, b, p in steps])
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # 32 at most
    rows = by_part.select("part", "masks", F.explode(grid).alias("g"))
    has = lambda m, bits: m["mask"].bitwiseAND(bits) != 0
    total = lambda which, value: F.aggregate(F.filter("masks", which), F.lit(0).cast("long"), lambda s, m: s + value(m))
    bit, before = F.col("g.bit"), F.col("g.before")
    removed = lambda m: has(m, bit) & ~has(m, before)
    n = lambda m: m["n"]
    return rows.select(
        "part", F.col("g.filter_order").alias("filter_order"), F.col("g.step").alias("step"),
        total(lambda m: ~has(m, bit.bitwiseOR(before)), n).alias("kept"), total(removed, n).alias("removed"),
        total(lambda m: has(m, bit) & has(m, before), n).alias("redundant"), total(lambda m: m["mask"] == bit, n).alias("unique_fails"),
        total(removed, lambda m: m["good"]).alias("good_lost"), total(removed, lambda m: m["toxic"]).alias("toxic_lost"),
        # of the orders of its failures, an equal share puts each of them first
        total(lambda m: has(m, bit), lambda m: (m["n"] * 120 / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )


def filter_interactions(docs: DataFrame, labels: DataFrame, filters: Filters = Filters(), id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, filter_order, step and the counts of `audit`, for documents and their labels."""
    return audit(mask_counts(docs, labels, filters, id_col, text_col, part_col))
