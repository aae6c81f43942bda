"""Filter interactions, toxicity and tokenizer alignment: brute force, held-out accuracy, odd rows."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from test_corpus import D, ODD, data, odd_docs

from weftgraph.llm import align, bits, filter_audit, main_text, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_bit_table_keeps_every_key(spark):
    keys = spark.range(0, 3000).select((F.col("id") * 7919 - 10_000).alias("k"))
    rows = spark.range(0, 200_000).select((F.col("id") - 10_000).alias("k"), F.lit("x").alias("cell"), F.lit("y").alias("at"))
    cells = bits.cells_for(3000)
    held = bits.may_hold(rows, F.col("k"), bits.bit_table(keys, "k", cells), cells)
    assert held.columns == rows.columns and held.join(keys, "k", "left_semi").count() == rows.join(keys, "k", "left_semi").count()
    assert held.count() < 0.2 * 200_000 and bits.cells_for(0) == 1 and bits.cells_for(10**12) == bits.MOST_CELLS
    assert bits.may_hold(rows, F.col("k"), bits.bit_table(keys.limit(0), "k", cells), cells).count() == 0


# -- filter interactions ------------------------------------------------------------------------------------


def plain_audit(docs, labels):
    """The rows of the audit by the definition: every order is run over the documents."""
    smaller = defaultdict(list)
    for doc, text, *_ in docs:
        if doc is not None:
            smaller[text or ""].append(doc)
    good = {d for d, q, t in labels if q == 1 and d is not None}
    toxic = {d for d, q, t in labels if t == 1 and d is not None}
    parts = defaultdict(list)
    for doc, text, source in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": doc is not None and min(smaller[text]) < doc,
        }
        parts[source or ""].append((doc, {k for k, v in fails.items() if v}))
    rows, shapley = {}, Counter()
    for part, held in parts.items():
        for order in map("".join, permutations("ABCDE")):
            left = list(held)
            for k, f in enumerate(order):
                removed, kept = [x for x in left if f in x[1]], [x for x in left if f not in x[1]]
                rows[part, order, k + 1] = (
                    len(kept), len(removed), sum(f in x[1] for x in held) - len(removed), sum(x[1] == {f} for x in held),
                    sum(x[0] in good for x in removed), sum(x[0] in toxic for x in removed),
                )
                shapley[part, f] += len(removed)
                left = kept
    return {(p, o, k): (*v, shapley[p, o[k - 1]]) for (p, o, k), v in rows.items()}


def got_audit(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


def test_filter_audit_equals_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice(["Alpha", "beta", "c#", "delta", "e"]) + str(rng.randrange(60)) for _ in range(rng.choice([10, 49, 50, 90]))) for _ in range(25)]
    docs = [(i, rng.choice(base), rng.choice(["x", "y", None])) for i in range(120)]
    docs += [(5, base[0], "x"), (5, base[0], "x"), (5, base[1], "y"), (None, base[0], "x"), (200, None, None), (201, "", ""), (202, None, "z"), (-1, "word " * 40_000, "z"), (300, "word " * 40_000, "z"), (301, "word " * 39_999 + "worm ", "z"), (302, "é" * 64 + "a", "z"), (303, "é" * 64 + "b", "z")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)] + [(4, 1, 1), (None, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("id", "part", "mask", "n", "hashes", "length", "signature", "salts")})
    assert got_audit(filter_audit.filter_interactions(df, spark.createDataFrame(labels, LABELS))) == plain_audit(docs, labels)


def test_copies_are_told_apart_when_hashes_are_equal(spark, monkeypatch):
    """With a hash that is the same for all texts of a length, only the full comparison decides."""
    monkeypatch.setattr(filter_audit, "block_hashes", lambda text, length: F.array(F.lit(0).cast("long")))
    docs = [(i, random.Random(i % 7).choice("abc") * 3 + str(i % 7), "s") for i in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    assert got_audit(filter_audit.filter_interactions(df, spark.createDataFrame([], LABELS))) == plain_audit(docs, [])


def test_a_large_class_of_copies_is_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "COPIES", 8)
    docs = [(i, "one text", "s") for i in range(100)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    one = filter_audit.with_first(df.select(F.col("doc_id").alias("id"), F.lit(1).alias("signature"))).first()
    assert (one["least"], one["salts"]) == (0, 13)
    assert got_audit(filter_audit.filter_interactions(df, spark.createDataFrame([], LABELS))) == plain_audit(docs, [])


def test_filter_audit_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0)], LABELS)
    got = got_audit(filter_audit.filter_interactions(odd_docs(spark), labels))
    assert got == plain_audit([(r[0], r[1], r[3]) for r in ODD], [(1, 1, 0)])
    assert filter_audit.filter_interactions(odd_docs(spark).limit(0), labels).count() == 0


# -- toxicity -----------------------------------------------------------------------------------------------


def test_toxicity_features():
    lex = toxicity.Lexicon({"fool": 5.0}, {"grum": 4.0})
    known = toxicity.Tokens(lex)
    f = lambda text: dict(zip(toxicity.FEATURES, toxicity.features(text, known), strict=True))
    assert set(f("").values()) == {0.0} and len(f("x")) == len(toxicity.FEATURES)
    a = f("You FOOL!! grumble, you know")
    assert a["learned"] == 2 / 5 and a["learned_max"] == 5 and a["second"] == 2 / 5 and a["near"] == 2 / 5 and a["shouted"] == 1 / 5
    assert a["mark_runs"] == 1 / 5 and a["calls"] == 2 / 5 and a["marks"] == 3 / 24
    for masked in ("f00l", "f.o.o.l", "f*ol", "FOOOOL", "1d1ot", "f o o l"):
        b = f(f"such a {masked} here")
        assert b["unmasked"] > 0 and not b["learned"], masked
    for plain in ("it's", "well-known", "3rd", "www.example.org", "cool", "food"):
        assert not f(f"such a {plain} here")["unmasked"], plain
    assert f("word " * 100_000 + "fool")["learned_n"] > 0  # whole texts


@data
def test_toxicity_held_out(spark):
    d = D.replace("sf0.001", "sf0.1")
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    hit = sum(r["predicted"] for r in got if r["toxic"] == 1) / sum(r["toxic"] == 1 for r in got)
    false = sum(r["predicted"] for r in got if r["toxic"] == 0) / sum(r["toxic"] == 0 for r in got)
    assert hit > 0.85 and false < 0.01


def test_toxicity_odd_rows_and_labels(spark):
    none = spark.createDataFrame([], LABELS)
    got = toxicity.toxicity(odd_docs(spark), none).collect()
    assert len(got) == len(ODD) and {r["score"] for r in got} == {0.0}
    one_kind = spark.createDataFrame([(i, 1, 1) for i in range(9)], LABELS)
    assert {r["score"] for r in toxicity.toxicity(odd_docs(spark), one_kind).collect()} == {1.0}
    mixed = spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)] + [(None, 1, 1), (3, 0, None)], LABELS)
    got = toxicity.toxicity(odd_docs(spark), mixed).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.toxicity(odd_docs(spark).limit(0), mixed).count() == 0


# -- tokenizer alignment ------------------------------------------------------------------------------------


def plain_alignment(rows):
    """Each document's row by the definition."""
    both = align.aligner(align.default_tokenizer(), align.default_pieces())
    links, per = Counter(), []
    for doc, text in rows:
        whole = (" " + (text or "")).encode()
        a, b = (both.a.encode(" " + text), both.b.encode(text)) if text else ([], [])
        sa, sb = [both.a.spelt[i] for i in a], [both.b.spelt[i] for i in b]
        if not text or b"".join(sa) != whole or b"".join(sb) != whole:
            per.append((doc, 0, 0, [], ""))
            continue
        ends = [{sum(map(len, s[: k + 1])): i for k, i in enumerate(ids)} for s, ids in ((sa, a), (sb, b))]
        cuts = sorted(ends[0].keys() & ends[1].keys())
        own = [(ends[0][c], ends[1][c]) for c in cuts]
        side = lambda e, low, high: ",".join(str(e[c]) for c in sorted(e) if low < c <= high)
        said = ";".join(f"{side(ends[0], low, high)}|{side(ends[1], low, high)}" for low, high in zip([0, *cuts], cuts))
        links.update(own)
        per.append((doc, len(a), len(b), own, said))
    best = defaultdict(int)
    for (_, b), n in links.items():
        best[b] = max(best[b], n)
    return sorted(
        (str(doc), na, nb, len(own), len(own), sum(links[x] == best[x[1]] for x in own), sum(links[x] for x in own), hashlib.sha256(said.encode()).hexdigest() if said else "")
        for doc, na, nb, own, said in per
    )


def got_alignment(df):
    return sorted((str(r["doc_id"]), *(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"))) for r in df.collect())


@pytest.mark.parametrize("size", [40, 8_000_000])
def test_alignment_equals_brute_force(spark, size):
    texts = ["the cat sat", "the cat sat on the mat", "", None, "ein Hund<|endoftext|>x </s> <0x41>", "日本語 é\x00\n\t  two", "\u2581under", "naïve 12345 " * 20, "a", "\U0001f600 smile"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, texts[1]), (None, "the cat"), (2**62, "the cat")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("slice", "group", "pos", "of", "a", "b")})
    assert got_alignment(align.align(df, slice_chars=size)) == plain_alignment(rows)


def test_alignment_odd_rows(spark):
    assert got_alignment(align.align(odd_docs(spark))) == plain_alignment([(r[0], r[1]) for r in ODD if r[0] != 5] + [(5, ODD[8][1])])
    assert align.align(odd_docs(spark).limit(0)).count() == 0
    white = spark.createDataFrame([(1, "x" + " " * 60_000 + "y")], "doc_id long, text string")
    assert align.align(white).first()["n_a"] >= 0


@data
def test_alignment_of_the_small_table(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").limit(60)
    assert got_alignment(align.align(docs, slice_chars=20_000)) == plain_alignment([tuple(r) for r in docs.collect()])


# -- main text ----------------------------------------------------------------------------------------------


def test_a_paragraph_is_not_lost_by_a_word_of_its_name(spark):
    html = """<html><body><nav><a href="/">Home</a></nav><article><h1>Shares rise</h1><p>The first paragraph of the article says what it is about in a whole sentence.</p>
<p class="share-value">The value of a share rose by two points on Monday morning.</p><p id="comment-period">The comment period for the new rule ends in the first week of May.</p>
<div class="share-buttons"><p>Share this with all of your friends and followers now.</p></div><p class="newsletter">Subscribe to our letter and get all the news in your box.</p></article></body></html>"""
    df = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    lines = main_text.extract_main_text(df).first()["text"].split("\n")
    assert len(lines) == 4 and lines[2].startswith("The value") and lines[3].startswith("The comment period")


@data
def test_pages_without_article_elements_come_out_the_same(spark):
    """With article and main renamed to div the costs alone no longer decide; the cut must."""
    pages = spark.read.parquet(f"{D.replace('sf0.001', 'sf0.01')}/pages.parquet")
    plain = pages.withColumn("html", F.regexp_replace("html", r"<(/?)(article|main)\b", "<$1div"))
    text = lambda df: {r["page_id"]: r["text"] for r in main_text.extract_main_text(df).collect()}
    with_names, without = text(pages), text(plain)
    assert with_names == without
