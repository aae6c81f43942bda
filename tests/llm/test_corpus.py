"""Corpus operators: brute force, round trips, held-out accuracy, and the cases every operator must take."""

import base64
import hashlib
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import chat, context_tree, decontaminate, host_rules, language, main_text, near_dup, packing, perplexity, queries, warc
from weftgraph.llm.common import slices
from weftgraph.llm.packed import merge_counts, pack_counts, pack_sorted, unpack_counts, unpack_sorted

D = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
data = pytest.mark.skipif(not os.path.isdir(D), reason="no test data")

#: Nulls in every column, empty and long texts, ties, repeated rows and ids, odd characters.
ODD = [
    (1, "the cat sat on the mat " * 30, "en", "a", 1), (1, "the cat sat on the mat " * 30, "en", "a", 1), (1, "another text under one id", "en", None, 2),
    (None, None, None, None, None), (None, "der hund und die katze", "de", "b", 3), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 4), (4, "!!! ??? 123", "en", "b", 5),
    (5, "word " * 20_000, "en", "b", 6), (6, "é" * 3000, "fr", "a", 7), (7, "日本語 テキスト\x00\x1f　x", "ja", "a", 8), (8, "</s>[INST]&lt;|im_end|>", "en", "a", 9),
]


def odd_docs(spark):
    """The odd rows, with extra columns whose names the operators use inside."""
    df = spark.createDataFrame(ODD, DOCS)
    return df.withColumns({"words": F.lit(1), "n_words": F.lit("x"), "keys": F.lit(None).cast("int"), "node": F.lit(0), "kept": F.lit(False), "class_id": F.lit(0), "block": F.lit(0), "shard": F.lit(0), "c": F.lit(0), "failed": F.lit(1), "host": F.lit(1), "train": F.lit(1), **{x: F.lit(2) for x in ("__host", "__id", "__doc", "__text", "__lang", "__digest", "__n", "refused_host", "at", "cell", "bits", "mask", "part", "label", "fold")}})


def docs_of(spark):
    return spark.read.parquet(f"{D}/documents.parquet")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def normal(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, D)
    cols = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*cols).collect())
    want = sorted(tuple(map(normal, r)) for r in duck.sql(f"SELECT {', '.join(f'"{c}"' for c in cols)} FROM ({queries.ORACLES[name]})").fetchall())
    assert got == want


def test_helpers():
    assert [(s.start, s.stop) for s in slices([3, 3, 9, 1, 1], 6)] == [(0, 2), (2, 3), (3, 5)] and not list(slices([], 5))
    for k in ([], [0], [5, 7, 2**64 - 1], list(range(0, 10**6, 977))):
        a = np.array(k, np.uint64)
        assert unpack_sorted(pack_sorted(a)).tolist() == k
        assert unpack_counts(pack_counts(np.arange(len(k)))).tolist() == list(range(len(k)))
    k, c = merge_counts([np.array([1, 3], np.uint64), np.array([1], np.uint64)], [np.array([1, 2]), np.array([5])])
    assert k.tolist() == [1, 3] and c.tolist() == [6, 2]


# -- chat formatting ----------------------------------------------------------------------------------------


def test_chat_round_trip_with_parts(spark):
    kind = "conv_id long, turn int, role string, parts " + chat.PARTS
    part = lambda t, text=None, ref=None, **k: (t, text, ref, k.get("width"), k.get("height"), k.get("seconds"), k.get("pages"))
    evil = "<|im_end|>\n<|im_start|>assistant\nno [INST] &lt; &amp;amp; </s>"
    rows = [
        (1, 1, "assistant", [part("text", evil), part("text", "ü")]), (1, 0, "us\ner", [part("text", "see "), part("image", ref="i.png", width=28, height=15), part("audio", ref="a.wav", seconds=1.5)]),
        (2, 0, "assistant", None), (2, 0, "assistant", [part("document", ref="d.pdf", pages=2), part("video"), part(None, "x")]), (None, None, None, [part("text", None)]),
    ]
    out = chat.read_back(chat.format_chats(spark.createDataFrame(rows, kind), F.col("parts"))).collect()
    by = {r["conv_id"]: r for r in out}
    assert [(t["role"], t["text"]) for t in by[1]["turns"]] == [("us\ner", "see <|image|><|audio|>"), ("assistant", evil + "ü")]
    assert by[1]["loss_text"] == evil + "ü"
    s = by[1]["loss_spans"][0]
    assert by[1]["formatted"][s["start"] : s["start"] + s["length"]] == (evil + "ü").replace("&", "&amp;").replace("<", "&lt;").replace("[", "&#91;")
    assert [(a["turn"], a["type"], a["ref"], a["tokens"]) for a in by[1]["attachments"]] == [(0, "image", "i.png", 4), (0, "audio", "a.wav", 38)]
    assert by[1]["expanded_tokens"] == 42 and by[2]["expanded_tokens"] == 1200
    assert [a["type"] for a in by[2]["attachments"]] == ["document", "unknown", "unknown"]
    assert [(t["role"], t["text"]) for t in by[None]["turns"]] == [("", "")]


def test_chat_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert chat.chat_digest(chat.read_back(chat.format_chats(none, chat.text_part(F.col("text"))))).count() == 0


# -- quality rules ------------------------------------------------------------------------------------------


def test_host_rules_odd_rows(spark):
    got = host_rules.host_rules(odd_docs(spark)).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[5][0]["n_words"] == 20_000 and by[5][0]["n_repeat_words"] == 20_000 and by[5][0]["base_failed"]
    assert sorted(r["n_words"] for r in by[None]) == [0, 5] and by[2][0]["n_words"] == 0
    kept = host_rules.keep_good(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == sum(r["kept"] for r in got)
    assert host_rules.host_rules(odd_docs(spark).limit(0)).count() == 0


def test_bad_host_is_refused_and_good_one_kept(spark):
    rng = random.Random(0)
    text = lambda: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(80))
    rows = [(i, text() if i % 10 == 0 else "short", "en", "bad", 1) for i in range(100)] + [(100 + i, text(), "en", "good", 1) for i in range(100)]
    got = {r["doc_id"]: r["kept"] for r in host_rules.host_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not any(got[i] for i in range(100)) and all(got[i] for i in range(100, 200))


# -- perplexity ---------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one_and_equals_plain_recursion():
    docs = [perplexity.plain(t) for t in ("the cat sat on the mat and the dog", "a cat and a dog sat", "der hund")]
    keys, counts = np.unique(perplexity.grams(docs)[0], return_counts=True)
    tables = perplexity.fit_tables(keys, counts)
    n = perplexity.ORDER
    raw = Counter()
    for d in docs:
        x = b"\n" * (n - 1) + d
        for i in range(n - 1, len(x)):
            raw[x[i - n + 1 : i + 1]] += 1
    level = {n: raw}
    for k in range(n - 1, 0, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])

    def p(gram):
        k = len(gram)
        lower = 1 / 256 if k == 1 else p(gram[1:])
        own = {g: c for g, c in level[k].items() if g[:-1] == gram[:-1]}
        if not own:
            return lower
        cc = Counter(level[k].values())
        n1, n2, n3, n4 = (max(1, cc[i]) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        d = np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.1, 0.15], [0, 0.95, 1.9, 2.85])
        total = sum(own.values())
        back = sum(d[min(c, 3)] for c in own.values()) / total
        c = own.get(gram, 0)
        return (c - d[min(c, 3)] if c else 0) / total + back * lower

    rng = np.random.default_rng(0)
    for h in (b"\n\n\n\n", b"the ", b"cat ", b"zzzz"):
        grams = [h + bytes([b]) for b in range(256)]
        ids = np.array([int.from_bytes(g[-2::-1] + g[-1:], "big") for g in grams], np.uint64)
        got = perplexity.probability(tables, ids)
        assert got.sum() == pytest.approx(1, abs=1e-5)
        for b in [*rng.integers(0, 256, 5), ord("c"), ord("t")]:
            assert got[b] == pytest.approx(p(grams[b]), rel=1e-4)
        for low, high, part in perplexity.shard_tables(tables, 3):
            if low <= h[-1] < high:
                assert np.allclose(perplexity.probability(part, ids), got)


@data
def test_perplexity_keeps_clean_and_refuses_noise(spark):
    big = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    got = perplexity.quality_by_perplexity(docs, labels).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(map(tuple, got))
    assert share[1] > 0.98 and share[0] < 0.4


def test_perplexity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 1, None), (6, 0, 0), (None, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    assert perplexity.quality_by_perplexity(odd_docs(spark), labels).count() == len(ODD)
    none = perplexity.quality_by_perplexity(odd_docs(spark), labels.limit(0))
    assert none.filter("kept").count() == len(ODD)
    assert perplexity.quality_by_perplexity(odd_docs(spark).limit(0), labels).count() == 0


def test_perplexity_sample_is_bounded_and_never_empty(spark):
    rows = [(i, "word " * (2000 + i), "en", "a", 1) for i in range(60)]
    docs, trusted = spark.createDataFrame(rows, DOCS), spark.range(60).withColumnRenamed("id", "doc_id")
    size = {i: len(t) for i, t, *_ in rows}
    take = lambda n: [r["doc_id"] for r in perplexity.sample_ids(docs, trusted, n, "doc_id", "text").collect()]
    usable = {i for i in size if zlib.crc32(str(i).encode()) % 5}
    assert set(take(10**9)) == usable and take(5000) == [min(usable)]
    some = take(100_000)
    assert 5 <= len(some) == len(set(some)) and set(some) <= usable and sum(size[i] for i in some) <= 100_000
    assert perplexity.sample_ids(docs, trusted.limit(0), 1000, "doc_id", "text").count() == 0


@data
def test_perplexity_verdict_follows_from_its_columns(spark):
    got = perplexity.quality_by_perplexity(docs_of(spark), spark.read.parquet(f"{D}/labels.parquet")).collect()
    for r in got:
        wide = 1.15 * 10 ** (2 / math.sqrt(r["n_bytes"]))
        assert r["kept"] == (r["least"] / wide <= r["perplexity"] <= r["most"] * wide)
        assert r["n_bytes"] == len(perplexity.plain(None)) or r["perplexity"] > 1
    assert len({(r["least"], r["most"]) for r in got}) >= 1 and 0 < sum(r["kept"] for r in got)


# -- language -----------------------------------------------------------------------------------------------


@data
def test_language_held_out_accuracy_and_spans(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    right, n = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).collect()[0]
    assert n > 100 and right > 0.97
    model = language.learn(docs)
    mixed = "the and of that with this are on in the " * 5 + "der die und ist nicht ein von mit sich " * 5
    out = language.spans(spark.createDataFrame([(9, mixed), (10, None)], "doc_id long, text string"), model).orderBy("span").collect()
    assert [r["lang"] for r in out] == ["en", "de"] and abs(out[1]["first_word"] - 50) <= 2
    assert sum(r["n_words"] for r in out) == len(mixed.split())


def test_language_paths_equal_plain_viterbi():
    rng = np.random.default_rng(4)
    m = language.Model(["a", "b", "c"], np.zeros((1, 3)), np.ones((1, 3), bool), penalty=1.5)
    sizes = np.array([0, 5, 1, 17, 5])
    scores = rng.normal(size=(sizes.sum(), 3)) * 2
    got = m.paths(scores, sizes)
    at = 0
    for n in sizes:
        own, lab = scores[at : at + n], got[at : at + n]
        if n:
            best = own[0].copy()
            for s in own[1:]:
                best = np.maximum(best, best.max() - 1.5) + s
            value = sum(own[i, x] for i, x in enumerate(lab)) - 1.5 * sum(x != y for x, y in zip(lab, lab[1:]))
            assert value == pytest.approx(best.max())
        at += n


def test_language_odd_rows(spark):
    got = language.identify(odd_docs(spark)).collect()
    assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
    und = Counter(r["doc_id"] for r in got if r["lang_pred"] == "und")
    assert und == Counter([None, 2, 3, 4])
    private_use = [(i, t, "en", "a", 1) for i, t in enumerate(["\U000f0000", "\U0010fffd 12", "\U000e0041!", "\U000e0100", "\u0301 5", "word \U000f0000"])]
    assert [r["lang_pred"] for r in language.predict(spark.createDataFrame(private_use, DOCS).coalesce(1), language.learn(odd_docs(spark))).collect()] == ["und"] * 5 + ["en"]
    assert language.keep_identified(odd_docs(spark).limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd_docs(spark).limit(0)).count() == 0
    assert language.keep_identified(odd_docs(spark)).columns == odd_docs(spark).columns


# -- packing ------------------------------------------------------------------------------------------------


@data
def test_packing_is_gapless_whole_and_equals_the_tokenizers_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    docs = docs_of(spark)
    got = packing.best_fit_packing(docs, shard_pieces=100).toPandas()
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 2048
    pieces = {i: g.sort_values("piece") for i, g in got.groupby("doc_id")}
    for r in docs.collect():
        ids = np.array([*t.encode(r["text"], add_special_tokens=False).ids, 0], "<u4")
        g = pieces[r["doc_id"]]
        assert g["length"].sum() == len(ids) and (g["length"].iloc[1:] == 2048).all()
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(g["start"], g["length"])] == g["ids_crc32"].tolist()
    whole = packing.best_fit_packing(docs).agg(F.countDistinct("sequence_id"), F.sum("length")).collect()[0]
    assert whole[0] <= math.ceil(whole[1] / 2048) * 1.02 + 2


def test_packing_small_cases():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer())
    encode = packing.encoder(packing.default_tokenizer())
    assert encode("a <|endoftext|> b") == [64, 220, 50256, 275]
    for s in ("x<|endoftext|><|endoftext|> y <|endoftext", "<|endoftext|>" + " " * 60_000, "<|endoftext|> a b　 x\n\n y", "  ", "١٢٣ ½ a1b2 ̀é 👩‍👩‍👧 \x00\x1f \x85", "'s IT'S ’s\r\n\t z   ", "a" * 5000, "a" + " " * 1_000_000 + "b", "\n" * 60_000):
        assert encode(s) == t.encode(s, add_special_tokens=False).ids
    assert packing.cut(5000, 2048) == [(0, 904), (904, 2048), (2952, 2048)] and packing.cut(2048, 2048) == [(0, 2048)] and packing.cut(1, 2048) == [(0, 1)]
    rng = np.random.default_rng(0)
    for n in (0, 1, 7, 900):
        lengths = rng.integers(1, 2049, n)
        seq, offset = packing.pack(lengths)
        assert sorted(set(seq.tolist())) == list(range(len(set(seq.tolist()))))
        for s in set(seq.tolist()):
            own = np.flatnonzero(seq == s)
            own = own[np.argsort(offset[own])]
            assert offset[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()] and lengths[own].sum() <= 2048


def test_packing_against_the_best_of_all_packings():
    rng = np.random.default_rng(4)

    def fewest(lengths, limit):
        best = {0: (0, limit)}  # of each set of pieces: sequences, and the least filling of the last
        for chosen in range(1, 1 << len(lengths)):
            best[chosen] = min((n + (used + x > limit), used + x if used + x <= limit else x) for i, x in enumerate(lengths) if chosen >> i & 1 for n, used in [best[chosen ^ 1 << i]])
        return best[(1 << len(lengths)) - 1][0]

    over = 0
    for _ in range(60):
        lengths, limit = rng.integers(1, 21, int(rng.integers(1, 10))), 20
        seq, _ = packing.pack(lengths, limit, groups=4, large=5)
        over += len(set(seq.tolist())) - fewest(lengths.tolist(), limit)
    assert 0 <= over <= 3


def test_packing_odd_rows(spark):
    got = packing.best_fit_packing(odd_docs(spark)).collect()
    assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r[0] for r in ODD)
    assert packing.best_fit_packing(odd_docs(spark).limit(0)).count() == 0


# -- decontamination ----------------------------------------------------------------------------------------


def test_decontamination_in_blocks_matches_and_odd_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    bench = spark.createDataFrame([(1, item), (1, "Alpha-Beta"), (2, item + " more"), (None, "Solo"), (4, None), (5, "...")], "item_id long, text string")
    rows = [(1, f"x ONE, two three four five six seven eight nine ten eleven y"), (2, "one two three four five six seven eight nine"), (3, "an alpha beta here, solo!"), (4, None), (None, "solo"), (None, "solo")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    for size in (4_000_000, 3):  # one block, and a block for each item
        got = {(r["doc_id"], r["n_words"]): r for r in decontaminate.contamination(docs, bench, block_words=size).collect()}
        assert got[1, 13]["n_hit"] == 11 and got[1, 13]["n_items"] == 2
        assert got[1, 13]["items_sha256"] == hashlib.sha256(b"1,2").hexdigest()
        assert not got[2, 9]["contaminated"] and got[3, 5]["n_hit"] == 3 and got[4, 0]["n_items"] == 0
        assert got[3, 5]["items_sha256"] == hashlib.sha256(b",1").hexdigest() and got[None, 1]["contaminated"]
        kept = decontaminate.remove_contaminated(docs, bench, block_words=size)
        assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 4]
    m = [(r["doc_id"], r["item_id"], r["start"], r["item_start"], r["n_words"]) for r in decontaminate.matches(docs, bench).collect()]
    assert (1, "1", 1, 0, 11) in m and (1, "2", 1, 0, 11) in m and (3, "1", 1, 0, 2) in m
    assert decontaminate.contamination(odd_docs(spark), bench.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.contamination(odd_docs(spark).limit(0), bench).count() == 0
    assert decontaminate.contamination(odd_docs(spark), bench).count() == len(ODD)


def test_decontamination_of_repeated_words_is_near_linear():
    words = [b"again"]
    block = decontaminate.make_block([("i", words * 2000), ("j", words * 12)], 10)
    began, docs = time.time(), [words * 300_000, [b"once"] * 5]
    shard = decontaminate.Shard([" ".join(["again"] * 300_000), "once"])
    shard.take(block)
    assert shard.report()[["n_hit", "n_items"]].values.tolist() == [[300_000, 2], [0, 0]]
    d, item, start, place, n = decontaminate.longest(block, docs)
    # one match for each diagonal of ten words or more, of the text with either item
    assert len(d) == sum(300_000 + size - 19 for size in (2000, 12)) and n.max() == 2000 and (item[n == 2000] == 0).sum() == 300_000 - 2000 + 1
    assert time.time() - began < 60


def test_longest_matches_equal_brute_force():
    rng = random.Random(9)
    for round_ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"][: 1 + round_ % 3]) for _ in range(rng.randrange(1, 30))] for _ in range(3)]
        items = [(rng.choice("xy"), [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 14))]) for _ in range(3)]
        items = list({(n, tuple(w)): (n, w) for n, w in items}.values())
        block = decontaminate.make_block(items, 4)
        want = set()
        for d, t in enumerate(texts):
            for k, (name, w) in enumerate(items):
                size = min(4, len(w))
                for s in range(len(t)):
                    for p in range(len(w) if len(w) >= 4 else 1):
                        n = 0
                        while s + n < len(t) and p + n < len(w) and t[s + n] == w[p + n]:
                            n += 1
                        if n >= size and (len(w) < 4 or not (s and p and t[s - 1] == w[p - 1])):
                            want.add((d, name, s, p, n if len(w) >= 4 else len(w), k))
        d, item, start, place, n = decontaminate.longest(block, texts)
        got = sorted((int(a), block.items[i], int(s), int(p), int(m)) for a, i, s, p, m in zip(d, item, start, place, n))
        assert got == sorted(x[:5] for x in want)


# -- near-duplicates ----------------------------------------------------------------------------------------


def test_suffix_array_is_sorted_to_the_end_of_every_run():
    rng = np.random.default_rng(2)
    ids = rng.integers(1, 4, 300)
    ids[rng.integers(0, 300, 12)] = 0
    ends = np.append(np.flatnonzero(ids == 0), len(ids))
    suffix = np.flatnonzero(ids)
    run = ends[np.searchsorted(ends, suffix)] - suffix
    read = decontaminate.Reader(ids, 3)
    order = decontaminate.sorted_suffixes(read(suffix, run), suffix, run, read)
    whole = [tuple(ids[s : s + n]) for s, n in zip(suffix[order], run[order])]
    assert whole == sorted(whole)


def edit_similarity(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return 1 - row[-1] / max(1, len(a), len(b))


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    texts = []
    for size in (40, 60, 80, 150, 150):
        base = [word() for _ in range(size)]
        texts.append(base)
        for _ in range(4):
            texts.append([w if rng.random() > 0.05 else word() for w in base])
    shared = [word() for _ in range(30)]
    texts += [shared + [word() for _ in range(60)] for _ in range(8)]  # a common passage makes no copy
    texts += [texts[0], texts[7]]
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if edit_similarity(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if x in (a, b) else x for x in root]
    assert [got[i] for i in range(len(texts))] == root


def test_near_duplicates_many_variants_of_one(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrst", k=5))
    base = [word() for _ in range(400)]
    texts = [base]
    for _ in range(80):  # each like the original, hardly two like each other
        at = rng.randrange(400 - 43)
        texts.append(base[:at] + [word() for _ in range(43)] + base[at + 43 :])
    shared = [word() for _ in range(150)]
    texts += [shared + [word() for _ in range(150)] for _ in range(12)]  # in common buckets, but no copies
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i] for i in range(81)] == [0] * 81
    assert [got[i] for i in range(81, 93)] == list(range(81, 93))


@pytest.mark.parametrize(("size", "pairs"), [(12, 120), (30, 120), (200, 100), (1000, 60), (5000, 24)])
def test_near_duplicates_recall_at_the_threshold(spark, size, pairs):
    """Pairs with a fifth of the words substituted anywhere: edit similarity 0.8, the least that is a link."""
    rng = random.Random(size)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    rows = []
    for i in range(pairs):
        a = [word() for _ in range(size)]
        b = list(a)
        for at in rng.sample(range(size), size // 5):
            b[at] = word()
        rows += [(2 * i, " ".join(a), "en", "a", 1), (2 * i + 1, " ".join(b), "en", "a", 1)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert {got[2 * i] for i in range(pairs)} == set(range(0, 2 * pairs, 2))
    assert sum(got[2 * i + 1] == 2 * i for i in range(pairs)) >= 0.95 * pairs


def test_near_duplicates_among_common_passages(spark):
    """Texts put together from few passages share every bucket; the pairs among them are still found."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    pool = [[word() for _ in range(25)] for _ in range(24)]
    texts = []
    for _ in range(40):
        one = [w for p in rng.sample(pool, 8) for w in p]
        texts += [one, [w if rng.random() > 0.1 else word() for w in one]]
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == i and got[i + 1] == i for i in range(0, 80, 2))


def test_alignment_equals_plain_distance():
    rng = random.Random(3)
    for _ in range(600):
        v = rng.choice([2, 4, 30, 1000])
        a = [rng.randrange(v) for _ in range(rng.choice([0, 3, 20, 120]))]
        b = [rng.randrange(v) if rng.random() < 0.15 else x for x in a if rng.random() > 0.05]
        if rng.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        n = max(len(a), len(b))
        d = round((1 - edit_similarity(a, b)) * n)
        for most in {0, 1, d - 1, d, d + 1, near_dup.allowed(n, 0.8)} - {-1}:
            assert near_dup.banded(a, b, most) == min(d, most + 1)
            assert near_dup.at_most(np.array(a, np.uint32), np.array(b, np.uint32), most) == (d <= most)


def test_near_duplicates_repeated_rows_without_broadcast(spark):
    """Texts are found by a shuffled join where the wanted ones are too many for a broadcast: same classes, and
    rows that repeat an id (or none) and a text are coded once."""
    words = np.random.default_rng(5).integers(0, 500, (6, 120))
    texts = [" ".join(f"w{x}" for x in row) for row in words]
    near = [t.replace(" ", " also ", 3) for t in texts]
    rows = [(i, t) for i, t in enumerate(texts)] + [(i, t) for i, t in enumerate(texts[:3])] + [(10 + i, t) for i, t in enumerate(near)] + [(None, near[0]), (None, near[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted([(i, i, 2 if i < 3 else 1) for i in range(6)] + [(10 + i, i, 1) for i in range(6)] + [(-1, 0, 2)])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for most in (before, "-1"):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
            got = near_dup.near_duplicates(docs).collect()
            assert sorted((-1 if r.doc_id is None else r.doc_id, r.class_id, r.copies) for r in got) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_near_duplicates_odd_rows(spark):
    got = near_dup.near_duplicates(odd_docs(spark)).collect()
    rows = Counter()
    for r in got:
        rows[r["doc_id"]] += r["copies"]
    assert rows == Counter(r[0] for r in ODD)
    odd = odd_docs(spark).withColumns({"own": F.lit(1), "__own": F.lit(1), "__id": F.lit(1), "keeper_id": F.lit(1), "keeper_node": F.lit(1), "_own": F.lit(1)})
    one = near_dup.keep_one(odd)
    kept = [(r["doc_id"], (r["text"] or "")[:10]) for r in one.collect()]
    assert near_dup.keep_one(odd.limit(0)).count() == 0
    assert one.columns == odd.columns and len(kept) == len(set(kept))
    assert kept.count((1, "the cat sa")) == 1 and sum(not t.strip() for _, t in kept) == 1 and (None, "der hund u") in kept
    assert near_dup.near_duplicates(odd_docs(spark).limit(0)).count() == 0


# -- main text ----------------------------------------------------------------------------------------------


def test_max_flow_against_every_cut():
    rng = np.random.default_rng(8)
    for _ in range(40):
        n = int(rng.integers(2, 7))
        edges = [(int(a), int(b), float(rng.integers(1, 9)), float(rng.integers(0, 4))) for a, b in rng.integers(0, n, (12, 2)) if a != b]
        g = main_text.Flow(n)
        for e in edges:
            g.edge(*e)
        side = g.source_side()
        cost = lambda s: sum(f * (s[a] and not s[b]) + r * (s[b] and not s[a]) for a, b, f, r in edges)
        best = min(cost([True, False, *(bool(m >> i & 1) for i in range(n - 2))]) for m in range(1 << (n - 2)))
        assert side[0] and not side[1] and cost(side) == pytest.approx(best)


def test_extraction_pages():
    page = """<html><body><header><h1>Site</h1></header><div id="cookie-notice">We use cookies, please accept all of them now.</div><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div>
    <div class="content"><h1>Real &amp; true</h1><p>First   paragraph,\n it has several words. It goes on.<p>Short.</p><div class="ad">Buy the best things now, only today.</div><p>Third <em>o</em>ne with <a href=x>link</a>.</p></div>
    <section id="comments"><p>Great article, I liked it a lot and will come back.</p></section><form>Name <button>Send</button></form><script>var t="</p>";</script><footer>me</footer>"""
    assert main_text.extract(page).split("\n") == ["Real & true", "First paragraph, it has several words. It goes on.", "Short.", "Third one with link."]
    assert main_text.extract(None) == main_text.extract("") == main_text.extract("<nav>x</nav>") == ""
    assert main_text.extract("just text") == "just text"
    assert main_text.extract("<p>a<p>b&nbsp;c<br>d</p></div></p><!-- x") == "a\nb c d"
    long = "<article>" + "".join(f"<p>Sentence number {i}, with some words.</p>" for i in range(5000)) + "</article>"
    assert main_text.extract(long).count("\n") == 4999


PROSE = "The committee met on Tuesday to discuss the new plan for the harbour, and most members agreed with it."
BODY = f"<h1>Harbour plan agreed</h1><p>{PROSE}</p><p>Short.</p><p>{PROSE} {PROSE}</p><p>Indeed.</p><p>{PROSE}</p>"
NAV, FOOT = "<nav><a href=a>Home</a> <a href=b>News</a></nav>", "<footer>Copyright us</footer>"


@pytest.mark.parametrize("page", [
    f'<div class="site no-sidebar">{NAV}<article>{BODY}</article>{FOOT}</div>',
    f'{NAV}<div class="has-sidebar"><article>{BODY}</article></div>{FOOT}',
    f'{NAV}<article><div class="entry-content comments-open">{BODY}</div></article>{FOOT}',
    f'{NAV}<section class="section-notice"><article>{BODY}</article></section>{FOOT}',
    f'{NAV}<article class="related-story">{BODY}</article>{FOOT}',
    f'<form id="aspnetForm">{NAV}<div>{BODY}</div>{FOOT}</form>',
    f'{NAV}<div class="x1">{BODY}</div><div>Accept</div>{FOOT}',
    f'<ul><li><a href=a>Home</a><li><a href=b>News</a></ul><div>{BODY}</div><div class="comments"><p>{PROSE}</p><p>{PROSE}</p></div><div id="sidebar"><p>Weather is fine today in the whole of the country.</p></div>{FOOT}',
    f'{NAV}<article>{BODY}<form>Subscribe to our newsletter <input></form></article>{FOOT}',
    f'{NAV}<article>{BODY}<section class="comments"><article class="comment"><p>{PROSE}</p></article></section></article>{FOOT}',
    f'<div class="cookie-banner"><p>{PROSE}</p></div>{NAV}<main>{BODY}<div class="ad">Buy the best things now, only today, and save.</div></main>{FOOT}',
])
def test_extraction_is_not_misled_by_names(page):
    want = "\n".join(["Harbour plan agreed", PROSE, "Short.", PROSE + " " + PROSE, "Indeed.", PROSE])
    assert main_text.extract(f"<html><body>{page}</body></html>") == want


def test_the_cut_decides_where_the_costs_alone_are_wrong():
    page = main_text.parse(f"<body>{NAV}<div>{BODY}<ul><li>first thing here</li><li>second thing</li></ul><p>{PROSE}</p></div><div>Accept</div>{FOOT}")
    costs = main_text.Costs()
    cut, alone = main_text.label(page, costs), [x >= 0 for x in main_text.balances(page, costs)]
    assert cut == [False] + [True] * 9 + [False] * 2
    assert [b.text for b, x, y in zip(page.blocks, cut, alone) if x != y] == ["Short.", "Indeed.", "first thing here", "second thing"]


def test_extraction_odd_rows(spark):
    rows = [(1, None, None), (None, "u", "<p>a"), (2, "v", ""), (3, "w", f"<article>{BODY}</article>"), (3, "w", f"<article>{BODY}</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "n_chars": F.lit("x")})
    got = main_text.extract_main_text(pages).collect()
    assert sorted((r["page_id"] or 0, r["url"], r["n_chars"]) for r in got if r["n_chars"] < 9) == [(0, "u", 1), (1, None, 0), (2, "v", 0)] and len(got) == 5
    assert main_text.extract_main_text(pages.limit(0)).count() == 0


@data
def test_extraction_equals_article(spark):
    import html

    pages = spark.read.parquet(f"{D}/pages.parquet")
    got = {r["page_id"]: r for r in main_text.extract_main_text(pages.withColumn("text", F.lit(1))).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1|h2)[^>]*>", body)]
        want = "\n".join(x for x in blocks if x)
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)


# -- context trees ------------------------------------------------------------------------------------------


def test_tree_equals_plain_recursion():
    docs = [context_tree.canonical(t) for t in ("Abra cadabra abra", "abra", "", "cad é", None)]
    depth = context_tree.DEPTH
    counts = defaultdict(lambda: [0, 0])
    for d in docs:
        x = b"\n" * depth + d
        for i in range(depth, len(x)):
            for bit in range(8):
                node = 1 << bit | x[i] >> (8 - bit)
                for k in range(depth + 1):
                    counts[x[i - k : i], node][x[i] >> (7 - bit) & 1] += 1
    seen = {c for c, _ in counts}

    def kt(c):
        return math.lgamma(c[0] + 0.5) + math.lgamma(c[1] + 0.5) - math.lgamma(sum(c) + 1) - math.log(math.pi)

    memo = {}

    def whole(ctx, node):
        if (ctx, node) not in memo:
            own = kt(counts[ctx, node])
            if len(ctx) < depth:
                down = sum(whole(bytes([b]) + ctx, node) for b in range(256) if (bytes([b]) + ctx, node) in counts)
                own = np.logaddexp(own, down) - math.log(2)
            memo[ctx, node] = own
        return memo[ctx, node]

    def one(past, k, node):
        ctx = past[len(past) - k :]
        if (ctx, node) not in counts:
            return 0.5
        c = counts[ctx, node]
        here = (c[1] + 0.5) / (sum(c) + 1)
        if k == depth:
            return here
        stop = math.exp(kt(c) - math.log(2) - whole(ctx, node))
        return stop * here + (1 - stop) * one(past, k + 1, node)

    keys, n = np.unique(context_tree.pairs(docs)[0], return_counts=True)
    shard = context_tree.shard_of(keys, 3)
    parts = [context_tree.Subtrees(keys[shard == s], n[shard == s]) for s in range(3)]
    top = [np.concatenate(x) for x in zip(*(t for p in parts for t in p.top))]
    sums = defaultdict(lambda: np.zeros(3))
    for node, z, o, b in zip(*top):
        sums[int(node)] += (z, o, b)
    order = sorted(sums)
    fitted = context_tree.Top.fit(np.array(order), *np.array([sums[k] for k in order]).T)
    for text in ("abra cad", "zq", ""):
        x = b"\n" * depth + context_tree.canonical(text)
        want = 0.0
        for i in range(depth, len(x)):
            for bit in range(8):
                p = one(x[i - depth : i], 0, 1 << bit | x[i] >> (8 - bit))
                want += math.log10(p if x[i] >> (7 - bit) & 1 else 1 - p)
        asked, _ = context_tree.pairs([context_tree.canonical(text)])
        s = context_tree.shard_of(asked, 3)
        got = sum(fitted.log10(asked[s == k], parts[k]).sum() for k in range(3))
        assert got == pytest.approx(want, rel=1e-9)
    assert seen


@data
def test_tree_scores_and_base_line(spark):
    docs = docs_of(spark)
    got = {r["doc_id"]: r for r in context_tree.score_documents(docs, block_bytes=100_000).collect()}
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    tokens = {r["doc_id"]: [*word.findall((r["text"] or "").encode().lower()), None] for r in docs.collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, held(i))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
    one = {r["doc_id"]: r["score"] for r in context_tree.score_documents(docs, block_bytes=10**9).collect()}
    salted = {r["doc_id"]: r for r in context_tree.score_documents(docs, block_bytes=100_000, salt_bytes=20_000).collect()}
    assert all(salted[i]["score"] == pytest.approx(got[i]["score"], rel=1e-6) and salted[i]["n_known"] == got[i]["n_known"] for i in got)
    counted = context_tree.count_pairs(docs.repartition(6), 3)
    once, twice = (context_tree.fit_top(context_tree.fit_shards(x)) for x in (counted, context_tree.merge_parts(counted, 2)))
    assert once[1:] == twice[1:] and np.allclose(once[0].stop1, twice[0].stop1)
    assert all(one[i] == pytest.approx(got[i]["score"], rel=1e-5) for i in one)


def test_tree_odd_rows(spark):
    got = context_tree.score_documents(odd_docs(spark)).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in ODD) and all(r["score"] < 0 for r in got)
    blind = context_tree.score_documents(odd_docs(spark), train=F.lit(False)).collect()
    assert all(r["base_score"] == 0 and r["train_tokens"] == 0 for r in blind)
    assert all(r["score"] == pytest.approx(-8 * r["n_bytes"] * math.log10(2)) for r in blind)
    assert context_tree.score_documents(odd_docs(spark).limit(0)).count() == 0
    assert context_tree.code_length_per_byte(spark.createDataFrame(blind)).filter("abs(bits_per_byte - 8) > 1e-5").count() == 0


# -- archives -----------------------------------------------------------------------------------------------


def test_loser_tree_merges():
    rng = random.Random(1)
    for k in range(0, 9):
        runs = [sorted(rng.choices(range(50), k=rng.randrange(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, tmp_path):
    trap = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://b.example/x", "same"), (5, "http://a.example/y#f", "same"), (3, None, "same"), (2, "http://a.example/Y?q=1", trap), (4, "http://a.example/y\r\nEvil: 1", ""), (None, "http://[bad", None), (7, "u", "ü" * 5000), (7, "u", "ü" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(0))
    path = f"file://{tmp_path}/a"
    got = warc.capture_histories(pages.repartition(3), path).orderBy("range_no", "place").collect()
    assert len(got) == len(rows) and [r["url_key"] for r in got] == sorted(r["url_key"] for r in got)
    by = {}
    for r in got:
        by.setdefault(r["page_id"], r)
    for page, _, text in rows:
        raw = (text or "").encode()
        assert by[page]["payload_bytes"] == len(raw) and by[page]["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    assert [(i, by[i]["record_type"], by[i]["refers_to"]) for i in (1, 3, 5)] == [(1, "revisit", 5), (3, "revisit", 5), (5, "response", None)]
    assert by[None]["record_type"] == "revisit" and by[None]["refers_to"] == 4 and by[7]["record_type"] == "response"
    assert warc.capture_histories(pages, min_bytes=10).filter("record_type = 'revisit'").count() == 0
    assert warc.capture_histories(pages.limit(0)).count() == 0
    wide = warc.merge_runs(warc.read_archives(spark, path), per_range=2).orderBy("range_no", "place").collect()
    assert [r["url_key"] for r in wide] == [r["url_key"] for r in got] and len({r["range_no"] for r in wide}) > 1


def test_archives_of_any_id_size_and_time(spark, tmp_path):
    big = "x" * 20_000
    rows = [(9_300_000_000_000, "u", big, 253402300800 + 5), (2**62, "u", "a", 253402300799), (-1, "u", big, 0), (2**62 + 1, "u", "b", None), (None, "u", "c" * 1_100_000, 7), (3, "u", "d", 7), (3, "u", "d", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, s long").withColumn("time", F.timestamp_seconds("s")).withColumn("__n", F.lit(1))
    path = f"file://{tmp_path}/any"
    got = warc.capture_histories(pages, path, time_col="time").orderBy("range_no", "place").collect()
    assert [r["page_id"] for r in got] == [-1, None, 3, 3, 2**62 + 1, 2**62, 9_300_000_000_000]
    assert {(r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 20_000} == {(-1, "revisit", 9_300_000_000_000), (9_300_000_000_000, "response", None)}
    files = [f"{d}/{n}" for d, _, names in os.walk(tmp_path / "any") for n in names if n.endswith(".gz")]
    heads = [h for f in files for _, h, _ in warc.parse(__import__("gzip").open(f))]
    assert len({h["warc-record-id"] for h in heads}) == len(rows) and len({r["file"] for r in got if r["payload_bytes"] > 16384 or r["page_id"] == 3}) >= 3


# -- pipeline -----------------------------------------------------------------------------------------------


@data
def test_pipeline_stages_keep_columns_and_decide(spark):
    import corpus_pipeline
    from weftgraph.llm.common import stage

    docs = docs_of(spark)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "language ID", "MinHash near-dedup", "benchmark decontamination", "best-fit packing"]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(f(spark, docs, D), "test")
        if k < 4:
            assert docs.columns == before.columns and 0 < docs.count() <= before.count()
            assert docs.exceptAll(before).count() == 0
        if k == 0:
            want = host_rules.host_rules(before).filter("kept").select("doc_id")
            assert docs.select("doc_id").exceptAll(want).count() == want.exceptAll(docs.select("doc_id")).count() == 0
        if k == 2:
            classes = near_dup.near_duplicates(before)
            assert docs.count() == classes.select("class_id").distinct().count()
        if k == 3:
            clean = decontaminate.contamination(before, spark.read.parquet(f"{D}/benchmark.parquet")).filter("not contaminated")
            assert docs.count() == clean.count()
        if k == 4:
            assert docs.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, D).count() == docs.count()
