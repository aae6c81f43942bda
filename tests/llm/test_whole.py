"""Nothing is sampled or left out: every pair of a bucket is decided."""

import random
import zlib

import numpy as np
from test_corpus import DOCS

from weftgraph.llm import near_dup, perplexity


def test_near_duplicates_decides_every_pair_of_a_bucket(spark):
    """A passage that all texts share puts them into common buckets; a text and its variant have no other key in
    common, and hardly any hub is like them. Every pair with a common key must be one class."""
    rng = random.Random(20)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    passage = [word() for _ in range(20)]
    texts = []
    for _ in range(40):
        own = [word() for _ in range(80)]
        texts += [passage + own, passage + [w if i % 5 else word() for i, w in enumerate(own)]]
    _, _, pairs, keys = near_dup.sketch_keys(texts)
    keys = [set(k.tolist()) | set(p.tolist()) for k, p in zip(keys, pairs)]
    meet = [i for i in range(0, 80, 2) if keys[i] & keys[i + 1]]
    assert len(meet) > 30
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i + 1] for i in meet] == meet
    assert all(got[i] == i for i in range(0, 80, 2))


def test_pairs_of_a_block_are_those_the_bags_allow():
    rng = random.Random(21)
    words = [[rng.randrange(400) for _ in range(rng.choice((3, 60, 75, 900, 1100)))] for _ in range(60)]
    words += [w[:-1] + [7] for w in words[:20]] + [[1] * 700, [1] * 690 + [2] * 10]
    size = np.array([len(w) for w in words])
    bags = [near_dup.word_bag(np.array(w, np.uint64)) for w in words]
    component = np.array([rng.randrange(12) for _ in words])
    for block in (np.zeros(len(words), int), np.array([rng.randrange(2) for _ in words])):
        n = min(len(b) for b in bags)
        short = [near_dup.folded(b, n).tobytes() for b in bags]
        want = {
            (i, j) for i in range(len(words)) for j in range(i)
            if component[i] != component[j] and (block.min() == block.max() or block[i] != block[j])
            and max(abs(int(size[i]) - int(size[j])), near_dup.bag_bound(short[i], short[j])) <= near_dup.allowed(max(size[i], size[j]), 0.8)
        }
        a, b = near_dup.allowed_pairs(component, block, size, bags, 0.8)
        got = [(max(x, y), min(x, y)) for x, y in zip(a.tolist(), b.tolist())]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_near_duplicates_make_no_row_for_each_pair_of_a_bucket(spark, monkeypatch):
    """Texts of the same words in other orders share a passage: bags allow every pair, and alignment refuses all but the
    variants. Rows of what is left to decide grow with the texts, not with their pairs."""
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6))
    passage, own = [word() for _ in range(20)], [word() for _ in range(60)]
    texts = []
    for _ in range(60):
        rng.shuffle(own)
        texts += [passage + own, passage + [w if i % 20 else word() for i, w in enumerate(own)]]
    rows = [(i, " ".join(t), "en", "a", 1) for i, t in enumerate(texts)]
    made, plain = {}, near_dup.stage

    def counted(df, name):
        out = plain(df, name)
        made[name] = max(made.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dup, "stage", counted)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i] == got[i + 1] == i for i in range(0, 120, 2))
    assert made["undecided"] < len(texts) and made["again"] <= made["placed"]


def test_joining_pairs_join_what_all_similar_pairs_join():
    rng = random.Random(23)
    texts = [[rng.randrange(50) for _ in range(30)] for _ in range(12)]
    texts = [[w if rng.random() > 0.1 else rng.randrange(50) for w in t] for t in texts for _ in range(6)]
    codes = [np.array(t, "<u4").tobytes() for t in texts]
    n = len(codes)
    component = np.array([rng.randrange(60) for _ in codes])
    marks = [np.array(sorted(rng.sample(range(-9, 9), 4)) + [9]) for _ in codes]
    i, j = np.array([(a, b) for a in range(n) for b in range(a)]).T
    bits = near_dup.first_common(marks, 9)
    first = [not (set(marks[a].tolist()) & set(marks[b].tolist()) - {9}) for a, b in zip(i, j)]
    assert [not (bits[a] & bits[b]).any() for a, b in zip(i, j)] == first

    def groups(pairs):
        label = component.tolist()
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return [[x == y for y in label] for x in label]

    similar = [(a, b) for a, b, f in zip(i.tolist(), j.tolist(), first) if f and near_dup.alike(codes[a], codes[b], 0.8)]
    got = near_dup.joining_pairs(component, codes, bits, i, j, 0.8)
    assert set(got) <= set(similar) and groups(got) == groups(similar) and 0 < len(got) < len(similar)


def test_quality_model_counts_every_trusted_text(spark, monkeypatch):
    """12 MB of trusted text, and one text of 3 MB: more than any sample held."""
    rng = random.Random(18)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=500_000 if i == 1 else 33_000)), "en", "a", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).coalesce(2)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    counted, keep = [], perplexity.count_grams
    monkeypatch.setattr(perplexity, "IDS", 20)
    monkeypatch.setattr(perplexity, "count_grams", lambda texts: (counted.append(texts.count()), keep(texts))[1])
    got = perplexity.quality_by_perplexity(docs, labels)
    assert got.count() == 60 and counted == [sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(60))]


def test_quality_model_in_rows_and_blocks_is_the_whole_model(spark, monkeypatch):
    rng = random.Random(19)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(1, 8))) for _ in range(200)]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 200))), "en", "a", 1) for i in range(80)] + [(7, "again", "de", "a", 1), (7, "again", "de", "a", 1), (None, None, None, "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    keys, counts = np.unique(perplexity.grams([perplexity.plain(r[1]) for r in rows])[0], return_counts=True)
    whole = perplexity.fit_tables(keys, counts)
    monkeypatch.setattr(perplexity, "HELD_GRAMS", 500)
    monkeypatch.setattr(perplexity, "ROW_GRAMS", 100)
    perplexity.ship(spark)
    lowest, model = perplexity.fit(perplexity.count_grams(docs))
    asked = np.unique(np.concatenate([keys, np.random.default_rng(1).integers(0, 1 << 40, 500, dtype=np.uint64)]))
    parts = sorted(model.collect(), key=lambda r: r["low"])
    want, got, edges = perplexity.probability(whole, asked), np.zeros(len(asked)), [0, *(r["low"] for r in parts[1:]), 1 << 16]
    for low, high, r in zip(edges, edges[1:], parts):
        here = (asked >= np.uint64(low << 24)) & (asked < np.uint64(high << 24))
        got[here] = perplexity.probability([lowest, *perplexity._unpacked(r["tables"])], asked[here])
    assert len(parts) > 10 and np.allclose(got, want, rtol=1e-12)
    score = lambda: sorted((r["doc_id"] or 0, r["lang"] or "", r["n_bytes"], round(r["perplexity"], 9)) for r in perplexity.perplexities(docs, lowest, model, ["lang"], "doc_id", "text").collect())
    one = score()
    monkeypatch.setattr(perplexity, "BLOCK_GRAMS", 600)
    assert len(perplexity.model_blocks(model)) > 2 and score() == one and len(one) == len(rows)
