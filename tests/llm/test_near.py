import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from loamwork.llm import components, ngram_join, simhash
from loamwork.llm import signature_tree as trees
from loamwork.llm.common import Workspace


def random_sets(rng):
    sets = []
    for _ in range(rng.randint(1, 10)):
        base = np.unique(np.array([rng.getrandbits(64) for _ in range(rng.choice([1, 3, 9, 12, 40, 200, 700]))], np.uint64))
        for _ in range(rng.randint(1, 20)):
            e = rng.randint(0, max(1, len(base) // 12))
            kept = np.delete(base, rng.sample(range(len(base)), min(e, len(base) - 1)))
            sets.append(np.unique(np.concatenate([kept, np.array([rng.getrandbits(64) for _ in range(rng.randint(0, e))], np.uint64)])))
    rng.shuffle(sets)
    return sets


def brute(sets, per_cent):
    groups = trees.Groups(len(sets))
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if both and 100 * both >= per_cent * (len(sets[i]) + len(sets[j]) - both):
                groups.join(i, j)
    return groups.labels()


def test_trees_lose_no_link():
    rng = random.Random(3)
    for _ in range(12):
        sets = random_sets(rng)
        for per_cent in (80, 90):
            want = brute(sets, per_cent)
            exact = trees.Groups(len(sets))
            trees.link_exact(sets, exact, per_cent)
            assert (exact.labels() == want).all()
            hashed = trees.Groups(len(sets))
            trees.link_hashed([ngram_join._bitmap(s) for s in sets], np.array([len(s) for s in sets]), hashed, per_cent)
            found = hashed.labels()
            assert all(len(set(found[want == v].tolist())) == 1 for v in set(want.tolist()))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


def near_documents(rng):
    texts = [None, "", " \n", "one", "ONE", "one two", "one\ttwo", "one two three", "É x y", "é x y"]
    shared = [f"p{k}" for k in range(60)]
    for g in range(8):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([9, 15, 60, 300]))] + (shared if g % 2 else [])
        texts += [edited(rng, words, rng.randrange(0, 1 + len(words) // 30)) for _ in range(rng.choice([1, 2, 12]))]
    chain = [f"c{k}" for k in range(200)]
    for k in range(6):
        texts.append(" ".join([*(f"r{j}" for j in range(4 * k)), *chain[4 * k :]]))
    rng.shuffle(texts)
    return texts + texts[:3]


def expected(texts, ids, n, per_cent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    groups = trees.Groups(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= per_cent * len(sets[i] | sets[j]):
                groups.join(i, j)
    labels = groups.labels()
    return sorted((ids[i], len(sets[i]), min(ids[j] for j in range(len(ids)) if labels[j] == labels[i])) for i in range(len(ids)))


def test_join_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK_HASHED", 5)
    monkeypatch.setattr(ngram_join, "BLOCK_EXACT", 5)
    rng = random.Random(11)
    texts = near_documents(rng)
    ids = rng.sample(range(1000), len(texts))
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, node int, key string")
    for n, per_cent in ((3, 90), (5, 80)):
        got = sorted(tuple(r) for r in ngram_join.similar_documents(spark, docs, n, per_cent).collect())
        assert got == expected(texts, ids, n, per_cent)


def test_join_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.similar_documents(spark, empty).count() == 0
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(7, text), (7, text), (7, "other words of this id"), (3, text + " x"), (None, text), (None, None), (9, None)]
    got = [tuple(r) for r in ngram_join.similar_documents(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()]
    assert sorted(got, key=str) == sorted([(7, 48, 3), (7, 48, 3), (7, 3, 7), (3, 49, 3), (None, 48, 3), (None, 0, None), (9, 0, 9)], key=str)


def test_components(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(500, 500 + k) for k in range(1, 60)]
    groups = trees.Groups(600)
    for a, b in edges:
        groups.join(a, b)
    labels = groups.labels()
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), Workspace(spark, "cc"), "t").collect()}
    assert got == {x: labels[x] for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long"), Workspace(spark, "cc"), "e").count() == 0


def test_roots_and_extended_components(spark):
    rng = random.Random(6)
    parents = [(k, k - 1) for k in range(1, 30)] + [(k, rng.randrange(100, k)) for k in range(101, 140)] + [(300 + k, 300) for k in range(1, 20)]
    edges = [(29, 130), (150, 151), (310, 150), (7, 9), (160, 161), (160, 160), (170, 170)]
    groups = trees.Groups(400)
    for a, b in parents:
        groups.join(a, b)
    one, ws = groups.labels(), Workspace(spark, "roots")
    labels = components.roots(spark.createDataFrame(parents, "node long, label long"), ws, "t")
    assert {r["node"]: r["label"] for r in labels.collect()} == {a: one[a] for a, _ in parents}
    for a, b in edges:
        groups.join(a, b)
    both = groups.labels()
    rows = components.extended(labels, spark.createDataFrame(edges, "a long, b long"), ws, "u").collect()
    assert len(rows) == len({r["node"] for r in rows})
    assert {r["node"]: r["label"] for r in rows} == {x: both[x] for e in parents + edges if e[0] != e[1] for x in e}
    none = spark.createDataFrame([], "a long, b long")
    empty = components.roots(none.toDF("node", "label"), ws, "n")
    assert empty.count() == 0 and components.extended(empty, none, ws, "m").count() == 0


def simhash_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, row int")
    return simhash.edited_fingerprints(docs).collect()


def test_edited_texts_and_neighbours(spark):
    rng = random.Random(8)
    texts = {k * 3: " ".join(f"w{rng.randrange(40_000)}" for _ in range(rng.choice([0, 1, 2, 30, 300, 5000]))) for k in range(40)} | {1000: "é€😀日本語 x", 1003: None}
    got = {r["doc_id"]: r for r in simhash_rows(spark, texts.items())}
    ids = sorted(texts)
    prints = {}
    for at, i in enumerate(ids):
        text, after = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        half = len(text) // 2
        want = text[: len(text) - half] + after[:half]
        r = got[i]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        prints.setdefault(text, r["fingerprint"])
        assert prints[text] == r["fingerprint"] and len(r["fingerprint"]) == simhash.BITS // 4
        same = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / simhash.BITS
        assert abs(r["near_edited"] - same(r["fingerprint"], r["edited_fingerprint"])) < 1e-12
        assert abs(r["near_next"] - same(r["fingerprint"], got[ids[(at + 1) % len(ids)]]["fingerprint"])) < 1e-12
    long = [r for r in got.values() if r["n_chars"] > 1000]
    assert np.mean([r["near_edited"] > r["near_next"] for r in long]) > 0.9


def test_simhash_edges(spark):
    assert simhash_rows(spark, []) == []
    (one,) = simhash_rows(spark, [(5, "a b c d")])
    assert one["edited_sha256"] == hashlib.sha256(b"a b a b"[:4] + b"a b").hexdigest() and one["near_next"] == 1.0
    got = simhash_rows(spark, [(5, "a b"), (5, "a b"), (None, None), (5, "c d e")])
    assert len(got) == 4 and len({r["fingerprint"] for r in got if r["n_chars"] == 3}) == 1


def test_radius_search(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(30)]
    values = {b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(5))) for b in base for _ in range(6)}
    df = spark.createDataFrame([(f"{v:032x}",) for v in values for _ in range(2)], "fingerprint string")
    want = sorted((f"{a:032x}", f"{b:032x}", (a ^ b).bit_count()) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3)
    assert sorted(tuple(r) for r in simhash.within_radius(df, 3).collect()) == want


def test_radius_counts(spark, monkeypatch):
    """All within the radius are counted, once each, however many share a key: recall 1.0 against brute force."""
    rng = random.Random(2)
    base = [rng.getrandbits(128) for _ in range(12)]
    values = list({b ^ sum(1 << k for k in rng.sample(range(128), rng.randrange(6))) for b in base for _ in range(14)} | {0, 1, (1 << 128) - 1, 1 << 127})
    asked = values[::3]
    df = spark.createDataFrame([(f"{v:032x}",) for v in values for _ in range(2)], "fingerprint string")
    ask = spark.createDataFrame([(f"{v:032x}",) for v in asked], "fingerprint string")
    for bucket, radius, blocks in ((1000, 3, 6), (3, 3, 4), (1000, 2, 3)):
        monkeypatch.setattr(simhash, "BUCKET", bucket)
        want = {f"{a:032x}": sum(1 <= (a ^ b).bit_count() <= radius for b in values) for a in asked}
        assert {r["fingerprint"]: r["n_within"] for r in simhash.counted_within(df, ask, radius, blocks).collect()} == want
    assert simhash.counted_within(df.limit(0), ask, 3).collect() == [] and simhash.counted_within(df, ask.limit(0), 3).collect() == []


def test_near_counts_of_documents(spark):
    rows = spark.createDataFrame([(1, "a" * 32), (100, "a" * 31 + "b"), (200, "0" * 32), (None, "a" * 32), (100, "a" * 31 + "b")], "doc_id long, fingerprint string")
    got = simhash.with_near_counts(spark, rows, F.col("doc_id") % 100 == 0).collect()
    assert sorted((r["doc_id"] or -1, r["n_within"] if r["n_within"] is not None else -1) for r in got) == [(-1, -1), (1, -1), (100, 1), (100, 1), (200, 0)]


def test_fingerprints_equal_plain_simhash(spark):
    """Bits by a plain sum of votes in Python, over the hashes Spark gives."""
    texts = ["the cat sat on the mat", "The CAT", "", "x", "a b a b longerword", "w " * 4500]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    found = {r["k"]: (r["f0"], r["f1"]) for r in simhash.fingerprint_rows(df, ["k"]).collect()}
    words = sorted({w for t in texts for w in t.lower().split(" ")})
    hashes = {r["w"]: (r["a"], r["b"]) for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", F.xxhash64("w").alias("a"), F.xxhash64("w", F.lit(1)).alias("b")).collect()}

    def weight(w):
        size = min(len(w), 8)
        return max(size * size // 4, min(size, 1))

    for k, text in enumerate(texts):
        own = text.lower().split(" ")
        for i in range(2):
            number = 0
            for bit in range(64):
                votes = sum(weight(w) if (hashes[w][i] & (1 << 64) - 1) >> bit & 1 else -weight(w) for w in own)
                number |= (votes > 0) << bit
            assert found[k][i] & (1 << 64) - 1 == number
