"""Collocations against plain counting in Python."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loamwork.llm import collocations
from loamwork.llm.common import Workspace

SCHEMA = "doc_id long, lang string, text string, phrase string, n string, rank string, word string"


def frame(spark, rows):
    return spark.createDataFrame([(i, a, t, "x", "y", "z", "w") for i, (a, t) in enumerate(rows)], SCHEMA).repartition(3)


def brute(rows, most_words=3, least=10, inside=50, best=2000):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    counts, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            n[lang] += len(words)
            for size in range(1, most_words + 1):
                for k in range(len(words) - size + 1):
                    counts.setdefault(lang, Counter())[tuple(words[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longest = Counter()
        for p, a in found.items():
            for size in range(2, len(p)):
                for k in range(len(p) - size + 1):
                    longest[p[k : k + size]] = max(longest[p[k : k + size]], a)
        scored = []
        for p, a in found.items():
            score, k = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            if not longest[p] or 100 * longest[p] < inside * a:
                scored.append((-score, -a, " ".join(p).encode(), a, f[p[:k]], f[p[k:]]))
        for rank, (score, _, phrase, a, left, right) in enumerate(sorted(scored)[:best], 1):
            out.append((lang, rank, phrase.decode(), a, left, right, n[lang], -score))
    return sorted(out)


def random_texts(seed, many=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(14)] + ["É", "é", "X", "x", "a b", "a\tb", " ", "…", "hot", "hot", "hot hot"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = []
    for _ in range(many):
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!"]) for w in rng.choices(words, weights, k=rng.randrange(40)))
        rows.append((rng.choice(["en", "en", "de", None, ""]), text))
    return [*rows, ("en", None), ("en", ""), (None, None), ("fr", "one two"), *[rows[0]] * 12]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = random_texts(seed)
    got = sorted(tuple(r) for r in collocations.collocations(spark, frame(spark, rows)).collect())
    assert got == brute(rows) and len(got) > 10


def test_other_sizes_and_limits(spark):
    rows = random_texts(3)
    got = sorted(tuple(r) for r in collocations.collocations(spark, frame(spark, rows), most_words=4, least=3, inside_per_cent=80, best=7).collect())
    assert got == brute(rows, 4, 3, 80, 7)


def test_split_pivots_and_shared_counts_change_nothing(spark, monkeypatch):
    """Pivots dealt to several parts, rows of few fragments, small slices, and a table where all words share two entries."""
    for name, value in (("HOT_FRAGMENTS", 5), ("TOGETHER_FRAGMENTS", 2), ("TOGETHER", 64), ("TABLE_BITS", 1)):
        monkeypatch.setattr(collocations, name, value)
    rows = random_texts(4)
    batches = [b for b in frame(spark, rows).select(F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit(""))).toArrow().to_batches()]
    import numpy as np
    import pyarrow as pa

    fragments = list(collocations._fragments(np.full(2, 1000), 3, 10)(iter(batches)))
    table = pa.Table.from_batches(fragments).sort_by([("lang", "ascending"), ("pivot", "ascending"), ("part", "ascending")])
    assert len(set(table["part"].to_pylist())) > 3
    found = Counter()
    for batch in collocations._mined(3, 10)(iter(table.to_batches(max_chunksize=7))):
        for r in batch.to_pylist():
            found[r["lang"], r["phrase"]] += r["n"]
    want = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")):
            words = [w for w in re.split("[ \t]", piece) if w]
            want.update(("und" if lang is None else lang, " ".join(words[k : k + s])) for s in (2, 3) for k in range(len(words) - s + 1))
    assert found == want


def test_one_very_long_text(spark):
    text = "the cat sat, " * 1_200_000  # above what is taken together
    got = collocations.collocations(spark, frame(spark, [("en", text), ("en", "x" * 9_000_000)])).collect()
    assert [(r["phrase"], r["a"], r["score"]) for r in got] == [("the cat sat", 1_200_000, 1_000_000)]


def test_empty_table(spark):
    assert collocations.collocations(spark, frame(spark, [])).collect() == []
    words, phrases = collocations.frequent_ngrams(spark, frame(spark, [(None, "A a")]), Workspace(spark, "t"), least=1)
    assert [tuple(r) for r in words.collect()] == [("und", "a", 2)] and [tuple(r) for r in phrases.collect()] == [("und", "a a", 1)]
