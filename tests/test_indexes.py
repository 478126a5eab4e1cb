"""Written indexes: what they find, what they read, masks before the cut, and later changes."""

import os

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from loamwork.operators import search, text_index, vector_index
from loamwork.plans import adapters as t
from loamwork.plans import queries as q

SF = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def vectors(spark, rows=3000, dim=12, seed=1, hot=0):
    """Clustered vectors; `hot` more of them are all alike."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, dim))
    out = [(i, [float(x) for x in centres[i % 15] + 0.6 * rng.normal(size=dim)]) for i in range(rows)]
    out += [(rows + i, [float(x) for x in centres[0]]) for i in range(hot)]
    bad = [(10**6, None), (10**6 + 1, [0.0] * dim), (10**6 + 2, [float("nan")] * dim), (10**6 + 3, [1.0])]
    return spark.createDataFrame(out + bad, "id long, embedding array<float>")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def scanned(spark, df, queries, limit, visible=None):
    own = df if visible is None else df.join(visible, "id", "left_semi")
    out = []
    for r in queries.collect():
        found = search.semantic(own, list(r["embedding"]), limit).collect()
        out += [(r["query"], k, x["id"], x["score"]) for k, x in enumerate(found, 1)]
    return sorted(out)


@needs_data
def test_recall_on_all_queries(spark):
    """Over the table as it is: of the nearest ten of every vector with an id divisible by 100, nine in ten or more."""
    found = q.QUERIES["semantic_recall"](spark, SF).first()
    truth = t.vectors(spark, SF).where("id % 100 = 0").count() * 10
    assert found["wanted"] == truth and found["recall"] >= 0.9


def test_index_equals_a_scan_where_asked_to(spark, tmp_path):
    df = vectors(spark)
    index = vector_index.build(df, str(tmp_path / "i"))
    queries = df.where("id % 100 = 0").select(F.col("id").alias("query"), "embedding").where("query < 1000")
    want = scanned(spark, df, queries, 10)
    assert rows_of(vector_index.search(index, queries, 10, probes=2, exact=True)) == want
    near = vector_index.recall(vector_index.search(index, queries, 10), spark.createDataFrame([x[:1] + x[2:3] for x in want], "query long, id long")).first()
    assert near["recall"] >= 0.9
    again = vector_index.opened(spark, str(tmp_path / "i"))
    assert rows_of(vector_index.search(again, queries, 3, exact=True)) == scanned(spark, df, queries, 3)


def test_masks_come_before_the_cut(spark, tmp_path):
    df = vectors(spark, 600)
    index = vector_index.build(df, str(tmp_path / "i"), cells=9)
    queries = df.where("id IN (0, 7)").select(F.col("id").alias("query"), "embedding")
    few = df.where("id % 50 = 3").select("id")
    assert rows_of(vector_index.search(index, queries, 5, exact=True, visible=few)) == scanned(spark, df, queries, 5, few)


def test_hot_cells_are_split_and_ties_go_by_id(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vector_index, "GROUP_ENTRIES", 50)
    monkeypatch.setattr(vector_index, "GROUP_QUERIES", 3)
    df = vectors(spark, 300, hot=400)
    index = vector_index.build(df, str(tmp_path / "i"), cells=6)
    queries = df.where("id % 15 = 0 AND id < 200").select(F.col("id").alias("query"), "embedding")
    assert rows_of(vector_index.search(index, queries, 10, exact=True)) == scanned(spark, df, queries, 10)


def test_rows_added_later(spark, tmp_path):
    df = vectors(spark, 400)
    index = vector_index.build(df.where("id < 300"), str(tmp_path / "i"), cells=8)
    index = vector_index.add(index, df.where("id >= 300"))
    queries = df.where("id IN (5, 350)").select(F.col("id").alias("query"), "embedding")
    assert rows_of(vector_index.search(index, queries, 6, exact=True)) == scanned(spark, df, queries, 6)
    assert int(index.members.sum()) == 400
    with pytest.raises(ValueError):
        vector_index.build(df.where("id > 1000 AND id < 1000003"), str(tmp_path / "none"))


def test_few_candidates_are_scored_again(spark, tmp_path, monkeypatch):
    """Not the best of each cell, but of all cells together, and the nearest cells are searched once."""
    df, counts, kept = vectors(spark, hot=30), [], vector_index._rescored
    index = vector_index.build(df, str(tmp_path / "i"), cells=50, tune=False)
    queries = df.where("id % 150 = 0 AND id < 3000").select(F.col("id").alias("query"), "embedding")
    monkeypatch.setattr(vector_index, "_rescored", lambda found, *rest: counts.append(found.distinct().count()) or kept(found, *rest))
    near = vector_index.stored(vector_index.search(index, queries, 10, probes=50))
    found = rows_of(vector_index.search(index, queries, 10, exact=True, near=near))
    monkeypatch.undo()
    assert found == rows_of(near) == scanned(spark, df, queries, 10)
    assert len(counts) == 2 and counts[0] <= 20 * 60 and counts[1] <= 20 * 30


TEXTS = [(i, f"alpha w{i % 7} w{i % 11} " + "beta " * (i % 3) + f"rare{i}") for i in range(500)] + [(900, None), (901, ""), (902, "ALPHA, Beta!")]


def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, content string")


def test_text_index_finds_what_a_scan_finds(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK_DOCUMENTS", 60)
    df = texts(spark)
    index = text_index.build(df, str(tmp_path / "i"))
    assert index.blocks > 5
    for words in ("alpha", "beta w3", "rare7", "none here", "alpha beta w2 w4", "?!", "Alpha ALPHA"):
        assert index.search(words, 50).collect() == search.fulltext(df, words, 50).collect(), words
    few = df.where("id % 20 = 1").select("id")
    assert index.search("alpha", 5, few).collect() == search.fulltext(df.join(few, "id"), "alpha", 5).collect()


def test_text_index_changes_and_merging(spark, tmp_path):
    df = texts(spark)
    index = text_index.build(df, str(tmp_path / "i"))
    changed = df.where("id % 3 = 0").withColumn("content", F.concat(F.lit("new gamma w3 "), F.col("id").cast("string")))
    index = text_index.add(index, changed, df.where("id % 3 = 1").select("id"))
    index = text_index.add(index, df.where("id = 0").withColumn("content", F.lit("newest gamma gamma")))
    want = df.where("id % 3 = 2").union(changed.where("id <> 0")).union(spark.createDataFrame([(0, "newest gamma gamma")], df.schema))
    small = text_index.merged(index, str(tmp_path / "m"))
    assert small.gone() is None
    for words in ("alpha", "gamma", "w3", "newest", "new gamma", "rare2"):
        wanted = search.fulltext(want, words, 1000).collect()
        assert index.search(words, 1000).collect() == wanted and small.search(words, 1000).collect() == wanted, words


def test_text_index_reads_only_the_terms_it_needs(spark, tmp_path, monkeypatch):
    """Row groups are sorted by term, and the filter reaches the scan."""
    monkeypatch.setattr(text_index, "ROW_GROUP_BYTES", 4096)
    many = spark.range(4000).selectExpr("id", "concat('t', id, ' u', id) AS content")
    index = text_index.build(many, str(tmp_path / "i"))
    plan = text_index.matches(index.rows(), "t17 u17")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [t17,u17])" in plan
    groups = hit = 0
    for name in os.listdir(tmp_path / "i" / "postings"):
        if name.endswith(".parquet"):
            meta = pq.ParquetFile(tmp_path / "i" / "postings" / name).metadata
            for g in range(meta.num_row_groups):
                s = meta.row_group(g).column(0).statistics
                groups, hit = groups + 1, hit + any(s.min <= x <= s.max for x in ("t17", "u17"))
    assert groups >= 8 and hit <= 2
