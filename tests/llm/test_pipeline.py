import random

from pyspark.sql import functions as F

import corpus_pipeline
from loamwork.llm import decontaminate, pii

from .test_text_models import words


def test_stages(spark, tmp_path):
    rng = random.Random(3)
    passage = words(rng, 40)
    docs, labels = [], []
    for i in range(240):
        text, y = words(rng, rng.randint(30, 90)), int(i % 3 > 0)
        if not y:
            text = " ".join(w.upper() + "!!" for w in text.split())
        docs.append((i, text, "en", "s", len(text)))
        labels.append((i, y, 0))
    clean = [d for d in docs if d[0] % 3]
    near = clean[10][1].rsplit(" ", 1)[0] + " other"
    extra = [(300, clean[5][1], "en", "s", 1), (301, near, "en", "s", 1), (302, words(rng, 30) + " " + passage + " " + words(rng, 30), "en", "s", 1), (303, words(rng, 40) + " a.b@c.com " + words(rng, 20), "en", "s", 1)]
    d = f"{tmp_path}/sf"
    spark.createDataFrame(docs + extra, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns = now.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r["doc_id"]: r["text"] for r in now.collect()}
    good = {i for i, y, _ in labels if y} | {300, 301, 302, 303}
    assert set(kept["quality"]) == good
    assert set(kept["near_duplicates"]) == good - {300, 301}
    assert set(kept["decontamination"]) == set(kept["personal_data"]) == good - {300, 301}
    assert not next(iter(decontaminate.Windows([("1", passage)]).scan([decontaminate.words_of(kept["decontamination"][302])])))[0].any()
    assert pii.base_spans(kept["personal_data"][303]) == [] and "<EMAIL>" in kept["personal_data"][303]
    assert {i: t for i, t in kept["personal_data"].items() if i < 300} == {i: t for i, t, *_ in docs if i in good}
    out = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == good - {300, 301}
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 4096").count() == 0


ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, Predicted string, hits string, component_id string, n_shingles string, row string, k string, label string, quality string"


def odd_tables(spark, tmp_path, rows):
    d = f"{tmp_path}/odd-{len(rows)}"
    more = ["x"] * 9
    spark.createDataFrame([(i, t, "en", "s", 1, *more) for i, t in rows], ODD_SCHEMA).repartition(2).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten"), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, spark.read.parquet(f"{d}/documents.parquet")


def test_stages_on_odd_rows(spark, tmp_path):
    """Null and empty texts, null ids, repeated rows, a very long text, and columns with the names that stages use."""
    rng = random.Random(5)
    same, long = words(rng, 40), words(rng, 60_000)
    rows = [(1, None), (None, None), (None, "no id " + same), (2, ""), (3, same), (3, same), (7, same), (4, long + " one two three four five six seven eight nine ten tail a.b@c.com"), (5, "!"), (6, "a.b@c.com")]
    d, docs = odd_tables(spark, tmp_path, rows)
    texts = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and {r["label"] for r in out.select("label").collect()} <= {"x"}
        got = texts(out)
        if name == "quality":
            assert all(x in rows for x in got)
        elif name == "near_duplicates":
            assert got == sorted([x for x in rows if x[0] != 7], key=repr)  # rows of the kept id, and those without one, all stay
        elif name == "decontamination":
            assert [x for x in got if x[0] != 4] == sorted([x for x in rows if x[0] != 4], key=repr)
            assert "seven eight" not in next(t for i, t in got if i == 4) and len(got) == len(rows)
        else:
            assert len(got) == len(rows) and {i: t for i, t in got if i in (1, 2, 5)} == {1: None, 2: "", 5: "!"} and (6, "<EMAIL>") in got
    pieces = corpus_pipeline.pack(spark, docs, d).collect()
    assert sum(r["start"] == 0 for r in pieces) == len(rows)
    assert sum(r["length"] for r in pieces) == sum(r["doc_tokens"] for r in pieces if r["start"] == 0)


def test_stages_on_empty_tables(spark, tmp_path):
    d, docs = odd_tables(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).collect() == []
    assert corpus_pipeline.run(spark, d).collect() == []
