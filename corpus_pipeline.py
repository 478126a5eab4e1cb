"""A training corpus from raw documents: STAGES in order, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet to the shared folder
and reads again as the next stage's docs.  All stages but the last keep the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamwork.llm import decontaminate, ngram_join, packing, pii, quality
from loamwork.llm.common import Workspace, held_out, load


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; trained on the labels that op1 may use.

    A null text is scored as an empty one; rows without an id, repeated rows and other columns, of any name, go through
    or go by the text alone.  Without labels the classifier has nothing to tell documents apart by and scores all alike.
    """
    names = ("score", "predicted")
    while {x.lower() for x in names} & {x.lower() for x in docs.columns}:
        names = (f"{names[0]}_", f"{names[1]}_")
    model = quality.train(docs, load(spark, sf_dir, "labels"), "quality", ~held_out("doc_id", 3, 1))
    return quality.score(docs, model, names).where(F.col(names[1]) == 1).select(*docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by 5-word shingles at a similarity of 0.8.

    Rows that repeat the kept id whole all stay, as do rows without an id: nothing says which of them to keep.
    """
    groups = ngram_join.similar_documents(spark, docs, n=5, per_cent=80)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").union(docs.where("doc_id IS NULL")).select(*docs.columns)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the benchmark's passages from the texts; all rows stay, and null texts stay null."""
    return decontaminate.remove_passages(docs, load(spark, sf_dir, "benchmark"), unnamed=True)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts; all rows stay, and null texts stay null."""
    return pii.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens along a space-filling curve.

    A null text has the end id alone; rows without an id and repeated rows are packed each on its own.
    """
    return packing.pack_along_curve(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each_group),
    ("decontamination", cut_benchmark),
    ("personal_data", mask_private),
    ("packing", pack),
]

#: The classifier, the span model and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents table."""
    ws = Workspace(spark, "pipeline")
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
