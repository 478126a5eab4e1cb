"""A written inverted index for full-text search: postings by term and block, clustered by term, with later changes merged in.

A block is some thousand documents, by their ids' hash, so a term that all documents have is many rows of bounded size.
A row tells how many documents it names; blocks without all the query's terms are dropped before any list is opened.
Rows lie sorted by term in small row groups, so a search reads the groups that its terms can be in.

Changes are further rows of a later generation; `gone` names the generation from which on an id's older postings don't
count.  `merged` makes one generation of all.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import PLAIN, Analyzer
from .search import check_limit

BLOCK_DOCUMENTS = 4096
ROW_GROUP_BYTES = 1 << 20


def postings(chunks: DataFrame, blocks: int, analyzer: Analyzer = PLAIN, text_col: str = "content", generation: int = 0) -> DataFrame:
    """term, block, n, ids, tfs, generation of chunks (id, text): documents of a block by id, and how often they have the term."""
    terms = chunks.select("id", F.explode(analyzer.counted_terms(F.col(text_col))).alias("term")).groupBy("term", "id").agg(F.count("*").cast("int").alias("tf"))
    return _grouped(terms, blocks, generation)


def _grouped(terms: DataFrame, blocks: int, generation: int) -> DataFrame:
    own = terms.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    rows = own.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("id", "tf"))).alias("x"))
    return rows.select("term", "block", F.size("x").alias("n"), F.col("x.id").alias("ids"), F.col("x.tf").alias("tfs"), F.lit(generation).alias("generation"))


def matches(index: DataFrame, query: str, analyzer: Analyzer = PLAIN, gone: DataFrame | None = None) -> DataFrame:
    """id, score of the documents with all the query's terms; gone: id, generation."""
    q = analyzer.query_terms(query)
    own = index.where(F.col("term").isin(q)) if q else index.where(F.lit(False))
    full = own.groupBy("block").agg(F.count_distinct("term").alias("terms")).where(F.col("terms") == len(q)).select("block")
    each = own.join(full, "block", "left_semi").select("term", "generation", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select("term", "generation", F.col("x.ids").alias("id"), F.col("x.tfs").alias("tf"))
    if gone is not None:
        each = each.join(gone.groupBy("id").agg(F.max("generation").alias("since")), "id", "left").where(F.col("since").isNull() | (F.col("generation") >= F.col("since")))
    # A posting that was written twice counts once.
    each = each.groupBy("id", "term").agg(F.max("tf").alias("tf"))
    score = F.round(F.sum(F.lit(1.0) + F.log(F.col("tf").cast("double"))), 6)
    return each.groupBy("id").agg(score.alias("score"), F.count("*").alias("n")).where(F.col("n") == len(q)).select("id", "score")


def best(found: DataFrame, limit: int | None = None, visible: DataFrame | None = None) -> DataFrame:
    """The best of found (id, score) among the visible ids; masked before the cut."""
    if visible is not None:
        found = found.join(visible.select("id"), "id", "left_semi")
    return found.orderBy(F.desc("score"), "id").limit(check_limit(limit))


@dataclass(frozen=True)
class TextIndex:
    """A written index in a folder: `postings` and `gone`."""

    spark: SparkSession
    path: str
    blocks: int
    generation: int
    analyzer: Analyzer

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def gone(self) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/gone") if self.generation else None

    def search(self, query: str, limit: int | None = None, visible: DataFrame | None = None) -> DataFrame:
        """id, score, best first."""
        return best(matches(self.rows(), query, self.analyzer, self.gone()), limit, visible)


def clustered(rows: DataFrame) -> DataFrame:
    """Postings in the order they are written in."""
    return rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block")


def _write(rows: DataFrame, path: str) -> None:
    clustered(rows).write.mode("append").option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/postings")


def build(chunks: DataFrame, path: str, analyzer: Analyzer = PLAIN, text_col: str = "content") -> TextIndex:
    """Writes an index of chunks (id, text; null texts have no terms) to a new folder and returns it."""
    blocks = 1 + chunks.count() // BLOCK_DOCUMENTS
    _write(postings(chunks, blocks, analyzer, text_col), path)
    return TextIndex(chunks.sparkSession, path, blocks, 0, analyzer)


def add(index: TextIndex, chunks: DataFrame, removed: DataFrame | None = None, text_col: str = "content") -> TextIndex:
    """The index with new or changed chunks, and without the removed ids: what was there of either no longer counts."""
    after = index.generation + 1
    ids = chunks.select("id") if removed is None else chunks.select("id").union(removed.select("id"))
    ids.distinct().withColumn("generation", F.lit(after)).write.mode("append").parquet(f"{index.path}/gone")
    _write(postings(chunks, index.blocks, index.analyzer, text_col, after), index.path)
    return TextIndex(index.spark, index.path, index.blocks, after, index.analyzer)


def merged(index: TextIndex, path: str) -> TextIndex:
    """The index in one generation, in a new folder."""
    each = index.rows().select("term", "generation", F.explode(F.arrays_zip("ids", "tfs")).alias("x")).select("term", "generation", F.col("x.ids").alias("id"), F.col("x.tfs").alias("tf"))
    gone = index.gone()
    if gone is not None:
        each = each.join(gone.groupBy("id").agg(F.max("generation").alias("since")), "id", "left").where(F.col("since").isNull() | (F.col("generation") >= F.col("since")))
    documents = each.select("id").distinct().count()
    blocks = 1 + documents // BLOCK_DOCUMENTS
    _write(_grouped(each.select("term", "id", "tf"), blocks, 0), path)
    return TextIndex(index.spark, path, blocks, 0, index.analyzer)
