"""Search: full text, semantic, hybrid by reciprocal ranks, and the projection of results.

All are lazy plans over a chunks-like table.  Every sort ends in the id, so equal scores have one order; scores are
rounded before they are ranked.  Top-k plans run as a bounded heap per task and one merge; the content of results
is joined only after the cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import under_root
from ..functions.text import PLAIN, Analyzer, log_tf, matches_all
from ..functions.vector import cosine

DEFAULT_LIMIT, MOST_RESULTS = 10, 1000
RANK_OFFSET = 59.0


def check_limit(limit: int | None) -> int:
    """The limit to use; ValueError outside of 1 to MOST_RESULTS."""
    limit = DEFAULT_LIMIT if limit is None else limit
    if not 1 <= limit <= MOST_RESULTS:
        raise ValueError(f"limit must be from 1 to {MOST_RESULTS}")
    return limit


def candidates(limit: int) -> int:
    """How many results of each modality a hybrid code search fuses."""
    return min(10 * limit, MOST_RESULTS)


def fulltext(chunks: DataFrame, query: str, limit: int | None = None, analyzer: Analyzer = PLAIN, text_col: str = "content", score: Column | None = None) -> DataFrame:
    """id, score of the chunks with all the query's terms, best first."""
    q = analyzer.query_terms(query)
    if not q:
        return chunks.select("id", F.lit(0.0).alias("score")).limit(0)
    # A text's terms are bound once and exploded to a score or none: a filter would extract them a second time.
    rated = F.transform(F.array(analyzer.all_terms(F.col(text_col))), lambda terms: F.when(matches_all(terms, q), score if score is not None else log_tf(terms, q)))
    found = chunks.select("id", F.explode(F.filter(rated, lambda x: x.isNotNull())).alias("score"))
    return found.orderBy(F.desc("score"), "id").limit(check_limit(limit))


def semantic(chunks: DataFrame, query: Sequence[float], limit: int | None = None, positive_only: bool = True) -> DataFrame:
    """id, score (cosine) of the chunks nearest to a vector, exact.  Unusable vectors are never found."""
    scored = chunks.where(F.col("embedding").isNotNull()).select("id", cosine(F.col("embedding"), query).alias("score")).where("score IS NOT NULL")
    if positive_only:
        scored = scored.where("score > 0")
    return scored.orderBy(F.desc("score"), "id").limit(check_limit(limit))


def ranked(results: DataFrame) -> DataFrame:
    """Bounded results with their rank from 1."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def reciprocal(ranks: DataFrame) -> DataFrame:
    return ranks.select("id", (F.lit(1.0) / (F.lit(RANK_OFFSET) + F.col("rank"))).alias("score"))


def fuse(lists: list[DataFrame], limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of ranked result lists (id, score): the first of a list adds 1/60."""
    parts = [reciprocal(ranked(x)) for x in lists]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    return every.groupBy("id").agg(F.round(F.sum("score"), 9).alias("score")).orderBy(F.desc("score"), "id").limit(check_limit(limit))


def hybrid(chunks: DataFrame, query: str, vector: Sequence[float], limit: int | None = None, analyzer: Analyzer = PLAIN, pool: int | None = None, text_col: str = "content", positive_only: bool = True) -> DataFrame:
    """Full-text and semantic results fused; pool: results of each modality, by default as for code search."""
    limit = check_limit(limit)
    pool = pool or candidates(limit)
    return fuse([semantic(chunks, vector, pool, positive_only), fulltext(chunks, query, pool, analyzer, text_col)], limit)


def with_content(results: DataFrame, chunks: DataFrame, root: str) -> DataFrame:
    """Results as clients see them: id, file_path below root, start_line, end_line, score, content."""
    shown = chunks.select("id", under_root(root, F.col("file_path")).alias("file_path"), "start_line", "end_line", "content")
    return shown.join(F.broadcast(results), "id").select("id", "file_path", "start_line", "end_line", "score", "content").orderBy(F.desc("score"), "id")


def coverage(chunks: DataFrame) -> DataFrame:
    """total, usable, pending, waiting, complete: how much of a table semantic search can see."""
    return chunks.agg(
        F.count("*").alias("total"), F.count_if(F.col("embedding").isNotNull() & (F.col("embedding_state") == "embedded")).alias("usable"),
        F.count_if(F.col("embedding_state") == "pending").alias("pending"), F.count_if(F.col("embedding").isNull() & (F.col("embedding_state") == "embedded")).alias("waiting"),
    ).withColumn("complete", F.col("pending") + F.col("waiting") == 0)
