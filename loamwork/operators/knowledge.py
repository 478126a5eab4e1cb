"""Notes: upsert, delete, list and search.  A note's text is its title and body."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import PLAIN, Analyzer
from . import search


def note_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("body", F.lit("")))


def embedding_text() -> Column:
    return F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.coalesce("body", F.lit("")))


def _scoped(notes: DataFrame, repo_path: str | None) -> DataFrame:
    return notes if repo_path is None else notes.where(F.col("repo_path") == repo_path)


def upsert(notes: DataFrame, new: DataFrame) -> DataFrame:
    """New notes replace those of the same id; the time of creation of a known note stays."""
    born = notes.select("id", F.col("created_at").alias("born"))
    fresh = new.join(born, "id", "left").withColumn("created_at", F.coalesce("born", "created_at")).select(*notes.columns)
    return notes.join(new.select("id"), "id", "left_anti").unionByName(fresh)


def delete(notes: DataFrame, ids: DataFrame) -> DataFrame:
    return notes.join(ids.select("id"), "id", "left_anti")


def listed(notes: DataFrame, repo_path: str | None = None, limit: int | None = None) -> DataFrame:
    """Latest first."""
    return _scoped(notes, repo_path).orderBy(F.desc("updated_at"), "id").limit(search.check_limit(limit))


def fulltext(notes: DataFrame, query: str, repo_path: str | None = None, limit: int | None = None, analyzer: Analyzer = PLAIN) -> DataFrame:
    return search.fulltext(_scoped(notes, repo_path).select("id", note_text().alias("content")), query, limit, analyzer)


def semantic(notes: DataFrame, vector: Sequence[float], repo_path: str | None = None, limit: int | None = None) -> DataFrame:
    """Nearest notes; far ones too, unlike chunks."""
    return search.semantic(_scoped(notes, repo_path), vector, limit, positive_only=False)


def hybrid(notes: DataFrame, query: str, vector: Sequence[float], repo_path: str | None = None, limit: int | None = None, analyzer: Analyzer = PLAIN) -> DataFrame:
    """Both fused, from twice the limit of each."""
    limit = search.check_limit(limit)
    pool = min(2 * limit, search.MOST_RESULTS)
    return search.fuse([semantic(notes, vector, repo_path, pool), fulltext(notes, query, repo_path, pool, analyzer)], limit)
