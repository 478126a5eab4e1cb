"""Linked checkouts of a family: what each one sees, and publishing what changed in one of them.

A checkout is published in steps: its tree is scanned, files get versions, only new versions are analysed, chunked and
embedded, then its map of paths (or, of a linked checkout, the fewest deltas over the base) and its edges are written as
its next generation.  Edges are patched: resolved anew only for files that changed and names that came or went there.
The tree must still be as it was scanned, and Git's state too, before the registry names the new generation.  When the
base moves, the deltas of all other checkouts are rewritten so that none sees a change, and named in the same commit.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.embed import Backend
from ..functions.text import UNICODE
from ..sources.files import scan, scan_paths
from ..sources.store import Store
from . import graph, indexing, text_index, versions

#: Blocks of a family's postings.
BLOCKS = 64
#: Share of shared rows that nobody sees from which an epoch is worth a new one.
GARBAGE = 0.5


@dataclass(frozen=True)
class Place:
    """What a request reads: a checkout's family, epoch and generation, and the base's."""

    family_id: str
    epoch: int
    checkout_id: str
    generation: int | None
    base_id: str
    base_generation: int | None

    @property
    def is_base(self) -> bool:
        return self.checkout_id == self.base_id


class Views:
    """Tables as a checkout sees them."""

    def __init__(self, store: Store, place: Place):
        self.store, self.place = store, place

    def base(self) -> DataFrame:
        return self.store.own("base", self.place.base_id, self.place.base_generation)

    def files(self) -> DataFrame:
        """path, version."""
        if self.place.is_base:
            return self.base()
        return versions.visible(self.base(), self.store.own("deltas", self.place.checkout_id, self.place.generation))

    def shared(self, table: str) -> DataFrame:
        return self.store.shared(table, self.place.family_id, self.place.epoch)

    def chunks(self) -> DataFrame:
        """Visible chunks, with vectors that came later."""
        return with_late_vectors(versions.masked_chunks(self.shared("chunks"), self.files()), self.shared("late_vectors"))

    def reusable(self) -> DataFrame:
        """The family's chunks with vectors, whoever sees them."""
        return with_late_vectors(self.shared("chunks"), self.shared("late_vectors"))

    def symbols(self) -> DataFrame:
        """chunk_id, name, kind, file_path, start_line, end_line."""
        return nodes_of(self.shared("analyses").join(self.files().select("version"), "version", "left_semi"))

    def edges(self) -> DataFrame:
        return graph.distinct_edges(self.store.own("edges", self.place.checkout_id, self.place.generation))

    def fulltext(self, query: str, limit: int | None = None) -> DataFrame:
        """id, score by the written postings; masked before the cut."""
        ids = versions.masked_chunks(self.shared("chunks").select("id", "file_version"), self.files()).select("id")
        return text_index.best(text_index.matches(self.shared("postings"), query, UNICODE), limit, ids)


def nodes_of(analyses: DataFrame) -> DataFrame:
    return analyses.select(F.col("path").alias("file_path"), F.explode("nodes").alias("x")).select("x.chunk_id", "x.name", "x.kind", "file_path", "x.start_line", "x.end_line").distinct()


def candidates_of(analyses: DataFrame) -> DataFrame:
    return analyses.select(F.col("path").alias("file_path"), F.explode("candidates").alias("x")).select("x.src", "file_path", "x.to_name", "x.relation")


def with_late_vectors(chunks: DataFrame, late: DataFrame) -> DataFrame:
    """Pending chunks get the vector that was made for their content since."""
    made = late.groupBy("content_hash").agg(F.first("embedding").alias("late"))
    out = chunks.join(made, "content_hash", "left")
    use = (F.col("embedding_state") == "pending") & F.col("late").isNotNull()
    return out.withColumns({"embedding": F.when(use, F.col("late")).otherwise(F.col("embedding")), "embedding_state": F.when(use, "embedded").otherwise(F.col("embedding_state"))}).drop("late").select(*chunks.columns)


class Moved(RuntimeError):
    """The tree changed while it was indexed."""


def scanned(spark, root: str, rules: dict[str, Any], views: Views, changed: list[str] | None) -> DataFrame:
    """path, source, size, content_hash, tier: the whole tree, or what is known with the changed paths read again."""
    if changed is None:
        return scan(spark, root, rules["exclude"], rules["vendor"])
    fresh = scan_paths(spark, root, changed, rules["exclude"], rules["vendor"])
    given = spark.createDataFrame([(p,) for p in changed], "path string")
    seen = views.files().join(given, "path", "left_anti").join(views.shared("versions").select(F.col("id").alias("version"), "content_hash", "tier", "source").dropDuplicates(["version"]), "version")
    return seen.select("path", "source", F.octet_length("source").cast("long").alias("size"), "content_hash", "tier").unionByName(fresh)


def publish(store: Store, place: Place, root: str, rules: dict[str, Any], backend: Backend, batch: int, generation: int, others: list[Place], changed: list[str] | None = None, count: Accumulator | None = None) -> dict[str, Any]:
    """Writes the next generation of a checkout and returns what the registry must name.

    generations: of each checkout to move (this one, and of a base the others too); files, chunks, new_files, problems.
    Moved if the tree was another one at the end.  changed: paths to look at; None for all.
    """
    spark, views, family = store.spark, Views(store, place), place.family_id
    held = []

    def hold(df: DataFrame) -> DataFrame:
        held.append(df.persist())
        return df

    try:
        files = hold(scanned(spark, root, rules, views, changed))
        assigned = hold(versions.assign_versions(files, views.shared("versions")))
        desired = assigned.select("path", "version")
        known = views.shared("analyses").where(F.col("revision") == indexing.REVISION).select("version").distinct()
        todo = hold(assigned.join(known, "version", "left_anti").select("version", "path", "tier", "source", "content_hash"))
        difference = hold(versions.minimal_deltas(views.files(), desired))
        new_files = todo.count()
        if place.generation is not None and not new_files and difference.isEmpty():
            _same(spark, root, rules, assigned, changed)
            return {"generations": {}, "files": assigned.count(), "new_files": 0, "chunks": versions.masked_chunks(views.shared("chunks").select("file_version"), desired).count(), "problems": []}
        problems: list[dict[str, Any]] = []
        if new_files:
            problems = _add_versions(store, place, views, todo, assigned, backend, batch, count, hold)
        news = {place.checkout_id: generation}
        if place.is_base:
            store.overwrite("base", desired, place.checkout_id, generation)
            after = replace(place, generation=generation, base_generation=generation)
            news |= _carried(store, views, Views(store, after).base(), others, generation)
        else:
            store.overwrite("deltas", versions.minimal_deltas(views.base(), desired), place.checkout_id, generation)
            after = replace(place, generation=generation)
        store.overwrite("edges", _edges(views, Views(store, after), hold(difference.select(F.col("path").alias("file_path")).union(todo.select("path")).distinct()), hold), place.checkout_id, generation)
        _same(spark, root, rules, assigned, changed)
        shown = versions.masked_chunks(store.shared("chunks", family, place.epoch).select("file_version"), desired).count()
        return {"generations": news, "files": assigned.count(), "new_files": new_files, "chunks": shown, "problems": problems}
    finally:
        for df in held:
            df.unpersist()


def _add_versions(store: Store, place: Place, views: Views, todo: DataFrame, assigned: DataFrame, backend: Backend, batch: int, count: Accumulator | None, hold) -> list[dict[str, Any]]:
    """Analyses, chunks and embeds files (version, path, tier, source) and adds them to the family's shared tables.

    Nobody sees a version before a map names it.  A run that stops between two tables is made whole by the next one:
    versions come last, and rows of an id that is there already aren't added (postings may be there twice; see matches).
    """
    family, epoch = place.family_id, place.epoch
    analysis = hold(indexing.analysed(todo, count=count))
    ready = hold(indexing.prepared(versions.reusable_embeddings(indexing.chunk_rows(analysis), views.reusable()), backend, batch))
    fresh = ready.join(views.shared("chunks").select("id"), "id", "left_anti")
    store.append("postings", text_index.clustered(text_index.postings(fresh.select("id", "content"), BLOCKS, UNICODE)), family, epoch)
    store.append("chunks", fresh, family, epoch)
    nodes = graph.link_chunks(ready, indexing.symbol_rows(analysis))
    store.append("analyses", _per_file(analysis, nodes, indexing.linked_candidates(indexing.candidate_rows(analysis), ready)), family, epoch)
    new = assigned.where("is_new").select(F.col("version").alias("id"), "path", "content_hash", F.col("tier").cast("short").alias("tier"), "source")
    store.append("versions", new, family, epoch)
    return [r.asDict() for r in analysis.where("problem IS NOT NULL").select("path", "problem").orderBy("path").limit(100).collect()]


def _same(spark, root: str, rules: dict[str, Any], assigned: DataFrame, changed: list[str] | None) -> None:
    """Moved if what was scanned is no longer what is there."""
    seen = assigned.select("path", "content_hash")
    if changed is None:
        again = scan(spark, root, rules["exclude"], rules["vendor"]).select("path", "content_hash")
    else:
        again = scan_paths(spark, root, changed, rules["exclude"], rules["vendor"]).select("path", "content_hash")
        seen = seen.join(spark.createDataFrame([(p,) for p in changed], "path string"), "path", "left_semi")
    again = again.persist()
    if not seen.exceptAll(again).isEmpty() or not again.exceptAll(seen).isEmpty():
        raise Moved(root)
    again.unpersist()


def _per_file(analysis: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of table analyses: nodes and candidates of each version, by their chunks."""
    n = nodes.groupBy(F.col("file_path").alias("path")).agg(F.collect_list(F.struct("chunk_id", "name", "kind", "start_line", "end_line")).alias("nodes"))
    c = candidates.distinct().groupBy(F.col("file_path").alias("path")).agg(F.collect_list(F.struct("src", "to_name", "relation")).alias("candidates"))
    return analysis.select("version", F.lit(indexing.REVISION).alias("revision"), "path", "problem").join(n, "path", "left").join(c, "path", "left")


def _edges(before: Views, after: Views, paths: DataFrame, hold) -> DataFrame:
    """The checkout's edges after files (file_path) changed: those of its last generation, patched, or all resolved at first."""
    stored = after.shared("analyses").where(F.col("revision") == indexing.REVISION).join(after.files().select("version"), "version", "left_semi")
    symbols, candidates = hold(nodes_of(stored)), candidates_of(stored)
    if before.place.generation is None:
        return graph.resolved(candidates, symbols)
    names = hold(before.symbols().union(symbols).join(paths, "file_path", "left_semi").select("name").distinct())
    kept = before.store.own("edges", before.place.checkout_id, before.place.generation)
    return graph.patched(kept, candidates, symbols, paths, names)


def _carried(store: Store, views: Views, desired: DataFrame, others: list[Place], generation: int) -> dict[str, int]:
    """New deltas and the same edges for every other checkout, over a base that moves to `desired`."""
    out = {}
    base = views.base()
    for other in others:
        if other.generation is None:
            continue
        ids = store.spark.createDataFrame([(other.checkout_id,)], "checkout_id string")
        own = store.own("deltas", other.checkout_id, other.generation).withColumn("checkout_id", F.lit(other.checkout_id))
        store.overwrite("deltas", versions.move_base(base, desired, own, ids), other.checkout_id, generation)
        store.overwrite("edges", store.own("edges", other.checkout_id, other.generation), other.checkout_id, generation)
        out[other.checkout_id] = generation
    return out


def garbage(store: Store, places: list[Place]) -> tuple[int, int]:
    """(versions that no checkout sees, all versions) of a family."""
    every = store.shared("versions", places[0].family_id, places[0].epoch).select("id").distinct()
    return versions.unreferenced(every, *_named(store, places)).count(), every.count()


def _named(store: Store, places: list[Place]) -> tuple[DataFrame, DataFrame]:
    base = store.own("base", places[0].base_id, places[0].base_generation)
    deltas = store.own("deltas", "", None)
    for p in places:
        if not p.is_base and p.generation is not None:
            deltas = deltas.unionByName(store.own("deltas", p.checkout_id, p.generation))
    return base, deltas.where("version IS NOT NULL")


def collect_garbage(store: Store, places: list[Place]) -> int:
    """Writes what the checkouts still see as the family's next epoch, and returns that; the registry must name it."""
    family, epoch = places[0].family_id, places[0].epoch
    base, deltas = _named(store, places)
    seen = base.select("version").unionByName(deltas.select("version")).distinct()
    read = lambda table: store.shared(table, family, epoch)
    store.drop_shared(family, epoch + 1)  # of a run that stopped
    late = read("late_vectors")
    kept = with_late_vectors(read("chunks").join(seen.withColumnRenamed("version", "file_version"), "file_version", "left_semi"), late)
    store.append("versions", read("versions").join(seen.withColumnRenamed("version", "id"), "id", "left_semi"), family, epoch + 1)
    store.append("analyses", read("analyses").where(F.col("revision") == indexing.REVISION).join(seen, "version", "left_semi"), family, epoch + 1)
    store.append("chunks", kept, family, epoch + 1)
    store.append("postings", text_index.clustered(text_index.postings(kept.select("id", "content"), BLOCKS, UNICODE)), family, epoch + 1)
    return epoch + 1


def backfill(store: Store, family_id: str, epoch: int, backend: Backend, limit: int = indexing.BACKFILL) -> int:
    """Embeds one batch of distinct contents that wait for a vector; returns how many got one."""
    rows = with_late_vectors(store.shared("chunks", family_id, epoch), store.shared("late_vectors", family_id, epoch))
    made = indexing.embedded_groups(rows, backend, limit).persist()
    try:
        got = made.count()
        if got:
            store.append("late_vectors", made, family_id, epoch)
        return got
    finally:
        made.unpersist()
