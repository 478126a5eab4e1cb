"""A written index for vector search: inverted cells by k-means, residual codes of a byte a dimension, exact rescoring.

Two Parquet tables lie in the index's folder.  `cells` has a row a cell: its centroid, the widest angle between it and a
member, and how many members there are.  `entries` is clustered by cell, so that a search reads the row groups of the
cells it visits; of those it scores the codes first and reads whole vectors for the few that are left.

A search visits the nearest cells only and may miss results; `exact` then goes on to every cell that may still hold a
better one, by the widest angle, and so gives what a scan gives.  Masks come before any cut, so hidden rows never push
visible ones out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vector import dot, usable
from ..sources.shared import shared_folder

#: Rows that centroids are fitted on, for each cell; all rows are indexed.
FIT_PER_CELL, MOST_CELLS = 256, 4096
#: Rows asked for, results of each, and share of them found, by which the number of cells to visit is chosen.
TUNED_ROWS, TUNED_LIMIT, TUNED_RECALL = 200, 10, 0.97
#: Candidates by code of a cell that may be scored exactly, for each result asked for.
SHORTLIST = 4
#: Entries and queries that one group scores, and how many groups small cells are put together to (of LEAST_BUNDLE entries at least).
GROUP_ENTRIES, GROUP_QUERIES = 1 << 15, 1 << 10
GROUPS, LEAST_BUNDLE = 64, 256
#: Rows fitted, queries whose cells are chosen, and scores held at once.
FITTED_AT_ONCE, ASKED_AT_ONCE, SCORES_AT_ONCE = 1024, 512, 1 << 22
_ENTRY = "cell int, id {kind}, low float, step float, code binary, embedding array<float>"
#: What rounding of angles and of scores to six digits can move.
_SLACK = 2e-6


@dataclass(frozen=True)
class VectorIndex:
    """A written index.  The centroids (at most MOST_CELLS of them) are on the driver."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    radii: np.ndarray
    members: np.ndarray
    probes: int = 8  # cells that a search visits

    def entries(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/entries")


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _assigned(centroids: np.ndarray):
    """Of batches (id, embedding): cell, id, the code of what a unit vector has beyond its centroid, embedding, angle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column(1), centroids.shape[1]))
            near = unit @ centroids.T
            cell = near.argmax(axis=1)
            angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
            beyond = unit - centroids[cell]
            low, high = beyond.min(axis=1), beyond.max(axis=1)
            step = np.maximum((high - low) / 255, 1e-12)
            codes = np.rint((beyond - low[:, None]) / step[:, None]).astype(np.uint8)
            offsets = pa.py_buffer(np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1])
            code = pa.Array.from_buffers(pa.binary(), len(codes), [None, offsets, pa.py_buffer(codes.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column(0), pa.array(low.astype(np.float32)), pa.array(step.astype(np.float32)), code, batch.column(1), pa.array(angle)], ["cell", "id", "low", "step", "code", "embedding", "angle"])

    return run


def _sums(centroids: np.ndarray):
    """Of batches (embedding): a row a cell with the task's number and the sum of the unit vectors nearest to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, found = np.zeros_like(centroids), np.zeros(len(centroids), bool)
        for batch in (b.slice(k, FITTED_AT_ONCE) for b in batches for k in range(0, b.num_rows, FITTED_AT_ONCE)):
            unit = _unit(_matrix(batch.column(0), centroids.shape[1]))
            cell = (unit @ centroids.T).argmax(axis=1)
            order = np.argsort(cell, kind="stable")
            own, first = np.unique(cell[order], return_index=True)
            sums[own] += np.add.reduceat(unit[order], first)
            found[own] = True
        own = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(np.full(len(own), TaskContext.get().partitionId(), np.int32)), pa.array(list(sums[own]), pa.list_(pa.float64()))], ["cell", "task", "sum"])

    return run


def _fit(vectors: DataFrame, cells: int, seed: int, rounds: int) -> np.ndarray:
    """Unit centroids of a bounded sample by spherical k-means, from rows by the hash of their id."""
    spark, rows = vectors.sparkSession, vectors.count()
    share = min(1.0, 1.2 * FIT_PER_CELL * cells / max(rows, 1))
    sample = (vectors.sample(share, seed) if share < 1 else vectors).repartition(spark.sparkContext.defaultParallelism, "id").persist()
    first = sample.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(2 * cells).select("embedding").collect()  # at most 2 * MOST_CELLS rows
    unit = _unit(np.array([r["embedding"] for r in first], np.float64))
    centroids = unit[np.sort(np.unique(np.round(unit, 9), axis=0, return_index=True)[1])[:cells]]
    for _ in range(rounds):
        tasks = sample.select("embedding").mapInArrow(_sums(centroids), "cell int, task int, sum array<double>")
        total = F.aggregate(F.array_sort(F.collect_list(F.struct("task", "sum"))), F.array_repeat(F.lit(0.0), centroids.shape[1]), lambda a, x: F.zip_with(a, x["sum"], lambda y, z: y + z))
        moved = tasks.groupBy("cell").agg(total.alias("sum")).collect()  # at most MOST_CELLS rows
        for r in moved:
            if any(r["sum"]):
                centroids[r["cell"]] = _unit(np.array([r["sum"]]))[0]
    sample.unpersist()
    return centroids


def build(vectors: DataFrame, path: str, cells: int | None = None, dim: int | None = None, seed: int = 7, rounds: int = 8, tune: bool = True) -> VectorIndex:
    """Writes an index of vectors (id, embedding) to a new folder and returns it.

    cells: by default the square root of the rows, at most MOST_CELLS.  Vectors that are null, zero, not finite or, of
    another length than the most frequent one (or dim) can't be found and aren't indexed.  ValueError without any vector.
    tune: chooses how many cells a search visits, which exact searches don't need.
    """
    spark = vectors.sparkSession
    fine = vectors.where(usable(F.col("embedding"), dim)).select("id", "embedding")
    if dim is None:
        first = fine.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
        if first is None:
            raise ValueError("there is no vector to index")
        dim = first["dim"]
        fine = fine.where(F.size("embedding") == dim)
    rows = fine.count()
    if not rows:
        raise ValueError("there is no vector to index")
    cells = max(1, min(MOST_CELLS, rows, cells or math.isqrt(rows)))
    centroids = _fit(fine, cells, seed, rounds) if cells > 1 else _unit(np.ones((1, dim)))
    index = add(VectorIndex(spark, path, centroids, np.zeros(len(centroids)), np.zeros(len(centroids), np.int64)), fine)
    if len(centroids) == 1 or not tune:
        return _saved(index)
    share = min(1.0, TUNED_ROWS / rows)
    sample = fine.sample(share, seed).limit(TUNED_ROWS) if share < 1 else fine
    return _saved(replace(index, probes=_tuned(index, sample.select(F.col("id").alias("query"), "embedding"))))


def _tuned(index: VectorIndex, queries: DataFrame) -> int:
    """The fewest cells that give TUNED_RECALL of the nearest TUNED_LIMIT of a bounded sample of queries."""
    queries = queries.persist()
    true = search(index, queries, TUNED_LIMIT, exact=True).join(index.entries().select("id", "cell"), "id")
    found = true.join(queries, "query").select("embedding", "cell").collect()
    queries.unpersist()
    if not found:
        return index.probes
    near = _unit(np.array([r["embedding"] for r in found], np.float64)) @ index.centroids.T
    own = near[np.arange(len(found)), [r["cell"] for r in found]]
    ranks = np.sort((near > own[:, None]).sum(axis=1)) + 1
    return int(ranks[min(len(ranks) - 1, math.ceil(TUNED_RECALL * len(ranks)))])


def add(index: VectorIndex, vectors: DataFrame) -> VectorIndex:
    """The index with more rows (id, embedding) in the cells it has.  An id that is there already is there twice."""
    kind = vectors.schema["id"].dataType.simpleString()
    fine = vectors.where(usable(F.col("embedding"), index.centroids.shape[1])).select("id", "embedding")
    entries = fine.mapInArrow(_assigned(index.centroids), _ENTRY.format(kind=kind) + ", angle double")
    # A range of cells a task; a cell of many rows is spread over several by its ids.
    entries.repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.mode("append").parquet(f"{index.path}/entries")
    found = index.spark.read.parquet(f"{index.path}/entries").groupBy("cell").agg(F.max("angle").alias("angle"), F.count("*").alias("n")).collect()
    radii, members = np.zeros(len(index.centroids)), np.zeros(len(index.centroids), np.int64)
    for r in found:
        radii[r["cell"]], members[r["cell"]] = r["angle"], r["n"]
    return _saved(replace(index, radii=radii, members=members))


def _saved(index: VectorIndex) -> VectorIndex:
    rows = [(k, [float(x) for x in c], float(index.radii[k]), int(index.members[k]), index.probes) for k, c in enumerate(index.centroids)]
    index.spark.createDataFrame(rows, "cell int, centroid array<double>, radius double, members long, probes int").coalesce(1).write.mode("overwrite").parquet(f"{index.path}/cells")
    return index


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """The index in a folder."""
    rows = spark.read.parquet(f"{path}/cells").orderBy("cell").collect()
    return VectorIndex(spark, path, np.array([r["centroid"] for r in rows]), np.array([r["radius"] for r in rows]), np.array([r["members"] for r in rows]), rows[0]["probes"])


def _bundles(members: np.ndarray) -> np.ndarray:
    """The bundle of each cell: neighbouring cells scored in one group, of some GROUPS-th of all entries; a larger cell is one alone."""
    most = min(GROUP_ENTRIES, max(LEAST_BUNDLE, int(members.sum()) // GROUPS))
    out, held = np.zeros(len(members), np.int32), 0
    for cell in range(1, len(members)):
        held += int(members[cell - 1])
        full = held > 0 and held + int(members[cell]) > most
        out[cell] = out[cell - 1] + full
        held = 0 if full else held
    return out


def _asks(batch: pa.RecordBatch, row: np.ndarray, cell: np.ndarray, bundles: np.ndarray) -> pa.RecordBatch:
    """Of a batch (query, embedding, least) and pairs sorted by row and cell: query, embedding, least, bundle, cells."""
    bundle = bundles[cell]
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (bundle[1:] != bundle[:-1])][: len(row)])
    at, ends = pa.array(row[first]), pa.array(np.r_[first, len(row)].astype(np.int32))
    cells = pa.ListArray.from_arrays(ends, pa.array(cell.astype(np.int32)))
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(3)), pa.array(bundle[first]), cells], ["query", "embedding", "least", "bundle", "cells"])


def _wanted(index: VectorIndex, probes: int):
    """Of batches (query, embedding, least): what is asked of each bundle, for the nearest cells."""
    centroids, bundles = index.centroids, _bundles(index.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ASKED_AT_ONCE) for b in batches for k in range(0, b.num_rows, ASKED_AT_ONCE)):
            near = _unit(_matrix(batch.column(1), centroids.shape[1])) @ centroids.T
            most = min(probes, near.shape[1])
            cells = np.sort(np.argpartition(-near, most - 1, axis=1)[:, :most], axis=1)
            yield _asks(batch, np.repeat(np.arange(len(near)), most), cells.ravel(), bundles)

    return run


def _left(index: VectorIndex):
    """Of batches (query, embedding, least): what is asked of each bundle, for all cells that may hold a score of least."""
    centroids, radii, members, bundles = index.centroids, index.radii, index.members, _bundles(index.members)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, ASKED_AT_ONCE) for b in batches for k in range(0, b.num_rows, ASKED_AT_ONCE)):
            angle = np.arccos(np.clip(_unit(_matrix(batch.column(1), centroids.shape[1])) @ centroids.T, -1, 1))
            bound = np.cos(np.maximum(angle - radii, 0))
            yield _asks(batch, *np.nonzero((bound >= batch.column(2).to_numpy()[:, None] - _SLACK) & (members > 0)), bundles)

    return run


def _best(centroids: np.ndarray, limit: int, by_code: bool):
    """Cogrouped queries and entries of a bundle: query, id and the bounds of the score, for what may be among a query's best.

    What can't reach `least`, or is below `limit` others here, is left out; of a cell, the best few by score, then id, stay.
    """
    keep = limit * SHORTLIST if by_code else limit

    def run(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(entries):
            return pd.DataFrame({"query": queries["query"][:0], "id": entries["id"][:0], "low": [], "high": []})
        entries = entries.sort_values(["cell", "id"])  # so ties of a cell go by position
        own, start, cell = np.unique(entries["cell"].to_numpy(), return_index=True, return_inverse=True)
        dim, off = centroids.shape[1], np.zeros(len(entries))
        if by_code:
            codes, step = np.frombuffer(b"".join(entries["code"]), np.uint8).reshape(-1, dim), entries["step"].to_numpy(np.float64)
            have = codes * step[:, None] + entries["low"].to_numpy(np.float64)[:, None] + centroids[own][cell]
            # Each entry is at most half a step off, and so its angle and its score by as much as here.
            off = np.arcsin(np.minimum(math.sqrt(dim) * (step / 2 + 1e-7), 1)) + 2 * (math.sqrt(dim) * (step / 2 + 1e-7) > 1)
        else:
            have = np.stack(entries["embedding"].to_numpy()).astype(np.float64)
        have, asking = _unit(have), _unit(np.stack(queries["embedding"].to_numpy()).astype(np.float64))
        asked = np.zeros((len(queries), len(own)), bool)
        flat = np.concatenate(queries["cells"].to_numpy())
        at, there = np.searchsorted(own, flat), np.isin(flat, own)
        asked[np.repeat(np.arange(len(queries)), queries["cells"].map(len))[there], at[there]] = True
        least, rows, columns, found = queries["least"].to_numpy(np.float64), [], [], []
        step = max(1, SCORES_AT_ONCE // len(entries))
        for first in range(0, len(queries), step):
            some = slice(first, first + step)
            scores = np.full((len(asking[some]), len(entries)), -np.inf)
            for k, (a, b) in enumerate(zip(start, [*start[1:], len(entries)])):
                who = np.flatnonzero(asked[some, k])
                scores[who, a:b] = asking[some][who] @ have[a:b].T
            fine = scores + off >= least[some, None] - _SLACK
            many = np.flatnonzero(fine.sum(axis=1) > keep)
            if len(many):
                nth = np.partition(scores[many] - off, len(entries) - limit, axis=1)[:, len(entries) - limit]
                fine[many] &= scores[many] + off >= nth[:, None] - _SLACK
            row, column = np.nonzero(fine)
            score = scores[row, column]
            order = np.lexsort((column, -(score if by_code else np.round(score, 6)), cell[column], row))
            row, column, score = row[order], column[order], score[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (cell[column[1:]] != cell[column[:-1]])][: len(row)]
            kept = np.arange(len(row)) - np.maximum.accumulate(np.where(new, np.arange(len(row)), 0)) < keep
            rows.append(first + row[kept]), columns.append(column[kept]), found.append(score[kept])
        row, column, score = np.concatenate(rows), np.concatenate(columns), np.concatenate(found)
        return pd.DataFrame({"query": queries["query"].to_numpy()[row], "id": entries["id"].to_numpy()[column], "low": score - off[column], "high": score + off[column]})

    return run


def _candidates(index: VectorIndex, wanted: DataFrame, entries: DataFrame, limit: int, by_code: bool) -> DataFrame:
    """query, id: what may be among the best of the cells wanted (see _asks); large cells are split both ways."""
    kinds = f"query {wanted.schema['query'].dataType.simpleString()}, id {entries.schema['id'].dataType.simpleString()}, low double, high double"
    bundles, asks, large = _bundles(index.members), {}, {}
    for cell, n in enumerate(index.members):
        large[int(bundles[cell])] = large.get(int(bundles[cell]), 0) + int(n)
    cells = wanted.select("bundle", F.posexplode("cells").alias("pos", "cell")).groupBy("cell").agg(F.count(F.when(F.col("pos") == 0, 1)).alias("n")).collect()  # at most MOST_CELLS rows
    for r in cells:
        asks[int(bundles[r["cell"]])] = asks.get(int(bundles[r["cell"]]), 0) + r["n"]
    parts = [[b, max(1, -(-large[b] // GROUP_ENTRIES)), max(1, -(-n // GROUP_QUERIES))] for b, n in sorted(asks.items())]
    split = F.broadcast(index.spark.createDataFrame(parts, "bundle int, parts int, blocks int"))
    of = F.broadcast(index.spark.createDataFrame([(r["cell"], int(bundles[r["cell"]])) for r in cells], "cell int, bundle int"))
    fields = ["code", "low", "step"] if by_code else ["embedding"]
    own = entries.where(F.col("cell").isin([r["cell"] for r in cells])).select("cell", "id", *fields).join(of, "cell").join(split, "bundle")
    own = own.withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = wanted.join(split, "bundle").withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    keys = ["bundle", "part", "block"]
    found = asked.select(*keys, "query", "embedding", "least", "cells").groupBy(*keys).cogroup(own.select(*keys, "cell", "id", *fields).groupBy(*keys)).applyInPandas(_best(index.centroids, limit, by_code), kinds)
    # Over all bundles: what is surely below `limit` others of the query needn't be scored again.
    by = Window.partitionBy("query")
    nth = found.withColumn("rank", F.row_number().over(by.orderBy(F.desc("low")))).withColumn("nth", F.max(F.when(F.col("rank") == limit, F.col("low"))).over(by))
    return nth.where(F.col("nth").isNull() | (F.col("high") >= F.col("nth") - _SLACK)).select("query", "id")


def _rescored(found: DataFrame, queries: DataFrame, entries: DataFrame, limit: int, positive_only: bool) -> DataFrame:
    """query, id, score: candidates (query, id) by their exact cosine."""
    pairs = found.distinct().join(entries.select("id", F.col("embedding").alias("v")), "id").join(queries.select("query", F.col("embedding").alias("q")), "query")
    value = dot(F.col("v"), F.col("q")) / (F.sqrt(dot(F.col("v"), F.col("v"))) * F.sqrt(dot(F.col("q"), F.col("q"))))
    scored = pairs.select("query", "id", F.round(value, 6).alias("score"))
    if positive_only:
        scored = scored.where("score > 0")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "id", "score")


def stored(found: DataFrame) -> DataFrame:
    """The same rows, written once to the session's shared folder."""
    path = shared_folder(found.sparkSession, "vector-search")
    found.write.parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path)


def search(index: VectorIndex, queries: DataFrame, limit: int = 10, probes: int | None = None, visible: DataFrame | None = None, exact: bool = False, positive_only: bool = True, near: DataFrame | None = None) -> DataFrame:
    """query, rank, id, score: the nearest rows to each of the queries (query, embedding), by cosine to six digits, then id.

    visible: ids that may be found, all if None.  exact: as a scan would find; else of the `probes` nearest cells (by default as many as the index was tuned to).
    near: for an exact search, what the same search finds without `exact`, if it is at hand (stored); else it is searched and stored first.
    Queries that are null, zero, not finite or of another length find nothing.
    """
    kind = queries.schema["query"].dataType.simpleString()
    fine = queries.where(usable(F.col("embedding"), index.centroids.shape[1])).select("query", "embedding")
    entries = index.entries()
    if visible is not None:
        entries = entries.join(visible.select("id"), "id", "left_semi")
    schema = f"query {kind}, embedding array<float>, least double, bundle int, cells array<int>"
    asking = fine.select("query", F.col("embedding").cast("array<float>").alias("embedding"))
    lowest = F.lit(0.0 if positive_only else -2.0)
    if not exact or near is None:
        wanted = asking.withColumn("least", lowest).mapInArrow(_wanted(index, probes or index.probes), schema)
        found = _rescored(_candidates(index, wanted, entries, limit, True), fine, entries, limit, positive_only)
        if not exact:
            return found
        near = stored(found)
    least = near.where(F.col("rank") == limit).select("query", F.col("score").alias("least"))
    rest = asking.join(least, "query", "left").select("query", "embedding", F.coalesce("least", lowest).alias("least"))
    return _rescored(_candidates(index, rest.mapInArrow(_left(index), schema), entries, limit, False), fine, entries, limit, positive_only)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found, wanted, recall: how many of the truth's (query, id) are found."""
    hit = truth.select("query", "id").join(found.select("query", "id").withColumn("hit", F.lit(1)), ["query", "id"], "left")
    return hit.agg(F.count("hit").alias("found"), F.count("*").alias("wanted")).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 6))
