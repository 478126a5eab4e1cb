"""Whitening of embeddings: exact integer statistics in Spark, eigenvectors by LAPACK on the driver, projection in tasks.

One aggregation sums the centred products of every pair of dimensions, the upper triangle of the covariance: generated
sums of Spark SQL, combined in each task first, so one short row a task is all that moves.  Entries are made integers and
centred on whole numbers, so sums are exact as long as they stay below 2^53, the order of rows doesn't matter, and what
the whole centres leave of the means is taken off exactly.  The driver holds the triangle and nothing that grows with
the rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

SCALE, OFFSET = 1024, 100_000
#: Entries beyond have no exact whole number of 64 bits; they count as non-finite.
MOST = float(1 << 62)
#: Up to here squares and products of 64-bit integers are safe.
_SAFE = 1 << 25


@dataclass(frozen=True)
class Statistics:
    """n vectors; the whole centre of each dimension, what n centres lack of the sum, and the centred products' sums."""

    n: int
    centres: list[int]
    rest: list[int]
    products: np.ndarray

    def covariance(self) -> np.ndarray:
        """Divisor n; each entry is the exact value's nearest double."""
        size, out = len(self.centres), np.zeros((len(self.centres),) * 2)
        for i in range(size):
            for j in range(i, size):
                out[i, j] = out[j, i] = Fraction(self.n * int(self.products[i, j]) - self.rest[i] * self.rest[j], self.n * self.n)
        return out


@dataclass(frozen=True)
class Components:
    """Unit eigenvectors in columns by falling eigenvalue, without those of no variance, and the trace."""

    vectors: np.ndarray
    values: np.ndarray
    trace: float


def _whole(vector: Column) -> Column:
    """Entries as whole numbers; null for vectors that are null or hold an entry without one."""
    sound = lambda c: F.coalesce(F.abs(c.cast("double") * SCALE) < MOST, F.lit(False)) & ~F.isnan(c.cast("double"))
    fine = vector.isNotNull() & F.forall(vector, sound)
    return F.when(fine, F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET)))


def whole_vectors(vectors: DataFrame, vector: str, keep: list[str]) -> tuple[DataFrame, int]:
    """keep and x of the vectors that can be used, and their length.

    Vectors of another length than the most frequent one (of equals, the least) can't be used, nor empty ones.
    """
    rows = vectors.select(*[F.col(c) for c in keep], _whole(F.col(vector)).alias("x")).where("x IS NOT NULL AND size(x) > 0")
    first = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    size = first["size"] if first else 0
    return rows.where(F.size("x") == size), size


def statistics(rows: DataFrame, size: int) -> Statistics:
    """Of rows with x, arrays of `size` longs; two passes, each one aggregation."""
    found = rows.agg(F.count("*").alias("n"), *[F.sum(F.col("x")[i].cast("decimal(20,0)")).alias(f"s{i}") for i in range(size)]).first()
    n = found["n"]
    if not n:
        return Statistics(0, [], [], np.zeros((0, 0)))
    sums = [int(found[f"s{i}"]) for i in range(size)]
    centres = [(2 * s + n) // (2 * n) for s in sums]
    centred = rows.select(*[(F.col("x")[i] - F.lit(m)).cast("double").alias(f"d{i}") for i, m in enumerate(centres)])
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    # As text: thousands of Column objects would take Python far longer than the sums take Spark.
    triangle = centred.selectExpr(f"array({', '.join(f'sum(d{i} * d{j})' for i, j in pairs)}) AS p").first()["p"]
    products = np.zeros((size, size))
    for (i, j), p in zip(pairs, triangle, strict=True):
        products[i, j] = products[j, i] = p
    return Statistics(n, centres, [s - n * m for s, m in zip(sums, centres, strict=True)], products)


def decompose(covariance: np.ndarray, most: int) -> Components:
    """Up to `most` components; an eigenvalue within rounding of nothing has none.  The largest entry of each is positive."""
    if not len(covariance):
        return Components(np.zeros((0, 0)), np.zeros(0), 0.0)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values[:most] > max(values[0], 0.0) * len(values) * np.finfo(float).eps).sum())
    values, vectors = values[:kept], vectors[:, :kept]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
    return Components(vectors * signs, values, float(np.trace(covariance)))


def project(rows: DataFrame, stats: Statistics, parts: Components) -> DataFrame:
    """The rows with deviation, decimal(38,0) (null beyond), and whitened, an array of a double for each component, for x."""
    kept = [c for c in rows.columns if c != "x"]
    n, size = stats.n, len(stats.centres)
    centres, rest = np.array(stats.centres, np.int64), np.array(stats.rest, object)
    left = np.array([float(Fraction(r, n)) for r in stats.rest])
    onto = parts.vectors / np.sqrt(parts.values)
    square = sum(r * r for r in stats.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(len(kept)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            d = x - centres
            # n x - S is n d - rest; its square's sum in whole numbers of any size.
            if d.size and np.abs(d).max() < _SAFE and n < 1 << 32:
                own, across = (d * d).sum(axis=1).astype(object), (d @ rest.astype(np.int64)).astype(object)
            else:
                wide = d.astype(object)
                own, across = (wide * wide).sum(axis=1), (wide * rest).sum(axis=1)
            deviation = [Decimal(v) if v < 10**38 else None for v in n * n * own - 2 * n * across + square]
            whitened = (d - left) @ onto
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1, dtype=np.int32) * onto.shape[1]), pa.array(whitened.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(deviation, pa.decimal128(38, 0)), lists], [*kept, "deviation", "whitened"])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "x"] + ["deviation decimal(38,0)", "whitened array<double>"])
    return rows.select(*kept, "x").mapInArrow(run, schema)


def identity_error(whitened: DataFrame, size: int) -> float:
    """The largest absolute entry of the covariance of whitened (an array of `size` doubles) minus the identity, over all rows."""
    w = [F.col("whitened")[i] for i in range(size)]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    found = whitened.agg(F.count("*"), *[F.avg(v) for v in w], *[F.avg(w[i] * w[j]) for i, j in pairs]).first()
    means, products = found[1 : 1 + size], found[1 + size :]
    return max(abs(p - means[i] * means[j] - (i == j)) for (i, j), p in zip(pairs, products, strict=True))


def whiten(spark: SparkSession, vectors: DataFrame, identity: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """identity, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    x is floor(1024 c) + 100000 of each entry c.  Vectors that are null, empty, hold a null, NaN, infinite or immense entry
    (1024 |c| of 2^62 or more), or differ in length from most are left out.  Components without variance aren't
    returned, as nothing can be divided by it: no rows at all where all vectors are equal.  Repeated rows and null
    identities have rows each; no vectors give no rows.  Other columns, of any name, aren't read.
    """
    ws = Workspace(spark, "whitening")
    rows, size = whole_vectors(vectors.select(F.col(identity).alias("id"), F.col(vector).alias("v")), "v", ["id"])
    stats = statistics(rows, size)
    parts = decompose(stats.covariance(), components)
    many = len(parts.values)
    kind = vectors.schema[identity].dataType.simpleString()
    if not many:
        return spark.createDataFrame([], f"`{identity}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")
    done = ws.save(project(rows, stats, parts), "projected")
    error = identity_error(done, many)
    explained = F.array(*[F.lit(float(e / parts.trace)) for e in parts.values])
    each = done.select("id", "deviation", F.posexplode("whitened").alias("at", "w"))
    return each.select(F.col("id").alias(identity), (F.col("at") + 1).alias("component"), F.lit(stats.n).cast("long").alias("n"), "deviation", F.col("w").alias("whitened"), explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
