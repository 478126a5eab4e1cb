"""Packing documents into training sequences along a space-filling curve.

Each document's hashed bag of token ids is projected to a few dimensions by fixed random signs.  Each dimension
is scaled by the corpus' mean and deviation through the normal distribution, so cells are about equally full,
and the cell's place on the Hilbert curve is the sort key: neighbours on the curve hold similar documents.  The
documents' ids in curve order form one stream, cut every `length` ids.  Only small rows (key, size) are sorted;
a document's place in the stream then cuts its own ids, so copies of one key spread over any number of tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .units import column_slices, encoder, with_end

HASHED, DIMENSIONS, BITS = 512, 4, 12
#: Documents whose bags are held at a time.
DOCS_AT_ONCE = 1024
_SIGNS = np.random.default_rng(20_240_613).choice([-1.0, 1.0], (HASHED, DIMENSIONS)) / sqrt(HASHED)


def project(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Each document's place: its unit-length hashed bag of ids under the fixed signs (zero for no ids)."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 9)).astype(np.int64)
    out, starts = np.zeros((len(ends), DIMENSIONS)), np.append(0, ends[:-1])
    for a in range(0, len(ends), DOCS_AT_ONCE):
        b = min(len(ends), a + DOCS_AT_ONCE)
        own = bucket[starts[a] : ends[b - 1]] + np.repeat(np.arange(b - a) * HASHED, ends[a:b] - starts[a:b])
        bags = np.sqrt(np.bincount(own, minlength=(b - a) * HASHED).reshape(b - a, HASHED))
        out[a:b] = bags @ _SIGNS / np.maximum(np.linalg.norm(bags, axis=1, keepdims=True), 1e-12)
    return out


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of cells (rows of whole numbers below 2**bits), as unsigned numbers.

    Skilling's transform: undo the excess rotations from the highest bit down, then Gray-decode and interleave.
    """
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    q = np.uint64(1 << (bits - 1))
    one = np.uint64(1)
    while q > one:
        p = q - one
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(on, p, swap)
            x[i] ^= swap
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
        q >>= one
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << one | (x[i] >> np.uint64(b) & one)
    return key


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, True)
        for batch in batches:
            for a, b in column_slices(batch.column(1)):
                flat, ends = with_end(*enc.ids(batch.column(1).slice(a, b - a)), end_id)
                at = project(flat, ends)
                size = enc.dtype.itemsize
                bounds = pa.py_buffer((np.append(0, ends) * size).astype(np.int32))
                ids = pa.Array.from_buffers(pa.binary(), len(ends), [None, bounds, pa.py_buffer(flat)])
                ties = [zlib.crc32(flat[x:y]) for x, y in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(np.diff(ends, prepend=0)), ids, pa.array(ties, pa.int64()), *[pa.array(at[:, k]) for k in range(DIMENSIONS)]],
                    ["doc_id", "doc_tokens", "ids", "tie", *[f"p{k}" for k in range(DIMENSIONS)]],
                )

    return run


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    """Logistic approximation; any increasing map to (0, 1) will do."""
    return 1 / (1 + np.exp(-1.702 * x))


def _keys(means: list[float], deviations: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.column_stack([batch.column(f"p{k}").to_numpy(zero_copy_only=False) for k in range(DIMENSIONS)])
            cells = np.minimum((_normal_cdf((at - means) / deviations) * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_tokens"), batch.column("tie"), pa.array(hilbert_keys(cells, BITS).astype(np.int64))], ["row", "doc_tokens", "tie", "curve"])

    return run


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, before = TaskContext.get().partitionId(), 0
    for batch in batches:
        size = batch.column("doc_tokens").to_numpy()
        ends = before + np.cumsum(size)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.full(len(size), part, np.int64)), pa.array(ends - size), pa.array(ends)], ["place_row", "part", "first", "after"])
        before = int(ends[-1]) if len(ends) else before


def _cut(length: int, base: dict[int, int], wide: bool, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc_id, n, ids, part, first in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "doc_tokens", "ids", "part", "first")), strict=True):
                whole = np.frombuffer(ids, "<u4" if wide else "<u2").astype("<u4")
                place, start = base[part] + first, 0
                while start < n:
                    offset = (place + start) % length
                    size = min(length - offset, n - start)
                    piece = whole[start : start + size].tobytes()
                    for column, x in zip(out, (doc_id, start, size, zlib.crc32(piece), n, (place + start) // length, offset, piece), strict=True):
                        column.append(x)
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: 7 + keep_ids]
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("doc_id").type), *[pa.array(x, pa.int64()) for x in out[1:7]], *[pa.array(out[7], pa.binary())] * keep_ids], names)

    return run


def pack_along_curve(docs: DataFrame, tokenizer_path: str, end_id: int = 2, length: int = 4096, keep_ids: bool = False) -> DataFrame:
    """Pieces of documents in sequences of `length` ids: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids].

    All sequences but the last are full, so less than one sequence of padding is needed in all.  A null text is
    empty and has the end id alone; null ids and repeated rows are kept and packed each on its own; other columns
    are ignored; an empty table gives no pieces.  Ties of the key go by a checksum of the ids.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "packing")
    kind = docs.schema["doc_id"].dataType.simpleString()
    places = ", ".join(f"p{k} double" for k in range(DIMENSIONS))
    wide = encoder(tokenizer_path, True).dtype.itemsize != 2
    tokens = docs.select("doc_id", text_or_empty()).mapInArrow(_tokenise(tokenizer_path, end_id), f"doc_id {kind}, doc_tokens long, ids binary, tie long, {places}")
    tokens = ws.save(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    stats = tokens.agg(*[f(f"p{k}").alias(f"{n}{k}") for k in range(DIMENSIONS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    means = [stats[f"m{k}"] or 0.0 for k in range(DIMENSIONS)]
    deviations = [max(stats[f"s{k}"] or 0.0, 1e-9) for k in range(DIMENSIONS)]
    keyed = tokens.select("row", "doc_tokens", "tie", *[f"p{k}" for k in range(DIMENSIONS)]).mapInArrow(_keys(means, deviations), "row long, doc_tokens long, tie long, curve long")
    ordered = ws.save(keyed.repartitionByRange("curve", "tie", "row").sortWithinPartitions("curve", "tie", "row").mapInArrow(_running, "place_row long, part long, first long, after long"), "order")
    base, total = {}, 0
    for r in sorted(ordered.groupBy("part").agg(F.max("after").alias("n")).collect()):
        base[r["part"]], total = total, total + r["n"]
    joined = tokens.select("row", "doc_id", "doc_tokens", "ids").join(ordered.select("place_row", "part", "first").hint("shuffle_hash"), F.col("row") == F.col("place_row"))
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * keep_ids
    return joined.select("doc_id", "doc_tokens", "ids", "part", "first").mapInArrow(_cut(length, base, wide, keep_ids), schema)


def sequences(pieces: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces with ids: sequence_id, n_ids, ids (padded binary).  A sequence bounds its group."""
    joined = F.expr("aggregate(transform(sort_array(collect_list(struct(offset, ids))), x -> x.ids), binary(''), (a, x) -> concat(a, x))")
    pad = F.unhex(F.lit("%02x%02x%02x%02x" % tuple(pad_id.to_bytes(4, "little"))))
    grouped = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), joined.alias("ids"))
    return grouped.withColumn("ids", F.concat("ids", F.unhex(F.repeat(F.hex(pad), (F.lit(length) - F.col("n_ids")).cast("int")))))
