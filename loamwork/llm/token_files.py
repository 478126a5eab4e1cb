"""Token-id files: frequency-ranked ids in byte-aligned variable-length coding.

Ids are numbered anew by falling corpus frequency, so the most frequent fit in one byte.  Each number takes one
to four data bytes; its length less one is two bits of a separate control stream, four numbers to a control
byte.  Decoding reads lengths from a table of 256 rows of four and gathers the data bytes, all in numpy.

A file set is a folder of two tables: blocks (shard, block, ids_before, n_ids, unnamed, doc_ids, lengths, control, data)
and ranks (rank, id), written by Spark's committer, so it may lie in any store that Spark can write.  The folder is all
that a reader needs.  Shards and blocks follow ascending doc_id; a block is the unit of reading and holds whole
documents, one long document at least.  Documents without an id come first: a block counts them in `unnamed`.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, text_or_empty
from .units import column_slices, encoder, with_end

BLOCK_IDS = 1 << 19
LENGTHS = np.array([[((i >> 2 * k) & 3) + 1 for k in range(4)] for i in range(256)], np.uint8)
RAW = "shard long, block long, ids_before long, n_ids long, unnamed long, doc_ids binary, lengths binary, ids binary"
BLOCKS = "shard long, block long, ids_before long, n_ids long, unnamed long, doc_ids binary, lengths binary, control binary, data binary"


def encode_stream(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit numbers."""
    v = np.ascontiguousarray(values, "<u4")
    size = 1 + (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]]
    codes = np.zeros(-(-len(v) // 4) * 4, np.uint8)
    codes[: len(v)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return control.astype(np.uint8).tobytes(), data.tobytes()


def decode_stream(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n numbers of a stream."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    ends = np.cumsum(size, dtype=np.int64)
    if n and ends[-1] != len(data) or not n and data:
        raise ValueError("control and data bytes differ in length")
    first = ends - size
    padded = np.frombuffer(data + b"\0\0\0", np.uint8)
    out = padded[first].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        longer = np.flatnonzero(size > k)
        out[longer] |= padded[first[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenise(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path, False)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        keys, named, sizes, ids, held = [], [], [], [], 0  # of the block that is still open

        def flush() -> pa.RecordBatch:
            nonlocal block, before, keys, named, sizes, ids, held
            unnamed = int((~np.concatenate(named)).sum())
            row = [shard, block, before, held, unnamed, *(np.concatenate(x).astype("<i8").tobytes() for x in (keys, sizes)), np.concatenate(ids).tobytes()]
            block, before = block + 1, before + held
            keys, named, sizes, ids, held = [], [], [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _arrow(RAW).types, strict=True)], schema=_arrow(RAW))

        for batch in batches:
            for a, b in column_slices(batch.column(1)):
                flat, ends = with_end(*enc.ids(batch.column(1).slice(a, b - a)), end_id)
                key = batch.column(0).slice(a, b - a)
                here, there = pc.fill_null(key, 0).to_numpy(), key.is_valid().to_numpy(zero_copy_only=False)
                size = np.diff(ends, prepend=0)
                first = 0
                while first < len(ends):
                    start = int(ends[first - 1]) if first else 0
                    last = min(len(ends), int(np.searchsorted(ends, start + BLOCK_IDS - held)) + 1)
                    for column, x in zip((keys, named, sizes, ids), (here[first:last], there[first:last], size[first:last], flat[start : ends[last - 1]]), strict=True):
                        column.append(x)
                    held += int(ends[last - 1]) - start
                    first = last
                    if held >= BLOCK_IDS:
                        yield flush()
        if keys:
            yield flush()

    return run


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(x.split()[0], pa.int64() if x.split()[1] == "long" else pa.binary()) for x in ddl.split(", ")])


def _count(dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                own = np.bincount(np.frombuffer(x, dtype), minlength=len(total))
                own[: len(total)] += total
                total = own
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["id", "n"])

    return run


def _pack(rank: np.ndarray, dtype: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                row["control"], row["data"] = encode_stream(rank[np.frombuffer(row.pop("ids"), dtype)])
                yield pa.RecordBatch.from_pylist([row], schema=_arrow(BLOCKS))

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, ws: Workspace, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes docs' ids in ascending doc_id order; returns the folder of the file set.

    A null text is empty and has the end id alone.  Rows with a null doc_id come first.  Rows that share a doc_id follow
    each other by a hash of the text, equal rows as often as they are there; other columns are ignored.  An empty table
    gives an empty file set.  The table of ranks is bounded by the vocabulary.
    """
    spark = docs.sparkSession
    dtype = encoder(tokenizer_path, False).dtype
    rows = docs.select(F.col(id_col).cast("long").alias("k"), text_or_empty(text_col).alias("t"))
    tie = F.xxhash64("t")  # the texts themselves would be too large for the sample of sort keys
    ordered = rows.repartitionByRange("k", tie).sortWithinPartitions("k", tie)
    raw = ws.save(ordered.mapInArrow(_tokenise(tokenizer_path, end_id), RAW), "raw")
    counts = raw.select("ids").mapInArrow(_count(dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    id_of = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    rank = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank[id_of] = np.arange(len(id_of), dtype=np.uint32)
    ranks = spark.createDataFrame([(k, x) for k, x in enumerate(id_of.tolist())], "rank long, id long")
    ws.save(ranks.coalesce(1), "token-files/ranks")
    ws.save(raw.mapInArrow(_pack(rank, dtype), BLOCKS), "token-files/blocks")
    ws.drop("raw")
    return ws.path("token-files")


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """Decodes a file set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32[, ids].

    ids is little-endian unsigned 32-bit.  The driver holds the ranks and one number per shard (a partition of the
    writer).
    """
    ranks = sorted(spark.read.schema("rank long, id long").parquet(f"{folder}/ranks").collect())
    id_of = np.array([r["id"] for r in ranks], np.uint32)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    sizes = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}
    base, total = {}, 0
    for shard in sorted(sizes):
        base[shard], total = total, total + sizes[shard]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = id_of[decode_stream(row["control"], row["data"], row["n_ids"])].astype("<u4")
                size = np.frombuffer(row["lengths"], "<i8")
                ends = np.cumsum(size)
                parts = [ids[a:b].tobytes() for a, b in zip(ends - size, ends, strict=True)]
                keys = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.arange(len(size)) < row["unnamed"])
                columns = [keys, pa.array(base[row["shard"]] + row["ids_before"] + ends - size), pa.array(size), pa.array([zlib.crc32(x) for x in parts], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array(parts, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return blocks.mapInArrow(run, schema)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer_path: str, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """Writes docs' token ids as a file set in the shared folder and reads it back, a row per row of docs."""
    return read_token_files(spark, write_token_files(docs, tokenizer_path, end_id, Workspace(spark, "token-files")), keep_ids)
