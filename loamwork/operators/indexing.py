"""The indexing dataflow: files to chunks, symbols, edges and vectors, all set-wise."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chunk import MAX_BYTES, chunks
from ..functions.embed import Backend, embed_column
from ..functions.parse import defines, parse
from ..functions.paths import language
from . import graph

MAX_PARSED = 1024 * 1024
BACKFILL = 128
ANALYSIS = (
    "version string, path string, tier short, chunks array<struct<ord:int,start_line:int,end_line:int,content:string>>, "
    "symbols array<struct<ord:int,name:string,kind:string,start_line:int,end_line:int>>, candidates array<struct<from_ord:int,from_line:int,to_name:string,relation:string>>, problem string"
)
_NUMBER, _TEXT = pa.int32(), pa.string()
_LISTS = [
    pa.list_(pa.struct([("ord", _NUMBER), ("start_line", _NUMBER), ("end_line", _NUMBER), ("content", _TEXT)])),
    pa.list_(pa.struct([("ord", _NUMBER), ("name", _TEXT), ("kind", _TEXT), ("start_line", _NUMBER), ("end_line", _NUMBER)])),
    pa.list_(pa.struct([("from_ord", _NUMBER), ("from_line", _NUMBER), ("to_name", _TEXT), ("relation", _TEXT)])),
    _TEXT,
]
#: Changes whenever a parser or the chunker would give something else for the same source.
REVISION = 3


def _analysed(limit: int, count: Accumulator | None):
    """Of batches (version, path, tier, language, source): rows of ANALYSIS.  A file that can't be analysed has a problem, not a failed task."""
    def one(row: dict) -> tuple:
        source = row["source"] or ""
        parsed = parse(source, row["language"] if len(source.encode()) <= MAX_PARSED else None)
        s = parsed.symbols
        cut = [{"ord": k, "start_line": c.start, "end_line": c.end, "content": c.content} for k, c in enumerate(chunks(source, [(x.start, x.end) for x in s], limit)) if c.content]
        names = [{"ord": k, "name": x.name, "kind": x.kind, "start_line": x.start, "end_line": x.end} for k, x in enumerate(s)]
        found = [{"from_ord": i, "from_line": s[i].start, "to_name": s[j].name, "relation": "defines"} for i, j in defines(s)]
        found += [{"from_ord": i, "from_line": s[i].start, "to_name": name, "relation": "calls"} for i, name in parsed.calls]
        return cut, names, found, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                try:
                    done.append(one(row))
                except Exception as e:  # one odd file must not stop the rest
                    done.append(([], [], [], f"{type(e).__name__}: {e}"[:500]))
            if count is not None:
                count.add(len(done))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *[pa.array([x[k] for x in done], _LISTS[k]) for k in range(4)]], ["version", "path", "tier", "chunks", "symbols", "candidates", "problem"])

    return run


def analysed(files: DataFrame, limit: int = MAX_BYTES, count: Accumulator | None = None) -> DataFrame:
    """Chunks, symbols and relation candidates of files (version, path, tier, source) in one pass, a row a file (ANALYSIS).

    count: gets the number of files analysed.
    """
    rows = files.select("version", "path", F.col("tier").cast("short").alias("tier"), language(F.col("path")).alias("language"), "source")
    return rows.mapInArrow(_analysed(limit, count), ANALYSIS)


def chunk_rows(analysis: DataFrame) -> DataFrame:
    """file_version, file_path, tier, ord, start_line, end_line, content, id, content_hash; ids derive from what they name."""
    rows = analysis.select(F.col("version").alias("file_version"), F.col("path").alias("file_path"), "tier", F.explode("chunks").alias("x")).select("file_version", "file_path", "tier", "x.*")
    return rows.withColumns({"id": F.sha2(F.concat_ws("\x1f", "file_version", "file_path", F.col("ord").cast("string")), 256), "content_hash": F.sha2("content", 256)})


def symbol_rows(analysis: DataFrame) -> DataFrame:
    return analysis.select(F.col("version").alias("file_version"), F.col("path").alias("file_path"), F.explode("symbols").alias("x")).select("file_version", "file_path", "x.*")


def candidate_rows(analysis: DataFrame) -> DataFrame:
    return analysis.select(F.col("version").alias("file_version"), F.col("path").alias("file_path"), F.explode("candidates").alias("x")).select("file_version", "file_path", "x.*")


def chunk_files(files: DataFrame, limit: int = MAX_BYTES) -> DataFrame:
    return chunk_rows(analysed(files, limit))


def symbols_of(files: DataFrame) -> DataFrame:
    return symbol_rows(analysed(files))


def edge_candidates(files: DataFrame) -> DataFrame:
    return candidate_rows(analysed(files))


def linked_candidates(candidates: DataFrame, chunks_: DataFrame) -> DataFrame:
    """src, file_path, to_name, relation: candidates with the chunk that starts on their symbol's line."""
    source = chunks_.groupBy("file_path", F.col("start_line").alias("from_line")).agg(F.min("id").alias("src"))
    return candidates.join(source, ["file_path", "from_line"]).select("src", "file_path", "to_name", "relation")


def structure(analysis: DataFrame, chunks_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """symbols, edges of the analysed files of one checkout."""
    nodes = graph.link_chunks(chunks_, symbol_rows(analysis))
    return nodes, graph.resolve(linked_candidates(candidate_rows(analysis), chunks_), nodes)


def prepared(chunk_rows: DataFrame, backend: Backend, batch: int = 64) -> DataFrame:
    """Chunks with vectors and states: first-party ones embedded (absent where there is no vector), vendored ones pending.

    Each distinct content is embedded once; chunks that bring a vector in `reused` keep it.
    """
    rows = chunk_rows if "reused" in chunk_rows.columns else chunk_rows.withColumn("reused", F.lit(None).cast("array<float>"))
    needed = rows.where("tier = 1 AND reused IS NULL").select("content_hash", "content").dropDuplicates(["content_hash"])
    made = embed_column(needed, "content", backend, batch).select("content_hash", "embedding")
    out = rows.join(made, "content_hash", "left").withColumn("embedding", F.when(F.col("tier") == 1, F.coalesce("reused", "embedding"))).drop("reused")
    state = F.when(F.col("tier") == 2, "pending").when(F.col("embedding").isNull(), "absent").otherwise("embedded")
    return out.withColumn("embedding_state", state)


def pending_groups(chunk_rows: DataFrame, limit: int = BACKFILL) -> DataFrame:
    """content_hash, content, rows: distinct contents that wait for a vector, at most one batch."""
    waiting = chunk_rows.where("embedding_state = 'pending' AND content_hash IS NOT NULL")
    return waiting.groupBy("content_hash").agg(F.min("content").alias("content"), F.count("*").alias("rows")).orderBy("content_hash").limit(limit)


def embedded_groups(chunk_rows: DataFrame, backend: Backend, limit: int = BACKFILL) -> DataFrame:
    """content_hash, embedding of one batch of waiting contents, without those that have no usable vector."""
    return embed_column(pending_groups(chunk_rows, limit).select("content_hash", "content"), "content", backend, 0).where("embedding IS NOT NULL").select("content_hash", "embedding")


def backfill(chunk_rows: DataFrame, backend: Backend, limit: int = BACKFILL) -> DataFrame:
    """chunk_rows after one batch of waiting contents is embedded and handed to all their copies.

    A content without a usable vector stays pending.
    """
    made = embedded_groups(chunk_rows, backend, limit).withColumnRenamed("embedding", "made")
    out = chunk_rows.join(F.broadcast(made), "content_hash", "left")  # at most `limit` vectors
    use = (F.col("embedding_state") == "pending") & F.col("made").isNotNull()
    return out.withColumns({"embedding": F.when(use, F.col("made")).otherwise(F.col("embedding")), "embedding_state": F.when(use, "embedded").otherwise(F.col("embedding_state"))}).drop("made")


def outcome(results: DataFrame) -> DataFrame:
    """files, succeeded, outcome (all, some, none) of a batch (column ok)."""
    sums = results.agg(F.count("*").alias("files"), F.count_if("ok").alias("succeeded"))
    return sums.withColumn("outcome", F.when(F.col("succeeded") == F.col("files"), "all").when(F.col("succeeded") > 0, "some").otherwise("none"))
