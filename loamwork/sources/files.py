"""Source trees as DataFrames: a walk that never enters what is excluded, inventories, scans and single files.

The walk goes level by level: the directories of a level are a table, dealt to tasks that list them, and the rules decide
on each entry; only directories that are kept are the next level.  Levels are written, so nothing is listed twice.
Content is read by tasks too, of the files that are wanted alone.
"""

from __future__ import annotations

import os
import stat
import time
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.glob import EXCLUDE_DEFAULTS, VENDOR_DEFAULTS, classify, compile_rules, verdict
from ..functions.paths import language
from ..operators.inventory import LARGE_FILE, admitted
from .shared import shared_folder

INVENTORY_ENTRIES = 100_000
#: Directories listed, and bytes read, by a task at a time.
DIRECTORIES_A_TASK, BATCH_BYTES = 256, 64 << 20
_ENTRY = pa.schema([("path", pa.string()), ("kind", pa.string()), ("size", pa.int64())])
_READ = pa.schema([("path", pa.string()), ("decision", pa.string()), ("content", pa.binary()), ("problem", pa.string())])


def _local(root: str) -> str:
    return root.removeprefix("file://").removeprefix("file:").rstrip("/") or "/"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _named(name: str) -> str:
    """Names that aren't UTF-8 are kept readable, and never match a file of that name."""
    return name.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _listing(root: str):
    """Of batches (path): path, kind, size of what lies in those directories; links aren't followed."""

    def entries(directory: str) -> Iterator[tuple[str, str, int | None]]:
        try:
            with os.scandir(os.path.join(root, directory)) as found:
                for entry in found:
                    path = _named(f"{directory}/{entry.name}" if directory else entry.name)
                    try:
                        mode = entry.stat(follow_symlinks=False)
                    except OSError:
                        yield path, "unreadable", None
                        continue
                    kinds = ((stat.S_ISLNK, "symlink"), (stat.S_ISDIR, "directory"), (stat.S_ISREG, "file"))
                    yield path, next((name for test, name in kinds if test(mode.st_mode)), "special"), mode.st_size
        except FileNotFoundError:
            return  # gone since its parent was listed
        except OSError:
            yield directory, "unreadable", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple[str, str, int | None]] = []
            for directory in batch.column(0).to_pylist():
                for row in entries(directory):
                    rows.append(row)
                    if len(rows) >= 50_000:
                        yield _batch(rows, _ENTRY)
                        rows = []
            if rows:
                yield _batch(rows, _ENTRY)

    return run


@dataclass
class Walk:
    """entries: path, kind (file, directory, symlink, special, unreadable), size, decision, language; how far it came."""

    entries: DataFrame
    listed: int = 0
    visited: int = 0
    complete: bool = True
    stop_reason: str | None = None
    levels: list[str] = field(default_factory=list)

    def files(self) -> DataFrame:
        """path, size, decision, language of regular files."""
        return self.entries.where("kind = 'file'").drop("kind")

    def counters(self) -> dict[str, int]:
        """What the walk passed by: excluded files it saw, directories it didn't enter, links, special and unreadable entries."""
        e = F.count_if
        kind, dropped = F.col("kind"), F.col("decision") == "drop"
        row = self.entries.agg(
            e((kind == "file") & dropped).alias("observed_excluded_files"), e((kind == "directory") & dropped).alias("pruned_directories"),
            e(kind == "symlink").alias("skipped_symlinks"), e(kind == "special").alias("skipped_special_entries"), e(kind == "unreadable").alias("unreadable_entries"),
        ).first()
        return row.asDict()


def walk(spark: SparkSession, root: str, exclude: list[str] | tuple[str, ...] = EXCLUDE_DEFAULTS, vendor: list[str] | tuple[str, ...] = VENDOR_DEFAULTS, most: int | None = None, budget_s: float | None = None) -> Walk:
    """The entries below a folder that all executors see.

    It stops before a level when it has seen `most` entries or `budget_s` seconds are over, and says so; the level before
    is whole, so it may have seen more.
    """
    began, folder = time.monotonic(), shared_folder(spark, "walk")
    excluded, vendored = compile_rules(exclude), compile_rules(vendor)
    decision = F.when(F.col("kind") == "directory", _of_directory(excluded)).otherwise(classify(F.col("path"), excluded, vendored))
    frontier, waiting = spark.createDataFrame([("",)], "path string"), 1
    out = Walk(spark.createDataFrame([], "path string, kind string, size long, decision string, language string"))
    while waiting:
        if most is not None and out.visited >= most or budget_s is not None and time.monotonic() - began >= budget_s:
            out.complete, out.stop_reason = False, "entry_limit" if most is not None and out.visited >= most else "time_limit"
            break
        tasks = min(-(-waiting // DIRECTORIES_A_TASK), 4 * spark.sparkContext.defaultParallelism)
        found = frontier.repartition(max(tasks, 1)).mapInArrow(_listing(_local(root)), "path string, kind string, size long")
        path = f"{folder}/level-{len(out.levels)}"
        found.withColumns({"decision": decision, "language": language(F.col("path"))}).write.parquet(path)
        level = spark.read.parquet(path)
        out.levels.append(path)
        out.listed += waiting
        frontier = level.where("kind = 'directory' AND decision <> 'drop'").select("path")
        counts = level.agg(F.count("*").alias("n"), F.count_if(F.expr("kind = 'directory' AND decision <> 'drop'")).alias("next")).first()
        out.visited, waiting = out.visited + counts["n"], counts["next"]
    if out.levels:
        out.entries = spark.read.parquet(*out.levels)
    return out


def _of_directory(excluded: list):
    """drop for a directory that isn't entered; those above it have been."""
    name = F.element_at(F.split("path", "/"), -1)
    return F.when((name == ".git") | verdict(F.col("path"), True, excluded), "drop").otherwise("tier1")


def inventory(spark: SparkSession, root: str, exclude: list[str] | tuple[str, ...] = EXCLUDE_DEFAULTS, vendor: list[str] | tuple[str, ...] = VENDOR_DEFAULTS, most: int = INVENTORY_ENTRIES, budget_s: float | None = None) -> Walk:
    """The walk of an inventory: no content is read, and it stops at about `most` entries."""
    return walk(spark, root, exclude, vendor, most, budget_s)


def _reading(root: str):
    """Of batches (path, decision): with content, or the problem why there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for path, decision in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content, problem = None, None
                try:
                    at = os.path.join(root, path)
                    mode = os.lstat(at)
                    if not stat.S_ISREG(mode.st_mode):
                        continue
                    if mode.st_size > LARGE_FILE:
                        problem = "too large"
                    else:
                        with open(at, "rb") as f:
                            content = f.read(LARGE_FILE + 1)
                except (FileNotFoundError, NotADirectoryError):
                    continue
                except OSError as e:
                    problem = e.strerror or "unreadable"
                rows.append((path, decision, content, problem))
                held += len(content or b"")
                if held >= BATCH_BYTES:
                    yield _batch(rows, _READ)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _READ)

    return run


def _sources(spark: SparkSession, root: str, wanted: DataFrame, tasks: int) -> DataFrame:
    read = wanted.repartition(max(1, tasks), "path").mapInArrow(_reading(_local(root)), "path string, decision string, content binary, problem string")
    tier = F.when(F.col("decision") == "tier2", 2).otherwise(1).cast("short").alias("tier")
    return admitted(read.where("content IS NOT NULL").withColumn("tier", tier), "tier")


def scan(spark: SparkSession, root: str, exclude: list[str] | tuple[str, ...] = EXCLUDE_DEFAULTS, vendor: list[str] | tuple[str, ...] = VENDOR_DEFAULTS) -> DataFrame:
    """path, source, size, content_hash, tier of the files below root that are indexed, in no order."""
    found = walk(spark, root, exclude, vendor)
    wanted = found.files().where(F.col("decision") != "drop").where(F.col("size") <= LARGE_FILE)
    return _sources(spark, root, wanted.select("path", "decision"), min(-(-found.visited // 64), 8 * spark.sparkContext.defaultParallelism))


def scan_paths(spark: SparkSession, root: str, paths: list[str], exclude: list[str] | tuple[str, ...] = EXCLUDE_DEFAULTS, vendor: list[str] | tuple[str, ...] = VENDOR_DEFAULTS) -> DataFrame:
    """As scan, for the given relative paths; those that are gone, no files or dropped have no row.  Only these are read."""
    given = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    decided = given.withColumn("decision", classify(F.col("path"), compile_rules(exclude), compile_rules(vendor))).where("decision <> 'drop'")
    return _sources(spark, root, decided, min(-(-len(paths) // 64), spark.sparkContext.defaultParallelism))
