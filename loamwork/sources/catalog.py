"""Tables with atomic, pinned versions: Parquet directories and a manifest that names those of the current version.

A commit writes new directories and then the next numbered manifest, which must not exist yet: the compare and swap
that makes concurrent writers safe.  A reader keeps the manifest it opened, so it sees one version throughout.  All
file access goes through Spark's file systems, so a catalog may lie in any store.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..schema import TABLES


class Conflict(RuntimeError):
    """Another writer has committed since the version was read."""


@dataclass(frozen=True)
class Snapshot:
    """One version of all tables."""

    spark: SparkSession
    root: str
    number: int
    tables: dict[str, dict[str, str]]

    def table(self, name: str) -> DataFrame:
        """A table of this version; one that was never written is empty."""
        if name not in self.tables:
            return self.spark.createDataFrame([], TABLES[name])
        at = self.tables[name]
        return self.spark.read.schema(at["schema"]).parquet(f"{self.root}/{at['path']}")


class Catalog:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))

    def _numbers(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def snapshot(self, number: int | None = None) -> Snapshot:
        """The latest version, or a given one."""
        numbers = self._numbers()
        number = (numbers[-1] if numbers else 0) if number is None else number
        tables = {}
        if number:
            stream = self._fs.open(self._path(f"{self.root}/manifests/{number:020d}.json"))
            try:
                tables = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            finally:
                stream.close()
        return Snapshot(self.spark, self.root, number, tables)

    def commit(self, read: Snapshot, changes: dict[str, DataFrame]) -> Snapshot:
        """Makes read's tables with the changes the next version; Conflict if there is one already.

        Tables without changes keep their directories.  Directories of a lost race are deleted.
        """
        tables, written = dict(read.tables), []
        for name, df in changes.items():
            path = f"data/{name}/{uuid.uuid4().hex}"
            df.write.parquet(f"{self.root}/{path}")
            written.append(path)
            tables[name] = {"path": path, "schema": df._jdf.schema().toDDL()}
        number = read.number + 1
        target, staged = self._path(f"{self.root}/manifests/{number:020d}.json"), self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(staged, False)
        out.write(bytearray(json.dumps(tables, sort_keys=True).encode()))
        out.close()
        won = not self._fs.exists(target) and self._fs.rename(staged, target)
        if not won:
            self._fs.delete(staged, False)
            for path in written:
                self._fs.delete(self._path(f"{self.root}/{path}"), True)
            raise Conflict(f"version {number} exists")
        return Snapshot(self.spark, self.root, number, tables)

    def vacuum(self, keep: int = 10) -> int:
        """Deletes all but the last `keep` versions and the directories only they name; returns how many went."""
        numbers = self._numbers()
        kept = {t["path"] for n in numbers[-keep:] for t in self.snapshot(n).tables.values()}
        gone = 0
        for n in numbers[:-keep]:
            for t in self.snapshot(n).tables.values():
                if t["path"] not in kept and self._fs.delete(self._path(f"{self.root}/{t['path']}"), True):
                    gone += 1
            self._fs.delete(self._path(f"{self.root}/manifests/{n:020d}.json"), False)
        return gone
