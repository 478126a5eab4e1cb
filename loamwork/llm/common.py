"""Helpers shared by the training-data operators: intermediate tables and null handling."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_local_root: str | None = None


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``.  Only where that is unset and the master is local (tests on one
    machine) a temporary folder of this process is used instead; on a cluster there is an error.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="loamwork-")
        atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
    return f"file://{_local_root}"


class Workspace:
    """Intermediate tables of one operator call, kept in the shared folder.

    A table is written by Spark's committer, so a lost executor costs only the tasks it ran, and reading
    the table back cuts the lineage.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/loamwork/{name}-{uuid.uuid4().hex}"
        self._files(self.root)[0].deleteOnExit(self._files(self.root)[1])  # with the application, as results may read it

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def save(self, df: DataFrame, table: str) -> DataFrame:
        """Writes df and returns the written table."""
        df.write.option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def release(self) -> None:
        """Lets go of the shuffle files of finished steps now; Spark does so when the JVM collects their plans."""
        self.spark._jvm.System.gc()

    def drop(self, table: str) -> None:
        """Deletes a table that nothing reads any more."""
        files, at = self._files(self.path(table))
        files.delete(at, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether crc32 of the id's decimal text leaves `part` modulo `parts`; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts == part


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
