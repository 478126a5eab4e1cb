"""The folder that driver and executors share, for what a query writes once and reads again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the session's spark.checkpoint.dir, deleted with the application.

    Only where that is unset and the master is local (tests on one machine) it lies in a temporary folder of this process.
    """
    global _own
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="loamwork-")
            atexit.register(shutil.rmtree, _own, ignore_errors=True)
        root = f"file://{_own}"
    path = f"{root.rstrip('/')}/loamwork/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
