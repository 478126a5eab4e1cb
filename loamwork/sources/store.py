"""Partitioned Parquet tables of families and checkouts.

What is keyed by file version (versions, analyses, chunks, postings, late vectors) is shared by a family's checkouts and only
grows; it lies in partitions of family and epoch, and an epoch is left behind when garbage is collected.  What belongs to a
checkout (its deltas, its edges) or is its base map lies in partitions of checkout and generation.  Which epoch and
generation count is said by the registry of checkouts, whose commit makes a new one visible at once: until then nobody
reads the new partitions, and a writer that fails leaves partitions that nobody names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables by family and epoch, and by checkout and generation.
SHARED = {
    "versions": "id string, path string, content_hash string, tier short, source string",
    "chunks": "id string, file_version string, file_path string, start_line int, end_line int, content string, embedding array<float>, tier short, embedding_state string, content_hash string",
    "analyses": "version string, revision int, path string, nodes array<struct<chunk_id:string,name:string,kind:string,start_line:int,end_line:int>>, candidates array<struct<src:string,to_name:string,relation:string>>, problem string",
    "postings": "term string, block int, n int, ids array<string>, tfs array<int>, generation int",
    "late_vectors": "content_hash string, embedding array<float>",
}
OWN = {
    "base": "path string, version string",
    "deltas": "path string, version string",
    "edges": "src string, dst string, relation string, to_name string, file_path string",
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _read(self, path: str, schema: str) -> DataFrame:
        files, at = self._files(path)
        return self.spark.read.schema(schema).parquet(path) if files.exists(at) else self.spark.createDataFrame([], schema)

    def shared(self, table: str, family_id: str, epoch: int) -> DataFrame:
        """One epoch of a family; only its folder is listed."""
        return self._read(f"{self.root}/{table}/family_id={family_id}/epoch={epoch}", SHARED[table])

    def own(self, table: str, checkout_id: str, generation: int | None) -> DataFrame:
        """One generation of a checkout, empty for none."""
        if generation is None:
            return self.spark.createDataFrame([], OWN[table])
        return self._read(f"{self.root}/{table}/checkout_id={checkout_id}/generation={generation}", OWN[table])

    def append(self, table: str, rows: DataFrame, family_id: str, epoch: int) -> None:
        names = [c.split()[0] for c in SHARED[table].split(", ")]
        keyed = rows.select(*names, F.lit(family_id).alias("family_id"), F.lit(epoch).alias("epoch"))
        keyed.write.mode("append").partitionBy("family_id", "epoch").option("parquet.block.size", 1 << 20 if table == "postings" else 128 << 20).parquet(f"{self.root}/{table}")

    def overwrite(self, table: str, rows: DataFrame, checkout_id: str, generation: int) -> None:
        """Writes the partition of one checkout's generation; no other partition is touched, and a second try replaces the first."""
        keyed = rows.select(*[c.split()[0] for c in OWN[table].split(", ")], F.lit(checkout_id).alias("checkout_id"), F.lit(generation).alias("generation"))
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("checkout_id", "generation").parquet(f"{self.root}/{table}")

    def drop_shared(self, family_id: str, epoch: int | None = None) -> None:
        """Deletes an epoch of a family's shared tables, or all of them."""
        for table in SHARED:
            files, at = self._files(f"{self.root}/{table}/family_id={family_id}" + ("" if epoch is None else f"/epoch={epoch}"))
            files.delete(at, True)

    def drop_own(self, checkout_id: str, but: int | None = None) -> None:
        """Deletes a checkout's generations, all or all but one."""
        for table in OWN:
            files, at = self._files(f"{self.root}/{table}/checkout_id={checkout_id}")
            if not files.exists(at):
                continue
            for found in files.listStatus(at):
                if but is None or found.getPath().getName() != f"generation={but}":
                    files.delete(found.getPath(), True)
