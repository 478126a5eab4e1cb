"""Families and checkouts: lookups, reconciliation with what is on disk, and control records.

Functions take and return DataFrames; Catalog.commit (sources.catalog) makes a set of them the next version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestors

RECEIPT_STATES = ("accepted", "running", "finished", "failed", "cancelled")


def nearest_ancestor(paths: DataFrame, registered: DataFrame) -> DataFrame:
    """path, root, family_id: the deepest registered root (root, family_id) that is a path or lies above it."""
    up = paths.select("path", F.explode(F.array_append(ancestors(F.col("path")), F.col("path"))).alias("root"))
    found = up.join(registered.select("root", "family_id"), "root")
    return found.groupBy("path").agg(F.max_by(F.struct("root", "family_id"), F.struct(F.length("root"), "root")).alias("x")).select("path", "x.root", "x.family_id")


def by_identity(families: DataFrame, keys: DataFrame) -> DataFrame:
    """Live families by identity (identity_kind, identity_key): digests are joined, then the bytes compared."""
    f = families.where("retired_at IS NULL").select("family_id", "identity_kind", "identity_key", F.sha2("identity_key", 256).alias("digest"))
    k = keys.select(F.col("identity_kind").alias("k"), F.col("identity_key").alias("own"), F.sha2("identity_key", 256).alias("d"))
    return f.join(k, (F.col("identity_kind") == F.col("k")) & (F.col("digest") == F.col("d")) & (F.col("identity_key") == F.col("own"))).select("family_id", "identity_kind", "identity_key")


def reconcile(stored: DataFrame, found: DataFrame) -> DataFrame:
    """git_dir, checkout_id, verdict for stored checkouts (checkout_id, git_dir, root, incarnation) and those on disk.

    new, present, moved (another root), replaced (another incarnation) or missing.
    """
    a = stored.select("git_dir", "checkout_id", F.col("root").alias("r0"), F.col("incarnation").alias("i0"))
    b = found.select("git_dir", F.col("root").alias("r1"), F.col("incarnation").alias("i1"))
    verdict = F.when(F.col("checkout_id").isNull(), "new").when(F.col("r1").isNull(), "missing").when(~F.col("i0").eqNullSafe(F.col("i1")), "replaced").when(F.col("r0") != F.col("r1"), "moved").otherwise("present")
    return a.join(b, "git_dir", "full").select("git_dir", "checkout_id", verdict.alias("verdict"))


def swapped(table: DataFrame, key: Column, expected: Column, changes: dict[str, Column]) -> DataFrame:
    """Compare-and-swap: rows of the key that still are as expected get the changes; `applied` says which did."""
    hit = key & expected
    return table.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()} | {"applied": hit})


def live(families: DataFrame) -> DataFrame:
    return families.where("retired_at IS NULL").orderBy("name", "family_id")


def removal_target(families: DataFrame, path: str) -> DataFrame:
    """The family that a removal by path means: the live one, else the one retired last."""
    return families.where(F.col("path") == path).orderBy(F.col("retired_at").isNull().desc(), F.col("retired_at").desc_nulls_first(), "family_id").limit(1)


def accept(receipts: DataFrame, new: DataFrame) -> DataFrame:
    """Adds receipts; one that is known already stays as it is, so a retried request changes nothing."""
    return receipts.unionByName(new.join(receipts.select("receipt_id"), "receipt_id", "left_anti").select(*receipts.columns))


def checkpointed(receipts: DataFrame, progress: DataFrame) -> DataFrame:
    """Applies progress (receipt_id, to); it never goes back and finished receipts never change."""
    p = progress.groupBy("receipt_id").agg(F.max("to").alias("to"))
    open_ = F.col("state").isin("accepted", "running")
    out = receipts.join(p, "receipt_id", "left")
    return out.withColumns({"progress": F.when(open_ & F.col("to").isNotNull(), F.greatest("progress", "to")).otherwise(F.col("progress")), "state": F.when(open_ & F.col("to").isNotNull(), "running").otherwise(F.col("state"))}).select(*receipts.columns)


def finished(receipts: DataFrame, results: DataFrame) -> DataFrame:
    """Closes receipts (receipt_id, outcome, value); the first result stands."""
    out = receipts.join(results.select("receipt_id", "outcome", "value"), "receipt_id", "left")
    now = F.col("state").isin("accepted", "running") & F.col("outcome").isNotNull()
    return out.withColumns({"state": F.when(now, F.col("outcome")).otherwise(F.col("state")), "result": F.when(now, F.col("value")).otherwise(F.col("result"))}).select(*receipts.columns)


def cancelled(work: DataFrame, ids: DataFrame) -> DataFrame:
    """Cancels accepted work; work in another state stays."""
    hit = work.join(ids.select("work_id").withColumn("hit", F.lit(True)), "work_id", "left")
    return hit.withColumn("state", F.when(F.col("hit") & (F.col("state") == "accepted"), "cancelled").otherwise(F.col("state"))).select(*work.columns)
