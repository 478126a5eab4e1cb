"""Versioned views of files: one base map per family, and per checkout only where it differs.

A delta with a null version is a tombstone.  visible() is one plan for base and linked checkouts alike; every
search over it masks before the cut to the best results, so another checkout's files never push results out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """path, version of one checkout: base (path, version) under its deltas (path, version or null)."""
    own = deltas.select("path", "version")
    kept = base.select("path", "version").join(own.select("path"), "path", "left_anti")
    return kept.unionByName(own.where("version IS NOT NULL"))


def visible_sets(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """path, version, everyone, checkouts: what each version is seen by, one row a path and version.

    everyone: all checkouts but those listed (a base entry and the checkouts that override it), else those listed alone.
    Base entries are never multiplied by checkouts.
    """
    own = deltas.select("checkout_id", "path", "version")
    over = own.groupBy("path").agg(F.collect_set("checkout_id").alias("checkouts"))
    none = F.array().cast("array<string>")
    below = base.select("path", "version").join(over, "path", "left").select("path", "version", F.lit(True).alias("everyone"), F.coalesce(F.col("checkouts").cast("array<string>"), none).alias("checkouts"))
    above = own.where("version IS NOT NULL").groupBy("path", "version").agg(F.collect_set(F.col("checkout_id").cast("string")).alias("checkouts"))
    return below.unionByName(above.select("path", "version", F.lit(False).alias("everyone"), "checkouts"))


def visible_all(base: DataFrame, deltas: DataFrame, checkouts: DataFrame) -> DataFrame:
    """checkout_id, path, version of many checkouts (one column checkout_id), a row for each that sees it.

    The ids of the checkouts (a registry's, not the data's) go into the plan.
    """
    kind = checkouts.schema["checkout_id"].dataType
    ids = F.array(*[F.lit(str(r["checkout_id"])) for r in checkouts.select("checkout_id").distinct().orderBy("checkout_id").collect()]).cast("array<string>")
    seen = F.when(F.col("everyone"), F.array_except(ids, "checkouts")).otherwise(F.array_intersect("checkouts", ids))
    return visible_sets(base, deltas).select(F.explode(seen).alias("checkout_id"), "path", "version").withColumn("checkout_id", F.col("checkout_id").cast(kind))


def masked_chunks(chunks: DataFrame, view: DataFrame) -> DataFrame:
    """The chunks of the versions that a view shows."""
    return chunks.join(view.select(F.col("version").alias("file_version")), "file_version", "left_semi")


def gated(rows: DataFrame, checkouts: DataFrame, checkout_id: str) -> DataFrame:
    """rows if the checkout is active and indexed, else none."""
    ready = checkouts.where((F.col("checkout_id") == checkout_id) & (F.col("state") == "active") & F.col("indexed_at").isNotNull()).select(F.lit(1).alias("ready")).limit(1)
    return rows.crossJoin(F.broadcast(ready)).drop("ready")


def minimal_deltas(base: DataFrame, desired: DataFrame) -> DataFrame:
    """path, version: the fewest deltas that turn the base map into the desired one."""
    b, d = base.select("path", F.col("version").alias("old")), desired.select("path", F.col("version").alias("version"))
    return b.join(d, "path", "full").where(~F.col("old").eqNullSafe(F.col("version"))).select("path", "version")


def move_base(base: DataFrame, new_base: DataFrame, deltas: DataFrame, checkouts: DataFrame) -> DataFrame:
    """checkout_id, path, version: deltas over the new base that leave every given checkout's view as it was.

    Only paths where the bases differ or a delta exists can change, so the plan never crosses checkouts with the
    whole base.
    """
    changed = base.select("path", F.col("version").alias("old")).join(new_base.select("path", F.col("version").alias("new")), "path", "full")
    changed = changed.where(~F.col("old").eqNullSafe(F.col("new")))
    ids = checkouts.select("checkout_id")
    own = deltas.join(ids, "checkout_id", "left_semi").select("checkout_id", "path", "version")
    # Without a delta: what was seen through the old base is kept where the new base shows something else.
    inherited = ids.crossJoin(changed.select("path", "old")).join(own.select("checkout_id", "path"), ["checkout_id", "path"], "left_anti").select("checkout_id", "path", F.col("old").alias("version"))
    # With a delta: it stays unless the new base says the same.
    after = own.join(new_base.select("path", F.col("version").alias("new")), "path", "left").where(~F.col("version").eqNullSafe(F.col("new")))
    return inherited.unionByName(after.select("checkout_id", "path", "version"))


def unreferenced(versions: DataFrame, base: DataFrame, deltas: DataFrame) -> DataFrame:
    """File versions that no base entry and no delta names."""
    used = base.select(F.col("version").alias("id")).unionByName(deltas.select(F.col("version").alias("id")))
    return versions.join(used, "id", "left_anti")


def deletable(captured: DataFrame, base_ids: DataFrame, readers: DataFrame, work: DataFrame) -> DataFrame:
    """id: captured ids that aren't in the base, held by an active reader or captured by accepted work."""
    held = readers.select(F.explode("references").alias("id")).unionByName(work.where("state = 'accepted'").select(F.explode("captured_ids").alias("id")))
    return captured.select("id").distinct().join(base_ids.select("id").unionByName(held), "id", "left_anti")


def assign_versions(files: DataFrame, versions: DataFrame) -> DataFrame:
    """path, content_hash, tier, source, version, is_new of scanned files.

    A known version is reused only if path, hash, tier and the source itself are equal (a null stored source can't
    prove it).  New ids derive from what they name, so a rerun makes the same.
    """
    f = files.select("path", "content_hash", "tier", "source")
    old = versions.select(F.col("path").alias("p"), F.col("content_hash").alias("h"), F.col("tier").alias("t"), F.col("source").alias("s"), "id")
    match = (F.col("path") == F.col("p")) & (F.col("content_hash") == F.col("h")) & (F.col("tier") == F.col("t")) & (F.col("source") == F.col("s"))
    known = f.join(old, match, "left").groupBy("path", "content_hash", "tier", "source").agg(F.min("id").alias("id"))
    made = F.sha2(F.concat_ws("\x1f", "path", "content_hash", F.col("tier").cast("string"), F.xxhash64("source").cast("string")), 256)
    return known.select("path", "content_hash", "tier", "source", F.coalesce("id", made).alias("version"), F.col("id").isNull().alias("is_new"))


def reusable_embeddings(new_chunks: DataFrame, old_chunks: DataFrame) -> DataFrame:
    """new_chunks with the vector of an old chunk of the same path and content in `reused`, null where there is none."""
    old = old_chunks.where("embedding IS NOT NULL").groupBy("file_path", "content_hash", "content").agg(F.min_by("embedding", "id").alias("reused"))
    return new_chunks.join(old, ["file_path", "content_hash", "content"], "left")


def orphans(stored: DataFrame, keep: DataFrame) -> DataFrame:
    """Distinct stored paths that aren't kept; with nothing to keep, all of them."""
    return stored.select("file_path").distinct().join(keep.select(F.col("path").alias("file_path")), "file_path", "left_anti")
