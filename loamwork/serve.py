"""Tools over a registry and its tables: the engine's named operations as functions of JSON arguments, and a line loop.

Families, checkouts, policies and notes are small tables of a catalog; each request reads one version of them, and writes
commit against it and fail if another writer was first.  What is indexed lies in partitioned tables (sources.store) that a
checkout's row in the catalog names.  One process at a time indexes a family.  Full-text search takes words of any script.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import inspect
import json
import os
import sys
import time
from collections.abc import Callable
from typing import Any, TextIO

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .functions.embed import Backend, HashingBackend
from .functions.paths import under_root
from .operators import checkouts as linked
from .operators import graph, inventory, knowledge, policy, registry, search
from .operators.search import MOST_RESULTS
from .functions.text import UNICODE
from .schema import TABLES
from .sources import git
from .sources.catalog import Catalog, Snapshot
from .sources.files import inventory as walked
from .sources.store import Store
from .streaming import changes, events


#: Version of the tool protocol that initialize answers with.
PROTOCOL = "2024-11-05"
#: Seconds that a checkout may be missing before it is retired, and that an inventory may take.
MISSING_S, PREFLIGHT_S = 60, 30.0
_JSON_TYPES = (("bool", "boolean"), ("int", "integer"), ("list[str]", "array"), ("dict", "object"))


def _schema_of(parameter: inspect.Parameter) -> dict[str, Any]:
    """The JSON type of a tool's parameter, by its annotation; string where there is none."""
    kind = str(parameter.annotation)
    name = next((to for start, to in _JSON_TYPES if kind.startswith(start)), "string")
    return {"type": name, "items": {"type": "string"}} if name == "array" else {"type": name}


def _now() -> dt.datetime:
    return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.collect()]


class Engine:
    """Operations on one catalog.  backend embeds chunks, notes and queries."""

    def __init__(self, spark: SparkSession, root: str, backend: Backend | None = None):
        self.spark, self.catalog, self.backend = spark, Catalog(spark, root), backend or HashingBackend()
        self.store = Store(spark, f"{root.rstrip('/')}/indexed")
        self.parsed = spark.sparkContext.accumulator(0)  # files analysed so far
        # The names of the tools.
        self.tools: dict[str, Callable[..., dict[str, Any]]] = {
            "search_hybrid": self.search_hybrid, "search_fulltext": self.search_fulltext, "search_semantic": self.search_semantic, "search_structural": self.search_structural,
            "record_knowledge": self.record_knowledge, "search_knowledge": self.search_knowledge, "delete_knowledge": self.delete_knowledge, "list_knowledge": self.list_knowledge,
            "inspect_policy": self.inspect_policy, "check_policy": self.check_policy, "apply_policy": self.apply_policy, "preflight_family": self.preflight_family,
            "register_family": self.register_family, "start_family": self.start_family, "reindex_family": self.reindex_family, "pause_family": lambda family_id: self._flag(family_id, "paused", True),
            "resume_family": lambda family_id: self._flag(family_id, "paused", False), "cancel_work": self.cancel_work, "inspect_status": self.inspect_status, "unregister_family": self.unregister_family,
            "forget_repository": self.forget_repository, "recreate_index": lambda **_: {"available": False}, "convert_directory": lambda **_: {"available": False}, "continue_request": self.continue_request,
        }

    # Tables

    def _replace(self, name: str, old: DataFrame, keys: DataFrame, key: str, new: list[dict[str, Any]]) -> DataFrame:
        fresh = self.spark.createDataFrame([Row(**x) for x in new], TABLES[name]) if new else self.spark.createDataFrame([], TABLES[name])
        return old.join(keys, key, "left_anti").unionByName(fresh)

    def _family(self, snap: Snapshot, family_id: str) -> dict[str, Any]:
        found = _rows(snap.table("families").where((F.col("family_id") == family_id) & F.col("retired_at").isNull()).limit(1))
        if not found:
            raise KeyError(f"unknown family {family_id}")
        return found[0]

    # Checkouts

    def _checkouts(self, snap: Snapshot, family_id: str) -> list[dict[str, Any]]:
        """Those that aren't retired, the base first."""
        return _rows(snap.table("checkouts").where((F.col("family_id") == family_id) & (F.col("state") != "retired")).orderBy(F.desc("is_base"), "root"))

    def _places(self, snap: Snapshot, family: dict[str, Any]) -> dict[str, linked.Place]:
        rows = self._checkouts(snap, family["family_id"])
        base = next((r for r in rows if r["is_base"]), None)
        if base is None:
            return {}
        return {r["checkout_id"]: linked.Place(family["family_id"], family["epoch"] or 0, r["checkout_id"], r["generation"], base["checkout_id"], base["generation"]) for r in rows}

    def resolve(self, snap: Snapshot, cwd: str) -> tuple[dict[str, Any], dict[str, Any]]:
        """The family and checkout that a directory belongs to: the checkout it lies in by Git, else the nearest root above it."""
        live = snap.table("families").where("retired_at IS NULL")
        cwd = cwd.rstrip("/") or "/"
        own = snap.table("checkouts").where("state = 'active'").join(live.select("family_id"), "family_id", "left_semi")
        found = git.discover(cwd) if os.path.isdir(cwd) else None
        if found is not None:
            rows = _rows(own.where(F.col("root") == found.root).limit(1))
            if not rows and (family := _rows(live.where((F.col("identity_kind") == "git") & (F.col("identity_key") == bytearray(found.common_dir.encode()))).limit(1))):
                self._reconcile(family[0]["family_id"])  # a worktree that is new to the family
                snap = self.catalog.snapshot()
                rows = _rows(snap.table("checkouts").where((F.col("state") == "active") & (F.col("root") == found.root)).limit(1))
            if rows:
                return self._family(snap, rows[0]["family_id"]), rows[0]
        asked = self.spark.createDataFrame([(cwd,)], "path string")
        up = registry.nearest_ancestor(asked.select(F.ltrim(F.col("path"), F.lit("/")).alias("path")), own.select(F.ltrim(F.col("root"), F.lit("/")).alias("root"), "family_id")).collect()
        if not up:
            raise KeyError(f"no registered family above {cwd}")
        row = _rows(own.where((F.ltrim(F.col("root"), F.lit("/")) == up[0]["root"]) & (F.col("family_id") == up[0]["family_id"])).limit(1))[0]
        return self._family(snap, row["family_id"]), row

    def _view(self, cwd: str) -> tuple[dict[str, Any], linked.Views]:
        """A checkout's row and tables; one that was never indexed is indexed first, itself alone."""
        snap = self.catalog.snapshot()
        family, checkout = self.resolve(snap, cwd)
        if checkout["generation"] is None:
            self._index(family["family_id"], [checkout["checkout_id"]])
            snap = self.catalog.snapshot()
            family, checkout = self.resolve(snap, cwd)
            if checkout["generation"] is None:
                raise RuntimeError(f"{checkout['root']} is not indexed: {checkout['problem'] or 'pending'}")
        return checkout, linked.Views(self.store, self._places(snap, family)[checkout["checkout_id"]])

    # Search

    def _answer(self, checkout: dict[str, Any], views: linked.Views, found: DataFrame) -> dict[str, Any]:
        """Results (id, score) as clients see them."""
        chunks = views.shared("chunks")
        shown = chunks.select("id", under_root(checkout["root"], F.col("file_path")).alias("file_path"), "start_line", "end_line", "content")
        rows = shown.join(F.broadcast(found), "id").dropDuplicates(["id"])  # at most MOST_RESULTS
        return {"results": _rows(rows.select("id", "file_path", "start_line", "end_line", "score", "content").orderBy(F.desc("score"), "id").drop("id"))}

    def _vector(self, query: str) -> list[float] | None:
        return self.backend.embed([query])[0] or None

    def search_fulltext(self, query: str, cwd: str, limit: int | None = None) -> dict[str, Any]:
        """Chunks with all the query's words, from the written postings."""
        checkout, views = self._view(cwd)
        return self._answer(checkout, views, views.fulltext(query, limit))

    def search_semantic(self, query: str, cwd: str, limit: int | None = None) -> dict[str, Any]:
        """Chunks nearest to the query's vector."""
        checkout, views = self._view(cwd)
        vector = self._vector(query)
        return self._answer(checkout, views, search.semantic(views.chunks(), vector, limit)) if vector else {"results": []}

    def search_hybrid(self, query: str, cwd: str, limit: int | None = None) -> dict[str, Any]:
        """Full-text and semantic results fused by rank."""
        checkout, views = self._view(cwd)
        vector, limit = self._vector(query), search.check_limit(limit)
        pool = search.candidates(limit)
        text = views.fulltext(query, pool if vector else limit)
        return self._answer(checkout, views, search.fuse([search.semantic(views.chunks(), vector, pool), text], limit) if vector else text)

    def search_structural(self, symbol: str, relation: str, cwd: str) -> dict[str, Any]:
        """Symbols one relation away from those of a name, at most MOST_RESULTS."""
        _, views = self._view(cwd)
        return {"symbols": _rows(graph.related(views.symbols(), views.edges(), symbol, relation).limit(MOST_RESULTS))}

    # Knowledge

    def record_knowledge(self, title: str, body: str, repo_path: str, tags: list[str] | None = None, related_files: list[str] | None = None, id: str | None = None) -> dict[str, Any]:
        snap, now = self.catalog.snapshot(), _now()
        id = id or hashlib.sha256(f"{repo_path}\x1f{title}\x1f{body}".encode()).hexdigest()
        vector = self._vector(f"{title}\n{body}")
        note = {"id": id, "repo_path": repo_path, "title": title, "body": body, "tags": tags or [], "related_files": related_files or [], "created_at": now, "updated_at": now, "embedding": vector}
        new = self.spark.createDataFrame([Row(**note)], TABLES["knowledge"])
        self.catalog.commit(snap, {"knowledge": knowledge.upsert(snap.table("knowledge"), new)})
        return {"id": id}

    def search_knowledge(self, query: str, repo_path: str | None = None, limit: int | None = None) -> dict[str, Any]:
        notes = self.catalog.snapshot().table("knowledge")
        vector = self._vector(query)
        found = knowledge.hybrid(notes, query, vector, repo_path, limit, UNICODE) if vector else knowledge.fulltext(notes, query, repo_path, limit, UNICODE)
        return {"results": _rows(notes.drop("embedding").join(F.broadcast(found), "id").orderBy(F.desc("score"), "id"))}

    def delete_knowledge(self, id: str) -> dict[str, Any]:
        snap = self.catalog.snapshot()
        notes = snap.table("knowledge")
        gone = notes.where(F.col("id") == id).count()
        self.catalog.commit(snap, {"knowledge": notes.where(F.col("id") != id)})
        return {"deleted": gone > 0}

    def list_knowledge(self, repo_path: str | None = None, limit: int | None = None) -> dict[str, Any]:
        return {"results": _rows(knowledge.listed(self.catalog.snapshot().table("knowledge").drop("embedding"), repo_path, limit))}

    # Families and policies

    def register_family(self, path: str, name: str) -> dict[str, Any]:
        """Registers a root, of a Git repository its primary checkout with all its worktrees; one that is registered keeps its id."""
        snap, path = self.catalog.snapshot(), path.rstrip("/")
        found = git.discover(path) if os.path.isdir(path) else None
        kind, key = ("git", found.common_dir) if found is not None and found.root == path else ("path", path)
        if kind == "git":
            path = git.worktrees(path)[0].root
        families = snap.table("families")
        known = _rows(families.where((F.col("identity_kind") == kind) & (F.col("identity_key") == bytearray(key.encode())) & F.col("retired_at").isNull()))
        if known:
            return {"family_id": known[0]["family_id"], "created": False}
        family_id = hashlib.sha256(f"{path}\x1f{snap.number}".encode()).hexdigest()[:32]
        row = {"family_id": family_id, "name": name, "path": path, "identity_kind": kind, "identity_key": bytearray(key.encode()), "embedding_dim": self.backend.dim, "paused": False, "enabled": True, "ever_indexed": False, "indexed_at": None, "retired_at": None, "epoch": 0}
        ids = self.spark.createDataFrame([(family_id,)], "family_id string")
        chosen = policy.shipped(name) | {"embeddings": {"backend": "local", "model": None, "batch_size": 64}}
        policies = self._replace("policies", snap.table("policies"), ids, "family_id", [{"family_id": family_id, "revision": 1, "policy": json.dumps(chosen)}])
        self.catalog.commit(snap, {"families": self._replace("families", families, ids, "family_id", [row]), "policies": policies})
        self._reconcile(family_id)
        return {"family_id": family_id, "created": True}

    def _on_disk(self, family: dict[str, Any]) -> list[dict[str, Any]]:
        """root, git_dir, incarnation, is_base of a family's checkouts that are there."""
        if family["identity_kind"] != "git":
            return [{"root": family["path"], "git_dir": family["path"], "incarnation": None, "is_base": True}] if os.path.isdir(family["path"]) else []
        out = []
        for k, tree in enumerate(git.worktrees(family["path"])):
            if not tree.bare and (found := git.discover(tree.root)) is not None:
                out.append({"root": found.root, "git_dir": found.git_dir, "incarnation": None, "is_base": k == 0})
        return out

    def _reconcile(self, family_id: str) -> None:
        """Brings the registry of a family's checkouts up to what is on disk: new, moved, missing (for a time of grace) or retired."""
        snap, now = self.catalog.snapshot(), _now()
        family = self._family(snap, family_id)
        stored, found = self._checkouts(snap, family_id), {x["git_dir"]: x for x in self._on_disk(family)}
        have = self.spark.createDataFrame([Row(checkout_id=r["checkout_id"], git_dir=r["git_dir"], root=r["root"], incarnation=None) for r in stored], "checkout_id string, git_dir string, root string, incarnation string")
        there = self.spark.createDataFrame([Row(git_dir=x["git_dir"], root=x["root"], incarnation=None) for x in found.values()], "git_dir string, root string, incarnation string")
        rows = {r["checkout_id"]: dict(r) for r in stored}
        for r in registry.reconcile(have, there).collect():
            if r["verdict"] == "new":
                x = found[r["git_dir"]]
                id = hashlib.sha256(f"{family_id}\x1f{x['git_dir']}\x1f{snap.number}".encode()).hexdigest()[:32]
                rows[id] = {"checkout_id": id, "family_id": family_id, "root": x["root"], "git_dir": x["git_dir"], "state": "active", "is_base": x["is_base"], "indexed_at": None, "missing_since": None, "retired_at": None, "generation": None, "stamp": None, "problem": None}
                continue
            row = rows[r["checkout_id"]]
            if r["verdict"] == "missing":
                since = row["missing_since"] or now
                row["missing_since"] = since
                if now >= since + dt.timedelta(seconds=MISSING_S) and not row["is_base"]:
                    row |= {"state": "retired", "retired_at": now}
            else:
                row |= {"missing_since": None, "root": found[r["git_dir"]]["root"]}
        if list(rows.values()) != stored:
            ids = self.spark.createDataFrame([(x,) for x in rows], "checkout_id string")
            self.catalog.commit(snap, {"checkouts": self._replace("checkouts", snap.table("checkouts"), ids, "checkout_id", list(rows.values()))})
            for row in rows.values():
                if row["state"] == "retired":
                    self.store.drop_own(row["checkout_id"])

    def _policy(self, snap: Snapshot, family_id: str) -> tuple[int, dict[str, Any]]:
        rows = snap.table("policies").where(F.col("family_id") == family_id).orderBy(F.desc("revision")).limit(1).collect()
        if not rows:
            raise KeyError(f"no policy of {family_id}")
        return rows[0]["revision"], json.loads(rows[0]["policy"])

    def inspect_policy(self, family_id: str) -> dict[str, Any]:
        revision, own = self._policy(self.catalog.snapshot(), family_id)
        return {"revision": revision, "policy": own, "effective": policy.effective(own)}

    def check_policy(self, family_id: str, policy_json: dict[str, Any]) -> dict[str, Any]:
        _, own = self._policy(self.catalog.snapshot(), family_id)
        try:
            return {"valid": True, "impact": policy.impact(own, policy.validate(policy_json))}
        except policy.PolicyError as e:
            return {"valid": False, "field": e.field, "message": str(e)}

    def apply_policy(self, family_id: str, revision: int, policy_json: dict[str, Any]) -> dict[str, Any]:
        """Adds the next revision if `revision` still is the current one; a change of the selection asks for a new index."""
        snap = self.catalog.snapshot()
        current, own = self._policy(snap, family_id)
        if current != revision:
            return {"applied": False, "revision": current}
        change = policy.impact(own, policy.validate(policy_json))
        if change == "embedding_profile":
            return {"applied": False, "revision": current, "impact": change}
        row = self.spark.createDataFrame([Row(family_id=family_id, revision=current + 1, policy=json.dumps(policy_json))], TABLES["policies"])
        changes = {"policies": snap.table("policies").unionByName(row)}
        if change == "selection":
            hit = F.col("family_id") == family_id
            changes["families"] = snap.table("families").withColumn("indexed_at", F.when(~hit, F.col("indexed_at")))
        self.catalog.commit(snap, changes)
        return {"applied": True, "revision": current + 1, "impact": change}

    def preflight_family(self, family_id: str) -> dict[str, Any]:
        """What indexing a family would take, by metadata alone; says how far it came and what it passed by."""
        snap = self.catalog.snapshot()
        family, (_, own) = self._family(snap, family_id), self._policy(snap, family_id)
        rules = policy.effective(own)["index"]
        seen = walked(self.spark, family["path"], rules["exclude"], rules["vendor"], budget_s=PREFLIGHT_S)
        decided = seen.files()
        shown = {"tiers": _rows(inventory.tiers(decided)), "largest_files": _rows(inventory.largest_files(decided)), "directories": _rows(inventory.costly_directories(decided))}
        return {**shown, "visited_entries": seen.visited, "stop_reason": seen.stop_reason, **seen.counters(), **_rows(inventory.advice(decided, complete=seen.complete))[0]}

    def _flag(self, family_id: str, column: str, value: bool) -> dict[str, Any]:
        snap = self.catalog.snapshot()
        self._family(snap, family_id)
        hit = F.col("family_id") == family_id
        self.catalog.commit(snap, {"families": snap.table("families").withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))})
        return {"family_id": family_id, column: value}

    def start_family(self, family_id: str) -> dict[str, Any]:
        """Indexes a family, embeds what waits for a vector, and drops what no checkout sees any more."""
        out = self.reindex_family(family_id)
        if out["indexed"]:
            out["embedded"] = self.backfill_family(family_id)
            self.collect_garbage(family_id)
        return out

    def reindex_family(self, family_id: str, changed: list[str] | None = None) -> dict[str, Any]:
        """Brings every checkout of a family up to its tree; changed: absolute paths to look at, none for all."""
        self._reconcile(family_id)
        return self._index(family_id, None, changed)

    def _index(self, family_id: str, only: list[str] | None, changed: list[str] | None = None) -> dict[str, Any]:
        """Publishes checkouts, the base first; one that can't be leaves its last index as it was and names the reason."""
        snap = self.catalog.snapshot()
        family, (_, own) = self._family(snap, family_id), self._policy(snap, family_id)
        if family["paused"] or not family["enabled"]:
            return {"indexed": False, "reason": "paused"}
        rows = [r for r in self._checkouts(snap, family_id) if r["missing_since"] is None]
        base = next((r for r in rows if r["is_base"]), None)
        if only is not None:
            rows = [r for r in rows if r["checkout_id"] in only or r["is_base"] and r["generation"] is None]
        out: dict[str, Any] = {"indexed": False, "reason": "there is no checkout"}
        skipped, linked_done = [], []
        for row in rows:
            paths = None
            if changed is not None and row["generation"] is not None:
                paths = self._below(row["root"], changed, rows)
                if not paths:
                    continue
            try:
                done = self._publish(family_id, row, policy.effective(own)["index"], own["embeddings"]["batch_size"], paths)
            except (linked.Moved, RuntimeError) as e:
                reason = "changed while it was indexed" if isinstance(e, linked.Moved) else str(e)
                skipped.append({"root": row["root"], "reason": reason})
                continue
            if row is base:
                out = {"indexed": True, "files": done["files"], "chunks": done["chunks"]}
            else:
                linked_done.append({"root": row["root"], "files": done["files"], "new_files": done["new_files"]})
            if done["problems"]:
                out["problems"] = out.get("problems", []) + done["problems"]
        if not out["indexed"]:
            out = {"indexed": bool(linked_done) or changed is not None and not skipped, **({"reason": skipped[0]["reason"]} if skipped else {})}
        return out | ({"linked": linked_done} if linked_done else {}) | ({"skipped": skipped} if skipped else {})

    @staticmethod
    def _below(root: str, changed: list[str], rows: list[dict[str, Any]]) -> list[str]:
        """The changed paths of a checkout, relative to it; those of a checkout within it are that one's."""
        others = [r["root"] for r in rows if r["root"].startswith(root + "/")]
        mine = [p for p in changed if p.startswith(root + "/") and not any(p == o or p.startswith(o + "/") for o in others)]
        return sorted({p[len(root) + 1 :] for p in mine})

    def _publish(self, family_id: str, row: dict[str, Any], rules: dict[str, Any], batch: int, paths: list[str] | None) -> dict[str, Any]:
        snap = self.catalog.snapshot()
        family = self._family(snap, family_id)
        places = self._places(snap, family)
        place = places[row["checkout_id"]]
        checkout = git.discover(row["root"]) if family["identity_kind"] == "git" else None
        stamp = git.stamp(checkout) if checkout is not None else None
        done = linked.publish(self.store, place, row["root"], rules, self.backend, batch, snap.number + 1, [p for p in places.values() if not p.is_base], paths, self.parsed)
        if checkout is not None and git.stamp(checkout) != stamp:
            raise linked.Moved(row["root"])
        now, news = _now(), done["generations"]
        generation = F.coalesce(*[F.when(F.col("checkout_id") == k, F.lit(g)) for k, g in news.items()], F.col("generation")) if news else F.col("generation")
        hit, mine = F.col("checkout_id") == row["checkout_id"], F.col("family_id") == family_id
        checkouts = snap.table("checkouts").withColumns({"generation": generation.cast("long"), "indexed_at": F.when(hit, F.lit(now)).otherwise(F.col("indexed_at")), "stamp": F.when(hit, F.lit(stamp).cast("string")).otherwise(F.col("stamp")), "problem": F.when(~hit, F.col("problem"))})
        families = snap.table("families").withColumns({"indexed_at": F.when(mine & F.lit(row["is_base"]), F.lit(now)).otherwise(F.col("indexed_at")), "ever_indexed": mine | F.col("ever_indexed")})
        self.catalog.commit(snap, {"checkouts": checkouts, "families": families})
        for id in news:  # the generation before stays for requests that are being answered
            if (before := places[id].generation) is not None:
                self._drop_older(id, before)
        return done

    def _drop_older(self, checkout_id: str, than: int) -> None:
        for table in ("base", "deltas", "edges"):
            files, at = self.store._files(f"{self.store.root}/{table}/checkout_id={checkout_id}")
            for found in files.listStatus(at) if files.exists(at) else []:
                if int(found.getPath().getName().removeprefix("generation=")) < than:
                    files.delete(found.getPath(), True)

    def backfill_family(self, family_id: str) -> int:
        """Embeds all contents of a family that wait for a vector, batch by batch, while any batch gets one."""
        epoch, total = self._family(self.catalog.snapshot(), family_id)["epoch"] or 0, 0
        while got := linked.backfill(self.store, family_id, epoch, self.backend):
            total += got
        return total

    def collect_garbage(self, family_id: str, share: float = linked.GARBAGE) -> int | None:
        """Starts a family's next epoch without the versions that no checkout sees, if they are that share of all."""
        snap = self.catalog.snapshot()
        family = self._family(snap, family_id)
        places = list(self._places(snap, family).values())
        if not places:
            return None
        gone, every = linked.garbage(self.store, places)
        if not gone or gone < share * every:
            return None
        epoch = linked.collect_garbage(self.store, places)
        hit = F.col("family_id") == family_id
        self.catalog.commit(snap, {"families": snap.table("families").withColumn("epoch", F.when(hit, F.lit(epoch).cast("long")).otherwise(F.col("epoch")))})
        self.store.drop_shared(family_id, places[0].epoch)
        return epoch

    def watch(self, log: str, state: str, window_ms: int = changes.DEBOUNCE_MS):
        """A streaming query that reindexes what a log of change events names (events.read_events), for ever.

        A lost event, or one that can't be trusted to name all that changed, makes the whole family be looked at.
        """

        def apply(batch: DataFrame, _: int) -> None:
            live = {r["family_id"]: r for r in _rows(self.catalog.snapshot().table("families").where("retired_at IS NULL"))}
            wanted: dict[str, list[str] | None] = {}
            for r in batch.collect():  # drains of at most BATCH_PATHS paths
                odd = r["full_audit"] or any("/.git/" in p or p.endswith("/.git") or not p.startswith("/") or "/../" in p or os.path.isdir(p) for p in r["paths"])
                before = wanted.get(r["family_id"], [])
                wanted[r["family_id"]] = None if odd or before is None else [*before, *r["paths"]]
            for family_id, paths in wanted.items():
                if family_id in live:
                    self.reindex_family(family_id, paths)

        ids = [r["family_id"] for r in _rows(self.catalog.snapshot().table("families").where("retired_at IS NULL"))]
        stream = events.batched(events.read_events(self.spark, log), ids, window_ms)
        return stream.writeStream.foreachBatch(apply).option("checkpointLocation", state).start()

    def unregister_family(self, family_id: str) -> dict[str, Any]:
        snap = self.catalog.snapshot()
        self._family(snap, family_id)
        hit = F.col("family_id") == family_id
        self.catalog.commit(snap, {"families": snap.table("families").withColumn("retired_at", F.when(hit, F.lit(_now())).otherwise(F.col("retired_at")))})
        return {"family_id": family_id, "retired": True}

    def forget_repository(self, family_id: str) -> dict[str, Any]:
        """Deletes all that is stored of a family."""
        snap = self.catalog.snapshot()
        gone = _rows(snap.table("checkouts").where(F.col("family_id") == family_id).select("checkout_id"))
        self.catalog.commit(snap, {t: snap.table(t).where(F.col("family_id") != family_id) for t in ("families", "policies", "checkouts")})
        self.store.drop_shared(family_id)
        for row in gone:
            self.store.drop_own(row["checkout_id"])
        return {"family_id": family_id, "forgotten": True}

    def cancel_work(self, work_id: str) -> dict[str, Any]:
        snap = self.catalog.snapshot()
        work = snap.table("accepted_work")
        hit = work.where((F.col("work_id") == work_id) & (F.col("state") == "accepted")).count()
        ids = self.spark.createDataFrame([(work_id,)], "work_id string")
        self.catalog.commit(snap, {"accepted_work": registry.cancelled(work, ids)})
        return {"cancelled": hit > 0}

    def continue_request(self, receipt_id: str) -> dict[str, Any]:
        found = _rows(self.catalog.snapshot().table("receipts").where(F.col("receipt_id") == receipt_id).limit(1))
        return found[0] if found else {"receipt_id": receipt_id, "state": "unknown"}

    def inspect_status(self) -> dict[str, Any]:
        """Families, their checkouts, and how much of their chunks semantic search can see."""
        snap = self.catalog.snapshot()
        text = lambda c: F.col(c).cast("string").alias(c)
        shown = _rows(snap.table("families").select("family_id", "name", "path", "paused", "ever_indexed", text("indexed_at"), text("retired_at"), F.coalesce("epoch", F.lit(0)).alias("epoch")).orderBy("name", "family_id"))
        trees = _rows(snap.table("checkouts").select("checkout_id", "family_id", "root", "state", "is_base", text("indexed_at"), "problem").orderBy("family_id", "root"))
        chunks = self.spark.createDataFrame([], "embedding array<float>, embedding_state string")
        for f in shown:
            read = lambda t, f=f: self.store.shared(t, f["family_id"], f["epoch"])
            chunks = chunks.unionByName(linked.with_late_vectors(read("chunks"), read("late_vectors")).select("embedding", "embedding_state"))
        return {"version": snap.number, "families": shown, "checkouts": trees, "coverage": _rows(search.coverage(chunks))[0]}

    # Protocol

    def call(self, tool: str, arguments: dict[str, Any]) -> dict[str, Any]:
        """Runs a tool and logs its use: time taken and results, if it has any."""
        if tool not in self.tools:
            raise KeyError(f"unknown tool {tool}")
        began = time.monotonic()
        out = self.tools[tool](**arguments)
        results = out.get("results", out.get("symbols"))
        row = {"ts": _now(), "tool": tool, "repo_path": arguments.get("cwd") or arguments.get("repo_path"), "duration_ms": int((time.monotonic() - began) * 1000), "result_count": None if results is None else len(results)}
        self._log_use(row)
        return out

    def _log_use(self, row: dict[str, Any]) -> bool:
        """Appends a use to the log; one that can't be logged never fails the call it belongs to."""
        try:
            new = self.spark.createDataFrame([Row(id=time.time_ns(), **row)], TABLES["usage"])
            new.coalesce(1).write.mode("append").parquet(f"{self.store.root}/usage")
            return True
        except Exception:  # the answer matters more than the log
            return False

    def uses(self) -> DataFrame:
        """The log of uses."""
        return self.store._read(f"{self.store.root}/usage", TABLES["usage"])

    def described(self) -> list[dict[str, Any]]:
        """Name, description and input schema of each tool, by its parameters."""
        out = []
        for name, tool in self.tools.items():
            shown = [p for p in inspect.signature(tool).parameters.values() if p.kind is not p.VAR_KEYWORD]
            schema = {"type": "object", "properties": {p.name: _schema_of(p) for p in shown}, "required": [p.name for p in shown if p.default is p.empty]}
            about = (tool.__doc__ or name.replace("_", " ").capitalize() + ".").split("\n")[0]
            out.append({"name": name, "description": about, "inputSchema": schema})
        return out

    def serve(self, source: TextIO = sys.stdin, sink: TextIO = sys.stdout) -> None:
        """Answers JSON-RPC requests, one a line: initialize, ping, tools/list and tools/call.

        Notifications (no id) are taken and not answered.
        """
        for line in source:
            if not line.strip():
                continue
            request: dict[str, Any] = {}
            try:
                if not isinstance(parsed := json.loads(line), dict):
                    raise ValueError("a request is an object")
                request = parsed
                method = request.get("method", "")
                if "id" not in request and method.startswith("notifications/"):
                    continue
                if method == "initialize":
                    result: Any = {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "loamwork", "version": "0.1"}}
                elif method == "ping":
                    result = {}
                elif method == "tools/list":
                    result = {"tools": self.described()}
                elif method == "tools/call":
                    p = request.get("params", {})
                    result = {"content": [{"type": "text", "text": json.dumps(self.call(p.get("name", ""), p.get("arguments", {})), default=str)}]}
                else:
                    raise KeyError(f"unknown method {method}")
                answer = {"jsonrpc": "2.0", "id": request.get("id"), "result": result}
            except Exception as e:  # a failed request is an answer, not the end of the loop
                answer = {"jsonrpc": "2.0", "id": request.get("id"), "error": {"code": -32000, "message": str(e)}}
            print(json.dumps(answer, default=str), file=sink, flush=True)
