"""Policies: validation, layering, impact of a change, and the fleet's decision table."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.glob import EXCLUDE_DEFAULTS, VENDOR_DEFAULTS, compile_rules

# Backends with their models, and limits.
MODELS: dict[str, str | None] = {"local": None, "voyage": "voyage-code-3", "openai": "text-embedding-3-small"}
DIMENSIONS = {"local": 512, "voyage": 1024, "openai": 1536}
MOST_EXACT, MOST_BATCH = 2**53 - 1, 2**32 - 1
_KEYS = {"name", "index", "watcher", "embeddings"}


class PolicyError(ValueError):
    """A rule that a policy breaks; field names the place."""

    def __init__(self, field: str, message: str):
        super().__init__(f"{field}: {message}")
        self.field = field


def shipped(name: str) -> dict[str, Any]:
    return {"name": name, "index": {"exclude": [], "vendor": []}, "watcher": {"debounce_ms": 300}, "embeddings": {"backend": "voyage", "model": MODELS["voyage"], "batch_size": 64}}


def defaults() -> dict[str, Any]:
    return {"index": {"exclude": list(EXCLUDE_DEFAULTS), "vendor": list(VENDOR_DEFAULTS)}}


def validate(policy: dict[str, Any]) -> dict[str, Any]:
    """The policy, or PolicyError: exact keys, ranges, a supported backend with its model, compilable rules."""

    def exact(value: Any, keys: set[str], field: str) -> None:
        if not isinstance(value, dict) or set(value) != keys:
            raise PolicyError(field, f"must have exactly {', '.join(sorted(keys))}")

    def whole(value: Any, low: int, high: int, field: str) -> None:
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise PolicyError(field, f"must be a whole number from {low} to {high}")

    exact(policy, _KEYS, "policy")
    exact(policy["index"], {"exclude", "vendor"}, "index")
    exact(policy["watcher"], {"debounce_ms"}, "watcher")
    exact(policy["embeddings"], {"backend", "model", "batch_size"}, "embeddings")
    if not isinstance(policy["name"], str) or not policy["name"].strip() or "\0" in policy["name"]:
        raise PolicyError("name", "must not be empty or contain NUL")
    whole(policy["watcher"]["debounce_ms"], 0, MOST_EXACT, "watcher.debounce_ms")
    whole(policy["embeddings"]["batch_size"], 1, MOST_BATCH, "embeddings.batch_size")
    e = policy["embeddings"]
    if e["backend"] not in MODELS or e["model"] != MODELS[e["backend"]]:
        raise PolicyError("embeddings.model", "is not a supported selection")
    for axis in ("exclude", "vendor"):
        rules = policy["index"][axis]
        if not isinstance(rules, list) or not all(isinstance(x, str) for x in rules):
            raise PolicyError(f"index.{axis}", "must be a list of rules")
        try:
            compile_rules(rules)
        except ValueError as err:
            raise PolicyError(f"index.{axis}", str(err)) from None
    return policy


def parse(text: str) -> dict[str, Any]:
    return validate(json.loads(text))


def effective(policy: dict[str, Any], base: dict[str, Any] | None = None) -> dict[str, Any]:
    """The policy with the default rules in front of its own."""
    base = base or defaults()
    return policy | {"index": {axis: [*base["index"][axis], *policy["index"][axis]] for axis in ("exclude", "vendor")}}


def impact(old: dict[str, Any], new: dict[str, Any]) -> str:
    """The gravest kind of change: embedding_profile, selection, runtime or display."""
    a, b = old["embeddings"], new["embeddings"]
    if (a["backend"], a["model"]) != (b["backend"], b["model"]):
        return "embedding_profile"
    if old["index"] != new["index"]:
        return "selection"
    if old["watcher"] != new["watcher"] or a["batch_size"] != b["batch_size"]:
        return "runtime"
    return "display"


def impact_column(backend: tuple[Column, Column], model: tuple[Column, Column], rules: tuple[Column, Column], runtime: tuple[Column, Column]) -> Column:
    """impact() over pairs of old and new columns."""
    differ = lambda x: ~x[0].eqNullSafe(x[1])
    return F.when(differ(backend) | differ(model), "embedding_profile").when(differ(rules), "selection").when(differ(runtime), "runtime").otherwise("display")


def fleet_decision() -> Column:
    """What the daemon does with a family: the first case that holds.

    Columns: missing (retired, pending or present), paused, enabled, stored_dim, configured_dim, indexed, ever_indexed,
    has_policy, preempt_requested, in_flight, locked.
    """
    return (
        F.when(F.col("missing") == "retired", "retire").when(F.col("missing") == "pending", "wait_missing").when(F.col("paused"), "skip_paused")
        .when(~F.col("enabled"), "skip_disabled").when(F.col("stored_dim") != F.col("configured_dim"), "skip_dimension")
        .when(~F.col("indexed") & ~F.col("ever_indexed") & ~F.col("has_policy"), "skip_never_indexed").when(~F.col("indexed") & F.col("preempt_requested"), "skip_foreground")
        .when(~F.col("indexed") & F.col("in_flight"), "skip_in_flight").when(~F.col("indexed") & F.col("locked"), "skip_locked").when(~F.col("indexed"), "reindex").otherwise("backfill_and_watch")
    )


def missing_state(now: Column, grace_s: int = 60) -> Column:
    """present, pending or retired by missing_since: a path must be gone for the whole grace time."""
    since = F.col("missing_since")
    return F.when(since.isNull(), "present").when(now >= since + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(grace_s))), "retired").otherwise("pending")


def rule_table(df_session, layers: list[tuple[str, list[str]]]) -> DataFrame:
    """origin, position, rule of layered rules, in effect order."""
    rows = [(n, origin, k, rule) for n, (origin, k, rule) in enumerate((o, k, r) for o, rules in layers for k, r in enumerate(rules))]
    return df_session.createDataFrame(rows, "ord int, origin string, position int, rule string")
