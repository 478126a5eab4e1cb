"""Change streams: debounced batches, full audits, the state machine of an index, and counts of repeated events.

The rules are pure functions over (state, events); module events has the stream, this one a replay of logged events.  A batch opens with its first event and closes a fixed time later, however many events follow.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DEBOUNCE_MS, AUDIT_S, BATCH_PATHS = 300, 300, 1024
KINDS = ("create", "modify", "remove")
#: State machine of an index: (state, event) -> state.
TRANSITIONS = {
    ("watching", "change"): "stale", ("stale", "change"): "stale", ("stale", "reindex"): "indexing", ("indexing", "success"): "indexed",
    ("indexing", "failure"): "stale", ("indexed", "settle"): "watching",
}


def step(state: str, event: str) -> str:
    """The next state; ValueError for an event that can't happen there."""
    if (state, event) not in TRANSITIONS:
        raise ValueError(f"{event} can't happen while {state}")
    return TRANSITIONS[state, event]


def batches(times_ms: list[int], window_ms: int = DEBOUNCE_MS) -> list[int]:
    """The number of each event's batch, for times in order."""
    out, opened, number = [], None, -1
    for t in times_ms:
        if opened is None or t >= opened + window_ms:
            opened, number = t, number + 1
        out.append(number)
    return out


def debounced(events: DataFrame, window_ms: int = DEBOUNCE_MS, key: str = "family_id") -> DataFrame:
    """key, batch, opened, paths of logged events (key, path, kind, ts): a replay of what a stream would have made.

    Batches of a key follow from one another, so a key's event times (not its paths) go through one group.
    """
    used = events.where(F.col("kind").isin(*KINDS))
    kind = events.schema[key].dataType.simpleString()

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ms")
        return pd.DataFrame({"k": pdf["k"], "ms": pdf["ms"], "batch": batches(pdf["ms"].tolist(), window_ms)})

    times = used.select(F.col(key).alias("k"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).distinct()
    numbered = times.groupBy("k").applyInPandas(number, f"k {kind}, ms long, batch long")
    rows = used.select(F.col(key).alias("k"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "path").join(numbered, ["k", "ms"])
    return rows.groupBy(F.col("k").alias(key), "batch").agg(F.timestamp_millis(F.min("ms")).alias("opened"), F.sort_array(F.collect_set("path")).alias("paths"))


def drained(paths: list[str], most: int = BATCH_PATHS) -> list[list[str]]:
    """A batch's distinct paths in order, in drains of at most `most`; the next drain goes on where one stopped."""
    rest = sorted(set(paths))
    return [rest[k : k + most] for k in range(0, len(rest), most)]


def needs_audit(events: DataFrame, known: DataFrame, git_dir: str = ".git", key: str = "family_id") -> DataFrame:
    """key, full_audit, paths: whether a batch's events can be trusted to name all that changed.

    An event in Git's directory, on the root, on a path that isn't plain, on a directory or above a known path
    calls for a full audit, as does a lost event (kind `overflow`).
    """
    parts = F.split(F.col("path"), "/")
    odd = F.exists(parts, lambda x: x.isin("", ".", "..")) | (F.col("path") == "")
    inside = (F.col("path") == git_dir) | F.startswith(F.col("path"), F.lit(git_dir + "/"))
    above = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("dir"), "path").where("dir <> path").select("dir").distinct()
    marked = events.join(above.withColumn("above", F.lit(True)), F.col("path") == F.col("dir"), "left")
    bad = odd | inside | F.coalesce("above", F.lit(False)) | (F.col("kind") == "overflow") | F.coalesce(F.col("is_dir"), F.lit(False))
    return marked.groupBy(key).agg(F.max(bad).alias("full_audit"), F.sort_array(F.collect_set("path")).alias("paths"))


class AuditSchedule:
    """When the next full audit is due; only a full audit that succeeds puts it off."""

    def __init__(self, now: float, every_s: float = AUDIT_S):
        self.every, self.due = every_s, now + every_s

    def select(self, changed: list[str] | None, now: float) -> list[str] | None:
        """The paths to look at, None for all."""
        return None if now >= self.due else changed

    def completed(self, full: bool, success: bool, now: float) -> None:
        if full and success:
            self.due = now + self.every


def repeated(events: DataFrame, fingerprint: str, seconds: int = 60) -> DataFrame:
    """window start, fingerprint, seen, suppressed: the first of equal events in a minute is shown, the rest counted."""
    w = F.window("ts", f"{seconds} seconds")
    return events.groupBy(w.alias("w"), F.col(fingerprint).alias("fingerprint")).agg(F.count("*").alias("seen")).select(F.col("w.start").alias("window_start"), "fingerprint", "seen", (F.col("seen") - 1).alias("suppressed"))


class Suppressor:
    """Repeated-event counts with the least recently seen of `most` fingerprints dropped first."""

    def __init__(self, most: int = 1024):
        self.most = most
        self.counts: dict[int, int] = {}

    def observe(self, fingerprint: int) -> tuple[bool, tuple[int, int] | None]:
        """(whether to show the event, what was dropped for it)."""
        if fingerprint in self.counts:
            self.counts[fingerprint] = self.counts.pop(fingerprint) + 1
            return False, None
        dropped = None
        if len(self.counts) >= self.most:
            oldest = next(iter(self.counts))
            dropped = oldest, self.counts.pop(oldest)
        self.counts[fingerprint] = 0
        return True, dropped

    def drain(self) -> list[tuple[int, int]]:
        """Repeats since the last drain."""
        out = [(k, n) for k, n in self.counts.items() if n]
        self.counts = dict.fromkeys(self.counts, 0)
        return out


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("n = 1").drop("n")
