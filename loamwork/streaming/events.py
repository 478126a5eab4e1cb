"""Change events as a streaming source, and batches of them by a timer for each family.

Watchers append events as JSON lines to files of a folder.  The source hands them on in the order of the files' names, at
most so many a micro-batch, and its offsets are places in those files: what a restart finds in the checkpoint is read
again, what comes later is read once.  Nothing is dropped: a line that can't be read comes as a lost event, which calls
for a full audit of every family.

A family's batch opens with its first event and closes a fixed time later by the clock, however many events follow and
however quiet other families and the source are.  No event is too late, as no event time is compared.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from .changes import BATCH_PATHS, DEBOUNCE_MS, KINDS, drained, step

SOURCE = "change_events"
SCHEMA = "family_id string, path string, kind string, ts timestamp_ntz"
BATCH_SCHEMA = "family_id string, opened_ms long, closed_ms long, drain int, full_audit boolean, paths array<string>, state string"
#: Bytes of a file looked at for one micro-batch, at most.
_READ_BYTES = 8 << 20


def _event(line: bytes) -> tuple[Any, ...]:
    """A row of SCHEMA; kind overflow of no family for a line that isn't an event."""
    try:
        x = json.loads(line)
        row = (x["family_id"], x["path"], x["kind"], pd.Timestamp(int(x["ts_ms"]), unit="ms").to_pydatetime())
        if isinstance(row[0], str) and isinstance(row[1], str) and isinstance(row[2], str):
            return row
    except (ValueError, KeyError, TypeError, OverflowError):
        pass
    return (None, None, "overflow", None)


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are {"file": name, "at": byte}; a line counts once it has its line feed."""

    def __init__(self, path: str, most: int):
        from pyarrow import fs

        self.store, self.root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        self.most = most

    def initialOffset(self) -> dict[str, Any]:
        return {"file": "", "at": 0}

    def _files(self) -> dict[str, int]:
        from pyarrow import fs

        found = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return {f.base_name: f.size for f in sorted(found, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith(".jsonl")}

    def _lines(self, start: dict[str, Any], stop: dict[str, Any] | None) -> Iterator[tuple[bytes, dict[str, Any]]]:
        for name, size in self._files().items():
            if name < start["file"] or (stop is not None and name > stop["file"]):
                continue
            at = start["at"] if name == start["file"] else 0
            end = stop["at"] if stop is not None and name == stop["file"] else size
            with self.store.open_input_file(f"{self.root}/{name}") as f:
                while at < end:
                    f.seek(at)
                    block = f.read(min(_READ_BYTES, end - at))
                    whole = block.rfind(b"\n") + 1
                    if not whole:
                        if len(block) < _READ_BYTES:
                            break  # a line that isn't finished
                        whole = len(block)  # longer than any event: it can't be read, and comes as lost
                    for line in block[:whole].split(b"\n")[: None if whole == len(block) and block[-1:] != b"\n" else -1]:
                        at += len(line) + 1
                        yield line, {"file": name, "at": min(at, end)}

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple[Any, ...]], dict[str, Any]]:
        rows: list[tuple[Any, ...]] = []
        for line, after in self._lines(start, None):
            if line.strip():
                rows.append(_event(line))
            start = after
            if len(rows) >= self.most:
                break
        return iter(rows), start

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple[Any, ...]]:
        return iter([_event(line) for line, _ in self._lines(start, end) if line.strip()])

    def commit(self, end: dict[str, Any]) -> None:
        pass  # files are their writers'


class ChangeEvents(DataSource):
    """Options: path, the folder; most, the events of a micro-batch (BATCH_PATHS)."""

    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:
        return _Reader(self.options["path"], int(self.options.get("most", BATCH_PATHS)))


def read_events(spark: SparkSession, path: str, most: int = BATCH_PATHS) -> DataFrame:
    """A stream of the events in a folder."""
    spark.dataSource.register(ChangeEvents)
    return spark.readStream.format(SOURCE).option("path", path).option("most", most).load()


class _Debounce(StatefulProcessor):
    """A family's open batch: when it opened, its paths, and whether something was lost.  The machine is watching, then
    stale from the first event on, and stays stale until the batch it gives out is indexed."""

    def __init__(self, window_ms: int, most: int):
        self.window_ms, self.most = window_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.opened = handle.getValueState("opened", "ms long, lost boolean, state string")
        self.paths = handle.getMapState("paths", "path string", "seen boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        ms, lost, state = self.opened.get() if self.opened.exists() else (None, False, "watching")
        seen = False
        for part in rows:
            for path, kind in zip(part["path"], part["kind"], strict=True):
                if kind == "overflow":
                    seen = lost = True
                elif kind in KINDS:
                    seen = True
                    self.paths.updateValue((path,), (True,))
        if seen:
            if ms is None:
                ms, state = now, step(state, "change")
                self.handle.registerTimer(now + self.window_ms)
            self.opened.update((ms, lost, state))
        return iter([])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if not self.opened.exists():
            return
        ms, lost, state = self.opened.get()
        parts = drained([k[0] for k in self.paths.keys()], self.most) or [[]]
        self.opened.clear()
        self.paths.clear()
        closed = expiredTimerInfo.getExpiryTimeInMs()
        yield pd.DataFrame({"family_id": [key[0]] * len(parts), "opened_ms": [ms] * len(parts), "closed_ms": [closed] * len(parts), "drain": range(len(parts)), "full_audit": [lost] * len(parts), "paths": parts, "state": [state] * len(parts)})

    def close(self) -> None:
        pass


def batched(events: DataFrame, families: list[str] | None = None, window_ms: int = DEBOUNCE_MS, most: int = BATCH_PATHS) -> DataFrame:
    """Batches of a stream of events (SCHEMA), rows of BATCH_SCHEMA: a batch comes in drains of at most `most` paths.

    A lost event of no family goes to all of `families`, if they are given.  Needs the RocksDB state store.
    """
    from pyspark.sql import functions as F

    own = events.where("family_id IS NOT NULL")
    if families:
        lost = events.where("family_id IS NULL AND kind = 'overflow'").withColumn("family_id", F.explode(F.array(*[F.lit(x) for x in families])))
        own = own.unionByName(lost)
    return own.select("family_id", "path", "kind").groupBy("family_id").transformWithStateInPandas(_Debounce(window_ms, most), BATCH_SCHEMA, "Append", "ProcessingTime")
