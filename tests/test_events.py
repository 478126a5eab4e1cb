"""The stream of change events: offsets, restarts, and batches by each family's own timer."""

import datetime as dt
import json
import time

import pytest

from loamwork.streaming import events


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(key, before) if before else spark.conf.unset(key)


def line(family, path, kind="modify", ms=0):
    return json.dumps({"family_id": family, "path": path, "kind": kind, "ts_ms": ms}) + "\n"


def test_three_thousand_events_come_in_three_drains_and_none_is_lost(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    (log / "0001.jsonl").write_text("".join(line("f", f"p{k}") for k in range(1500)))
    (log / "0002.jsonl").write_text("".join(line("f", f"p{k}") for k in range(1500, 3000)) + '{"family_id": "f", "pa')
    seen, fail = {}, {1}

    def take(df, number):
        seen[number] = [r["path"] for r in df.collect()]
        if number in fail:
            fail.discard(number)
            raise RuntimeError("lost")

    def start():
        return events.read_events(spark, str(log)).writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "state")).start()

    q = start()
    with pytest.raises(Exception):  # noqa: B017, PT011
        q.processAllAvailable()
    q.stop()
    assert sorted(seen) == [0, 1]
    q = start()  # the batch that failed comes again
    try:
        q.processAllAvailable()
        assert [len(seen[k]) for k in sorted(seen)] == [1024, 1024, 952]
        with (log / "0002.jsonl").open("a") as f:
            f.write('th": "p3000", "kind": "modify", "ts_ms": 1}\nno event\n')
        q.processAllAvailable()
    finally:
        q.stop()
    every = [p for k in sorted(seen) for p in seen[k]]
    assert every == [f"p{k}" for k in range(3001)] + [None]


def test_every_family_has_its_own_timer(spark, rocks, tmp_path):
    """Out-of-order families, the first events of a slow one, old event times and a source that falls silent: all come out."""
    log = tmp_path / "log"
    log.mkdir()
    (log / "1.jsonl").write_text(line("a", "x", ms=20_000) + line("b", "y", ms=21_000) + line("a", "x", ms=20_001) + line("a", "no", "access"))
    stream = events.batched(events.read_events(spark, str(log)), ["a", "b", "c"], window_ms=200)
    q = stream.writeStream.format("memory").queryName("batched").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()

    def rows(want):
        until = time.monotonic() + 60
        while time.monotonic() < until:
            found = [(r["family_id"], r["paths"], r["full_audit"], r["state"]) for r in spark.sql("SELECT * FROM batched ORDER BY closed_ms, family_id, drain").collect()]
            if len(found) >= want:
                return found
            time.sleep(0.3)
        raise AssertionError(found)

    try:
        assert sorted(rows(2)) == [("a", ["x"], False, "stale"), ("b", ["y"], False, "stale")]
        (log / "2.jsonl").write_text(line("b", "late", ms=7_000) + line("c", "first", ms=8_000) + "".join(line("c", f"p{k:04}") for k in range(2000)))
        found = rows(5)[2:]
        assert ("b", ["late"], False, "stale") in found
        assert [len(p) for f, p, *_ in found if f == "c"] in ([1024, 977], [1023, 977, 1]) or sum(len(p) for f, p, *_ in rows(6) if f == "c") == 2001
        (log / "3.jsonl").write_text("broken\n" + line("a", "z"))
        late = [x for x in rows(8) if x[2]]
        assert {f for f, *_ in late} == {"a", "b", "c"}
    finally:
        q.stop()


def test_places_in_the_log(tmp_path):
    log = tmp_path / "log"
    reader = events._Reader(str(log), 2)
    assert list(reader.read(reader.initialOffset())[0]) == []  # no folder yet
    log.mkdir()
    (log / "a.jsonl").write_text(line("f", "1") + "\n" + line("f", "2") + line("f", "3"))
    (log / "other.txt").write_text(line("f", "no"))
    rows, at = reader.read(reader.initialOffset())
    assert [r[1] for r in rows] == ["1", "2"]
    more, end = reader.read(at)
    assert [r[1] for r in more] == ["3"]
    assert [r[1] for r in reader.readBetweenOffsets(reader.initialOffset(), end)] == ["1", "2", "3"]
    assert list(reader.read(end)[0]) == [] and reader.read(end)[1] == end
    assert events._event(line("f", "p", ms=1500).encode())[3] == dt.datetime(1970, 1, 1, 0, 0, 1, 500_000)
    for bad in (b"[]", b"1", b'{"family_id": 1, "path": "p", "kind": "k", "ts_ms": 1}', b"\xff"):
        assert events._event(bad)[2] == "overflow"
