import hashlib
import random

import pytest

from loamwork.llm import warc
from loamwork.llm.common import Workspace


def through(spark, pages, keep=False):
    ws = Workspace(spark, "warc-test")
    warc.write_archives(pages, ws.path("a"))
    return warc.read_archives(spark.read.format("binaryFile").load(ws.path("a")), keep)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, digest string")


def test_archives_round_trip(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("aé€😀\r\n ") for _ in range(60_000))
    texts = ["", None, "short", "short", "x" * 99, "x" * 99, "y" * 100, "y" * 100, long, long, "a\r\n\r\nWARC/1.1\r\n" * 20, "€" * 20_000, "0\r\n\r\n", "z" * 16_384]
    pages = [(k * 5 % 17, f"http://h/{k}\r\nX: y" if k % 3 else None, t) for k, t in enumerate(texts)]
    got = {int(r["page_id"]): r for r in through(spark, frame(spark, pages), True).collect()}
    assert len(got) == len(pages)
    for i, _, t in pages:
        data = (t or "").encode()
        twin = min(j for j, _, x in pages if (x or "") == (t or ""))
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        revisit = len(data) >= 100 and twin != i
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (str(twin) if revisit else None)
        if not revisit:
            assert bytes(r["payload"]) == data


def test_edges(spark):
    assert through(spark, frame(spark, [])).count() == 0
    assert through(spark, frame(spark, [(1, "u", "p" * 200)] * 3)).select("page_id", "record_type").collect() == [("1", "response")]
    with pytest.raises(Exception, match="page_id is null"):
        through(spark, frame(spark, [(None, "u", "p")]))


def test_each_row_is_a_page(spark, tmp_path):
    import duckdb

    from loamwork.llm import queries

    long = "€" * 20_000
    rows = [(1, "u", "p" * 200)] * 3 + [(2, "u", long), (2, "u", long + "x"), (2, "v", "p" * 200), (None, "u", "q"), (None, "u", "q"), (None, "u", long), (5, None, None), (6, "u", long)]
    frame(spark, rows).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.op5_warc(spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    assert len(got) == len(rows) and sorted(got, key=str) == sorted(con.execute(queries.OP5_SQL).fetchall(), key=str)


def test_broken_archives_raise(spark, tmp_path):
    payload = b"q" * 40_000
    whole = list(warc.records("7", "u", payload, hashlib.sha256(payload).hexdigest(), None))
    assert len(whole) == 3
    for name, records in {"gap": [whole[0], whole[2]], "no_end": whole[:2], "no_start": whole[1:], "twice": [*whole, whole[1].replace("q", "r", 1)]}.items():
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.warc").write_bytes("".join(r + warc.END for r in records).encode())
        with pytest.raises(Exception, match="whole record|twice|cut short"):
            warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path / name))).collect()
    (tmp_path / "ok").mkdir()
    for k, r in enumerate(reversed(whole)):
        (tmp_path / "ok" / f"{k}.warc").write_bytes((r + warc.END).encode())
    assert warc.read_archives(spark.read.format("binaryFile").load(str(tmp_path / "ok"))).select("payload_bytes").collect() == [(40_000,)]
    with pytest.raises(ValueError):
        list(warc.parse(whole[0].encode()))
    with pytest.raises(ValueError):
        warc.http_payload(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab")
    assert warc.http_payload(b"HTTP/1.1 200 OK\r\n\r\nplain") == b"plain"
