"""WARC archives: writing pages with deduplication and segmentation, and reassembling them.

Archives are gzipped WARC/1.1 files written by Spark's text writer with the record terminator as line separator,
so they may lie in any store that Spark can write.  A long block is cut into segments: the first record carries
WARC-Segment-Number 1, each continuation its number and WARC-Segment-Origin-ID, and the last the total length.
Readers parse by Content-Length, group segments by origin, order them by number, check the numbers and the total
length, and undo the chunked transfer coding of the HTTP message within.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "\r\n\r\n"
#: Payloads shorter than this are never revisits.
LEAST_REVISIT = 100
#: A block longer than this is cut; a chunk of the transfer coding is at most so long.
SEGMENT_BYTES, CHUNK_BYTES = 16_384, 4_096
#: With segments this bounds a file to about 64 MB; readers hold one file at a time.
RECORDS_PER_FILE = 4_000
DATE = "2024-01-01T00:00:00Z"
RECORDS = "origin string, number int, total long, kind string, uri string, page_id string, refers_to string, block binary, payload_bytes long, payload_digest string"


def _cuts(data: bytes, size: int) -> Iterator[bytes]:
    """Parts of at most `size` bytes (size >= 4) that don't split a UTF-8 character."""
    at = 0
    while at < len(data):
        end = min(at + size, len(data))
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        yield data[at:end]
        at = end


def http_message(payload: bytes) -> bytes:
    """An HTTP response with the payload in chunked transfer coding."""
    chunks = b"".join(b"%x\r\n%s\r\n" % (len(x), x) for x in _cuts(payload, CHUNK_BYTES))
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunks + b"0\r\n\r\n"


def http_payload(message: bytes) -> bytes:
    """The payload of an HTTP response, its transfer coding undone; a malformed message raises ValueError."""
    head, found, body = message.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the HTTP headers")
    fields = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:]))
    if fields.get(b"transfer-encoding", b"").lower() != b"chunked":
        return body
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if size == 0:
            return b"".join(parts)
        data = body[end + 2 : end + 2 + size]
        if len(data) != size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk is cut short")
        parts.append(data)
        at = end + 4 + size


def _record(fields: list[tuple[str, object]], block: bytes) -> str:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n{block.decode()}"


def _clean(url: str | None) -> str:
    return "".join(x for x in url or "" if x >= " ")


def records(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, row: int | None = None) -> Iterator[str]:
    """The records of a page, each without its terminator.  row: a number of its own for each row, part of the names."""
    name = f"page:{page_id}" if row is None else f"page-null:{row}" if page_id is None else f"page-row:{row}:{page_id}"
    origin = f"<urn:{name}>"
    fields = [("WARC-Date", DATE), ("WARC-Target-URI", _clean(url)), *([] if page_id is None else [("WARC-Page-ID", page_id)]), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", len(payload))]
    if refers_to is not None:
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", origin), *fields, ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("Content-Type", "application/http; msgtype=response")], b"HTTP/1.1 200 OK\r\n\r\n")
        return
    message = http_message(payload)
    parts = list(_cuts(message, SEGMENT_BYTES))
    for n, part in enumerate(parts, 1):
        more = [("WARC-Segment-Number", n)] if len(parts) > 1 else []
        if n == len(parts) > 1:
            more.append(("WARC-Segment-Total-Length", len(message)))
        if n == 1:
            yield _record([("WARC-Type", "response"), ("WARC-Record-ID", origin), *fields, *more, ("Content-Type", "application/http; msgtype=response")], part)
        else:
            yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:{name}:{n}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", origin), *more], part)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", each_row: bool = False) -> None:
    """Writes a WARC record (or its segments) per row of pages under `path`.

    Of equal payloads of at least LEAST_REVISIT bytes the row with the smallest id is the response and the others
    are revisits of it.  A null html is an empty payload, a null url an empty field; a null id raises an error,
    as a record needs its name.  Rows that repeat an id whole are one record; ids with different pages raise an
    error when they are read.  With `each_row` every row is a page of its own, those that repeat an id and those with a
    null id too; WARC-Refers-To then names the page (WARC-Page-ID), as several records may have it.  Other columns are ignored; an empty table gives an archive without records.
    The payloads don't move: only digests are grouped, and their copies are counted before the shuffle.
    """
    key = F.col(id_col) if each_row else F.when(F.col(id_col).isNotNull(), F.col(id_col)).otherwise(F.raise_error(F.lit("page_id is null")))
    rows = pages.select(key.alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    first = rows.where(F.octet_length("html") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("same"), "first")
    marked = rows.join(first, F.col("digest") == F.col("same"), "left").select("id", "url", "html", "digest", F.when(F.col("first") != F.col("id"), F.col("first")).cast("string").alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [x for i, url, html, digest, refers, row in zip(*(c.to_pylist() for c in batch.columns), strict=True) for x in records(i, url, html.encode(), digest, refers, row)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    row = F.monotonically_increasing_id() if each_row else F.lit(None).cast("long")
    texts = marked.withColumn("id", F.col("id").cast("string")).withColumn("row", row).mapInArrow(run, "value string")
    texts.write.option("compression", "gzip").option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Fields (names in lower case) and block of each record of an archive, plain or gzipped."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start, size = end + 4, int(fields["content-length"])
        if data[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} is cut short")
        yield fields, data[start : start + size]
        at = start + size + 4


def _page(name: str | None) -> str | None:
    if name is None or name.startswith("<urn:page-null:"):
        return None
    name = name.removesuffix(">")
    return name.split(":", 3)[3] if name.startswith("<urn:page-row:") else name.removeprefix("<urn:page:")


def _described(fields: dict[str, str], block: bytes, keep: bool) -> dict:
    kind = fields["warc-type"]
    origin = fields.get("warc-segment-origin-id") or fields["warc-record-id"]
    total = fields.get("warc-segment-total-length")
    row = dict.fromkeys(_ARROW.names) | {"origin": origin, "number": int(fields.get("warc-segment-number", 0)), "total": total and int(total)}
    if kind != "continuation":
        row |= {"kind": kind, "uri": fields.get("warc-target-uri"), "page_id": _page(fields["warc-record-id"]), "refers_to": _page(fields.get("warc-refers-to"))}
    if kind == "revisit":
        return row | {"payload_bytes": int(fields["warc-payload-length"]), "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:")}
    if row["number"] or keep:
        return row | {"block": block}
    payload = http_payload(block)
    return row | {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


_ARROW = pa.schema([("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("kind", pa.string()), ("uri", pa.string()), ("page_id", pa.string()), ("refers_to", pa.string()), ("block", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def read_archives(files: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Pages of archives: page_id (string), uri, record_type, refers_to, payload_bytes, payload_digest[, payload].

    `files` has the column content (Spark's binaryFile source).  Segments are grouped by origin, ordered by number
    and joined; a gap or repeat in the numbers, a wrong total length, a missing first or last segment or bad
    framing raises an error.  Only segments move in the shuffle, unsegmented records as a digest alone unless the
    payload is kept.  A group is one page's segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows, size = [], 0
                for fields, block in parse(data.as_py()):
                    rows.append(_described(fields, block, keep_payload))
                    size += len(rows[-1]["block"] or b"")
                    if len(rows) >= 4096 or size > 1 << 24:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _ARROW)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                parts = row.pop("parts")
                if parts:
                    segmented = parts[-1]["number"] > 0
                    block = b"".join(x["block"] for x in parts)
                    if row["kind"] is None or segmented and ([x["number"] for x in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block)) or not segmented and len(parts) > 1:
                        raise ValueError(f"the segments of {row['page_id']} don't make a whole record")
                    payload = http_payload(block)
                    row |= {"payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}
                    if keep_payload:
                        row["payload"] = payload
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, pages)

    pages = pa.schema([(k, pa.int64() if k == "payload_bytes" else pa.string()) for k in ("page_id", "kind", "uri", "refers_to", "payload_bytes", "payload_digest")] + [("payload", pa.binary())] * keep_payload)
    found = files.select("content").mapInArrow(run, RECORDS)
    first = [F.max(x).alias(x) for x in ("page_id", "kind", "uri", "refers_to", "payload_bytes", "payload_digest")]
    # Rows that repeat an id whole repeat its records; the set of them is one record.
    parts = F.sort_array(F.collect_set(F.when(F.col("block").isNotNull(), F.struct("number", "total", "block")))).alias("parts")
    whole = found.groupBy("origin").agg(*first, parts).drop("origin").mapInArrow(join, "page_id string, kind string, uri string, refers_to string, payload_bytes long, payload_digest string" + ", payload binary" * keep_payload)
    return whole.withColumnRenamed("kind", "record_type")
