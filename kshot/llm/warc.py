"""Operator 1, WARC archives: writing with deduplication, and reading with segment reassembly.

Writer: one record per page.  Of pages with equal payloads (of at least ``min_bytes`` bytes) the one with
the largest id is the response, the others are revisit records that name it; the payload is sent in chunked
transfer framing; a record block over ``segment_bytes`` is cut into a first record and continuations
(``WARC-Segment-Number``, ``WARC-Segment-Origin-ID``, the total length on the last).  Spark's text writer
stores the records (a WARC record ends with two line breaks, which is the line separator) as gzip files of
at most ``records_per_file`` records, with its usual commit, on any Hadoop file system.

Reader: files are inflated and cut by ``Content-Length`` inside tasks.  Whole records are decoded where they
are read; only segments are shuffled: grouped by origin id, ordered by segment number, checked for gaps and
for the total length, then decoded.  A group is one record.  Every payload's SHA-1 is compared with the header.

``status``: ok, gap (missing or repeated segment), length (total length differs), framing (bad chunked
framing), digest (payload digest differs), other (a record type besides response and revisit), header (no usable
length: the rest of the file cannot be cut and is skipped), truncated (the file ends inside the record or its gzip
stream), gzip (damaged stream); records that are not ok keep their row, without a payload.  Archives from elsewhere
are read as well: ``record_id`` holds any record id, ``page_id`` is null unless the id is one of the writer's, and a
record without a base32 SHA-1 payload digest is taken as it is.

Edge cases: a null html is an empty payload; a null id is written as ``null`` and read back as null, and it
is never the largest of its group unless all are null; rows with the group's largest id are all responses;
record ids carry a row number, so repeated rows stay apart; header values lose line breaks; an empty table
gives an archive without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from kshot.llm.common import map_batches
from kshot.session import staged

SEGMENT, PER_FILE, CHUNK = 32_768, 2_000, 8_192
CRLF = b"\r\n"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i:i + size]), payload[i:i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunk(body: bytes) -> bytes | None:
    """Payload of a chunked body (extensions and trailers allowed), None if the framing is broken."""
    out, at = [], 0
    while True:
        stop = body.find(CRLF, at)
        if stop < 0:
            return None
        size = body[at:stop].split(b";", 1)[0].strip()
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return None
        n, at = int(size, 16), stop + 2
        if n == 0:
            return b"".join(out) if body[at:at + 2] == CRLF or body.endswith(b"\r\n\r\n") else None
        if body[at + n:at + n + 2] != CRLF:
            return None
        out.append(body[at:at + n])
        at += n + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without its closing pair of line breaks."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def page_records(page_id, url, payload: bytes, winner, revisit: bool, row: int, segment_bytes: int) -> list[bytes]:
    name = f"<urn:page:{'null' if page_id is None else page_id}:{row}>"
    target = re.sub(r"[\r\n]+", " ", url or "")
    head = [("WARC-Target-URI", target), ("WARC-Date", "2000-01-01T00:00:00Z"),
            ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
            ("Content-Type", "application/http; msgtype=response")]
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisit:
        block = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode()
        return [_record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), ("WARC-Refers-To", f"<urn:page:{winner}>"),
                         ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), *head], block)]
    block = f"{http}Transfer-Encoding: chunked\r\n\r\n".encode() + chunked(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *head]
    if len(block) <= segment_bytes:
        return [_record(first, block)]
    cuts = [block[i:i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([*first, ("WARC-Segment-Number", "1")], cuts[0])]
    for i, part in enumerate(cuts[1:], 2):
        last = [("WARC-Segment-Total-Length", str(len(block)))] if i == len(cuts) else []
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", name[:-1] + f":{i}>"),
                            ("WARC-Target-URI", target), ("WARC-Segment-Origin-ID", name),
                            ("WARC-Segment-Number", str(i)), *last], part))
    return out


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, segment_bytes: int = SEGMENT,
                  records_per_file: int = PER_FILE) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files under ``path`` (further columns are ignored)."""
    src = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    src = src.withColumn("sha", F.unhex(F.sha1(F.col("html").cast("binary"))))
    # payloads held by several pages; written first, so that AQE can split a hot payload in the join
    twice = staged(src.where(F.octet_length("html") >= min_bytes).groupBy("sha")
                   .agg(F.max("page_id").alias("winner"), F.count(F.lit(1)).alias("n")).where("n > 1")
                   .select("sha", "winner"), "payloads")
    rows = (src.join(twice, "sha", "left")
            .select("page_id", "url", F.col("html").cast("binary").alias("payload"), "winner",
                    F.coalesce(~F.col("page_id").eqNullSafe(F.col("winner")), F.lit(False)).alias("other"),
                    F.monotonically_increasing_id().alias("row")))
    rows = rows.withColumn("revisit", F.col("other") & F.col("winner").isNotNull()).drop("other")

    def fn(batch):
        cols = [batch.column(c) for c in ("page_id", "url", "payload", "winner", "revisit", "row")]
        step = 64
        for lo in range(0, len(batch), step):
            part = [c.slice(lo, step).to_pylist() for c in cols]
            yield {"record": pa.array([r for args in zip(*part) for r in page_records(*args, segment_bytes)], pa.binary())}

    records = map_batches(rows, fn, "record binary").select(F.col("record").cast("string").alias("value"))
    (records.write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", records_per_file).text(path))


def parse(data: bytes):
    """Records of one gzip file: (headers, block); inflated piece by piece.  What is wrong with a record, or with the
    end of the file, stands in its headers under ``PROBLEM``."""
    inflate, at, buf, step = zlib.decompressobj(31), 0, bytearray(), 1 << 12
    pos, fed, damaged = 0, False, False

    def more(n: int) -> bool:
        nonlocal at, pos, inflate, step, fed, damaged
        if pos > 1 << 20:
            del buf[:pos]
            pos = 0
        while len(buf) - pos < n:
            if inflate.eof:                                   # next gzip member, after zero padding
                at -= len(inflate.unused_data)
                while data[at:at + 1] == b"\0":
                    at += 1
                inflate, step, fed = zlib.decompressobj(31), 1 << 12, False
            if at >= len(data) or damaged:
                return False
            part = data[at:at + step]
            try:
                buf.extend(inflate.decompress(part))
            except zlib.error:
                damaged = True
                return False
            fed = True
            at, step = at + len(part), min(2 * step, 1 << 18)   # small at first: what is over is read again
        return True

    def ending() -> dict[str, str]:
        """What the end of the file lacks, if anything."""
        return {PROBLEM: "gzip"} if damaged else {PROBLEM: "truncated"} if fed and not inflate.eof else {}

    while True:
        while more(2) and buf[pos:pos + 2] == CRLF:
            pos += 2
        if not more(1):
            if ending():
                yield ending(), b""
            return
        size = 1 << 11
        while (stop := buf.find(b"\r\n\r\n", pos)) < 0:
            had = len(buf) - pos
            if not more(size) and len(buf) - pos == had:      # at the end, what came last may hold it
                yield ending() or {PROBLEM: "truncated"}, bytes(buf[pos:])
                return
            size *= 2
        lines = bytes(buf[pos:stop]).decode("utf-8", "replace").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = headers.get("content-length", "")
        skip = stop + 4 - pos
        if not length.isascii() or not length.isdigit():
            yield {**headers, PROBLEM: "header"}, b""
            return
        n = int(length)
        if not more(skip + n) and len(buf) - pos < skip + n:
            yield {**headers, **(ending() or {PROBLEM: "truncated"})}, bytes(buf[pos + skip:])
            return
        yield headers, bytes(buf[pos + skip:pos + skip + n])
        pos += skip + n


PROBLEM = ":problem"
OWN_ID = re.compile(r"<urn:page:(-?\d+)(?::\d+)*>")          # the writer's record ids of pages with an id
FIELDS = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
          "payload_bytes long, payload binary, status string, record_id string")


def _page(record_id: str) -> int | None:
    own = OWN_ID.fullmatch(record_id)
    return int(own[1]) if own else None


def decode(headers: dict[str, str], block: bytes, problem: str | None = None) -> dict:
    """The result row of a whole record."""
    ident, kind = headers.get("warc-record-id", ""), headers.get("warc-type")
    given = headers.get("warc-payload-digest", "")
    digest = given[5:].upper() if given[:5].lower() == "sha1:" and len(given) == 37 else None
    problem = problem or headers.get(PROBLEM) or (None if kind in ("response", "revisit") else "other")
    row = {"page_id": _page(ident), "url": headers.get("warc-target-uri"), "record_type": kind, "refers_to": None,
           "payload_digest": digest, "payload_bytes": None, "payload": None, "status": problem or "ok", "record_id": ident or None}
    if problem:
        return row
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:])}
    if kind == "revisit":
        size = http.get(b"content-length", b"")
        return row | {"refers_to": _page(headers.get("warc-refers-to", "")), "payload_bytes": int(size) if size.isdigit() else None}
    payload = dechunk(body) if http.get(b"transfer-encoding", b"").lower() == b"chunked" else body
    if payload is None:
        return row | {"status": "framing"}
    true = base32_sha1(payload)
    if digest not in (None, true):
        return row | {"status": "digest"}
    return row | {"payload": payload, "payload_bytes": len(payload), "payload_digest": true}


def _number(value: str) -> int | None:
    return int(value) if value.isascii() and value.isdigit() and len(value) < 10 else None


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A row per logical record: ``page_id, url, record_type, refers_to, payload_digest, payload_bytes,
    payload, status, record_id``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    names = [f.split()[0] for f in FIELDS.split(", ")]
    arrow = to_arrow_schema(StructType.fromDDL(FIELDS))

    def tabled(rows: list[dict]) -> dict:
        return {n: [r[n] for r in rows] for n in names}

    def whole(batch):
        for data in batch.column("content"):
            rows, size = [], 0
            for headers, block in parse(data.as_py()):
                if "warc-segment-number" in headers:
                    continue
                rows.append(decode(headers, block))
                size += len(block)
                if size > 1 << 21:
                    yield tabled(rows)
                    rows, size = [], 0
            yield tabled(rows)

    def segments(batch):
        for data in batch.column("content"):
            for headers, block in parse(data.as_py()):
                if "warc-segment-number" in headers:
                    yield {"origin": [headers.get("warc-segment-origin-id", headers.get("warc-record-id", ""))],
                           "number": [_number(headers["warc-segment-number"])],
                           "total": [_number(headers.get("warc-segment-total-length", ""))],
                           "headers": [list(headers.items())], "block": [block]}

    def assemble(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        parts = sorted(t.to_pylist(), key=lambda r: r["number"] or 0)
        headers = {h["k"]: h["v"] for h in parts[0]["headers"]}
        block = b"".join(p["block"] for p in parts)
        total = parts[-1]["total"]
        problem = None
        if [p["number"] for p in parts] != list(range(1, len(parts) + 1)) or total is None:
            problem = "gap"
        elif total != len(block):
            problem = "length"
        headers.pop(PROBLEM, None)
        row = decode({"warc-type": "response"} | headers | {"warc-record-id": key[0].as_py()}, block, problem)
        return pa.Table.from_pylist([row], schema=arrow)

    cut = map_batches(files, segments, "origin string, number int, total long, "
                                       "headers array<struct<k: string, v: string>>, block binary")
    joined = cut.groupBy("origin").applyInArrow(assemble, FIELDS)
    return map_batches(files, whole, FIELDS).unionByName(joined)
