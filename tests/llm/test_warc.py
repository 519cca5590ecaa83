"""WARC: exact round trip, segments, deduplication, broken input, edge rows."""

import gzip

import pytest

from kshot.llm import warc as W
from kshot.session import local_path, shared_dir

SCHEMA = "page_id long, url string, html string, sha string, row int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def roundtrip(spark, rows, **kw):
    path = shared_dir(spark, "t_warc")
    W.write_archive(pages(spark, rows).repartition(3), path, **kw)
    return W.read_archive(spark, path).collect(), path


def test_round_trip_with_segments_and_copies(spark):
    big = "é\r\n\r\nWARC/1.1\r\n日本" * 700
    rows = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, "u\r\nrl", big), (4, None, None), (5, "e", ""),
            (6, "u", big), (7, "v", "0\r\n\r\n" * 50)]
    got, _ = roundtrip(spark, rows, segment_bytes=1000, records_per_file=5)
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.status == "ok" for r in got)
    for i, _, html in rows:
        data = (html or "").encode()
        assert by[i].payload_bytes == len(data) and by[i].payload_digest == W.base32_sha1(data)
        if by[i].record_type == "response":
            assert bytes(by[i].payload) == data
    assert {i: r.refers_to for i, r in by.items()} == {1: 2, 2: None, 3: 6, 4: 5, 5: None, 6: None, 7: None}


def test_min_bytes_nulls_and_repeated_rows(spark):
    rows = [(1, "a", "xy"), (2, "a", "xy"), (None, "n", "zz"), (9, "r", "same"), (9, "r", "same"), (8, "r", "same")]
    got, _ = roundtrip(spark, rows, min_bytes=3)
    kinds = sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(False, 1, "response", None), (False, 2, "response", None), (False, 8, "revisit", 9),
                     (False, 9, "response", None), (False, 9, "response", None), (True, 0, "response", None)]


def test_empty_table(spark):
    path = shared_dir(spark, "t_warc_empty")
    W.write_archive(spark.createDataFrame([], SCHEMA), path)
    assert W.read_archive(spark, path).count() == 0


@pytest.mark.parametrize("fault,status", [("drop", "gap"), ("total", "length"), ("frame", "framing"), ("digest", "digest")])
def test_broken_records_are_reported(spark, tmp_path, fault, status):
    recs = W.page_records(5, "http://x", b"A" * 3000, None, False, 0, 1000)
    assert len(recs) == 4
    if fault == "drop":
        recs = recs[:2] + recs[3:]
    elif fault == "total":
        recs[3] = recs[3].replace(b"Total-Length: ", b"Total-Length: 9")
    elif fault == "frame":
        recs[0] = recs[0].replace(b"bb8\r\n", b"zz8\r\n")
    else:
        recs[1] = recs[1].replace(b"AAAA", b"AAAB", 1)
    path = local_path(shared_dir(spark, f"t_warc_{fault}"))
    import os
    os.makedirs(path)
    with gzip.open(f"{path}/part.gz", "wb") as f:      # members of their own, and out of order
        f.write(b"\r\n\r\n".join(reversed(recs)) + b"\r\n\r\n")
    (row,) = W.read_archive(spark, path).collect()
    assert row.status == status and row.page_id == 5 and row.payload is None


@pytest.mark.parametrize("size", [10, 3000, 400_000])
def test_every_gzip_member_is_read(size):
    import random
    rng = random.Random(size)
    recs = [r + b"\r\n\r\n" for i in range(40) for r in W.page_records(i, f"http://x/{i}", rng.randbytes(size), None, False, 0, 1 << 30)]
    want = list(W.parse(gzip.compress(b"".join(recs))))
    assert len(want) == 40
    members = [gzip.compress(r) for r in recs]
    assert list(W.parse(b"".join(members))) == want
    assert list(W.parse((b"\0" * 600).join(members) + b"\0" * 600)) == want
    cut = gzip.compress(recs[0][:50]) + gzip.compress(b"") + gzip.compress(recs[0][50:])
    assert list(W.parse(cut)) == want[:1] and list(W.parse(b"")) == []


def test_dechunk():
    assert W.dechunk(W.chunked(b"abc" * 9, 4)) == b"abc" * 9
    assert W.dechunk(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    assert W.dechunk(b"5\r\nabc\r\n0\r\n\r\n") is None and W.dechunk(b"") is None


def _read(spark, name, data):
    import os
    path = local_path(shared_dir(spark, name))
    os.makedirs(path)
    with open(f"{path}/part.gz", "wb") as f:
        f.write(data)
    return W.read_archive(spark, path).collect()


def test_files_that_end_early_or_are_damaged_leave_a_row(spark):
    rec = b"".join(W.page_records(5, "http://x", bytes(range(256)) * 40, None, False, 0, 1 << 20)) + b"\r\n\r\n"
    whole = gzip.compress(rec)
    for cut in (30, len(whole) // 2, len(whole) - 12):
        (row,) = _read(spark, "t_cut", whole[:-cut])
        assert row.status == "truncated" and row.payload is None
    rows = _read(spark, "t_second", whole + whole[: len(whole) // 2])
    assert sorted(r.status for r in rows) == ["ok", "truncated"]
    broken = bytearray(whole)
    broken[len(whole) // 2] ^= 255
    got = {r.status for r in _read(spark, "t_damaged", bytes(broken))}
    assert got and got <= {"gzip", "truncated", "digest", "framing", "header"}
    assert [r.status for r in _read(spark, "t_garbage", whole + b"no gzip")] == ["ok", "gzip"]
    assert [r.status for r in _read(spark, "t_header", gzip.compress(rec[:90]))] == ["truncated"]


def test_archives_from_elsewhere(spark):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hi</p>"
    def rec(kind, ident, block, *more):
        return W._record([("WARC-Type", kind), ("WARC-Record-ID", ident), *more], block) + b"\r\n\r\n"
    good = W.base32_sha1(b"<p>hi</p>")
    recs = [rec("warcinfo", "<urn:uuid:1>", b"software: x"), rec("response", "<urn:uuid:2>", http),
            rec("response", "<urn:uuid:3>", http, ("WARC-Payload-Digest", f"sha1:{good}")),
            rec("response", "<urn:uuid:4>", http, ("WARC-Payload-Digest", "sha1:" + "A" * 32)),
            rec("response", "<urn:uuid:5>", http, ("WARC-Payload-Digest", "md5:abc")),
            rec("revisit", "<urn:uuid:6>", b"HTTP/1.1 200 OK\r\n\r\n", ("WARC-Refers-To", "<urn:uuid:2>")),
            rec("request", "<urn:uuid:7>", b"GET / HTTP/1.1\r\n\r\n"),
            b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:8>\r\nContent-Length: many\r\n\r\nx"]
    rows = {r.record_id[-2]: r for r in _read(spark, "t_foreign", b"".join(map(gzip.compress, recs)))}
    assert {k: r.status for k, r in rows.items()} == {"1": "other", "2": "ok", "3": "ok", "4": "digest", "5": "ok", "6": "ok",
                                                      "7": "other", "8": "header"}
    assert all(r.page_id is None for r in rows.values())
    assert rows["2"].payload == rows["3"].payload == b"<p>hi</p>" and rows["2"].payload_digest == good
    assert rows["6"].refers_to is None and rows["6"].record_type == "revisit"
