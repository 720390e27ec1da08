import io
import struct
import zipfile
from base64 import b32encode
from hashlib import sha1

import pytest

from plateflow.llm import warc as W
from plateflow.llm.queries import op8_warc

from .helpers import clashing

PAGES = "page_id long, url string, html string"


def expected(rows, least=0):
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "")]
        top = max((p for p in same if p is not None), default=None)
        revisit = len(raw) >= least and page != top
        out.append((page, len(raw), b32encode(sha1(raw).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return out


KEY = lambda r: (r[0] is None, r[0] or 0, r[1:4])


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, least):
    rows = [(1, "http://a/x", "same page"), (2, None, "same page"), (3, "http://b/\r\nodd%0A", None), (4, "u", ""), (5, "v", "<p>é</p>\r\n\r\n" * 9000), (6, "w", "abc"), (7, "w", "abc"), (None, "n", "no id")]
    df = clashing(spark.createDataFrame(rows, PAGES).repartition(3))
    got = W.read(W.write(df, least=least, package_bytes=20_000)).collect()
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got], key=KEY) == sorted(expected(rows, least), key=KEY)
    by = {r["page_id"]: r for r in got}
    assert by[3]["url"] == "http://b/\r\nodd%0A" and by[2]["url"] is None and bytes(by[5]["payload"]).decode() == rows[4][2]


def test_repeated_rows(spark):
    got = W.read(W.write(spark.createDataFrame([(1, "u", "x")] * 3, PAGES))).collect()
    assert sorted(r["record_type"] for r in got) == ["response", "revisit", "revisit"] and {r["refers_to"] for r in got} == {None, 1}
    assert W.read(W.write(spark.createDataFrame([], PAGES))).collect() == []


def test_tables(spark, sf):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = op8_warc(spark, sf).collect()
    assert sorted([tuple(r[c] for c in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) for r in got]) == sorted(expected(rows))


def zip64(members, prefix=b""):
    """A ZIP file whose sizes, offsets and counts are all in ZIP64 records."""
    out, directory, wide = io.BytesIO(prefix), b"", 0xFFFFFFFF
    out.seek(0, 2)
    for name, data in members:
        at = out.tell() - len(prefix)
        extra = struct.pack("<HHQQ", 1, 16, len(data), len(data))
        out.write(struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 45, 0, 0, 0, 0, 0, wide, wide, len(name), len(extra)) + name + extra + data)
        extra = struct.pack("<HHI", 0x5455, 4, 7) + struct.pack("<HHQQQ", 1, 24, len(data), len(data), at)
        directory += struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45, 0, 0, 0, 0, 0, wide, wide, len(name), len(extra), 2, 0, 0, 0, wide) + name + extra + b"ok"
    at = out.tell() - len(prefix)
    out.write(directory)
    end = out.tell()
    out.write(struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, len(members), len(members), len(directory), at))
    out.write(struct.pack("<4sIQI", b"PK\6\7", 0, end, 1))
    out.write(struct.pack("<4sHHHHIIH", b"PK\5\6", 0xFFFF, 0xFFFF, 0xFFFF, 0xFFFF, wide, wide, 5) + b"PK\5\6!")
    return out.getvalue()


@pytest.mark.parametrize("prefix", [b"", b"#!/bin/sh\n" * 50])
def test_zip64(prefix):
    raw = zip64([(b"a", b"hello"), ("b/é".encode(), b"x" * 1000)], prefix)
    members = W.StoredMembers(io.BytesIO(raw), len(raw))
    assert members.read("a") == b"hello" and members.read("b/é") == b"x" * 1000


def test_stored_only_and_damage():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("packed", b"y" * 999, zipfile.ZIP_DEFLATED)
        z.writestr("plain", b"z" * 9)
        z.comment = b"a comment"
    members = W.StoredMembers(out, len(out.getvalue()))
    assert members.read("plain") == b"z" * 9
    with pytest.raises(ValueError):
        members.read("packed")
    with pytest.raises(ValueError):
        W.StoredMembers(io.BytesIO(b"no archive"), 10)


def test_archives_without_an_index():
    """Members that no index names are walked: gzip records and plain ones, also those that lie across steps."""
    records = [W.record(i, f"http://h/{i}", b"<p>\r\n\r\n" + bytes([97 + i]) * (i * 90_000), W.base32_sha1(b""), None, False) for i in range(6)]
    whole = W.package([(r, {"page": i}) for i, r in enumerate(records)])
    for step in (1 << 20, 1000):
        W.STEP, kept = step, W.STEP
        try:
            for name, raw in ((W.DATA, None), ("archive/plain.warc", b"".join(records))):
                out = io.BytesIO()
                with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
                    z.writestr(name, raw if raw is not None else zipfile.ZipFile(io.BytesIO(whole)).read(W.DATA))
                assert list(W.records_of(io.BytesIO(out.getvalue()), len(out.getvalue()))) == records
        finally:
            W.STEP = kept


def test_packages_are_plain_zip_files():
    raw = W.package([(W.record(1, "u", b"body", W.base32_sha1(b"body"), None, False), {"page": 1})])
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.namelist() == [W.DATA, W.INDEX] and z.testzip() is None
    (record,) = W.records_of(io.BytesIO(raw), len(raw))
    assert W.parse_record(record)[2] == b"body"
