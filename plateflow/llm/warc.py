"""Web archives packaged in ZIP files: written in pieces, and read by ranges.

A package holds a stored member archive/data.warc.gz (each record a gzip member of its own) and a stored member
indexes/index.cdxj (a line of JSON for each record, with its offset and length). The reader parses the end record, the ZIP64
locator and end record and the central directory, finds stored archives and their indexes, and reads each record as a
range of the package: nothing is extracted. Packages lie in the shared folder, each attempt of a task under names of its
own, and the rows that name them are checkpointed: a lost executor's packages are written again, and what a failed attempt
left is never read.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from base64 import b32encode
from collections.abc import Iterator
from hashlib import sha1
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, file_system, shared_dir

#: Bytes of payload from which a new package begins.
PACKAGE_BYTES = 16_000_000
#: Most tasks that packages are dealt to, each of which reads one after the other.
TASKS = 1 << 14
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# Reading a package by ranges


class StoredMembers:
    """The members of a ZIP file that is read by ranges; file has seek() and read(), size is its length."""

    def __init__(self, file, size: int):
        self.file, self.members = file, {}
        tail_at = max(0, size - 65_557 - 76)
        tail = self.range(tail_at, size - tail_at)
        end = tail.rfind(b"PK\5\6")
        while end >= 0 and (len(tail) < end + 22 or end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != len(tail)):
            end = tail.rfind(b"PK\5\6", 0, end)
        if end < 0:
            raise ValueError("no end of a central directory")
        count, length, at = struct.unpack_from("<HII", tail, end + 10)
        directory_end = tail_at + end
        if end >= 20 and tail[end - 20 : end - 16] == b"PK\6\7":
            where = struct.unpack_from("<Q", tail, end - 12)[0]
            record = self.range(where, 56)
            if record[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end record where its locator points")
            count, length, at = struct.unpack_from("<QQQ", record, 32)
            directory_end = where
        shift = directory_end - length - at  # bytes before the first member that the offsets don't count
        directory, p = self.range(at + shift, length), 0
        for _ in range(count):
            if directory[p : p + 4] != b"PK\1\2":
                raise ValueError("a damaged central directory")
            method = struct.unpack_from("<H", directory, p + 10)[0]
            packed, full, n, extra, note = struct.unpack_from("<IIHHH", directory, p + 20)
            offset = struct.unpack_from("<I", directory, p + 42)[0]
            name = directory[p + 46 : p + 46 + n].decode("utf-8", "replace")
            q = p + 46 + n
            while q + 4 <= p + 46 + n + extra:
                kind, m = struct.unpack_from("<HH", directory, q)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{m // 8}Q", directory, q + 4))
                    full = wide.pop(0) if full == 0xFFFFFFFF else full
                    packed = wide.pop(0) if packed == 0xFFFFFFFF else packed
                    offset = wide.pop(0) if offset == 0xFFFFFFFF else offset
                q += 4 + m
            self.members[name] = (method, offset + shift, packed)
            p += 46 + n + extra + note

    def range(self, at: int, length: int) -> bytes:
        self.file.seek(at)
        return self.file.read(length)

    def place(self, name: str) -> tuple[int, int]:
        """Where a stored member's bytes begin, and their number."""
        method, offset, length = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored")
        header = self.range(offset, 30)
        if header[:4] != b"PK\3\4":
            raise ValueError(f"{name} has no local header")
        return offset + 30 + sum(struct.unpack_from("<HH", header, 26)), length

    def read(self, name: str) -> bytes:
        return self.range(*self.place(name))


# Records


def base32_sha1(payload: bytes) -> str:
    return b32encode(sha1(payload).digest()).decode()


def _line(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if any(c in text for c in "%\r\n") else text


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid4()}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}"]
    fields += [f"WARC-Page-ID: {page}"] * (page is not None) + [f"WARC-Target-URI: {_line(url or '')}"] * (url is not None)
    if revisit:
        fields += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] + [f"WARC-Refers-To: <urn:page:{refers_to}>"] * (refers_to is not None)
    fields += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(fields).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields of a record, of its HTTP head, and what follows that."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def package(records: list[tuple[bytes, dict]]) -> bytes:
    """A ZIP file of records and their index."""
    data, index = io.BytesIO(), []
    for raw, about in records:
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = squeeze.compress(raw) + squeeze.flush()
        index.append(json.dumps(about | {"offset": data.tell(), "length": len(member), "filename": DATA}))
        data.write(member)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(DATA), data.getvalue())
        z.writestr(zipfile.ZipInfo(INDEX), "".join(x + "\n" for x in index))
    return out.getvalue()


def records_of(file, size: int) -> Iterator[bytes]:
    """The records of a package, each read as a range of it; those of stored archives without an index by walking these."""
    zipped = StoredMembers(file, size)
    indexed = set()
    for name in sorted(zipped.members):
        if name.startswith("indexes/") and name.endswith(".cdxj"):
            for line in zipped.read(name).decode().splitlines():
                about = json.loads(line)
                start, _ = zipped.place(about["filename"])
                indexed.add(about["filename"])
                yield zlib.decompress(zipped.range(start + about["offset"], about["length"]), 31)
    for name in sorted(zipped.members):
        if name.startswith("archive/") and name not in indexed and name.endswith((".warc.gz", ".warc")):
            yield from walk(zipped, name)


#: Bytes that are read at once where no index tells a record's place.
STEP = 1 << 20


def walk(zipped: StoredMembers, name: str) -> Iterator[bytes]:
    """The records of a stored archive, in order: its gzip members, or records by the lengths that their heads tell."""
    at, left = zipped.place(name)

    def more() -> bytes:
        nonlocal at, left
        part = zipped.range(at, min(STEP, left))
        at, left = at + len(part), left - len(part)
        return part

    held = more()
    while held:
        if name.endswith(".gz"):
            member, out = zlib.decompressobj(31), []
            while not member.eof:
                if not held and not (held := more()):
                    raise ValueError(f"{name} ends within a record")
                out.append(member.decompress(held))
                held = member.unused_data if member.eof else b""
            yield b"".join(out)
        else:
            while (head := held.find(b"\r\n\r\n")) < 0 or len(held) < (whole := head + 8 + int(re.search(rb"(?im)^content-length:\s*(\d+)", held[:head])[1])):
                if not (part := more()):
                    raise ValueError(f"{name} ends within a record")
                held += part
            yield held[:whole]
            held = held[whole:]
        held = held or more()


# Over DataFrames


def write(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, least: int = 0, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes a record for each row; returns (path, records) of the packages, checkpointed.

    Of records with equal payloads of at least `least` bytes the one with the largest id is a response and the others
    revisit it; smaller ones are all responses. Null texts have an empty payload; null ids are below all others; of equal
    ids the greatest URL decides, and of rows that are equal in all one is the response.
    """
    folder = folder or f"{shared_dir(pages.sparkSession).rstrip('/')}/warc-{uuid4()}"
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.unhex(F.sha1("payload")))
    counted = rows.where(F.octet_length("payload") >= least).groupBy("sha", "id", "url").agg(F.count("*").alias("times"))
    first = counted.groupBy("sha").agg(F.max(F.struct("id", "url", "times")).alias("top")).select(F.col("sha").alias("known"), "top")
    first = cut_lineage(first)
    joined = rows.join(first, F.col("sha") == F.col("known"), "left")
    is_top = F.col("id").eqNullSafe(F.col("top.id")) & F.col("url").eqNullSafe(F.col("top.url"))
    several = is_top & (F.coalesce(F.col("top.times"), F.lit(0)) > 1)
    one = lambda revisit: ("id", "url", "sha", revisit.alias("revisit"), F.col("top.id").alias("top"), "payload")
    said = joined.where(~several).select(*one(F.col("known").isNotNull() & ~is_top))
    if first.where("top.times > 1").isEmpty():  # else payloads are shuffled once more
        return cut_lineage(said.mapInArrow(_Writer(folder, package_bytes), "path string, records long"))
    # rows that are the same in all: the first is the response
    again = joined.where(several).dropDuplicates(["sha"]).withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("top.times"))))
    said = said.unionByName(again.select(*one(F.col("n") > 1)))
    return cut_lineage(said.mapInArrow(_Writer(folder, package_bytes), "path string, records long"))


class _Writer:
    def __init__(self, folder: str, package_bytes: int):
        self.folder, self.package_bytes = folder, package_bytes

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, size = [], 0
        for batch in batches:
            for page, url, sha, revisit, top, payload in zip(*(c.to_pylist() for c in batch.columns)):
                digest = b32encode(sha).decode()
                raw = record(page, url, payload, digest, top, bool(revisit))
                records.append((raw, {"page": page, "digest": f"sha1:{digest}"}))
                size += len(raw)
                if size >= self.package_bytes:
                    yield self.put(records)
                    records, size = [], 0
        if records:
            yield self.put(records)

    def put(self, records: list) -> pa.RecordBatch:
        files, folder = file_system(self.folder)
        files.create_dir(folder, recursive=True)
        name = f"{uuid4()}.wacz"
        with files.open_output_stream(f"{folder}/{name}") as out:
            out.write(package(records))
        return pa.RecordBatch.from_arrays([pa.array([f"{self.folder}/{name}"]), pa.array([len(records)])], names=["path", "records"])


def read(packages: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the packages (path): page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload.

    payload_bytes and payload_digest are those of the full payload: counted and made anew from a response's, said by a
    revisit. payload is null for revisits, and left out without with_payload. A damaged package or a payload that
    doesn't have its digest raises ValueError.
    """
    schema = T.StructType.fromDDL("page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload)
    # packages are dealt out by a number: few and short rows would be put together in one task otherwise
    paths = packages.select("path")
    return paths.repartition(max(1, min(TASKS, paths.count()))).mapInArrow(_Reader(with_payload, schema), schema)


class _Reader:
    def __init__(self, with_payload: bool, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, place = file_system(path)
                with files.open_input_file(place) as f:
                    rows = []
                    for raw in records_of(f, f.size()):
                        rows.append(self.row(*parse_record(raw)))
                        if len(rows) == 1000:
                            yield self.batch(rows)
                            rows = []
                    if rows:
                        yield self.batch(rows)

    @staticmethod
    def row(fields: dict, http: dict, payload: bytes) -> dict:
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and base32_sha1(payload) != digest:
            raise ValueError(f"{fields['WARC-Record-ID']} doesn't have its digest")
        page, refers = fields.get("WARC-Page-ID"), fields.get("WARC-Refers-To")
        return {
            "page_id": None if page is None else int(page),
            "url": _unline(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
            "payload_bytes": len(payload) if kind == "response" else int(http["Content-Length"]),
            "payload_digest": digest,
            "record_type": kind,
            "refers_to": None if refers is None else int(refers.strip("<>").rpartition(":")[2]),
            "payload": payload if kind == "response" else None,
        }

    def batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in self.schema], schema=self.schema)
