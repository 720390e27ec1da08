"""Files made of table rows, so that the readers have something to read in queries: a builder for each format.

Builders take plain values and return bytes. They write the simplest file of a format that has the wanted content, and share
no code with the readers but for the sinks.
"""

from __future__ import annotations

import io
import sqlite3
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def files_of(rows: DataFrame, key: str, build: Callable[[dict], bytes]) -> DataFrame:
    """(path, content): a file for each row, named by its key and built where the row is; no shuffle."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([str(r[key]) for r in part], pa.string()), pa.array([build(r) for r in part], pa.binary())], names=["path", "content"])

    return rows.mapInArrow(made, "path string, content binary")


def dealt(rows: DataFrame) -> DataFrame:
    """Small rows whose files are dear, over four tasks for each core: a table of a few megabytes is read by one task or two."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def raster_files(pixels: DataFrame, build: Callable[[np.ndarray], bytes], width: int = 64) -> DataFrame:
    """(path, content): a file for each image of pixels (image, y, x, v), which has width pixels in a row."""
    images = pixels.groupBy("image").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("p")).select("image", F.col("p")["v"].alias("v"))
    return files_of(images, "image", lambda r: build(np.array(r["v"], np.uint8).reshape(-1, width)))


# Rasters


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def png(rows: bytes, width: int, height: int, depth: int = 8, color: int = 0, extra: bytes = b"") -> bytes:
    """rows: each line's filter and bytes."""
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + extra + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def png_filtered(gray: np.ndarray) -> bytes:
    """Gray, the five filters in turn."""
    v = gray.astype(np.int64)
    up, left = np.vstack([np.zeros_like(v[:1]), v[:-1]]), np.hstack([np.zeros_like(v[:, :1]), v[:, :-1]])
    corner = np.hstack([np.zeros_like(up[:, :1]), up[:, :-1]])
    guess = left + up - corner
    far = [np.abs(guess - x) for x in (left, up, corner)]
    paeth = np.where((far[0] <= far[1]) & (far[0] <= far[2]), left, np.where(far[1] <= far[2], up, corner))
    by = [np.zeros_like(v), left, up, (left + up) // 2, paeth]
    rows = b"".join(bytes([y % 5]) + ((v[y] - by[y % 5][y]) & 255).astype(np.uint8).tobytes() for y in range(len(v)))
    return png(rows, v.shape[1], v.shape[0])


def png_interlaced(gray: np.ndarray) -> bytes:
    """Gray, in seven passes over finer and finer grids: every pixel belongs to the first pass whose grid has it."""
    height, width = gray.shape
    y, x = np.mgrid[0:height, 0:width]
    left, rows = np.ones(gray.shape, bool), b""
    for down, across in ((8, 8), (8, 4), (4, 4), (4, 2), (2, 2), (2, 1), (1, 1)):
        own = left & (y % down == 0) & (x % across == 0)
        left &= ~own
        rows += b"".join(b"\0" + gray[i][own[i]].tobytes() for i in range(height) if own[i].any())
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 1)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows)) + _chunk(b"IEND", b"")


def png_palette(gray: np.ndarray) -> bytes:
    """An index of a palette whose colours are (i, 255 - i, i / 2)."""
    palette = b"".join(bytes([i, 255 - i, i // 2]) for i in range(256))
    return png(b"".join(b"\0" + line.tobytes() for line in gray), gray.shape[1], gray.shape[0], 8, 3, _chunk(b"PLTE", palette))


def png_bits(gray: np.ndarray) -> bytes:
    """One bit for each pixel: whether it is 128 or more."""
    return png(b"".join(b"\0" + np.packbits(line >= 128).tobytes() for line in gray), gray.shape[1], gray.shape[0], 1)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW with literal codes alone, the table cleared before codes would need ten bits."""
    bits = []
    for i in range(0, max(1, len(data)), 200):
        bits.append(format(256, "09b"))
        bits += [format(b, "09b") for b in data[i : i + 200]]
    said = "".join(bits) + format(257, "09b")
    said += "0" * (-len(said) % 8)
    return int(said, 2).to_bytes(len(said) // 8, "big")


def runs(data: bytes) -> bytes:
    """PackBits: runs of equal bytes as repeats, all others as literals of one byte."""
    out, i = b"", 0
    while i < len(data):
        n = 1
        while n < 128 and i + n < len(data) and data[i + n] == data[i]:
            n += 1
        out += bytes([257 - n if n > 1 else 0, data[i]])
        i += n
    return out


def tiff(gray: np.ndarray, packing: int = 1, predictor: int = 1, order: str = "<") -> bytes:
    """Gray, one strip."""
    raw = np.diff(gray, axis=1, prepend=np.uint8(0)) if predictor == 2 else gray
    body = {1: bytes, 5: lzw, 8: zlib.compress, 32773: runs}[packing](raw.astype(np.uint8).tobytes())
    short, long = (lambda v: struct.pack(order + "HH", v, 0)), (lambda v: struct.pack(order + "I", v))
    tags = [(256, 3, short(gray.shape[1])), (257, 3, short(gray.shape[0])), (258, 3, short(8)), (259, 3, short(packing)), (262, 3, short(1)), (273, 4, long(8)), (277, 3, short(1)), (278, 3, short(gray.shape[0])), (279, 4, long(len(body))), (317, 3, short(predictor))]
    body += b"\0" * (len(body) % 2)
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body)) + body + struct.pack(order + "H", len(tags)) + b"".join(struct.pack(order + "HHI", t, k, 1) + v for t, k, v in tags) + bytes(4)


def bmp(gray: np.ndarray) -> bytes:
    """24 bits: (v, 255 - v, v / 2), from the lowest line up."""
    height, width = gray.shape
    lines = b""
    for line in gray[::-1]:
        part = np.stack([line // 2, 255 - line, line], axis=1).astype(np.uint8).tobytes()
        lines += part + b"\0" * (-len(part) % 4)
    return b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(lines), 0, 0, 54, 40, width, height, 1, 24, 0, len(lines), 2835, 2835, 0, 0) + lines


def tga(gray: np.ndarray) -> bytes:
    """Gray, run-length packets within lines."""
    body = b""
    for line in gray.tolist():
        i = 0
        while i < len(line):
            n = 1
            while n < 128 and i + n < len(line) and line[i + n] == line[i]:
                n += 1
            body += bytes([127 + n, line[i]]) if n > 1 else bytes([0, line[i]])
            i += n
    return struct.pack("<BBBHHBHHHHBB", 0, 0, 11, 0, 0, 0, 0, 0, gray.shape[1], gray.shape[0], 8, 0x20) + body


def webp_head(width: int, height: int, alpha: bool) -> bytes:
    return b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes([16 * alpha, 0, 0, 0]) + (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")


def dng(cells: np.ndarray, white: int = 65_535) -> bytes:
    """16-bit cells behind a red, green, green, blue filter."""
    short, long = (lambda v: struct.pack("<HH", v, 0)), (lambda v: struct.pack("<I", v))
    body = cells.astype("<u2").tobytes()
    tags = [(256, 3, 1, short(cells.shape[1])), (257, 3, 1, short(cells.shape[0])), (258, 3, 1, short(16)), (259, 3, 1, short(1)), (273, 4, 1, long(8)), (0x828E, 1, 4, bytes([0, 1, 1, 2])), (0xC612, 1, 4, bytes([1, 4, 0, 0])), (0xC61D, 4, 1, long(white))]
    return b"II" + struct.pack("<HI", 42, 8 + len(body)) + body + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in sorted(tags)) + bytes(4)


# Layers


def psd(layers: list[tuple[str, tuple[int, int, int, int], bytes, int, int, int, tuple[int, int, int, int]]], width: int, height: int, dpi: int = 150, packing: int = 0) -> bytes:
    """RGB layers (name, (top, left, bottom, right), blend key, opacity, clipping, flags, colour and alpha), from the lowest."""
    resolution = b"8BIM" + struct.pack(">HBBI", 0x03ED, 0, 0, 16) + struct.pack(">IHHIHH", dpi << 16, 1, 1, dpi << 16, 1, 1)
    records, planes = b"", b""
    for name, (top, left, bottom, right), key, opacity, clipping, flags, rgba in layers:
        channels = b""
        for ident, value in zip((0, 1, 2, -1), rgba):
            lines = [bytes([value]) * (right - left)] * (bottom - top)
            if packing == 1:
                lines = [runs(x) for x in lines]
                body = struct.pack(">H", 1) + b"".join(struct.pack(">H", len(x)) for x in lines) + b"".join(lines)
            else:
                body = struct.pack(">H", packing) + (zlib.compress(b"".join(lines)) if packing == 2 else b"".join(lines))
            channels += struct.pack(">hI", ident, len(body))
            planes += body
        said = bytes([len(name)]) + name.encode()
        extra = struct.pack(">II", 0, 0) + said + b"\0" * (-len(said) % 4)
        records += struct.pack(">iiiiH", top, left, bottom, right, 4) + channels + b"8BIM" + key + bytes([opacity, clipping, flags, 0]) + struct.pack(">I", len(extra)) + extra
    info = struct.pack(">h", len(layers)) + records + planes
    section = struct.pack(">I", len(info)) + info
    return b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, height, width, 8, 3) + struct.pack(">I", 0) + struct.pack(">I", len(resolution)) + resolution + struct.pack(">I", len(section)) + section


def xcf(width: int, height: int, dpi: float, layers: list[tuple[str, int, int, int, int, int, bool]]) -> bytes:
    """layers: (name, left, top, width, height, opacity, visible), from the top."""
    head = b"gimp xcf v003\0" + struct.pack(">III", width, height, 0) + struct.pack(">IIff", 19, 8, dpi, dpi) + struct.pack(">II", 0, 0)
    bodies, at = [], len(head) + 4 * len(layers) + 4
    for name, left, top, w, h, opacity, visible in layers:
        raw = name.encode() + b"\0"
        bodies.append(struct.pack(">III", w, h, 0) + struct.pack(">I", len(raw)) + raw + struct.pack(">III", 6, 4, opacity) + struct.pack(">III", 8, 4, visible) + struct.pack(">IIii", 15, 8, left, top) + struct.pack(">II", 0, 0))
    places = [at + sum(map(len, bodies[:i])) for i in range(len(bodies))]
    return head + struct.pack(f">{len(places) + 1}I", *places, 0) + b"".join(bodies)


def database(tables: dict[str, tuple[str, list[tuple]]]) -> bytes:
    """A SQLite file: each table's columns (as SQL names them) and rows."""
    db = sqlite3.connect(":memory:")
    for name, (columns, rows) in tables.items():
        db.execute(f"CREATE TABLE {name} ({columns})")
        db.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(columns.split(',')))})", rows)
    db.commit()
    return db.serialize()


# Containers and documents


def archive(entries: list[tuple[str, str | bytes]], packed: bool = True) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED) as z:
        for name, data in entries:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_DEFLATED if packed else zipfile.ZIP_STORED)
    return out.getvalue()


def compound(stream: str) -> bytes:
    """An OLE2 file whose directory has one stream."""
    name = stream.encode("utf-16-le")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(22) + struct.pack("<H", 9) + bytes(16) + struct.pack("<I", 0)
    return head.ljust(512, b"\0") + (name.ljust(64, b"\0") + struct.pack("<H", len(name) + 2)).ljust(128, b"\0").ljust(512, b"\0")


def pdf(objects: list[bytes], root: int = 1, info: int | None = None, table: bool = True) -> bytes:
    """Objects 1, 2, ... with a cross-reference table, or without one (such files must be repaired)."""
    out, places = b"%PDF-1.4\n", []
    for i, body in enumerate(objects, 1):
        places.append(len(out))
        out += b"%d 0 obj " % i + body + b" endobj\n"
    trailer = b"trailer << /Size %d /Root %d 0 R " % (len(objects) + 1, root) + (b"/Info %d 0 R " % info if info else b"") + b">>"
    if not table:
        return out + trailer
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places) + trailer + b"\nstartxref\n%d\n%%%%EOF" % len(out)


def revised(old: bytes, number: int, body: bytes, root: int = 1, size: int = 9) -> bytes:
    """A file with a later revision of one object appended."""
    before, at = old.rindex(b"xref\n0 "), len(old) + 1
    new = old + b"\n" + b"%d 0 obj " % number + body + b" endobj\n"
    return new + b"xref\n%d 1\n%010d 00000 n \ntrailer << /Size %d /Root %d 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (number, at, size, root, before, len(new))


def pdf_streams(members: list[tuple[int, bytes]], page: bytes) -> bytes:
    """Objects 1 to n in an object stream, a page as object n + 1, and a cross-reference stream with a predictor."""
    n, offsets, body = len(members), [], b""
    for number, raw in members:
        offsets.append((number, len(body)))
        body += raw + b" "
    head = b" ".join(b"%d %d" % x for x in offsets) + b" "
    packed = zlib.compress(head + body)
    out = b"%PDF-1.5\n"
    places = {n + 1: len(out)}
    out += b"%d 0 obj " % (n + 1) + page + b" endobj\n"
    places[n + 2] = len(out)
    out += b"%d 0 obj << /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >> stream\n" % (n + 2, n, len(head), len(packed)) + packed + b"\nendstream endobj\n"
    at = len(out)
    rows = [(0, 0, 0)] + [(2, n + 2, i) for i in range(n)] + [(1, places[n + 1], 0), (1, places[n + 2], 0), (1, at, 0)]
    raw = [bytes([a]) + struct.pack(">H", b) + bytes([c]) for a, b, c in rows]
    up = b"".join(b"\2" + bytes((x - y) & 255 for x, y in zip(now, before)) for now, before in zip(raw, [bytes(4), *raw]))
    table = zlib.compress(up)
    out += b"%d 0 obj << /Type /XRef /Size %d /W [1 2 1] /Root 1 0 R /Length %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> >> stream\n" % (n + 3, n + 4, len(table)) + table + b"\nendstream endobj\n"
    return out + b"startxref\n%d\n%%%%EOF" % at


# Drawings


def wmf(width: int, height: int, points: list[tuple[int, int]]) -> bytes:
    """A placeable metafile (1,440 units in an inch): a move and lines, then the whole as a rectangle."""
    record = lambda kind, *v: struct.pack(f"<IH{len(v)}h", 3 + len(v), kind, *v)
    lines = record(0x0214, points[0][1], points[0][0]) + b"".join(record(0x0213, y, x) for x, y in points[1:])
    return b"\xd7\xcd\xc6\x9a" + struct.pack("<H4hHIH", 0, 0, 0, width, height, 1440, 0, 0) + struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0) + lines + record(0x041B, height, width, 0, 0) + record(0)


def emf(width: int, height: int, points: list[tuple[int, int]]) -> bytes:
    head = struct.pack("<II8i", 1, 88, 0, 0, width, height, 0, 0, 0, 0) + b" EMF"
    return head.ljust(88, b"\0") + struct.pack("<IIii", 0x1B, 16, *points[0]) + b"".join(struct.pack("<IIii", 0x36, 16, *p) for p in points[1:]) + struct.pack("<II", 14, 20)


def djvu(width: int, height: int, dpi: int) -> bytes:
    return b"AT&TFORM\0\0\0\0DJVUINFO" + struct.pack(">IHH", 10, width, height) + b"\x18\0" + struct.pack("<H", dpi) + b"\x16\1"


# Fonts


def truetype(glyphs: list[list[tuple[int, int, bool]]], first: str = "A", units: int = 1000) -> bytes:
    """A font of one contour for each of the characters from `first` on; glyph 0 is empty."""
    shapes = [b""]
    for points in glyphs:
        xs, ys = [p[0] for p in points], [p[1] for p in points]
        steps = lambda v: b"".join(struct.pack(">h", b - a) for a, b in zip([0, *v], v))
        raw = struct.pack(">hhhhh", 1, min(xs), min(ys), max(xs), max(ys)) + struct.pack(">HH", len(points) - 1, 0) + bytes(int(p[2]) for p in points) + steps(xs) + steps(ys)
        shapes.append(raw + b"\0" * (-len(raw) % 4))
    places = [0]
    for s in shapes:
        places.append(places[-1] + len(s))
    start, n = ord(first), len(glyphs)
    sub = struct.pack(">HHH", 4, 32, 0) + struct.pack(">HHHH", 4, 4, 1, 0) + struct.pack(">HH", start + n - 1, 0xFFFF) + struct.pack(">H", 0) + struct.pack(">HH", start, 0xFFFF) + struct.pack(">hh", 1 - start, 1) + struct.pack(">HH", 0, 0)
    tables = {
        b"cmap": struct.pack(">HH", 0, 1) + struct.pack(">HHI", 3, 1, 12) + sub,
        b"glyf": b"".join(shapes),
        b"head": bytes(18) + struct.pack(">H", units) + bytes(30) + struct.pack(">hh", 1, 0),
        b"loca": struct.pack(f">{len(places)}I", *places),
        b"maxp": struct.pack(">IH", 0x00010000, n + 1),
    }
    at, index, body = 12 + 16 * len(tables), b"", b""
    for name, raw in tables.items():
        index += struct.pack(">4sIII", name, 0, at + len(body), len(raw))
        body += raw + b"\0" * (-len(raw) % 4)
    return struct.pack(">IHHHH", 0x00010000, len(tables), 0, 0, 0) + index + body
