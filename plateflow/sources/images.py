"""Files to DataFrames: kinds, images, layers, pages and drawings, from Spark's binaryFile rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fonts, icc, jpeg, layered_files, office, pdf, raster_files, raw_files, vector_files
from .containers import Archive, sqlite_tables
from .model import Damaged, Image, Unsupported

#: Rows of files that are handed on at once number so many, or have so many bytes, and one file more.
HELD_ROWS, HELD_BYTES = 1000, 4 << 20
ERRORS = (Damaged, Unsupported, struct.error, zlib.error, ValueError, IndexError, KeyError, TypeError, OverflowError, RecursionError, AttributeError)


def kind_of(data: bytes) -> str:
    """What a file is, from its bytes; the most telling signs first, TGA if nothing else fits."""
    if raw_files.is_raw(data):
        return "raw"
    for kind, sign in (("png", b"\x89PNG\r\n\x1a\n"), ("jpeg", b"\xff\xd8\xff"), ("tiff", b"II*\0"), ("tiff", b"MM\0*"), ("bmp", b"BM"), ("psd", b"8BPS"), ("xcf", b"gimp xcf "), ("clip", b"CSFCHUNK"), ("clip", b"SQLite format 3\0"), ("eps", b"%!PS"), ("eps", b"\xc5\xd0\xd3\xc6"), ("djvu", b"AT&TFORM"), ("wmf", b"\xd7\xcd\xc6\x9a"), ("ole2", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")):
        if data.startswith(sign):
            return kind
    if data[:4] == b"RIFF":
        return "webp" if data[8:12] == b"WEBP" else "cdr" if data[8:11] in (b"CDR", b"cdr") else "riff"
    if data[40:44] == b" EMF":
        return "emf"
    if data[:3] == b"AC1":
        return "dwg"
    if data[:4] == b"PK\3\4":
        try:
            return office.kind_of(data)
        except (Damaged, Unsupported):
            return "cdr" if any(n.startswith("content/riffData") for n in _names(data)) else "zip"
    if b"%PDF-" in data[:32_768]:  # a drawing program's file may have it behind bytes of its own
        return "pdf"
    head = data[:1024].decode("latin1")
    if "<svg" in head:
        return "svg"
    if head.lstrip().startswith("0") and "SECTION" in head:
        return "dxf"
    return "tga"


def _names(data: bytes) -> list[str]:
    try:
        return Archive(data).names()
    except Damaged:
        return []


def decode_image(data: bytes, kind: str | None = None, scale: int = 1) -> Image:
    """One flat image of any raster, camera or layered file."""
    kind = kind or kind_of(data)
    if kind == "jpeg":
        return jpeg.decode(data, scale)
    if kind == "psd":
        return layered_files.flatten(layered_files.psd(data))
    if kind == "clip":
        doc = layered_files.clip(data)
        if doc.preview is None:
            raise Unsupported("a drawing without a preview")
        return doc.preview
    readers: dict[str, Callable[[bytes], Image]] = {"png": raster_files.png, "tiff": raster_files.tiff, "bmp": raster_files.bmp, "tga": raster_files.tga, "webp": raster_files.webp, "raw": raw_files.raw}
    if kind not in readers:
        raise Unsupported(f"no image in a file of kind {kind}")
    return readers[kind](data)


def decode_pages(data: bytes, images: bool = False, only: set[int] | None = None) -> tuple[str, str | None, list[pdf.Page]]:
    """Kind, title and pages of a document; only: pages of a print file whose contents are decoded."""
    kind = kind_of(data)
    if kind == "pdf":
        return kind, *pdf.read_pages(data[max(0, data.find(b"%PDF-", 0, 65_536)) :], images, only=only)
    if kind in ("eps", "djvu", "svg", "dxf", "dwg", "wmf", "emf", "cdr"):
        d = decode_drawing(data, kind)
        return kind, None, [office.page(i + 1, d.width, d.height, d.text, image=d.preview if i == 0 else None, paths=d.paths if i == 0 else []) for i in range(d.pages)]
    return office.read(data)


def decode_drawing(data: bytes, kind: str | None = None) -> vector_files.Drawing:
    kind = kind or kind_of(data)
    if kind in ("svg", "dxf"):
        return getattr(vector_files, kind)(data.decode("utf-8-sig", "replace"))
    if kind in ("dwg", "wmf", "emf", "eps", "djvu", "cdr"):
        return getattr(vector_files, kind)(data)
    raise Unsupported(f"no drawing in a file of kind {kind}")


class _Each:
    """Applies fn to each file; a file that can't be read gives one row with its error."""

    def __init__(self, fn: Callable[[bytes], list[dict]], names: list[str]):
        self.fn, self.names = fn, names

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    rows = self.fn(content.as_py() or b"")
                except ERRORS as e:
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                held += [{n: (path if n == "path" else r.get(n)) for n in self.names} for r in rows]
                size += sum(len(v) for r in rows for v in r.values() if isinstance(v, (bytes, str)))
                if len(held) >= HELD_ROWS or size >= HELD_BYTES:
                    yield pa.RecordBatch.from_pylist(held, schema=self.schema)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=self.schema)

    schema: pa.Schema


def _mapped(files: DataFrame, fn: Callable[[bytes], list[dict]], ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"path string, {ddl}, error string")
    each = _Each(fn, schema.names)
    each.schema = to_arrow_schema(schema)
    return files.select(F.col("path"), F.col("content")).mapInArrow(each, schema)


def files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, modificationTime, length, content) of the files under a path."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


IMAGE_DDL = "kind string, width int, height int, channels int, bits int, color_space string, dpi_x int, dpi_y int, alpha boolean, data binary"


def image_row(image: Image, kind: str = "") -> dict:
    return {"kind": kind, "width": image.width, "height": image.height, "channels": image.channels, "bits": image.bits, "color_space": image.color_space, "dpi_x": image.dpi_x, "dpi_y": image.dpi_y, "alpha": image.alpha, "data": image.data}


def kinds(source: DataFrame) -> DataFrame:
    return _mapped(source, lambda data: [{"kind": kind_of(data)}], "kind string")


def images(source: DataFrame, scale: int = 1) -> DataFrame:
    """One image for each file."""
    return _mapped(source, lambda data: [image_row(decode_image(data, k := kind_of(data), scale), k)], IMAGE_DDL)


def layers(source: DataFrame) -> DataFrame:
    """A row for each layer of layered files, from the lowest."""

    def rows(data: bytes) -> list[dict]:
        kind = kind_of(data)
        if kind not in ("psd", "xcf", "clip"):
            raise Unsupported(f"no layers in a file of kind {kind}")
        doc = getattr(layered_files, kind)(data)
        return [{"z": i, "name": x.name, "left": x.left, "top": x.top, "right": x.right, "bottom": x.bottom, "opacity": x.opacity, "mode": x.mode, "visible": x.visible, "clipping": x.clipping, "folder": x.folder, "canvas_width": doc.width, "canvas_height": doc.height, "data": x.image.data if x.image else None} for i, x in enumerate(doc.layers)]

    return _mapped(source, rows, "z int, name string, left int, top int, right int, bottom int, opacity double, mode string, visible boolean, clipping boolean, folder boolean, canvas_width int, canvas_height int, data binary")


def pages(source: DataFrame) -> DataFrame:
    """A row for each page of documents."""

    def rows(data: bytes) -> list[dict]:
        kind, title, found = decode_pages(data)
        return [{"kind": kind, "title": title, "page_number": p.number, "media": p.media, "crop": p.crop, "bleed": p.bleed, "trim": p.trim, "text": p.text, "metadata": {k: str(v) for k, v in p.metadata.items()}} for p in found]

    return _mapped(source, rows, "kind string, title string, page_number int, media array<double>, crop array<double>, bleed array<double>, trim array<double>, text string, metadata map<string,string>")


def page_numbers(source: DataFrame) -> DataFrame:
    """A row for each page of documents and images, without decoding their pictures."""

    def rows(data: bytes) -> list[dict]:
        kind = kind_of(data)
        if kind in ("png", "jpeg", "tiff", "bmp", "tga", "webp", "raw", "psd", "clip", "xcf"):
            return [{"kind": kind, "page_number": 1}]
        return [{"kind": kind, "page_number": p.number} for p in decode_pages(data, only=set())[2]]

    return _mapped(source, rows, "kind string, page_number int")


def path_commands(source: DataFrame) -> DataFrame:
    """A row for each command of drawings' paths."""

    def rows(data: bytes) -> list[dict]:
        return [{"path_no": i, "ord": j, "op": op, "args": args} for i, p in enumerate(decode_drawing(data).paths) for j, (op, args) in enumerate(p)]

    return _mapped(source, rows, "path_no int, ord int, op string, args array<double>")


def entries(source: DataFrame) -> DataFrame:
    """A row for each entry of ZIP archives."""

    def rows(data: bytes) -> list[dict]:
        z = Archive(data)
        return [{"entry": n, "size": z.infos[n].file_size, "method": z.infos[n].compress_type, "content": z.read(n)} for n in z.names()]

    return _mapped(source, rows, "entry string, size long, method int, content binary")


def database_rows(source: DataFrame) -> DataFrame:
    """A row for each row of SQLite files' tables, values as JSON text."""
    import json

    def rows(data: bytes) -> list[dict]:
        show = lambda v: v.hex() if isinstance(v, bytes) else v
        return [{"table": t, "row": i, "values": json.dumps(dict(zip(columns, map(show, r))))} for t, (columns, found) in sqlite_tables(data).items() for i, r in enumerate(found)]

    return _mapped(source, rows, "table string, row int, values string")


def sizes(source: DataFrame) -> DataFrame:
    """Each raster's size; of WebP files, whose samples aren't read, that of the head."""

    def rows(data: bytes) -> list[dict]:
        kind = kind_of(data)
        if kind == "webp":
            width, height, alpha = raster_files.webp_size(data)
            return [{"kind": kind, "width": width, "height": height, "alpha": alpha}]
        image = decode_image(data, kind)
        return [{"kind": kind, "width": image.width, "height": image.height, "alpha": image.alpha}]

    return _mapped(source, rows, "kind string, width int, height int, alpha boolean")


def drawings(source: DataFrame) -> DataFrame:
    """Each drawing's size in points, number of pages and of paths, and text."""

    def rows(data: bytes) -> list[dict]:
        kind = kind_of(data)
        d = decode_drawing(data, kind)
        return [{"kind": kind, "width": d.width, "height": d.height, "n_pages": d.pages, "n_paths": len(d.paths), "text": d.text}]

    return _mapped(source, rows, "kind string, width double, height double, n_pages int, n_paths int, text string")


def profiles(source: DataFrame) -> DataFrame:
    """Each ICC profile's head, and the names of its tags."""

    def rows(data: bytes) -> list[dict]:
        p = icc.parse(data)
        return [{"version": p.version, "device": p.device, "space": p.space, "pcs": p.pcs, "is_matrix": p.is_matrix, "is_table": p.is_table, "tags": sorted(p.tags)}]

    return _mapped(source, rows, "version string, device string, space string, pcs string, is_matrix boolean, is_table boolean, tags array<string>")


def profile_numbers(source: DataFrame) -> DataFrame:
    """A row for each curve and each XYZ value of ICC profiles: tag, kind (gamma, table, parametric and its type, XYZ) and numbers."""

    def rows(data: bytes) -> list[dict]:
        out = []
        for tag, raw in icc.parse(data).tags.items():
            if raw[:4] in (b"curv", b"para"):
                kind, *rest = icc.curve(raw)
                numbers = rest[-1] if isinstance(rest[-1], list) else [rest[-1]]
                out.append({"tag": tag, "kind": f"{kind} {rest[0]}" if kind == "parametric" else kind, "numbers": numbers})
            elif raw[:4] == b"XYZ ":
                out.append({"tag": tag, "kind": "XYZ", "numbers": list(icc.xyz(raw))})
        return out

    return _mapped(source, rows, "tag string, kind string, numbers array<double>")


def through_profiles(source: DataFrame, tag: str, points: list[tuple[float, ...]]) -> DataFrame:
    """Unit values through a table (A2B0, B2A0, ...) of ICC profiles: a row for each profile and point."""

    def rows(data: bytes) -> list[dict]:
        found = icc.parse(data).tags
        if tag not in found:
            raise Unsupported(f"no table {tag}")
        out = icc.evaluate(icc.table(found[tag]), np.array(points, float))
        return [{"point": i, "result": v} for i, v in enumerate(out.tolist())]

    return _mapped(source, rows, "point int, result array<double>")


def glyphs(source: DataFrame, text: str) -> DataFrame:
    """A row for each point of the outlines of a text's characters in TrueType fonts, in font units."""

    def rows(data: bytes) -> list[dict]:
        font = fonts.TrueType(data)
        return [{"ord": k, "character": c, "glyph": font.map.get(ord(c), 0), "contour": i, "point": j, "x": x, "y": y, "on": on} for k, c in enumerate(text) for i, contour in enumerate(font.glyph(font.map.get(ord(c), 0)).contours) for j, (x, y, on) in enumerate(contour)]

    return _mapped(source, rows, "ord int, character string, glyph int, contour int, point int, x double, y double, `on` boolean")


def text_paths(source: DataFrame, text: str, size: float) -> DataFrame:
    """A line of text as path commands, in each TrueType font: a row for each command."""

    def rows(data: bytes) -> list[dict]:
        return [{"ord": i, "op": op, "args": args} for i, (op, args) in enumerate(fonts.text_outline(fonts.TrueType(data), text, size))]

    return _mapped(source, rows, "ord int, op string, args array<double>")


def charstrings(source: DataFrame) -> DataFrame:
    """The path commands of Type 2 charstrings, one in each file."""
    return _mapped(source, lambda data: [{"ord": i, "op": op, "args": args} for i, (op, args) in enumerate(fonts.charstring(data))], "ord int, op string, args array<double>")


def pixels(source: DataFrame) -> DataFrame:
    """(path, y, x, v): the samples of 8-bit images, one row for a pixel. Samples are cut apart once, not for each pixel."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, width, height, channels, data in zip(*(c.to_pylist() for c in batch.columns)):
                samples = np.frombuffer(data, np.uint8)[: width * height * channels].reshape(-1, channels)
                for i in range(0, len(samples), 1 << 16):
                    part = samples[i : i + (1 << 16)].astype(np.int32)
                    at = np.arange(i, i + len(part), dtype=np.int32)
                    values = pa.ListArray.from_arrays(pa.array(np.arange(0, part.size + 1, channels, dtype=np.int32)), pa.array(part.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part), pa.string()), pa.array(at // width), pa.array(at % width), values], names=["path", "y", "x", "v"])

    return source.where("error IS NULL AND bits = 8").select("path", "width", "height", "channels", "data").mapInArrow(cut, "path string, y int, x int, v array<int>")


def sample_at(x: int, y: int) -> Column:
    """The first sample of a pixel of 8-bit images, as an expression on their rows; null outside."""
    at = (F.lit(y) * F.col("width") + F.lit(x)) * F.col("channels") + 1
    inside = (F.lit(x) < F.col("width")) & (F.lit(y) < F.col("height")) & (F.col("bits") == 8)
    return F.when(inside, F.conv(F.hex(F.substring("data", at, F.lit(1))), 16, 10).cast("int"))


def blocks(source: DataFrame, side: int | None = None) -> DataFrame:
    """(path, width, height, y, x, darkest, lightest, samples): squares of 8-bit images (without a side, whole images) by their
    place among the squares, the extremes of all their channels and their number of pixels. One row for a square, not for a pixel."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, out, held = [], [], 0
            for path, width, height, channels, data in zip(*(c.to_pylist() for c in batch.columns)):
                lines = np.frombuffer(data, np.uint8)[: width * height * channels].reshape(height, width * channels)
                tops, lefts = np.arange(0, height, side or height), np.arange(0, width, side or width)
                least, most = (f.reduceat(f.reduceat(lines, tops, axis=0), lefts * channels, axis=1).ravel() for f in (np.minimum, np.maximum))
                pixels = np.outer(np.diff(tops, append=height), np.diff(lefts, append=width)).ravel()
                y, x = np.divmod(np.arange(len(least)), len(lefts))
                paths += [path] * len(least)
                out.append(np.stack([np.full(len(least), width), np.full(len(least), height), y, x, least, most, pixels]))
                held += len(least)
                if held >= 1 << 16:
                    yield made(paths, out)
                    paths, out, held = [], [], 0
            if out:
                yield made(paths, out)

    def made(paths: list[str], out: list[np.ndarray]) -> pa.RecordBatch:
        columns = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), *(pa.array(c.astype(np.int32)) for c in columns[:6]), pa.array(columns[6].astype(np.int64))], names=["path", "width", "height", "y", "x", "darkest", "lightest", "samples"])

    return source.where("error IS NULL AND bits = 8").select("path", "width", "height", "channels", "data").mapInArrow(cut, "path string, width int, height int, y int, x int, darkest int, lightest int, samples long")
