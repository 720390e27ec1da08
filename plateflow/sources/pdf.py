"""PDF files (ISO 32000): objects, cross-references with their revisions, repair, filters and pages."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

from . import compression as C
from .model import Damaged, Image, Unsupported

_SPACE, _DELIMITER = b"\0\t\n\x0c\r ", b"()<>[]{}/%"
_REGULAR = re.compile(rb"[^\0\t\n\x0c\r ()<>\[\]{}/%]+")
#: Objects within each other, and objects that a reference may lead through.
DEPTH = 64


class Name(str):
    __slots__ = ()


@dataclass(frozen=True)
class Ref:
    number: int
    generation: int


@dataclass
class Stream:
    entries: dict
    raw: bytes


class Keyword(bytes):
    __slots__ = ()


class Parser:
    """Objects from bytes at a place."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at]
            if c in _SPACE:
                self.at += 1
            elif c == 37:
                while self.at < n and data[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def read(self, depth: int = 0):
        if depth > DEPTH:
            raise Damaged("objects too deep within each other")
        self.skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise Damaged("the file ends within an object")
        c = data[at : at + 1]
        if c == b"/":
            m = _REGULAR.match(data, at + 1)
            self.at = m.end() if m else at + 1
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes([int(h[1], 16)]), m[0] if m else b"").decode("latin1"))
        if data.startswith(b"<<", at):
            return self.dictionary(depth)
        if c == b"<":
            end = data.find(b">", at)
            if end < 0:
                raise Damaged("a string without an end")
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at + 1 : end])
            self.at = end + 1
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"(":
            return self.string()
        if c == b"[":
            self.at, out = at + 1, []
            while True:
                self.skip()
                if self.data[self.at : self.at + 1] == b"]":
                    self.at += 1
                    return out
                out.append(self.read(depth + 1))
        m = _REGULAR.match(data, at)
        if not m:
            raise Damaged(f"a stray {c!r}")
        self.at, word = m.end(), m[0]
        if re.fullmatch(rb"[+-]?\d+", word):
            ahead = re.compile(rb"[\0\t\n\x0c\r ]+(\d+)[\0\t\n\x0c\r ]+R(?![A-Za-z0-9])").match(data, self.at)
            if ahead and word.isdigit():
                self.at = ahead.end()
                return Ref(int(word), int(ahead[1]))
            return int(word)
        if re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", word):
            return float(word)
        return {b"true": True, b"false": False, b"null": None}.get(word, Keyword(word))

    def string(self) -> bytes:
        out, level, i, data = bytearray(), 1, self.at + 1, self.data
        while i < len(data):
            c = data[i]
            if c == 92 and i + 1 < len(data):
                n = data[i + 1 : i + 2]
                octal = re.compile(rb"[0-7]{1,3}").match(data, i + 1)
                if octal:
                    out.append(int(octal[0], 8) & 255)
                    i = octal.end()
                    continue
                if n in b"\r\n":
                    i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                    continue
                out += {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\x0c"}.get(n, n)
                i += 2
                continue
            level += (c == 40) - (c == 41)
            i += 1
            if not level:
                self.at = i
                return bytes(out)
            out.append(c)
        raise Damaged("a string without an end")

    def dictionary(self, depth: int):
        self.at += 2
        out = {}
        while True:
            self.skip()
            if self.data.startswith(b">>", self.at):
                self.at += 2
                break
            key = self.read(depth + 1)
            if not isinstance(key, Name):
                raise Damaged("a key that isn't a name")
            out[str(key)] = self.read(depth + 1)
        m = re.compile(rb"[\0\t\n\x0c\r ]*stream(\r\n|\n|\r)").match(self.data, self.at)
        if not m:
            return out
        start, size = m.end(), out.get("Length")
        if not isinstance(size, int) or not re.compile(rb"[\0\t\n\x0c\r ]*endstream").match(self.data, start + size):
            end = self.data.find(b"endstream", start)
            if end < 0:
                raise Damaged("a stream without an end")
            size = len(self.data[start:end].rstrip(b"\r\n"))
        self.at = start + size
        return Stream(out, self.data[start : start + size])


class Document:
    """Objects by number; the newest revision of each, read when asked for."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise Damaged("no PDF signature")
        self.data, self.places, self.trailer, self.held = data, {}, {}, {}
        try:
            self.load()
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise Damaged("no catalog")
        except (Damaged, ValueError, IndexError, RecursionError):
            self.repair()

    def load(self) -> None:
        m = list(re.finditer(rb"startxref\s+(\d+)", self.data[-2048:]))
        if not m:
            raise Damaged("no startxref")
        at, seen = int(m[-1][1]), set()
        while at is not None and at not in seen:
            seen.add(at)
            at = self.section(at)

    def section(self, at: int) -> int | None:
        """One revision's table; older ones don't replace what newer ones said."""
        p = Parser(self.data, at)
        p.skip()
        if self.data.startswith(b"xref", p.at):
            p.at += 4
            while True:
                p.skip()
                if self.data.startswith(b"trailer", p.at):
                    p.at += 7
                    break
                first, count = p.read(), p.read()
                if not isinstance(first, int) or not isinstance(count, int):
                    raise Damaged("a broken cross-reference")
                for i in range(count):
                    offset, _, kind = p.read(), p.read(), p.read()
                    if kind == b"n":
                        self.places.setdefault(first + i, (1, offset, 0))
                    else:
                        self.places.setdefault(first + i, None)
            trailer = p.read()
            if isinstance(trailer.get("XRefStm"), int):
                self.section(trailer["XRefStm"])
        else:
            p.read(), p.read(), p.read()
            stream = p.read()
            if not isinstance(stream, Stream):
                raise Damaged("a broken cross-reference stream")
            trailer, body = stream.entries, self.decode(stream)
            w = trailer["W"]
            index = trailer.get("Index") or [0, trailer["Size"]]
            at = 0
            for first, count in zip(index[::2], index[1::2]):
                for i in range(count):
                    row = []
                    for n in w:
                        row.append(int.from_bytes(body[at : at + n], "big"))
                        at += n
                    kind = row[0] if w[0] else 1
                    self.places.setdefault(first + i, (kind, row[1], row[2]) if kind in (1, 2) else None)
        for key, value in trailer.items():
            self.trailer.setdefault(key, value)
        return trailer.get("Prev") if isinstance(trailer.get("Prev"), int) else None

    def repair(self) -> None:
        """Places of all objects by search; later ones replace earlier ones."""
        self.places, self.held, self.trailer = {}, {}, {}
        for m in re.finditer(rb"(?<![0-9])(\d{1,9})\s+(\d{1,5})\s+obj\b", self.data):
            self.places[int(m[1])] = (1, m.start(), 0)
        for m in re.finditer(rb"trailer\s*(?=<<)", self.data):
            try:
                self.trailer |= Parser(self.data, m.end()).read()
            except Damaged:
                continue
        for number in list(self.places):
            value = self.get(Ref(number, 0))
            if isinstance(value, Stream) and value.entries.get("Type") == "ObjStm":
                for i, n in enumerate(self.members(value)[0]):
                    self.places.setdefault(n, (2, number, i))
        if not isinstance(self.get(self.trailer.get("Root")), dict):
            roots = [n for n in self.places if isinstance(v := self.get(Ref(n, 0)), dict) and v.get("Type") == "Catalog"]
            if not roots:
                raise Damaged("no catalog")
            self.trailer["Root"] = Ref(roots[-1], 0)

    def get(self, value, depth: int = 0):
        """What a reference means; null if there is nothing."""
        if not isinstance(value, Ref):
            return value
        if depth > DEPTH:
            return None
        if value.number not in self.held:
            self.held[value.number] = None
            self.held[value.number] = self.fetch(value.number)
        return self.get(self.held[value.number], depth + 1)

    def fetch(self, number: int):
        place = self.places.get(number)
        if not place:
            return None
        kind, at, index = place
        if kind == 2:
            stream = self.get(Ref(at, 0))
            if not isinstance(stream, Stream):
                return None
            numbers, offsets, body, first = *self.members(stream)[:2], self.decode(stream), stream.entries["First"]
            return Parser(body, first + offsets[numbers.index(number)]).read() if number in numbers else None
        p = Parser(self.data, at)
        try:
            if p.read() != number or not isinstance(p.read(), int) or p.read() != b"obj":
                return None
            value = p.read()
        except Damaged:
            return None
        if isinstance(value, Stream) and isinstance(value.entries.get("Length"), Ref):
            size = self.get(value.entries["Length"])
            if isinstance(size, int):
                value.raw = value.raw[:size] if size <= len(value.raw) else value.raw
        return value

    def members(self, stream: Stream) -> tuple[list[int], list[int]]:
        p = Parser(self.decode(stream))
        pairs = [(p.read(), p.read()) for _ in range(stream.entries["N"])]
        return [a for a, _ in pairs], [b for _, b in pairs]

    def decode(self, stream: Stream, upto_image: bool = False) -> bytes:
        filters, parms = self.get(stream.entries.get("Filter")), self.get(stream.entries.get("DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        out = stream.raw
        for name, parm in zip(filters, parms):
            parm = self.get(parm) or {}
            name = self.get(name)
            if name in ("FlateDecode", "Fl"):
                out = _predicted(C.inflate(out), parm)
            elif name in ("ASCIIHexDecode", "AHx"):
                digits = re.sub(rb"[^0-9A-Fa-f]", b"", out.split(b">")[0])
                out = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
            elif name in ("ASCII85Decode", "A85"):
                out = ascii85(out)
            elif name in ("RunLengthDecode", "RL"):
                out = C.packbits(out, end_mark=True)
            elif name in ("LZWDecode", "LZW"):
                out = _predicted(C.lzw(out), parm)
            elif name in ("DCTDecode", "DCT") and upto_image:
                return out
            else:
                raise Unsupported(f"filter {name}")
        return out

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        out, seen = [], set()

        def walk(ref, inherited: dict, depth: int):
            node = self.get(ref)
            if not isinstance(node, dict) or depth > DEPTH or isinstance(ref, Ref) and ref in seen:
                return
            if isinstance(ref, Ref):
                seen.add(ref)
            own = inherited | {k: node[k] for k in ("MediaBox", "CropBox", "Resources", "Rotate") if k in node}
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own, depth + 1)
            else:
                out.append(own | node)

        walk(self.get(self.trailer["Root"]).get("Pages"), {}, 0)
        return out

    def box(self, page: dict, name: str) -> list[float] | None:
        value = self.get(page.get(name))
        numbers = [self.get(v) for v in value] if isinstance(value, list) else []
        return [float(v) for v in numbers] if len(numbers) == 4 and all(isinstance(v, (int, float)) for v in numbers) else None

    def content(self, page: dict) -> bytes:
        value = self.get(page.get("Contents"))
        parts = [self.get(v) for v in value] if isinstance(value, list) else [value]
        out = []
        for part in parts:
            try:
                out.append(self.decode(part) if isinstance(part, Stream) else b"")
            except (Unsupported, Damaged, zlib.error):
                continue
        return b"\n".join(out)

    def image(self, page: dict, scale: int = 1) -> Image | None:
        """The page's first image that can be decoded."""
        from .jpeg import decode

        objects = self.get((self.get(page.get("Resources")) or {}).get("XObject")) or {}
        for ref in objects.values():
            x = self.get(ref)
            if not isinstance(x, Stream) or x.entries.get("Subtype") != "Image":
                continue
            filters = self.get(x.entries.get("Filter"))
            last = filters[-1] if isinstance(filters, list) and filters else filters
            try:
                if last in ("DCTDecode", "DCT"):
                    return decode(self.decode(x, upto_image=True), scale)
                space = self.get(x.entries.get("ColorSpace"))
                if isinstance(space, list) and self.get(space[0]) == "ICCBased":
                    n = self.get(self.get(space[1]).entries["N"])
                else:
                    n = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4, "CalGray": 1, "CalRGB": 3}.get(space[0] if isinstance(space, list) else space)
                if n is None or self.get(x.entries.get("BitsPerComponent")) != 8:
                    continue
                w, h = self.get(x.entries["Width"]), self.get(x.entries["Height"])
                return Image(w, h, n, self.decode(x), 8, {1: "GRAY", 3: "RGB", 4: "CMYK"}[n])
            except (Unsupported, Damaged, KeyError, AttributeError):
                continue
        return None

    def info(self, key: str) -> str | None:
        value = self.get((self.get(self.trailer.get("Info")) or {}).get(key))
        return (value[2:].decode("utf-16-be", "replace") if value[:2] == b"\xfe\xff" else value.decode("latin1")) if isinstance(value, bytes) else None


def ascii85(data: bytes) -> bytes:
    body = re.sub(rb"\s", b"", data.split(b"~>")[0].removeprefix(b"<~"))
    out, group = bytearray(), []
    for c in body:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")
                group = []
    if len(group) > 1:
        n = len(group) - 1
        group += [84] * (5 - len(group))
        out += (sum(v * 85 ** (4 - i) for i, v in enumerate(group)) & 0xFFFFFFFF).to_bytes(4, "big")[:n]
    return bytes(out)


def _predicted(data: bytes, parms: dict) -> bytes:
    import numpy as np

    kind = parms.get("Predictor", 1)
    if kind == 1:
        return data
    colors, bits, columns = parms.get("Colors", 1), parms.get("BitsPerComponent", 8), parms.get("Columns", 1)
    row, step = (colors * bits * columns + 7) // 8, max(1, colors * bits // 8)
    if kind == 2 and bits == 8:
        rows = len(data) // row
        return C.sum_rows(np.frombuffer(data, np.uint8, rows * row).reshape(rows, columns, colors)).tobytes()
    if kind >= 10:
        return C.unfilter(data, row, step)
    raise Unsupported(f"predictor {kind}")


@dataclass
class Page:
    number: int
    media: list[float]
    crop: list[float]
    bleed: list[float]
    trim: list[float]
    text: str = ""
    image: Image | None = None
    metadata: dict = field(default_factory=dict)
    paths: list = field(default_factory=list)  # of commands (op, args), in points from the upper left corner


def read_pages(data: bytes, images: bool = True, scale: int = 1, only: set[int] | None = None) -> tuple[str | None, list[Page]]:
    """The title and the pages; boxes stand in for one another, and a page without any is Letter.

    only: numbers of the pages whose contents and images are decoded; of others the boxes alone are read.
    """
    doc, out = Document(data), []
    for i, page in enumerate(doc.pages()):
        media = doc.box(page, "MediaBox") or [0.0, 0.0, 612.0, 792.0]
        crop = doc.box(page, "CropBox") or media
        bleed = doc.box(page, "BleedBox") or crop
        wanted = only is None or i + 1 in only
        text = doc.content(page).decode("latin1") if wanted else ""
        out.append(Page(i + 1, media, crop, bleed, doc.box(page, "TrimBox") or bleed, text, doc.image(page, scale) if images and wanted else None))
    return doc.info("Title"), out
