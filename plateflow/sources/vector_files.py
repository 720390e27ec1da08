"""Drawings: SVG, DXF, DWG previews, WMF and EMF, EPS, DjVu and CDR previews."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from .model import Damaged, Image, Unsupported
from .office import attribute, tags

KAPPA = 0.5522847498
Command = tuple[str, list[float]]


@dataclass
class Drawing:
    width: float
    height: float
    paths: list[list[Command]] = field(default_factory=list)
    text: str = ""
    pages: int = 1
    preview: Image | None = None


def ellipse(cx: float, cy: float, rx: float, ry: float) -> list[Command]:
    kx, ky = rx * KAPPA, ry * KAPPA
    return [("M", [cx + rx, cy]), ("C", [cx + rx, cy + ky, cx + kx, cy + ry, cx, cy + ry]), ("C", [cx - kx, cy + ry, cx - rx, cy + ky, cx - rx, cy]), ("C", [cx - rx, cy - ky, cx - kx, cy - ry, cx, cy - ry]), ("C", [cx + kx, cy - ry, cx + rx, cy - ky, cx + rx, cy]), ("Z", [])]


def polygon(points: list[tuple[float, float]], closed: bool) -> list[Command]:
    return [("M" if i == 0 else "L", list(p)) for i, p in enumerate(points)] + ([("Z", [])] if closed and points else [])


NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
#: Numbers that a command takes.
TAKES = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}


def path(data: str) -> list[Command]:
    """Absolute moves, lines and cubics of SVG path data; an arc becomes a line."""
    out: list[Command] = []
    x = y = sx = sy = bx = by = 0.0
    for letter, rest in re.findall(r"([MmLlHhVvCcSsQqTtAaZz])([^MmLlHhVvCcSsQqTtAaZz]*)", data):
        op, rel, v = letter.upper(), letter.islower(), [float(n) for n in NUMBER.findall(rest)]
        n = TAKES[op]
        for i in range(0, max(1, len(v) - len(v) % n) if n else 1, n or 1):
            g = v[i : i + n]
            if len(g) < n:
                break
            ox, oy = (x, y) if rel else (0.0, 0.0)
            if op == "Z":
                out.append(("Z", []))
                x, y = sx, sy
                bx, by = x, y
                continue
            if op == "H":
                end = (g[0] + ox, y)
            elif op == "V":
                end = (x, g[0] + oy)
            else:
                end = (g[-2] + ox, g[-1] + oy)
            if op in ("C", "S"):
                one = (g[0] + ox, g[1] + oy) if op == "C" else (2 * x - bx, 2 * y - by)
                two = (g[-4] + ox, g[-3] + oy)
                out.append(("C", [*one, *two, *end]))
                bx, by = two
            elif op in ("Q", "T"):
                q = (g[0] + ox, g[1] + oy) if op == "Q" else (2 * x - bx, 2 * y - by)
                out.append(("C", [x + 2 / 3 * (q[0] - x), y + 2 / 3 * (q[1] - y), end[0] + 2 / 3 * (q[0] - end[0]), end[1] + 2 / 3 * (q[1] - end[1]), *end]))
                bx, by = q
            else:
                out.append(("M" if op == "M" and i == 0 else "L", [*end]))
                bx, by = end
            x, y = end
            if op == "M" and i == 0:
                sx, sy = end
    return out


def svg(text: str) -> Drawing:
    head = (tags(text, "svg") or [""])[0]
    if not head:
        raise Damaged("no svg element")
    box = [float(v) for v in NUMBER.findall(attribute(head, "viewBox") or "")]
    size = lambda n, i, d: float((NUMBER.findall(attribute(head, n) or "") or [box[i] if len(box) == 4 else d])[0])
    out = Drawing(size("width", 2, 612.0), size("height", 3, 792.0))
    num = lambda t, n, d=0.0: float((NUMBER.findall(attribute(t, n) or "") or [d])[0])
    out.paths += [p for t in tags(text, "path") if (p := path(attribute(t, "d") or ""))]
    for t in tags(text, "rect"):
        x, y, w, h = (num(t, n) for n in ("x", "y", "width", "height"))
        if w > 0 and h > 0:
            out.paths.append(polygon([(x, y), (x + w, y), (x + w, y + h), (x, y + h)], True))
    out.paths += [ellipse(num(t, "cx"), num(t, "cy"), r, r) for t in tags(text, "circle") if (r := num(t, "r")) > 0]
    out.paths += [ellipse(num(t, "cx"), num(t, "cy"), rx, ry) for t in tags(text, "ellipse") if (rx := num(t, "rx")) > 0 and (ry := num(t, "ry")) > 0]
    out.paths += [polygon([(num(t, "x1"), num(t, "y1")), (num(t, "x2"), num(t, "y2"))], False) for t in tags(text, "line")]
    for name in ("polyline", "polygon"):
        for t in tags(text, name):
            v = [float(n) for n in NUMBER.findall(attribute(t, "points") or "")]
            if len(v) >= 4:
                out.paths.append(polygon(list(zip(v[::2], v[1::2])), name == "polygon"))
    return out


#: Papers in points, wide side first.
PAPERS = {"ARCH_D": (2592.0, 1728.0), "ISO_A1": (2384.0, 1684.0), "ISO_A4": (842.0, 595.0), "LETTER": (792.0, 612.0)}


def dxf(text: str, paper: str = "ARCH_D", margin: float = 72.0) -> Drawing:
    """Lines, circles and polylines, scaled evenly into the middle of the paper; arcs count for the extent."""
    lines = text.replace("\r", "").split("\n")
    pairs = [(lines[i].strip(), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
    if not any(p == ("0", "SECTION") for p in pairs):
        raise Damaged("no section")
    entities: list[tuple[str, list[tuple[int, str]]]] = []
    for code, value in pairs:
        if code == "0":
            entities.append((value, []))
        elif entities and re.fullmatch(r"-?\d+", code):
            entities[-1][1].append((int(code), value))
    shapes, points = [], []
    for kind, values in entities:
        first = {}
        for c, v in values:
            if NUMBER.fullmatch(v):
                first.setdefault(c, float(v))
        if kind == "LINE":
            ends = [(first.get(10, 0.0), first.get(20, 0.0)), (first.get(11, 0.0), first.get(21, 0.0))]
            shapes.append(polygon(ends, False))
            points += ends
        elif kind in ("CIRCLE", "ARC"):
            cx, cy, r = first.get(10, 0.0), first.get(20, 0.0), first.get(40, 0.0)
            points += [(cx - r, cy - r), (cx + r, cy + r)]
            if kind == "CIRCLE":
                shapes.append(ellipse(cx, cy, r, r))
        elif kind == "LWPOLYLINE":
            xs, ys = [float(v) for c, v in values if c == 10], [float(v) for c, v in values if c == 20]
            shapes.append(polygon(list(zip(xs, ys)), bool(int(first.get(70, 0)) & 1)))
            points += zip(xs, ys)
    width, height = PAPERS[paper]
    x0, x1 = (min(p[0] for p in points), max(p[0] for p in points)) if points else (0.0, 100.0)
    y0, y1 = (min(p[1] for p in points), max(p[1] for p in points)) if points else (0.0, 100.0)
    w, h = (x1 - x0) or 100.0, (y1 - y0) or 100.0
    k = min((width - 2 * margin) / w, (height - 2 * margin) / h)
    dx, dy = margin + (width - 2 * margin - w * k) / 2 - x0 * k, margin + (height - 2 * margin - h * k) / 2 - y0 * k
    return Drawing(width, height, [[(op, [v * k + (dy if i % 2 else dx) for i, v in enumerate(a)]) for op, a in s] for s in shapes])


#: Releases by a DWG file's first six bytes.
DWG = {"AC1012": "R13", "AC1014": "R14", "AC1015": "2000", "AC1018": "2004", "AC1021": "2007", "AC1024": "2010", "AC1027": "2013", "AC1032": "2018"}


def dwg(data: bytes) -> Drawing:
    """The release, and the preview if there is one; the entities aren't decoded."""
    from .raster_files import bmp

    sign = data[:6].decode("latin1")
    if not sign.startswith("AC1"):
        raise Damaged("no DWG signature")
    at = data.find(b"BM", 6)
    out = Drawing(*PAPERS["ARCH_D"], text=DWG.get(sign, sign))
    if at >= 0:
        try:
            out.preview = bmp(data[at:])
        except (Damaged, Unsupported):
            pass
    return out


def wmf(data: bytes) -> Drawing:
    """Moves, lines, rectangles and polygons of a placeable or plain metafile."""
    at, inch, box = 0, 1440, None
    if data[:4] == b"\xd7\xcd\xc6\x9a":
        box = struct.unpack_from("<4h", data, 6)
        inch, at = struct.unpack_from("<H", data, 14)[0] or 1440, 22
    if len(data) < at + 18 or struct.unpack_from("<H", data, at)[0] not in (1, 2):
        raise Damaged("no metafile header")
    k = 72 / inch
    at += 18
    out, here = Drawing(*(((box[2] - box[0]) * k, (box[3] - box[1]) * k) if box else (612.0, 792.0))), (0.0, 0.0)
    origin = box[:2] if box else (0, 0)
    put = lambda x, y: ((x - origin[0]) * k, (y - origin[1]) * k)
    while at + 6 <= len(data):
        words, kind = struct.unpack_from("<IH", data, at)
        body = data[at + 6 : at + 2 * words]
        if words < 3 or not kind:
            break
        v = struct.unpack(f"<{len(body) // 2}h", body[: len(body) // 2 * 2])
        if kind == 0x0214 and len(v) >= 2:
            here = put(v[1], v[0])
        elif kind == 0x0213 and len(v) >= 2:
            end = put(v[1], v[0])
            out.paths.append(polygon([here, end], False))
            here = end
        elif kind == 0x041B and len(v) >= 4:
            (x1, y1), (x0, y0) = put(v[1], v[0]), put(v[3], v[2])
            out.paths.append(polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], True))
        elif kind in (0x0324, 0x0325) and v and len(v) > 2 * v[0]:
            out.paths.append(polygon([put(v[1 + 2 * i], v[2 + 2 * i]) for i in range(v[0])], kind == 0x0324))
        at += 2 * words
    return out


def emf(data: bytes) -> Drawing:
    if len(data) < 88 or data[40:44] != b" EMF":
        raise Damaged("no metafile header")
    box = struct.unpack_from("<4i", data, 8)
    k = 72 / 96
    out, here, at = Drawing(max(1, box[2] - box[0]) * k, max(1, box[3] - box[1]) * k), (0.0, 0.0), 0
    put = lambda x, y: ((x - box[0]) * k, (y - box[1]) * k)
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if size < 8 or at + size > len(data) or kind == 14:
            break
        if kind == 0x1B:
            here = put(*struct.unpack_from("<2i", data, at + 8))
        elif kind == 0x36:
            end = put(*struct.unpack_from("<2i", data, at + 8))
            out.paths.append(polygon([here, end], False))
            here = end
        elif kind == 0x2B:
            x0, y0, x1, y1 = struct.unpack_from("<4i", data, at + 8)
            (x0, y0), (x1, y1) = put(x0, y0), put(x1, y1)
            out.paths.append(polygon([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], True))
        at += size
    return out


def eps(data: bytes) -> Drawing:
    """Size and number of pages from the comments, and the preview; the program isn't run."""
    preview = None
    if data[:4] == b"\xc5\xd0\xd3\xc6":
        from .raster_files import tiff

        at, size, _, _, tiff_at, tiff_size = struct.unpack_from("<6I", data, 4)
        if tiff_size:
            try:
                preview = tiff(data[tiff_at : tiff_at + tiff_size])
            except (Damaged, Unsupported, struct.error):
                preview = None
        data = data[at : at + size]
    text = data.decode("latin1")
    if not text.startswith("%!PS"):
        raise Damaged("no PostScript signature")
    box = None
    for name in ("HiResBoundingBox", "BoundingBox"):
        m = re.findall(rf"%%{name}:\s*([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)\s+([-\d.]+)", text)
        if m and not box:
            box = [float(v) for v in m[-1]]
    pages = re.findall(r"%%Pages:\s*(\d+)", text)
    width, height = (box[2] - box[0], box[3] - box[1]) if box else (612.0, 792.0)
    return Drawing(width, height, pages=max(1, int(pages[-1])) if pages else 1, preview=preview)


def djvu(data: bytes) -> Drawing:
    at = data.find(b"INFO")
    if data[:8] != b"AT&TFORM" or at < 0 or at + 18 > len(data):
        raise Damaged("no DjVu header")
    width, height = struct.unpack_from(">2H", data, at + 8)
    dpi = struct.unpack_from("<H", data, at + 14)[0] or 300
    return Drawing(width / dpi * 72, height / dpi * 72)


def cdr(data: bytes) -> Drawing:
    """The drawing as SVG if the archive has one, else its preview; the curves aren't decoded."""
    from .containers import Archive
    from .images import decode_image
    from .raster_files import bmp

    if data[:4] == b"RIFF" and data[8:11] in (b"CDR", b"cdr"):
        at = data.find(b"bmp ")
        preview = None
        if at >= 0:
            try:
                preview = bmp(data[at + 8 :])
            except (Damaged, Unsupported):
                preview = None
        return Drawing(612.0, 792.0, preview=preview)
    z = Archive(data)
    for name in z.names():
        if name.lower().endswith(".svg"):
            return svg(z.text(name))
    for name in z.names():
        if name.lower().rpartition(".")[2] in ("png", "bmp", "jpg", "jpeg"):
            return Drawing(612.0, 792.0, preview=decode_image(z.read(name)))
    raise Unsupported("no drawing that can be read")
