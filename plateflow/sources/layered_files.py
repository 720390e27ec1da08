"""Layered files: PSD and PSB with their samples; XCF and CLIP with their layers' properties."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

from . import compression as C
from .containers import sqlite_tables
from .model import Damaged, Image, Unsupported, check_size

# Blend modes by their keys in a PSD file.
BLEND_KEYS = {"norm": "normal", "mul ": "multiply", "scrn": "screen", "over": "overlay", "dark": "darken", "lite": "lighten", "div ": "color_dodge", "idiv": "color_burn", "hLit": "hard_light", "sLit": "soft_light", "diff": "difference", "smud": "exclusion"}
MODES = {1: "GRAY", 3: "RGB", 4: "CMYK"}


@dataclass
class Layer:
    name: str
    left: int = 0
    top: int = 0
    right: int = 0
    bottom: int = 0
    opacity: float = 1.0
    mode: str = "normal"
    visible: bool = True
    clipping: bool = False
    folder: bool = False
    image: Image | None = None


@dataclass
class Layered:
    width: int
    height: int
    dpi_x: int = 300
    dpi_y: int = 300
    color_space: str = "RGB"
    layers: list[Layer] = field(default_factory=list)
    icc: bytes | None = None
    preview: Image | None = None


class _Reader:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, form: str):
        size = struct.calcsize(">" + form)
        if self.at + size > len(self.data) or self.at < 0:
            raise Damaged(f"{size} bytes at {self.at} of {len(self.data)}")
        out = struct.unpack_from(">" + form, self.data, self.at)
        self.at += size
        return out if len(out) > 1 else out[0]

    def raw(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Damaged(f"{n} bytes at {self.at} of {len(self.data)}")
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


def psd(data: bytes) -> Layered:
    r = _Reader(data)
    if r.raw(4) != b"8BPS":
        raise Damaged("no PSD signature")
    version = r.take("H")
    r.raw(6)
    _, height, width, depth, mode = r.take("HIIHH")
    if version not in (1, 2) or max(width, height) > (30_000 if version == 1 else 300_000) or depth != 8 or mode not in MODES:
        raise Unsupported(f"PSD version {version}, {depth} bits, mode {mode}")
    check_size(min(width, 65_535), min(height, 65_535), 4)
    out = Layered(width, height, color_space=MODES[mode])
    r.raw(r.take("I"))
    resources = _Reader(r.raw(r.take("I")))
    while resources.at + 12 <= len(resources.data) and resources.raw(4) in (b"8BIM", b"MeSa"):
        ident = resources.take("H")
        name = resources.take("B")
        resources.raw(name + (name + 1) % 2)
        body = resources.raw(resources.take("I"))
        resources.at += len(body) % 2
        if ident == 0x03ED:
            x, y = struct.unpack_from(">I", body)[0], struct.unpack_from(">I", body, 8)[0]
            out.dpi_x, out.dpi_y = int(x / 65_536 + 0.5), int(y / 65_536 + 0.5)
        elif ident == 0x040F:
            out.icc = body
    long = "I" if version == 1 else "Q"
    if not r.take(long):
        return out
    if not r.take(long):
        return out
    found = []
    for _ in range(abs(r.take("h"))):
        top, left, bottom, right, channels = r.take("iiiiH")
        parts = [(r.take("h"), r.take(long)) for _ in range(channels)]
        _, key, opacity, clipping, flags, _ = r.take("4s4sBBBB")
        extra = _Reader(r.raw(r.take("I")))
        extra.raw(extra.take("I"))
        extra.raw(extra.take("I"))
        n = extra.take("B")
        name = extra.raw(n).decode("mac-roman", "replace")
        extra.at += -(n + 1) % 4
        folder = False
        while extra.at + 12 <= len(extra.data):
            mark, kind = extra.raw(4), extra.raw(4)
            body = extra.raw(extra.take("I"))
            extra.at += len(body) % 2
            if mark not in (b"8BIM", b"8B64"):
                break
            if kind == b"lsct":
                folder = struct.unpack(">I", body[:4])[0] in (1, 2, 3)
            elif kind == b"luni":
                name = body[4 : 4 + 2 * struct.unpack(">I", body[:4])[0]].decode("utf-16-be", "replace").rstrip("\0")
        found.append((Layer(name, left, top, right, bottom, opacity / 255, BLEND_KEYS.get(key.decode("latin1"), "normal"), not flags & 2, bool(clipping), folder), parts))
    for layer, parts in found:
        width, height = layer.right - layer.left, layer.bottom - layer.top
        planes = {}
        for ident, size in parts:
            body = r.raw(size)
            if ident >= -1 and width > 0 and height > 0:
                planes[ident] = _plane(body, width, height, version)
        if planes and width > 0 and height > 0:
            layer.image = _layer_image(planes, width, height, out)
        out.layers.append(layer)
    return out


def _plane(body: bytes, width: int, height: int, version: int) -> np.ndarray:
    check_size(width, height)
    packing, rest = struct.unpack(">H", body[:2])[0], body[2:]
    if packing == 1:
        step = 2 if version == 1 else 4
        sizes = np.frombuffer(rest, f">u{step}", height)
        at, rows = step * height, []
        for n in sizes.tolist():
            rows.append(C.packbits(rest[at : at + n])[:width].ljust(width, b"\0"))
            at += n
        rest = b"".join(rows)
    elif packing in (2, 3):
        rest = C.inflate(rest)
        if packing == 3:
            rest = C.sum_rows(np.frombuffer(rest, np.uint8, width * height).reshape(height, width, 1)).tobytes()
    elif packing:
        raise Unsupported(f"PSD compression {packing}")
    return np.frombuffer(rest[: width * height].ljust(width * height, b"\0"), np.uint8).reshape(height, width)


def _layer_image(planes: dict[int, np.ndarray], width: int, height: int, out: Layered) -> Image:
    """Gray is spread to RGB, inks are proofed, and alpha is the last of four channels."""
    solid, none = np.full((height, width), 255, np.uint8), np.zeros((height, width), np.uint8)
    if out.color_space == "GRAY":
        rgb = [planes.get(0, none)] * 3
    elif out.color_space == "CMYK":
        c, m, y, k = ((planes.get(i, solid)).astype(np.float64) / 255 for i in range(4))  # a PSD holds what inks leave white
        rgb = [np.floor(255 * v * k + 0.5).astype(np.uint8) for v in (c, m, y)]
    else:
        rgb = [planes.get(i, none) for i in range(3)]
    return Image(width, height, 4, np.stack([*rgb, planes.get(-1, solid)], axis=2).tobytes(), 8, "RGB", out.dpi_x, out.dpi_y, True)


def flatten(doc: Layered) -> Image:
    """All layers over white, as RGB: the packed plan of the compositing fold."""
    from ..operators.packed import blend_pixels

    canvas = np.ones((doc.height, doc.width, 3))
    base = None
    for layer in doc.layers:
        if not layer.visible or layer.folder or layer.image is None:
            continue
        alpha = np.zeros((doc.height, doc.width))
        color = np.zeros((doc.height, doc.width, 3))
        y0, y1, x0, x1 = max(0, layer.top), min(doc.height, layer.bottom), max(0, layer.left), min(doc.width, layer.right)
        if y0 < y1 and x0 < x1:
            part = layer.image.array()[y0 - layer.top : y1 - layer.top, x0 - layer.left : x1 - layer.left] / 255
            alpha[y0:y1, x0:x1] = part[:, :, 3] * layer.opacity
            color[y0:y1, x0:x1] = part[:, :, :3]
        if layer.clipping:
            alpha = alpha * base if base is not None else alpha
        else:
            base = alpha
        canvas = blend_pixels(layer.mode, canvas, color, alpha[:, :, None])
    return Image(doc.width, doc.height, 3, np.floor(np.clip(canvas, 0, 1) * 255 + 0.5).astype(np.uint8).tobytes(), 8, "RGB", doc.dpi_x, doc.dpi_y)


def xcf(data: bytes) -> Layered:
    """Size, resolution and the layers' properties; the samples aren't decoded."""
    r = _Reader(data)
    if r.raw(9) != b"gimp xcf ":
        raise Damaged("no XCF signature")
    version = r.raw(5).rstrip(b"\0")
    wide = version.startswith(b"v") and version[1:].isdigit() and int(version[1:]) >= 11
    width, height, _ = r.take("III")
    check_size(min(width, 65_535), min(height, 65_535), 4)
    if wide or version.startswith(b"v") and version[1:].isdigit() and int(version[1:]) >= 4:
        r.take("I")  # precision
    out = Layered(width, height)

    def properties(reader: _Reader):
        while True:
            kind, size = reader.take("II")
            if not kind:
                return
            yield kind, reader.raw(size)

    for kind, body in properties(r):
        if kind == 19:
            out.dpi_x, out.dpi_y = (int(v + 0.5) for v in struct.unpack(">ff", body[:8]))
    pointers = []
    while p := r.take("Q" if wide else "I"):
        pointers.append(p)
    for p in reversed(pointers):  # the file has the top layer first
        q = _Reader(data, p)
        w, h, _ = q.take("III")
        layer = Layer(q.raw(q.take("I")).rstrip(b"\0").decode("utf-8", "replace"))
        for kind, body in properties(q):
            if kind == 6:
                layer.opacity = struct.unpack(">I", body)[0] / 255
            elif kind == 8:
                layer.visible = bool(struct.unpack(">I", body)[0])
            elif kind == 15:
                layer.left, layer.top = struct.unpack(">ii", body)
            elif kind == 29:
                layer.folder = True
        layer.right, layer.bottom = layer.left + w, layer.top + h
        out.layers.append(layer)
    return out


def _preview(data: bytes) -> Image | None:
    from .images import decode_image

    try:
        return decode_image(data)
    except (Damaged, Unsupported, struct.error, ValueError, IndexError):
        return None


def clip(data: bytes) -> Layered:
    """A drawing's size, layers and preview from its database; the layers' samples aren't decoded."""
    at = data.find(b"SQLite format 3\0")
    if at < 0:
        raise Damaged("no database")
    tables = sqlite_tables(data[at:])
    value = lambda columns, row, *names: next((row[i] for i, c in enumerate(columns) for n in names if c.lower() == n.lower() and row[i] is not None), None)
    if "Canvas" not in tables or not tables["Canvas"][1]:
        raise Damaged("no canvas")
    columns, rows = tables["Canvas"]
    width, height, dpi = (value(columns, rows[0], n) for n in ("CanvasWidth", "CanvasHeight", "CanvasResolution"))
    if not width or not height:
        raise Damaged("a canvas without a size")
    out = Layered(int(width), int(height), int(dpi or 300), int(dpi or 300))
    for row in tables.get("CanvasPreview", ([], []))[1]:
        for blob in row:
            if out.preview is None and isinstance(blob, bytes) and len(blob) > 8:
                out.preview = _preview(blob)
    columns, rows = tables.get("Layer", ([], []))
    for row in rows:
        opacity = value(columns, row, "LayerOpacity")
        out.layers.append(Layer(str(value(columns, row, "LayerName") or ""), right=out.width, bottom=out.height, opacity=min(1.0, (256 if opacity is None else opacity) / 256), visible=value(columns, row, "LayerVisibility") != 0, clipping=bool(value(columns, row, "LayerClip"))))
    return out
