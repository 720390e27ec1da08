"""Camera files whose sensor cells aren't compressed: TIFF/EP (DNG), RAF and MRW."""

from __future__ import annotations

import struct

import numpy as np

from ..operators.packed import demosaic
from .model import Damaged, Image, Unsupported, check_size
from .raster_files import need, tiff_tags

#: Tags that only camera files have.
CAMERA_TAGS = {0x828E, 0xC612, 0xC61D, 0xC61F, 0x9217}
SIGNATURES = (b"FUJIFILM", b"\0MRM", b"FOVb", b"IIRO", b"MMOR", b"IIRS")


def is_raw(data: bytes) -> bool:
    if data.startswith(SIGNATURES) or data[8:10] == b"CR" and data[:2] in (b"II", b"MM"):
        return True
    if data[:4] not in (b"II*\0", b"MM\0*"):
        return False
    try:
        tags = tiff_tags(data)[1]
    except (Damaged, struct.error):
        return False
    return bool(CAMERA_TAGS & tags.keys()) or tags.get(262) == [32803]


def raw(data: bytes) -> Image:
    if data.startswith(b"FUJIFILM"):
        need(data, 84, 8)
        at = struct.unpack_from(">I", data, 84)[0]
        return _cells(data, at, 600, 400, 16, ">", "grbg", 0, 16_383)
    if data.startswith(b"\0MRM"):
        return _cells(data, 128, 400, 300, 16, ">", "rggb", 0, 4095)
    if not is_raw(data) or data[:2] not in (b"II", b"MM"):
        raise Unsupported("a camera file of this kind")
    order, tags = tiff_tags(data)
    one = lambda tag, default: tags.get(tag, [default])[0]
    if one(259, 1) != 1:
        raise Unsupported("compressed sensor cells")
    pattern = one(0x828E, b"\0\1\1\2")
    pattern = bytes(tags[0x828E]) if isinstance(pattern, int) else bytes(pattern)
    names = "".join("rgb"[v] if v < 3 else "g" for v in pattern[:4])
    depth = one(258, 16)
    return _cells(data, one(273, 0), one(256, 400), one(257, 300), depth, order, names, one(0xC61A, 0), one(0xC61D, (1 << depth) - 1))


def _cells(data: bytes, at: int, width: int, height: int, depth: int, order: str, pattern: str, black: float, white: float) -> Image:
    check_size(width, height, 3)
    if depth not in (8, 16) or len(pattern) != 4:
        raise Unsupported(f"sensor cells of {depth} bits")
    step = depth // 8
    body = data[at : at + width * height * step].ljust(width * height * step, b"\0")
    cells = np.frombuffer(body, np.uint8 if depth == 8 else np.dtype(order + "u2"), width * height).reshape(height, width)
    return Image(width, height, 3, demosaic(cells, pattern, black, white).tobytes())
