"""TIFF files: one strip, little-endian, plain or Deflate."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ..sources.model import Image, Unsupported

PHOTOMETRIC = {"GRAY": 1, "RGB": 2, "CMYK": 5, "DEVICE_N": 5}


def write_tiff(image: Image, compress: bool = True) -> bytes:
    if image.color_space not in PHOTOMETRIC:
        raise Unsupported(image.color_space)
    body = image.data if image.bits == 8 else image.array().astype("<u2").tobytes()
    body = zlib.compress(body) if compress else body
    short, long, ratio, raw = 3, 4, 5, 7
    process = {"GRAY": 1, "RGB": 3}.get(image.color_space, 4)
    tags = [(256, long, [image.width]), (257, long, [image.height]), (258, short, [image.bits] * image.channels), (259, short, [8 if compress else 1]), (262, short, [PHOTOMETRIC[image.color_space]]), (273, long, [8]), (277, short, [image.channels]), (278, long, [image.height]), (279, long, [len(body)]), (282, ratio, [(image.dpi_x, 1)]), (283, ratio, [(image.dpi_y, 1)]), (284, short, [1]), (296, short, [2])]
    if image.channels > process:
        tags.append((338, short, [2 if image.alpha and i == 0 else 0 for i in range(image.channels - process)]))
    if image.icc:
        tags.append((34675, raw, image.icc))
    end = 8 + len(body) + len(body) % 2
    room, entries, more = end + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, values in sorted(tags):
        packed = bytes(values) if kind == raw else b"".join(struct.pack("<II", *v) for v in values) if kind == ratio else struct.pack(f"<{len(values)}{'H' if kind == short else 'I'}", *values)
        entries += struct.pack("<HHI", tag, kind, len(values))
        if len(packed) <= 4:
            entries += packed.ljust(4, b"\0")
        else:
            entries += struct.pack("<I", room + len(more))
            more += packed + b"\0" * (len(packed) % 2)
    return b"II" + struct.pack("<HI", 42, end) + body + b"\0" * (len(body) % 2) + struct.pack("<H", len(tags)) + entries + struct.pack("<I", 0) + more


def write_plates(image: Image, job: str = "job", composite: bool = False) -> dict[str, bytes]:
    """A gray file for each ink, by name; inks beyond four are the image's spots."""
    if image.color_space not in ("CMYK", "DEVICE_N"):
        raise Unsupported("plates are made of inks")
    import re

    names = ["Cyan", "Magenta", "Yellow", "Black", *image.spots]
    names += [f"Spot{i + 1}" for i in range(len(names) - 4, image.channels - 4)]
    samples = image.array()
    out = {}
    for i in range(image.channels):
        plate = Image(image.width, image.height, 1, np.ascontiguousarray(samples[:, :, i]).tobytes(), image.bits, "GRAY", image.dpi_x, image.dpi_y)
        out[f"{job}_{re.sub('[^A-Za-z0-9_-]', '_', names[i])}.tif"] = write_tiff(plate)
    if composite:
        out[f"{job}_composite.tif"] = write_tiff(image)
    return out
