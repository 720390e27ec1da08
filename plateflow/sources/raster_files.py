"""PNG, BMP, TGA, TIFF and WebP files (the published specifications)."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from . import compression as C
from .model import Damaged, Image, Unsupported, check_size


def need(data: bytes, at: int, n: int) -> None:
    if at < 0 or at + n > len(data):
        raise Damaged(f"{n} bytes at {at} of {len(data)}")


#: First column and row, and steps across and down, of the passes of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def _png_samples(data: bytes, width: int, height: int, channels: int, depth: int, interlaced: int) -> np.ndarray:
    """(height, width, channels) samples of filtered rows, as numbers of the file's depth."""
    out, at = np.zeros((height, width, channels), np.dtype(">u2") if depth == 16 else np.uint8), 0
    for x, y, across, down in PASSES if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // across), -(-(height - y) // down)
        if w <= 0 or h <= 0:
            continue
        row = (w * channels * depth + 7) // 8
        raw = C.unfilter(data[at : at + (row + 1) * h], row, max(1, channels * depth // 8))
        at += (row + 1) * h
        if len(raw) < row * h:
            raise Damaged("rows are missing")
        part = C.unpack_bits(raw, w, h, channels, depth) if depth < 8 else np.frombuffer(raw, out.dtype, w * h * channels)
        out[y::down, x::across] = part.reshape(h, w, channels)
    return out


def png(data: bytes, verify: bool = True) -> Image:
    """All colour types and depths, interlaced or not."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise Damaged("no PNG signature")
    at, head, palette, alpha, pixels, dpi, icc = 8, None, None, None, [], (300, 300), None
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        need(data, at + 8, size + 4)
        body = data[at + 8 : at + 8 + size]
        if verify and zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + size)[0]:
            raise Damaged(f"chunk {kind!r} has a wrong checksum")
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body[:13])
            check_size(head[0], head[1], 4, head[2])
        elif kind == b"PLTE":
            palette = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            pixels.append(body)
        elif kind == b"pHYs" and body[8] == 1:
            dpi = tuple(int(v * 0.0254 + 0.5) for v in struct.unpack(">II", body[:8]))
        elif kind == b"iCCP":
            name_end = body.index(b"\0")
            icc = C.inflate(body[name_end + 2 :])
        elif kind == b"IEND":
            break
    if not head:
        raise Damaged("no header")
    width, height, depth, color, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(color)
    if not channels or depth not in (1, 2, 4, 8, 16):
        raise Damaged(f"colour type {color} of {depth} bits")
    samples = _png_samples(C.inflate(b"".join(pixels)), width, height, channels, depth, interlaced)
    if depth < 8 and color == 0:
        samples = (samples.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    raw = samples.tobytes()
    bits = 16 if depth == 16 else 8
    if color == 3:
        if palette is None:
            raise Damaged("no palette")
        index = np.minimum(np.frombuffer(raw, np.uint8, width * height), len(palette) - 1)
        rgb = palette[index]
        if alpha is not None:
            full = np.full(len(palette), 255, np.uint8)
            full[: len(alpha)] = alpha[: len(palette)]
            return Image(width, height, 4, np.column_stack([rgb, full[index]]).tobytes(), 8, "RGB", *dpi, True, icc)
        return Image(width, height, 3, rgb.tobytes(), 8, "RGB", *dpi, False, icc)
    return Image(width, height, channels, raw, bits, "GRAY" if channels < 3 else "RGB", *dpi, color in (4, 6), icc)


def write_png(image: Image) -> bytes:
    """8 or 16 bits, gray or RGB, with alpha if there is any."""
    color = {1: 0, 2: 4, 3: 2, 4: 6}.get(image.channels)
    if color is None or image.color_space not in ("GRAY", "RGB"):
        raise Unsupported("PNG is gray or RGB")
    row = image.width * image.channels * image.bits // 8
    rows = b"".join(b"\0" + image.data[i : i + row] for i in range(0, len(image.data), row))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    metre = lambda dpi: int(dpi / 0.0254 + 0.5)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.width, image.height, image.bits, color, 0, 0, 0)) + chunk(b"pHYs", struct.pack(">IIB", metre(image.dpi_x), metre(image.dpi_y), 1)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def bmp(data: bytes) -> Image:
    """8 bits with a palette, 24 or 32 bits; rows from the bottom unless the height is negative."""
    need(data, 0, 54)
    if data[:2] != b"BM":
        raise Damaged("no BMP signature")
    at, size, width, height, _, depth, packing, _, ppm_x, ppm_y, used = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    if size < 40 or depth not in (8, 24, 32) or packing not in (0, 3):
        raise Unsupported(f"BMP of {depth} bits")
    check_size(width, abs(height), 3)
    row = (width * depth // 8 + 3) // 4 * 4
    body = data[at : at + row * abs(height)].ljust(row * abs(height), b"\0")  # rows that are cut off are black
    lines = np.frombuffer(body, np.uint8).reshape(abs(height), row)[:, : width * depth // 8]
    lines = lines[::-1] if height > 0 else lines
    if depth == 8:
        table = np.zeros((256, 3), np.uint8)
        held = np.frombuffer(data[14 + size : 14 + size + 4 * (used or 256)], np.uint8)
        held = held[: len(held) // 4 * 4].reshape(-1, 4)[:, 2::-1]
        table[: len(held)] = held
        pixels = table[lines]
    else:
        pixels = lines.reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    dpi = lambda v: int(v * 0.0254 + 0.5)
    return Image(width, abs(height), 3, np.ascontiguousarray(pixels).tobytes(), 8, "RGB", dpi(ppm_x), dpi(ppm_y))


def tga(data: bytes) -> Image:
    """Gray, palette and true colour, plain or in runs."""
    need(data, 0, 18)
    name, _, kind, first, entries, entry_bits, _, _, width, height, depth, how = struct.unpack_from("<BBBHHBHHHHBB", data)
    if kind not in (1, 2, 3, 9, 10, 11) or depth not in (8, 15, 16, 24, 32):
        raise Unsupported(f"TGA type {kind} of {depth} bits")
    check_size(width, height, 4)
    at, step = 18 + name, (depth + 7) // 8
    table = data[at : at + entries * ((entry_bits + 7) // 8)]
    at += entries * ((entry_bits + 7) // 8)
    total = width * height * step
    if kind > 8:
        out = bytearray()
        while len(out) < total and at < len(data):
            n = (data[at] & 127) + 1
            if data[at] & 128:
                out += data[at + 1 : at + 1 + step] * n
                at += 1 + step
            else:
                out += data[at + 1 : at + 1 + n * step]
                at += 1 + n * step
        raw = bytes(out)
    else:
        raw = data[at : at + total]
    pixels = np.frombuffer(raw[:total].ljust(total, b"\0"), np.uint8).reshape(height, width, step)
    if kind in (1, 9):
        colours = _tga_colours(np.frombuffer(table, np.uint8).reshape(entries, -1), entry_bits)
        pixels = colours[np.clip(pixels[:, :, 0].astype(int) - first, 0, max(0, entries - 1))]
    elif step > 1:
        pixels = _tga_colours(pixels, depth)
    pixels = pixels if how & 0x20 else pixels[::-1]
    pixels = pixels[:, ::-1] if how & 0x10 else pixels
    channels = pixels.shape[2]
    return Image(width, height, channels, np.ascontiguousarray(pixels).tobytes(), 8, "GRAY" if channels == 1 else "RGB", alpha=channels == 4)


def _tga_colours(raw: np.ndarray, depth: int) -> np.ndarray:
    if depth in (15, 16):
        v = raw[..., 0].astype(np.uint16) | raw[..., 1].astype(np.uint16) << 8
        five = np.stack([v >> 10 & 31, v >> 5 & 31, v & 31], axis=-1)
        return (five * 255 // 31).astype(np.uint8)
    return raw[..., [2, 1, 0, 3]] if depth == 32 else raw[..., 2::-1]


TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "B", 8: "h", 9: "i"}


def tiff_tags(data: bytes, at: int | None = None) -> tuple[str, dict[int, list]]:
    """The byte order and the first directory's values by tag."""
    need(data, 0, 8)
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] not in (42, 0x4F52, 0x5352, 85):
        raise Damaged("no TIFF signature")
    at = struct.unpack_from(order + "I", data, 4)[0] if at is None else at
    need(data, at, 2)
    tags: dict[int, list] = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        p = at + 2 + 12 * i
        need(data, p, 12)
        tag, kind, count = struct.unpack_from(order + "HHI", data, p)
        if kind not in TYPES or count > len(data):
            continue
        form = TYPES[kind]
        size = struct.calcsize("=" + form) * count
        q = p + 8 if size <= 4 else struct.unpack_from(order + "I", data, p + 8)[0]
        if q + size > len(data):
            continue
        if kind == 2 or kind == 7:
            tags[tag] = [data[q : q + count]]
        elif kind == 5:
            pair = struct.unpack_from(f"{order}{2 * count}I", data, q)
            tags[tag] = [a / b if b else 0.0 for a, b in zip(pair[::2], pair[1::2])]
        else:
            tags[tag] = list(struct.unpack_from(f"{order}{count}{form}", data, q))
    return order, tags


def tiff(data: bytes) -> Image:
    """The first image, in strips, with its samples side by side."""
    order, tags = tiff_tags(data)
    one = lambda tag, default: tags.get(tag, [default])[0]
    width, height = one(256, 0), one(257, 0)
    depths, channels, packing = tags.get(258, [1]), one(277, 1), one(259, 1)
    depth = depths[0]
    check_size(width, height, channels, max(depth, 8))
    if 322 in tags or one(284, 1) != 1 or depth not in (1, 2, 4, 8, 16) or any(d != depth for d in depths):
        raise Unsupported("TIFF with tiles, planes or odd depths")
    row = (width * channels * depth + 7) // 8
    per, strips = one(278, height), []
    sizes = tags.get(279) or [len(data)] * len(tags.get(273, []))
    for i, (at, n) in enumerate(zip(tags.get(273, []), sizes)):
        raw = data[at : at + n]
        if packing in (8, 32946):
            raw = C.inflate(raw)
        elif packing == 5:
            raw = C.lzw(raw)
        elif packing == 32773:
            raw = C.packbits(raw)
        elif packing != 1:
            raise Unsupported(f"TIFF compression {packing}")
        rows = min(per, height - i * per)
        strips.append(raw[: rows * row].ljust(rows * row, b"\0"))
    body = b"".join(strips)
    if len(body) < row * height:
        raise Damaged("strips are missing")
    photometric = one(262, 1)
    if depth < 8:
        samples = C.unpack_bits(body, width, height, channels, depth)
        if photometric != 3:
            samples = (samples.astype(np.int64) * 255 // ((1 << depth) - 1)).astype(np.uint8)
        samples = samples.reshape(height, width, channels)
    else:
        samples = np.frombuffer(body, np.uint8 if depth == 8 else np.dtype(order + "u2"), width * height * channels).reshape(height, width, channels)
    if one(317, 1) == 2:
        samples = C.sum_rows(samples.astype(samples.dtype.newbyteorder("=")))
    if photometric == 0:
        samples = np.iinfo(samples.dtype).max - samples
    unit = {2: 1.0, 3: 2.54}.get(one(296, 2), 0)
    dpi = lambda tag: int(one(tag, 0.0) * unit + 0.5)
    bits = 16 if depth == 16 else 8
    if photometric == 3:
        table = np.array(tags.get(320, [0] * 768)).reshape(3, -1).T // 256
        samples, channels = table[samples[:, :, 0]].astype(np.uint8), 3
    space = "CMYK" if photometric == 5 else "GRAY" if channels < 3 else "RGB"
    alpha = 338 in tags and channels in (2, 4) and space != "CMYK"
    out = samples.astype(np.uint8) if bits == 8 else samples.astype(">u2")
    return Image(width, height, channels, out.tobytes(), bits, space, dpi(282), dpi(283), alpha, tags[34675][0] if 34675 in tags else None)


def webp_size(data: bytes) -> tuple[int, int, bool]:
    """Width, height and whether there is alpha; the samples of WebP files aren't decoded here."""
    need(data, 0, 30)
    kind = data[12:16]
    if kind == b"VP8X":
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little"), bool(data[20] & 16)
    if kind == b"VP8L":
        v = int.from_bytes(data[21:25], "little")
        return (v & 0x3FFF) + 1, (v >> 14 & 0x3FFF) + 1, bool(v >> 28 & 1)
    if kind == b"VP8 ":
        w, h = struct.unpack_from("<HH", data, 26)
        return w & 0x3FFF, h & 0x3FFF, False
    raise Damaged("no WebP chunk")


def webp(data: bytes) -> Image:
    raise Unsupported(f"WebP of {webp_size(data)[:2]}")
