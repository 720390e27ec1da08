"""Baseline JPEG (ISO 10918-1, JFIF): decoding, also at a half, a quarter or an eighth, and encoding."""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

from ..operators.raster import CHROMINANCE, LUMINANCE
from .model import Damaged, Image, Unsupported, check_size


def _zigzag() -> np.ndarray:
    """Places (row by row) in the order of the diagonals."""
    order = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (p[0] + p[1], p[1] if (p[0] + p[1]) % 2 == 0 else p[0]))
    return np.array([y * 8 + x for y, x in order])


ZIGZAG = _zigzag()
# The standard's Huffman tables (ISO 10918-1, annex K.3): for each length of a code, from 1 to 16 bits, its symbols.
# fmt: off
DC_LUMINANCE = [
    [],
    [0x00],
    [0x01, 0x02, 0x03, 0x04, 0x05],
    [0x06],
    [0x07],
    [0x08],
    [0x09],
    [0x0A],
    [0x0B],
    [],
    [],
    [],
    [],
    [],
    [],
    [],
]
DC_CHROMINANCE = [
    [],
    [0x00, 0x01, 0x02],
    [0x03],
    [0x04],
    [0x05],
    [0x06],
    [0x07],
    [0x08],
    [0x09],
    [0x0A],
    [0x0B],
    [],
    [],
    [],
    [],
    [],
]
AC_LUMINANCE = [
    [],
    [0x01, 0x02],
    [0x03],
    [0x00, 0x04, 0x11],
    [0x05, 0x12, 0x21],
    [0x31, 0x41],
    [0x06, 0x13, 0x51, 0x61],
    [0x07, 0x22, 0x71],
    [0x14, 0x32, 0x81, 0x91, 0xA1],
    [0x08, 0x23, 0x42, 0xB1, 0xC1],
    [0x15, 0x52, 0xD1, 0xF0],
    [0x24, 0x33, 0x62, 0x72],
    [],
    [],
    [0x82],
    [
        0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36,
        0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56,
        0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76,
        0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95,
        0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3,
        0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA,
        0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7,
        0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
    ],
]
AC_CHROMINANCE = [
    [],
    [0x00, 0x01],
    [0x02],
    [0x03, 0x11],
    [0x04, 0x05, 0x21, 0x31],
    [0x06, 0x12, 0x41, 0x51],
    [0x07, 0x61, 0x71],
    [0x13, 0x22, 0x32, 0x81],
    [0x08, 0x14, 0x42, 0x91, 0xA1, 0xB1, 0xC1],
    [0x09, 0x23, 0x33, 0x52, 0xF0],
    [0x15, 0x62, 0x72, 0xD1],
    [0x0A, 0x16, 0x24, 0x34],
    [],
    [0xE1],
    [0x25, 0xF1],
    [
        0x17, 0x18, 0x19, 0x1A, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43,
        0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63,
        0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x82,
        0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99,
        0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7,
        0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5,
        0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF2, 0xF3,
        0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA,
    ],
]
# fmt: on


def _table(by_length: list[list[int]]) -> tuple[list[int], list[int]]:
    """How many codes of each length there are, and all symbols."""
    return [len(x) for x in by_length], [v for x in by_length for v in x]


DC = {0: _table(DC_LUMINANCE), 1: _table(DC_CHROMINANCE)}
AC = {0: _table(AC_LUMINANCE), 1: _table(AC_CHROMINANCE)}


def codes(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, codes counted up within each length."""
    out, code, i = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[i]
            code, i = code + 1, i + 1
        code <<= 1
    return out


@lru_cache(16)
def lookup(counts: tuple[int, ...], symbols: tuple[int, ...]) -> list[int]:
    """For each 16 bits: length << 8 | symbol, or 0. Most files share a few tables, so these are kept."""
    table = [0] * 65_536
    for (length, code), symbol in codes(counts, symbols).items():
        low = code << (16 - length)
        table[low : low + (1 << (16 - length))] = [length << 8 | symbol] * (1 << (16 - length))
    return table


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def peek(self, n: int) -> int:
        while self.n < n:
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.n += 8
        return self.held >> (self.n - n) & ((1 << n) - 1)

    def take(self, n: int) -> int:
        v = self.peek(n) if n else 0
        self.n -= n
        self.held &= (1 << self.n) - 1
        return v

    def symbol(self, table: list[int]) -> int:
        got = table[self.peek(16)]
        if not got or self.at > len(self.data) + 8:
            raise Damaged("a code that isn't in its table")
        self.take(got >> 8)
        return got & 255

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def basis(n: int) -> np.ndarray:
    f, p = np.arange(n)[:, None], np.arange(n)[None, :]
    return 0.5 * np.where(f == 0, 2**-0.5, 1.0) * np.cos((2 * p + 1) * f * np.pi / (2 * n))


def scale_for(ratio: float) -> int:
    return 8 if ratio <= 0.15 else 4 if ratio <= 0.35 else 2 if ratio <= 0.70 else 1


def decode(data: bytes, scale: int = 1) -> Image:
    """scale: 1, 2, 4 or 8; blocks keep their lowest 8 / scale frequencies a side."""
    if data[:2] != b"\xff\xd8":
        raise Damaged("no JPEG signature")
    at, quant, huff, frame, restart, dpi, adobe, icc = 2, {}, {}, None, 0, (300, 300), None, {}
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            i = 0
            while i < len(body):
                wide, which = body[i] >> 4, body[i] & 15
                form = ">64H" if wide else ">64B"
                quant[which] = np.array(struct.unpack_from(form, body, i + 1))
                i += 1 + struct.calcsize(form)
        elif mark == 0xC4:
            i = 0
            while i + 17 <= len(body):
                counts = list(body[i + 1 : i + 17])
                huff[body[i]] = lookup(tuple(counts), tuple(body[i + 17 : i + 17 + sum(counts)]))
                i += 17 + sum(counts)
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            check_size(width, height, n)
            if depth != 8 or n not in (1, 3, 4):
                raise Unsupported(f"JPEG of {depth} bits and {n} components")
            frame = width, height, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise Unsupported("JPEG that isn't baseline")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xE0 and body[:5] == b"JFIF\0":
            unit, x, y = struct.unpack_from(">BHH", body, 7)
            dpi = {1: (x, y), 2: (int(x * 2.54 + 0.5), int(y * 2.54 + 0.5))}.get(unit, dpi)
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xE2 and body[:12] == b"ICC_PROFILE\0":
            icc[body[12]] = body[14:]
        elif mark == 0xDA:
            if not frame:
                raise Damaged("a scan before its frame")
            return _scan(data[at:], body, frame, quant, huff, restart, dpi, adobe, b"".join(icc[k] for k in sorted(icc)) or None, scale)
    raise Damaged("no scan")


def _scan(rest: bytes, body: bytes, frame, quant, huff, restart, dpi, adobe, icc, scale) -> Image:
    width, height, parts = frame
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    top_h, top_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-width // (8 * top_h)), -(-height // (8 * top_v))
    if len(parts) == 1:
        parts, top_h, top_v, across, down = [(parts[0][0], 1, 1, parts[0][3])], 1, 1, -(-width // 8), -(-height // 8)
    planes = [np.zeros((down * v, across * h, 64), np.int32) for _, h, v, _ in parts]
    pieces, i = [], 0
    while i < len(rest):  # entropy-coded pieces between restart marks
        j = i
        while (j := rest.find(b"\xff", j)) >= 0 and j + 1 < len(rest) and rest[j + 1] == 0:
            j += 2
        end = len(rest) if j < 0 or j + 1 >= len(rest) else j
        pieces.append(rest[i:end].replace(b"\xff\0", b"\xff"))
        if end == len(rest) or not 0xD0 <= rest[end + 1] <= 0xD7:
            break
        i = end + 2
    bits, before, piece = _Bits(pieces[0]), [0] * len(parts), 0
    try:
        for mcu in range(across * down):
            if restart and mcu and mcu % restart == 0:
                piece += 1
                bits, before = _Bits(pieces[piece] if piece < len(pieces) else b""), [0] * len(parts)
            y0, x0 = divmod(mcu, across)
            for c, (ident, h, v, _) in enumerate(parts):
                dc, ac = huff[tables[ident] >> 4], huff[16 | tables[ident] & 15]
                for b in range(h * v):
                    block = planes[c][y0 * v + b // h, x0 * h + b % h]
                    before[c] += bits.signed(bits.symbol(dc))
                    block[0] = before[c]
                    k = 1
                    while k < 64:
                        s = bits.symbol(ac)
                        if not s & 15:
                            if s != 0xF0:
                                break
                            k += 16
                            continue
                        k += s >> 4
                        if k > 63:
                            raise Damaged("a run beyond its block")
                        block[k] = bits.signed(s & 15)
                        k += 1
    except KeyError as e:
        raise Damaged(f"no table {e}") from e
    n = 8 // scale
    out_w, out_h = -(-width // scale), -(-height // scale)
    shown = []
    for plane, (_, h, v, q) in zip(planes, parts):
        if q not in quant:
            raise Damaged("no quantisation table")
        full = np.zeros(plane.shape, np.float64)
        full[:, :, ZIGZAG] = plane * quant[q]
        low = full.reshape(*plane.shape[:2], 8, 8)[:, :, :n, :n]
        w = basis(n) if n > 1 else np.array([[8**-0.5]])
        samples = np.einsum("abvu,vy,ux->aybx", low, w, w) + 128 if n > 1 else (low[:, :, 0, 0] / 8 + 128)[:, None, :, None]
        samples = samples.reshape(plane.shape[0] * n, plane.shape[1] * n)
        samples = samples.repeat(top_v // v, axis=0).repeat(top_h // h, axis=1)
        shown.append(samples[:out_h, :out_w])
    samples = np.stack(shown, axis=-1)
    if len(parts) > 1 and (adobe != 0 if len(parts) == 3 else adobe == 2):
        y, cb, cr = samples[..., 0], samples[..., 1] - 128, samples[..., 2] - 128
        samples = np.concatenate([np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=-1), samples[..., 3:]], axis=-1)
    out = np.floor(np.clip(samples, 0, 255) + 0.5).clip(0, 255).astype(np.uint8)
    if len(parts) == 4 and adobe is not None:
        out = 255 - out
    return Image(out_w, out_h, len(parts), out.tobytes(), 8, {1: "GRAY", 3: "RGB", 4: "CMYK"}[len(parts)], *(max(1, d // scale) for d in dpi), False, icc)


def quantiser(base: list[int], quality: int) -> np.ndarray:
    q = min(100, max(1, quality))
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(base) * scale + 50) // 100, 1, 255)


def encode(image: Image, quality: int = 85) -> bytes:
    """Gray, RGB (as YCbCr) or CMYK (inverted, as Adobe has it), without subsampling. Alpha is laid over white."""
    samples = image.array().astype(np.float64)
    if image.bits == 16:
        samples = np.floor(samples / 257 + 0.5)
    if image.color_space in ("RGB", "GRAY") and image.channels in (2, 4):
        a = samples[:, :, -1:] / 255
        samples = samples[:, :, :-1] * a + 255 * (1 - a)
    n = samples.shape[2]
    if n not in (1, 3, 4):
        raise Unsupported(f"JPEG of {n} channels")
    if n == 3:
        r, g, b = np.moveaxis(samples, 2, 0)
        samples = np.stack([0.299 * r + 0.587 * g + 0.114 * b, -0.168736 * r - 0.331264 * g + 0.5 * b + 128, 0.5 * r - 0.418688 * g - 0.081312 * b + 128], axis=2)
    elif n == 4:
        samples = 255 - samples
    tables = [quantiser(LUMINANCE, quality), quantiser(CHROMINANCE, quality)]
    kinds = [0, 1, 1] if n == 3 else [0] * n
    used = sorted(set(kinds))
    h, w = samples.shape[:2]
    padded = np.pad(samples, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge")
    blocks = padded.reshape(padded.shape[0] // 8, 8, padded.shape[1] // 8, 8, n) - 128
    f = basis(8)
    freq = np.einsum("aybxc,vy,ux->abcvu", blocks, f, f).reshape(-1, n, 64)[:, :, ZIGZAG]
    steps = np.stack([tables[k][ZIGZAG] for k in kinds])
    levels = np.rint(freq / steps).astype(int)
    segment = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, 1, image.dpi_x, image.dpi_y, 0, 0))
    if n == 4:
        out += segment(0xEE, b"Adobe" + struct.pack(">HHHB", 100, 0, 0, 0))
    if image.icc:
        parts = [image.icc[i : i + 65_000] for i in range(0, len(image.icc), 65_000)]
        for i, part in enumerate(parts):
            out += segment(0xE2, b"ICC_PROFILE\0" + bytes([i + 1, len(parts)]) + part)
    out += b"".join(segment(0xDB, bytes([k]) + tables[k][ZIGZAG].astype(np.uint8).tobytes()) for k in used)
    out += segment(0xC0, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([i + 1, 0x11, k]) for i, k in enumerate(kinds)))
    for k in used:
        for group, table in ((0, DC[k]), (16, AC[k])):
            out += segment(0xC4, bytes([group | k]) + bytes(table[0]) + bytes(table[1]))
    out += segment(0xDA, bytes([n]) + b"".join(bytes([i + 1, k << 4 | k]) for i, k in enumerate(kinds)) + b"\0\x3f\0")
    return out + _entropy(levels, kinds) + b"\xff\xd9"


@lru_cache(2)
def _standard(k: int) -> tuple[dict, dict]:
    """(length, code) of each symbol in the standard's tables k, of DC and of AC."""
    return tuple({s: at for at, s in codes(*tables[k]).items()} for tables in (DC, AC))


def _entropy(levels: np.ndarray, kinds: list[int]) -> bytes:
    dc, ac = ({k: _standard(k)[i] for k in set(kinds)} for i in (0, 1))
    held = n = 0
    out = bytearray()

    def put(length: int, code: int):
        nonlocal held, n
        held, n = held << length | code, n + length
        while n >= 8:
            n -= 8
            byte = held >> n & 255
            out.append(byte)
            if byte == 255:
                out.append(0)
        held &= (1 << n) - 1

    def number(v: int, size: int):
        put(size, v if v > 0 else v + (1 << size) - 1)

    before = [0] * len(kinds)
    for block in levels.tolist():
        for c, k in enumerate(kinds):
            row = block[c]
            diff, before[c] = row[0] - before[c], row[0]
            size = abs(diff).bit_length()
            put(*dc[k][size])
            if size:
                number(diff, size)
            zeros = 0
            last = max((i for i in range(1, 64) if row[i]), default=0)
            for v in row[1 : last + 1]:
                if not v:
                    zeros += 1
                    continue
                while zeros > 15:
                    put(*ac[k][0xF0])
                    zeros -= 16
                size = abs(v).bit_length()
                put(*ac[k][zeros << 4 | size])
                number(v, size)
                zeros = 0
            if last < 63:
                put(*ac[k][0])
    if n:
        put(8 - n, (1 << (8 - n)) - 1)
    return bytes(out)
