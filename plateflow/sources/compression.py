"""Run lengths, LZW, Deflate and predictors of raster files (TIFF 6.0, PNG, PDF)."""

from __future__ import annotations

import zlib

import numpy as np

from .model import Damaged, Unsupported


def packbits(data: bytes, end_mark: bool = False) -> bytes:
    """A head of 0 to 127 copies one more byte than it says, 129 to 255 repeat a byte 257 - head times; 128 is nothing, or the end."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
        elif end_mark:
            break
    return bytes(out)


def pack(data: bytes) -> bytes:
    """The same the other way: runs of three or more are repeated."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run >= 3:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        start = i
        while i < n and i - start < 128 and not (i + 2 < n and data[i] == data[i + 1] == data[i + 2]):
            i += 1
        out += bytes([i - start - 1]) + data[start:i]
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, high bits first, that grow one code early."""
    clear, end = 256, 257
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, before, width = bytearray(), b"", 9
    bits = held = 0
    for byte in data:
        held = held << 8 | byte
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == end:
            break
        if code == clear:
            del table[258:]
            width, before = 9, b""
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and before:
            entry = before + before[:1]
        else:
            break  # a code that can't be: what came before it stays
        out += entry
        if before:
            table.append(before + entry[:1])
        before = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return bytes(out)


def inflate(data: bytes) -> bytes:
    """With zlib's frame or without; of a stream that is cut off, what there is."""
    for wbits in (15, -15):
        d = zlib.decompressobj(wbits)
        try:
            return d.decompress(data) + d.flush()
        except zlib.error:
            d = zlib.decompressobj(wbits)
            out = b""
            try:
                for i in range(0, len(data), 512):
                    out += d.decompress(data[i : i + 512])
            except zlib.error:
                if out:
                    return out
    raise Damaged("a broken Deflate stream")


def sum_rows(samples: np.ndarray) -> np.ndarray:
    """Undoes horizontal differences of (height, width, channels) samples, modulo their type."""
    return np.cumsum(samples, axis=1, dtype=samples.dtype)


def unfilter(data: bytes, row: int, step: int) -> bytes:
    """Undoes PNG's filters: rows of `row` bytes, each behind its filter's number; step: bytes of a pixel."""
    out, before = bytearray(), np.zeros(row, np.uint8)
    for at in range(0, len(data) - row, row + 1):
        kind, line = data[at], np.frombuffer(data, np.uint8, row, at + 1).copy()
        if kind == 1:
            for c in range(step):
                line[c::step] = np.cumsum(line[c::step], dtype=np.uint8)
        elif kind == 2:
            line += before
        elif kind in (3, 4):
            cur, up = line.tolist(), before.tolist()
            for i in range(row):
                left = cur[i - step] if i >= step else 0
                if kind == 3:
                    cur[i] = (cur[i] + (left + up[i]) // 2) & 255
                else:
                    corner = up[i - step] if i >= step else 0
                    p = left + up[i] - corner
                    a, b, c = abs(p - left), abs(p - up[i]), abs(p - corner)
                    cur[i] = (cur[i] + (left if a <= b and a <= c else up[i] if b <= c else corner)) & 255
            line = np.array(cur, np.uint8)
        elif kind:
            raise Unsupported(f"filter {kind}")
        out += line.tobytes()
        before = line
    return bytes(out)


def unpack_bits(data: bytes, width: int, height: int, channels: int, depth: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, rows padded to bytes, as (height, width * channels) numbers."""
    row = (width * channels * depth + 7) // 8
    bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height).reshape(height, row), axis=1)
    bits = bits[:, : width * channels * depth].reshape(height, width * channels, depth)
    return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
