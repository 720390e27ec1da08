"""Outlines of TrueType and CFF fonts."""

from __future__ import annotations

import struct
from dataclasses import dataclass

from .model import Damaged, Unsupported

Command = tuple[str, list[float]]


@dataclass
class Glyph:
    contours: list[list[tuple[float, float, bool]]]


class TrueType:
    """Tables head, maxp, cmap (format 4), loca and glyf; simple and composite glyphs."""

    def __init__(self, data: bytes):
        self.data, self.tables = data, {}
        try:
            for i in range(struct.unpack_from(">H", data, 4)[0]):
                tag, _, at, size = struct.unpack_from(">4sIII", data, 12 + 16 * i)
                if at + size > len(data):
                    raise Damaged(f"table {tag!r} is cut off")
                self.tables[tag.decode("latin1")] = at
            self.units, self.long = struct.unpack_from(">H", data, self.tables["head"] + 18)[0], struct.unpack_from(">h", data, self.tables["head"] + 50)[0]
            self.count = struct.unpack_from(">H", data, self.tables["maxp"] + 4)[0]
            self.map = self.characters()
        except (struct.error, KeyError) as e:
            raise Damaged(f"a font without {e}") from e

    def characters(self) -> dict[int, int]:
        at = self.tables["cmap"]
        for i in range(struct.unpack_from(">H", self.data, at + 2)[0]):
            sub = at + struct.unpack_from(">HHI", self.data, at + 4 + 8 * i)[2]
            if struct.unpack_from(">H", self.data, sub)[0] == 4:
                return self.segments(sub)
        return {}

    def segments(self, at: int) -> dict[int, int]:
        n = struct.unpack_from(">H", self.data, at + 6)[0] // 2
        read = lambda form, p: struct.unpack_from(f">{n}{form}", self.data, p)
        ends, starts, deltas, ranges = read("H", at + 14), read("H", at + 16 + 2 * n), read("h", at + 16 + 4 * n), read("H", at + 16 + 6 * n)
        out = {}
        for i in range(n):
            for c in range(starts[i], min(ends[i], 0xFFFE) + 1):
                g = c
                if ranges[i]:
                    p = at + 16 + 6 * n + 2 * i + ranges[i] + 2 * (c - starts[i])
                    g = struct.unpack_from(">H", self.data, p)[0] if p + 2 <= len(self.data) else 0
                    if not g:
                        continue
                out[c] = (g + deltas[i]) & 0xFFFF
        return out

    def glyph(self, index: int, depth: int = 0) -> Glyph:
        if index >= self.count or depth > 5:
            return Glyph([])
        loca, glyf = self.tables["loca"], self.tables["glyf"]
        a, b = struct.unpack_from(">II", self.data, loca + 4 * index) if self.long else (2 * v for v in struct.unpack_from(">HH", self.data, loca + 2 * index))
        if a == b:
            return Glyph([])
        n = struct.unpack_from(">h", self.data, glyf + a)[0]
        return self.simple(glyf + a + 10, n) if n >= 0 else self.composite(glyf + a + 10, depth)

    def simple(self, at: int, n: int) -> Glyph:
        ends = struct.unpack_from(f">{n}H", self.data, at)
        at += 2 * n
        at += 2 + struct.unpack_from(">H", self.data, at)[0]
        total, flags = (ends[-1] + 1 if n else 0), []
        while len(flags) < total:
            f = self.data[at]
            at += 1
            flags.append(f)
            if f & 8:
                flags += [f] * self.data[at]
                at += 1
        axes = []
        for short, same in ((2, 16), (4, 32)):
            v, values = 0, []
            for f in flags[:total]:
                if f & short:
                    v += self.data[at] if f & same else -self.data[at]
                    at += 1
                elif not f & same:
                    v += struct.unpack_from(">h", self.data, at)[0]
                    at += 2
                values.append(v)
            axes.append(values)
        points = [(float(x), float(y), bool(f & 1)) for x, y, f in zip(*axes, flags)]
        return Glyph([points[a:b] for a, b in zip((0, *(e + 1 for e in ends)), (e + 1 for e in ends))])

    def composite(self, at: int, depth: int) -> Glyph:
        out = []
        while True:
            flags, index = struct.unpack_from(">HH", self.data, at)
            at += 4
            dx, dy = struct.unpack_from(">hh" if flags & 1 else ">bb", self.data, at)
            at += 4 if flags & 1 else 2
            m = [1.0, 0.0, 0.0, 1.0]
            n = 1 if flags & 8 else 2 if flags & 0x40 else 4 if flags & 0x80 else 0
            v = [x / 16_384 for x in struct.unpack_from(f">{n}h", self.data, at)]
            at += 2 * n
            m = [v[0], 0.0, 0.0, v[0]] if n == 1 else [v[0], 0.0, 0.0, v[1]] if n == 2 else v if n == 4 else m
            dx, dy = (dx, dy) if flags & 2 else (0, 0)
            for c in self.glyph(index, depth + 1).contours:
                out.append([(m[0] * x + m[2] * y + dx, m[1] * x + m[3] * y + dy, on) for x, y, on in c])
            if not flags & 0x20:
                return Glyph(out)


def outline(glyph: Glyph) -> list[Command]:
    """Moves and cubics of quadratic contours; points between two controls are implied."""
    out: list[Command] = []
    for c in glyph.contours:
        if not c:
            continue
        full = []
        for i, p in enumerate(c):
            q = c[(i + 1) % len(c)]
            full.append(p)
            if not p[2] and not q[2]:
                full.append(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, True))
        first = next((i for i, p in enumerate(full) if p[2]), None)
        if first is None:
            continue
        full = full[first:] + full[: first + 1]
        here, i = full[0], 1
        out.append(("M", [here[0], here[1]]))
        while i < len(full):
            p = full[i]
            if p[2]:
                out.append(("L", [p[0], p[1]]))
                here, i = p, i + 1
            else:
                e = full[i + 1]
                two = [v for a in (here, e) for v in (a[0] + 2 / 3 * (p[0] - a[0]), a[1] + 2 / 3 * (p[1] - a[1]))]
                out.append(("C", [*two, e[0], e[1]]))
                here, i = e, i + 2
        out.append(("Z", []))
    return out


def charstring(code: bytes) -> list[Command]:
    """A Type 2 charstring's moves, lines and curves; hints are passed over, subroutines aren't called."""
    out: list[Command] = []
    stack: list[float] = []
    x = y = 0.0
    i = hints = 0

    def line(dx: float, dy: float):
        nonlocal x, y
        x, y = x + dx, y + dy
        out.append(("L", [x, y]))

    def curve(a: float, b: float, c: float, d: float, e: float, f: float):
        nonlocal x, y
        p = [x + a, y + b, x + a + c, y + b + d]
        x, y = p[2] + e, p[3] + f
        out.append(("C", [*p, x, y]))

    def move(dx: float, dy: float):
        nonlocal x, y
        if out and out[-1][0] != "Z":
            out.append(("Z", []))
        x, y = x + dx, y + dy
        out.append(("M", [x, y]))

    while i < len(code):
        b = code[i]
        i += 1
        if b >= 32 or b == 28:
            if b == 28:
                stack.append(struct.unpack_from(">h", code, i)[0])
                i += 2
            elif b < 247:
                stack.append(b - 139)
            elif b < 255:
                stack.append((b - 247) * 256 + code[i] + 108 if b < 251 else -(b - 251) * 256 - code[i] - 108)
                i += 1
            else:
                stack.append(struct.unpack_from(">i", code, i)[0] / 65_536)
                i += 4
            continue
        s = stack
        if b == 21:
            move(*s[-2:])
        elif b == 22:
            move(s[-1], 0.0)
        elif b == 4:
            move(0.0, s[-1])
        elif b == 5:
            for k in range(0, len(s) - 1, 2):
                line(s[k], s[k + 1])
        elif b in (6, 7):
            for k, v in enumerate(s):
                line(v, 0.0) if (k % 2 == 0) == (b == 6) else line(0.0, v)
        elif b in (8, 24):
            n = len(s) - (2 if b == 24 else 0)
            for k in range(0, n - 5, 6):
                curve(*s[k : k + 6])
            if b == 24:
                line(*s[-2:])
        elif b == 25:
            for k in range(0, len(s) - 7, 2):
                line(s[k], s[k + 1])
            curve(*s[-6:])
        elif b in (26, 27):
            extra = s.pop(0) if len(s) % 4 else 0.0
            for k in range(0, len(s) - 3, 4):
                curve(*((extra, s[k], s[k + 1], s[k + 2], 0.0, s[k + 3]) if b == 26 else (s[k], extra, s[k + 1], s[k + 2], s[k + 3], 0.0)))
                extra = 0.0
        elif b in (30, 31):
            level = b == 31
            for k in range(0, len(s) - 3, 4):
                last = s[k + 4] if len(s) - k == 5 else 0.0
                curve(*((s[k], 0.0, s[k + 1], s[k + 2], last, s[k + 3]) if level else (0.0, s[k], s[k + 1], s[k + 2], s[k + 3], last)))
                level = not level
        elif b in (1, 3, 18, 23):
            hints += len(s) // 2
        elif b in (19, 20):
            hints += len(s) // 2
            i += (hints + 7) // 8
        elif b == 14:
            break
        elif b == 12:
            op = code[i]
            i += 1
            two = {10: lambda a, c: a + c, 11: lambda a, c: a - c, 12: lambda a, c: a / c if c else 0.0, 24: lambda a, c: a * c}
            if op in two and len(s) > 1:
                c = s.pop()
                s.append(two[op](s.pop(), c))
                continue
            if op in (9, 14) and s:
                s.append(abs(s.pop()) if op == 9 else -s.pop())
                continue
            raise Unsupported(f"operator 12 {op}")
        else:
            raise Unsupported(f"operator {b}")
        stack.clear()
    if out and out[-1][0] != "Z":
        out.append(("Z", []))
    return out


def text_outline(font: TrueType, text: str, size: float, x: float = 0.0, y: float = 0.0) -> list[Command]:
    """A line of text as paths, y downward; a glyph is as wide as its outline and a tenth of the size, an empty one three tenths."""
    k, out = size / font.units, []
    for c in text:
        glyph = font.glyph(font.map.get(ord(c), 0))
        commands = outline(glyph)
        xs = [p[0] for contour in glyph.contours for p in contour]
        if not xs:
            x += 0.3 * size
            continue
        low = min(xs)
        out += [(op, [x + (v - low) * k if i % 2 == 0 else y - v * k for i, v in enumerate(args)]) for op, args in commands]
        x += (max(xs) - low) * k + 0.1 * size
    return out
