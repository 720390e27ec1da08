"""ICC profiles: header, tags, curves and tables (ICC.1:2010)."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from datetime import datetime, timezone

import numpy as np

from .model import Damaged


@dataclass
class Profile:
    version: str
    device: str
    space: str
    pcs: str
    intent: int
    created: datetime | None
    tags: dict[str, bytes] = field(default_factory=dict)

    @property
    def is_matrix(self) -> bool:
        """Primaries and curves for red, green and blue are all there."""
        return {f"{c}{k}" for c in "rgb" for k in ("XYZ", "TRC")} <= self.tags.keys()

    @property
    def is_table(self) -> bool:
        return bool({"A2B0", "B2A0"} & self.tags.keys())


def parse(data: bytes) -> Profile:
    if len(data) < 132 or data[36:40] != b"acsp":
        raise Damaged("no profile signature")
    size = struct.unpack_from(">I", data)[0]
    if size > len(data):
        raise Damaged(f"{len(data)} bytes of {size}")
    when = struct.unpack_from(">6H", data, 24)
    try:
        created = datetime(*when, tzinfo=timezone.utc)
    except ValueError:
        created = None
    text = lambda at: data[at : at + 4].decode("latin1").strip()
    out = Profile(f"{data[8]}.{data[9] >> 4}.{data[9] & 15}", text(12), text(16), text(20), struct.unpack_from(">I", data, 64)[0], created)
    for i in range(min(1000, struct.unpack_from(">I", data, 128)[0])):
        if 144 + 12 * i > len(data):
            raise Damaged("the tag table is cut off")
        name, at, n = struct.unpack_from(">4sII", data, 132 + 12 * i)
        if at + n > len(data):
            raise Damaged(f"tag {name!r} is cut off")
        out.tags[name.decode("latin1")] = data[at : at + n]
    return out


def build(space: str, pcs: str, device: str, tags: dict[str, bytes]) -> bytes:
    """A version 4.3 profile; each tag begins at a multiple of four."""
    at, table, body = 132 + 12 * len(tags), b"", b""
    for name, raw in tags.items():
        table += struct.pack(">4sII", name.encode(), at + len(body), len(raw))
        body += raw + b"\0" * (-len(raw) % 4)
    head = struct.pack(">I4sI4s4s4s6H4s", at + len(body), b"", 0x04300000, device.encode(), space.ljust(4).encode(), pcs.ljust(4).encode(), 2000, 1, 1, 0, 0, 0, b"acsp")
    head = head.ljust(68, b"\0") + struct.pack(">3i", *(round(v * 65_536) for v in (0.9642, 1.0, 0.8249)))
    return head.ljust(128, b"\0") + struct.pack(">I", len(tags)) + table + body


def xyz(tag: bytes) -> tuple[float, ...]:
    if tag[:4] != b"XYZ ":
        raise Damaged("no XYZ tag")
    return tuple(v / 65_536 for v in struct.unpack_from(">3i", tag, 8))


def xyz_tag(values) -> bytes:
    return b"XYZ \0\0\0\0" + struct.pack(">3i", *(round(v * 65_536) for v in values))


#: How many numbers a parametric curve of each type has.
PARAMETERS = (1, 3, 4, 5, 7)


def curve(tag: bytes):
    """('gamma', g), ('table', values) or ('parametric', type, numbers)."""
    if tag[:4] == b"curv":
        n = struct.unpack_from(">I", tag, 8)[0]
        if n == 0:
            return "gamma", 1.0
        if 12 + 2 * n > len(tag):
            raise Damaged("a curve is cut off")
        if n == 1:
            return "gamma", struct.unpack_from(">H", tag, 12)[0] / 256
        return "table", (np.frombuffer(tag, ">u2", n, 12) / 65_535).tolist()
    if tag[:4] == b"para":
        kind = struct.unpack_from(">H", tag, 8)[0]
        if kind >= len(PARAMETERS) or 12 + 4 * PARAMETERS[kind] > len(tag):
            raise Damaged("a curve that isn't one")
        return "parametric", kind, [v / 65_536 for v in struct.unpack_from(f">{PARAMETERS[kind]}i", tag, 12)]
    raise Damaged("no curve")


def _curves(tag: bytes, at: int, n: int) -> list:
    """n curves that stand one after the other, each at a multiple of four, as functions."""
    rows = []
    for _ in range(n):
        if at + 12 > len(tag):
            raise Damaged("a curve is cut off")
        kind, count = tag[at : at + 4], struct.unpack_from(">I", tag, at + 8)[0]
        size = 12 + 2 * count if kind == b"curv" else 12 + 4 * PARAMETERS[min(count >> 16, 4)]
        rows.append(unit_curve(tag[at : at + size]))
        at += size + -size % 4
    return rows


def _curve_table(tag: bytes) -> dict:
    """A table between curves (mAB: A, grid, B; mBA: B, grid, A); a grid has its own number of nodes on each axis."""
    n_in, n_out = tag[8:10]
    at_b, _, _, at_grid, at_a = struct.unpack_from(">5I", tag, 12)
    if not at_grid or not at_a:
        raise Damaged("curves without a table")
    nodes, step = list(tag[at_grid : at_grid + n_in]), tag[at_grid + 16]
    form, top = (np.uint8, 255) if step == 1 else (np.dtype(">u2"), 65_535)
    count = int(np.prod(nodes)) * n_out
    if at_grid + 20 + step * count > len(tag):
        raise Damaged("a table is cut off")
    grid = (np.frombuffer(tag, form, count, at_grid + 20) / top).reshape(*nodes, n_out)
    first, last = (at_a, at_b) if tag[:4] == b"mAB " else (at_b, at_a)
    return {"matrix": np.eye(3), "input": _curves(tag, first, n_in), "grid": grid, "output": _curves(tag, last, n_out)}


def table(tag: bytes) -> dict:
    """A lut8, lut16, mAB or mBA tag: input curves, a grid and output curves, as unit values; `matrix` counts for XYZ alone."""
    kind = tag[:4]
    if kind in (b"mAB ", b"mBA "):
        return _curve_table(tag)
    if kind not in (b"mft1", b"mft2"):
        raise Damaged("no table")
    n_in, n_out, grid = tag[8:11]
    matrix = np.array([v / 65_536 for v in struct.unpack_from(">9i", tag, 12)]).reshape(3, 3)
    if kind == b"mft1":
        entries, form, top, at = (256, 256), np.uint8, 255, 48
    else:
        entries, form, top, at = struct.unpack_from(">2H", tag, 48), np.dtype(">u2"), 65_535, 52
    step = np.dtype(form).itemsize
    counts = (n_in * entries[0], grid**n_in * n_out, n_out * entries[1])
    if at + step * sum(counts) > len(tag):
        raise Damaged("a table is cut off")
    parts = []
    for n in counts:
        parts.append(np.frombuffer(tag, form, n, at) / top)
        at += n * step
    return {"matrix": matrix, "input": parts[0].reshape(n_in, -1), "grid": parts[1].reshape(*[grid] * n_in, n_out), "output": parts[2].reshape(n_out, -1)}


def evaluate(lut: dict, values: np.ndarray) -> np.ndarray:
    """Unit values (n, inputs) through curves, grid (simplex interpolation) and curves."""
    def curves(rows, v: np.ndarray) -> np.ndarray:
        if isinstance(rows, list):
            return np.stack([np.clip(f(np.clip(v[:, i], 0, 1)), 0, 1) for i, f in enumerate(rows)], axis=1)
        x = np.linspace(0, 1, rows.shape[1])
        return np.stack([np.interp(np.clip(v[:, i], 0, 1), x, rows[i]) for i in range(len(rows))], axis=1)

    v, grid = curves(lut["input"], np.asarray(values, float)), lut["grid"]
    n = np.array(grid.shape[:-1])
    s = v * (n - 1)
    i = np.maximum(0, np.minimum(np.floor(s).astype(int), n - 2))
    d = s - i
    order = np.argsort(-d, axis=1, kind="stable")
    rest = np.take_along_axis(d, order, axis=1)
    node = i.copy()
    out = grid[tuple(node.T)] * (1 - rest[:, :1])
    for k in range(v.shape[1]):
        np.put_along_axis(node, order[:, k : k + 1], np.take_along_axis(node, order[:, k : k + 1], axis=1) + 1, axis=1)
        weight = rest[:, k] - (rest[:, k + 1] if k + 1 < v.shape[1] else 0)
        out = out + grid[tuple(node.T)] * weight[:, None]
    return curves(lut["output"], out)


def unit_curve(tag: bytes):
    """A curve as a function of unit values."""
    kind, *rest = curve(tag)
    if kind == "gamma":
        return lambda v: np.power(v, rest[0])
    if kind == "table":
        return lambda v: np.interp(v, np.linspace(0, 1, len(rest[0])), rest[0])
    n, p = rest
    g, a, b, c, d, e, f = (*p, *[0.0] * (7 - len(p)))
    power = lambda v: np.power(np.maximum(0, a * v + b), g)
    if n == 0:
        return lambda v: np.power(v, g)
    if n in (1, 2):
        return lambda v: np.where(v >= -b / a, power(v) + c, c) if n == 2 else np.where(v >= -b / a, power(v), 0.0)
    return lambda v: np.where(v >= d, power(v) + e, c * v + f)


#: The profile connection space's white, and the two numbers of Lab.
WHITE, EPSILON, KAPPA = (0.9642, 1.0, 0.8249), 216 / 24389, 24389 / 27


def to_inks(source: Profile, target: Profile, values: np.ndarray) -> np.ndarray:
    """Unit RGB (n, 3) through a matrix profile to Lab, and through the target's table B2A0 to unit inks."""
    if not source.is_matrix or "B2A0" not in target.tags:
        raise Damaged("the profiles are not a matrix and a table B2A0")
    linear = np.stack([np.clip(unit_curve(source.tags[f"{c}TRC"])(values[:, i]), 0, 1) for i, c in enumerate("rgb")], axis=1)
    seen = linear @ np.array([xyz(source.tags[f"{c}XYZ"]) for c in "rgb"])
    t = seen / WHITE
    f = np.where(t > EPSILON, np.cbrt(t), (KAPPA * t + 16) / 116)
    lab = np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], axis=1)
    place = np.clip(np.stack([lab[:, 0] / 100, (lab[:, 1] + 128) / 255, (lab[:, 2] + 128) / 255], axis=1), 0, 1)
    return evaluate(table(target.tags["B2A0"]), place)
