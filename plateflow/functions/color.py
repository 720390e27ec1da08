"""Colour spaces, tone curves and colour difference as Column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp, half_up, inverse, multiply, transform3

# White points, the Bradford cone matrix and sRGB's primaries (in XYZ, D65), CIE's Lab constants.
D50 = (0.9642, 1.0, 0.8249)
D65 = (0.95047, 1.0, 1.08883)
BRADFORD = [[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]]
SRGB_TO_XYZ_D65 = [[0.4124564, 0.3575761, 0.1804375], [0.2126729, 0.7151522, 0.0721750], [0.0193339, 0.1191920, 0.9503041]]
LAB_EPSILON, LAB_KAPPA = 216 / 24389, 24389 / 27


def fixed16(v: float) -> float:
    """v as an s15.16 number, as profiles hold it."""
    return round(v * 65536) / 65536


def adaptation(source: tuple, target: tuple) -> list[list[float]]:
    """The Bradford matrix from one white point to another."""
    cone = lambda w: [sum(r[j] * w[j] for j in range(3)) for r in BRADFORD]
    s, t = cone(source), cone(target)
    scale = [[t[i] / s[i] if i == j else 0.0 for j in range(3)] for i in range(3)]
    return multiply(inverse(BRADFORD), multiply(scale, BRADFORD))


def srgb_matrix() -> list[list[float]]:
    """Linear sRGB to XYZ (D50), with a profile's precision."""
    return [[fixed16(x) for x in r] for r in multiply(adaptation(D65, D50), SRGB_TO_XYZ_D65)]


def adapt(xyz: tuple[Column, ...], m: list[list[float]]) -> tuple[Column, ...]:
    return tuple(F.greatest(F.lit(0.0), x) for x in transform3(m, xyz))


@dataclass(frozen=True)
class Parametric:
    """ICC's parametric curve of type 0 to 4."""

    kind: int
    g: float
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 0.0
    f: float = 0.0

    def evaluate(self, x: Column) -> Column:
        x = clamp(x)
        power = lambda add=0.0: F.pow(F.greatest(F.lit(0.0), F.lit(self.a) * x + F.lit(self.b)), F.lit(self.g)) + F.lit(add)
        if self.kind == 0:
            y = F.pow(x, F.lit(self.g))
        elif self.kind in (1, 2):
            add = self.c if self.kind == 2 else 0.0
            y = F.when(x >= F.lit(-self.b / self.a), power(add)).otherwise(F.lit(add))
        else:
            y = F.when(x >= F.lit(self.d), power(self.e if self.kind == 4 else 0.0)).otherwise(F.lit(self.c) * x + F.lit(self.f if self.kind == 4 else 0.0))
        return clamp(y)

    def invert(self, y: Column) -> Column:
        y = clamp(y)
        root = lambda v: (F.pow(F.greatest(F.lit(0.0), v), F.lit(1.0 / self.g)) - F.lit(self.b)) / F.lit(self.a)
        if self.kind == 0:
            x = F.pow(y, F.lit(1.0 / self.g))
        elif self.kind in (1, 2):
            x = root(y - F.lit(self.c if self.kind == 2 else 0.0))
        else:
            e, f = (self.e, self.f) if self.kind == 4 else (0.0, 0.0)
            low = (y - F.lit(f)) / F.lit(self.c) if self.c else F.lit(0.0)
            x = F.when(y >= F.lit(self.c * self.d + f), root(y - F.lit(e))).otherwise(low)
        return clamp(x)


#: sRGB's curve, with a profile's precision.
SRGB = Parametric(3, fixed16(2.4), fixed16(1 / 1.055), fixed16(0.055 / 1.055), fixed16(1 / 12.92), fixed16(0.04045))


def gamma(x: Column, g: float) -> Column:
    return F.pow(clamp(x), F.lit(g))


def sampled(x: Column, table: list[float]) -> Column:
    """Linear between the samples of an evenly spaced table."""
    n = len(table)
    at = clamp(x) * F.lit(float(n - 1))
    i = F.least(F.floor(at), F.lit(n - 2)).cast("int")
    values = F.array(*[F.lit(float(v)) for v in table])
    low, high = F.element_at(values, i + 1), F.element_at(values, i + 2)
    return low + (at - i) * (high - low)


def sampled_inverse(y: Column, table: list[float]) -> Column:
    """Where a rising table has the value y: the first segment that reaches it."""
    n = len(table)
    out = F.lit(1.0)
    for i in range(n - 2, -1, -1):
        low, high = float(table[i]), float(table[i + 1])
        share = (y - F.lit(low)) / F.lit(high - low) if high != low else F.lit(0.0)
        out = F.when(y <= F.lit(high), (F.lit(float(i)) + share) / F.lit(float(n - 1))).otherwise(out)
    return clamp(F.when(y <= F.lit(float(table[0])), F.lit(0.0)).otherwise(out))


def rgb_to_xyz(rgb: tuple[Column, ...]) -> tuple[Column, ...]:
    """sRGB unit values to XYZ (D50)."""
    return transform3(srgb_matrix(), tuple(SRGB.evaluate(v) for v in rgb))


def xyz_to_lab(xyz: tuple[Column, ...], white: tuple = D50) -> tuple[Column, ...]:
    def f(t: Column) -> Column:
        return F.when(t > F.lit(LAB_EPSILON), F.cbrt(t)).otherwise((F.lit(LAB_KAPPA) * t + F.lit(16.0)) / F.lit(116.0))

    x, y, z = (f(v / F.lit(w)) for v, w in zip(xyz, white))
    return clamp(F.lit(116.0) * y - F.lit(16.0), 0.0, 100.0), clamp(F.lit(500.0) * (x - y), -128.0, 127.0), clamp(F.lit(200.0) * (y - z), -128.0, 127.0)


def lab_to_xyz(lab: tuple[Column, ...], white: tuple = D50) -> tuple[Column, ...]:
    def f(t: Column) -> Column:
        cube = t * t * t
        return F.when(cube > F.lit(LAB_EPSILON), cube).otherwise((F.lit(116.0) * t - F.lit(16.0)) / F.lit(LAB_KAPPA))

    y = (lab[0] + F.lit(16.0)) / F.lit(116.0)
    return tuple(F.greatest(F.lit(0.0), f(t) * F.lit(w)) for t, w in zip((y + lab[1] / F.lit(500.0), y, y - lab[2] / F.lit(200.0)), white))


def chroma(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def hue(a: Column, b: Column) -> Column:
    """Degrees in [0, 360)."""
    h = F.degrees(F.atan2(b, a))
    return F.when(h < 0, h + F.lit(360.0)).otherwise(h)


def ciede2000(one: tuple[Column, ...], two: tuple[Column, ...], kl: float = 1.0, kc: float = 1.0, kh: float = 1.0) -> Column:
    """The CIEDE2000 difference, by Sharma, Wu and Dalal (2005)."""
    (l1, a1, b1), (l2, a2, b2) = one, two
    seventh = lambda c: F.pow(c, F.lit(7.0))
    ratio = lambda c: F.sqrt(seventh(c) / (seventh(c) + F.lit(25.0**7)))
    mean = (chroma(a1, b1) + chroma(a2, b2)) / F.lit(2.0)
    g = F.lit(0.5) * (F.lit(1.0) - ratio(mean))
    p1, p2 = a1 * (F.lit(1.0) + g), a2 * (F.lit(1.0) + g)
    c1, c2 = chroma(p1, b1), chroma(p2, b2)
    angle = lambda a, b: F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(hue(a, b))
    h1, h2 = angle(p1, b1), angle(p2, b2)
    gray = c1 * c2 == 0
    turn = h2 - h1
    dh = F.when(gray, F.lit(0.0)).when(F.abs(turn) <= 180, turn).when(turn > 180, turn - F.lit(360.0)).otherwise(turn + F.lit(360.0))
    big_h = F.lit(2.0) * F.sqrt(c1 * c2) * F.sin(F.radians(dh / F.lit(2.0)))
    ml, mc, total = (l1 + l2) / F.lit(2.0), (c1 + c2) / F.lit(2.0), h1 + h2
    mh = F.when(gray, total).when(F.abs(h1 - h2) <= 180, total / F.lit(2.0)).when(total < 360, (total + F.lit(360.0)) / F.lit(2.0)).otherwise((total - F.lit(360.0)) / F.lit(2.0))
    cos = lambda d: F.cos(F.radians(d))
    t = F.lit(1.0) - F.lit(0.17) * cos(mh - F.lit(30.0)) + F.lit(0.24) * cos(F.lit(2.0) * mh) + F.lit(0.32) * cos(F.lit(3.0) * mh + F.lit(6.0)) - F.lit(0.2) * cos(F.lit(4.0) * mh - F.lit(63.0))
    bend = (mh - F.lit(275.0)) / F.lit(25.0)
    rotation = F.lit(-1.0) * F.sin(F.radians(F.lit(60.0) * F.exp(F.lit(-1.0) * bend * bend))) * F.lit(2.0) * ratio(mc)
    off = (ml - F.lit(50.0)) * (ml - F.lit(50.0))
    sl = F.lit(1.0) + F.lit(0.015) * off / F.sqrt(F.lit(20.0) + off)
    sc, sh = F.lit(1.0) + F.lit(0.045) * mc, F.lit(1.0) + F.lit(0.015) * mc * t
    x, y, z = (l2 - l1) / (F.lit(kl) * sl), (c2 - c1) / (F.lit(kc) * sc), big_h / (F.lit(kh) * sh)
    return F.sqrt(F.greatest(F.lit(0.0), x * x + y * y + z * z + rotation * y * z))


def naive_cmyk(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """RGB to CMYK with full gray replacement."""
    inks = [F.lit(1.0) - v for v in (r, g, b)]
    k = F.least(*inks)
    solid = k >= 1
    return (*[F.when(solid, F.lit(0.0)).otherwise((v - k) / F.when(solid, F.lit(1.0)).otherwise(F.lit(1.0) - k)) for v in inks], F.when(solid, F.lit(1.0)).otherwise(k))


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> tuple[Column, ...]:
    """A proof's RGB bytes."""
    return tuple(half_up(F.lit(255.0) * (F.lit(1.0) - v) * (F.lit(1.0) - k)) for v in (c, m, y))


# JFIF's colour transform.
YCC = [[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]]


def rgb_to_ycc(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    y, u, v = transform3(YCC, (r, g, b))
    return half_up(y), half_up(u + F.lit(128.0)), half_up(v + F.lit(128.0))


def ycc_to_rgb(y: Column, cb: Column, cr: Column) -> tuple[Column, ...]:
    u, v = cb - F.lit(128.0), cr - F.lit(128.0)
    return tuple(half_up(clamp(x, 0.0, 255.0)) for x in (y + F.lit(1.402) * v, y - F.lit(0.344136) * u - F.lit(0.714136) * v, y + F.lit(1.772) * u))
