"""Ink limits, spot inks and overprint as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp

Inks = tuple[Column, Column, Column, Column]

# Total ink limits in per cent, and the CMYK of full tints of named spot inks.
LIMITS = {"swop": 300.0, "gracol": 320.0, "fogra39": 330.0, "newsprint": 240.0}
SPOTS = {"PANTONE 185 C": (0.0, 0.93, 0.79, 0.0), "PANTONE Reflex Blue C": (1.0, 0.89, 0.0, 0.0), "Spot White": (0.0, 0.0, 0.0, 0.0), "Varnish": (0.0, 0.0, 0.0, 0.0), "CutContour": (0.0, 1.0, 0.0, 0.0)}


def total(inks: Inks) -> Column:
    return inks[0] + inks[1] + inks[2] + inks[3]


def coverage(inks: Inks) -> Column:
    """Total area coverage in per cent."""
    return F.lit(100.0) * total(inks)


def limit(inks: Inks, percent: float = 300.0, gcr: float = 0.8) -> Inks:
    """Inks within a total: gray is moved to black first, then colour removed in proportion, then all scaled."""
    most = F.lit(percent / 100.0)
    c, m, y, k = inks
    over = total(inks) > most
    moved = F.greatest(F.lit(0.0), F.least(F.least(c, m, y) * F.lit(min(1.0, max(0.0, gcr))), F.lit(1.0) - k))
    one = [F.when(over, v - moved).otherwise(v) for v in (c, m, y)] + [F.when(over, k + moved).otherwise(k)]
    rest, colour = total(tuple(one)) - most, one[0] + one[1] + one[2]
    fix, some = over & (rest > 0), colour > 0
    share = rest / F.when(some, colour).otherwise(F.lit(1.0))
    two = [F.when(fix & some, F.greatest(F.lit(0.0), v - v * share)).otherwise(v) for v in one[:3]]
    two.append(F.when(fix & ~some, F.least(one[3], most)).otherwise(one[3]))
    left = total(tuple(two))
    scale = F.when(over & (left > most), most / F.when(left > 0, left).otherwise(F.lit(1.0))).otherwise(F.lit(1.0))
    return tuple(v * scale for v in two)


def spot(tint: Column, full: Inks) -> Inks:
    """A spot ink's tint as process inks."""
    t = clamp(tint)
    return tuple(v * t for v in full)


def device_n(tints: list[Column], transform) -> Inks:
    """Several inks at once: each tint is clamped, and transform makes the process inks of them."""
    return transform([clamp(t) for t in tints])


def overprint(below: Inks, above: Inks, active: bool = True, mode: int = 1, mixing: bool = False) -> Inks:
    """What prints where above lies over below: in mode 1 an ink that above lacks shows through."""
    if not active or mode != 1:
        return above
    added = lambda b, a: b + a - b * a if mixing else a
    return tuple(F.when(a == 0, b).otherwise(added(b, a)) for b, a in zip(below, above))


def spot_overprint(below: Inks, ink: Inks) -> Inks:
    return tuple(clamp(b + s - b * s) for b, s in zip(below, ink))
