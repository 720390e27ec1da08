"""Blend modes and alpha compositing (ISO 32000, Porter and Duff) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import clamp


def _one() -> Column:
    return F.lit(1.0)


def _multiply(b: Column, s: Column) -> Column:
    return b * s


def _screen(b: Column, s: Column) -> Column:
    return b + s - b * s


def _hard_light(b: Column, s: Column) -> Column:
    return F.when(s <= 0.5, _multiply(b, F.lit(2.0) * s)).otherwise(_screen(b, F.lit(2.0) * s - _one()))


def _dodge(b: Column, s: Column) -> Column:
    rest = F.when(s >= 1, _one()).otherwise(_one() - s)
    return F.when(b <= 0, F.lit(0.0)).when(s >= 1, _one()).otherwise(F.least(_one(), b / rest))


def _burn(b: Column, s: Column) -> Column:
    safe = F.when(s <= 0, _one()).otherwise(s)
    return F.when(b >= 1, _one()).when(s <= 0, F.lit(0.0)).otherwise(_one() - F.least(_one(), (_one() - b) / safe))


def _soft_light(b: Column, s: Column) -> Column:
    bright = F.when(b <= 0.25, ((F.lit(16.0) * b - F.lit(12.0)) * b + F.lit(4.0)) * b).otherwise(F.sqrt(b))
    dark = b - (_one() - F.lit(2.0) * s) * b * (_one() - b)
    return F.when(s <= 0.5, dark).otherwise(b + (F.lit(2.0) * s - _one()) * (bright - b))


#: The separable modes: backdrop and source to result.
MODES = {
    "normal": lambda b, s: s,
    "multiply": _multiply,
    "screen": _screen,
    "overlay": lambda b, s: _hard_light(s, b),
    "darken": lambda b, s: F.least(b, s),
    "lighten": lambda b, s: F.greatest(b, s),
    "color_dodge": _dodge,
    "color_burn": _burn,
    "hard_light": _hard_light,
    "soft_light": _soft_light,
    "difference": lambda b, s: F.abs(b - s),
    "exclusion": lambda b, s: b + s - F.lit(2.0) * b * s,
}


def blend(mode: str, b: Column, s: Column) -> Column:
    """One channel; an unknown mode is normal."""
    return clamp(MODES.get(mode, MODES["normal"])(b, s))


def blend_by(mode: Column, b: Column, s: Column) -> Column:
    """The same where the mode is a column."""
    out = blend("normal", b, s)
    for name in MODES:
        if name != "normal":
            out = F.when(mode == name, blend(name, b, s)).otherwise(out)
    return out


def union_alpha(ab: Column, a: Column) -> Column:
    return a + ab * (_one() - a)


def blended(mixed: Column, b: Column, ab: Column, s: Column, a: Column) -> Column:
    """One channel of a source with alpha over a backdrop with alpha, where mixed is their blend."""
    alpha = union_alpha(ab, a)
    weighted = (_one() - ab) * a * s + (_one() - a) * ab * b + a * ab * mixed
    return F.when(a <= 0, b).when(ab <= 0, s).otherwise(clamp(weighted / F.when(alpha > 0, alpha).otherwise(_one())))


def blend_alpha(mode: str, b: Column, ab: Column, s: Column, a: Column) -> Column:
    return blended(blend(mode, b, s), b, ab, s, a)


def source_over(b: Column, ab: Column, s: Column, a: Column) -> Column:
    """Porter and Duff's over, not premultiplied."""
    alpha = union_alpha(ab, a)
    return F.when(a >= 1, s).when(a <= 0, b).otherwise((s * a + b * ab * (_one() - a)) / F.when(alpha > 0, alpha).otherwise(_one()))


#: Porter and Duff's operators: the shares of source and backdrop that stay, from the alphas of both.
PORTER_DUFF = {
    "clear": (lambda a, b: F.lit(0.0), lambda a, b: F.lit(0.0)),
    "source": (lambda a, b: _one(), lambda a, b: F.lit(0.0)),
    "destination": (lambda a, b: F.lit(0.0), lambda a, b: _one()),
    "source_over": (lambda a, b: _one(), lambda a, b: _one() - a),
    "destination_over": (lambda a, b: _one() - b, lambda a, b: _one()),
    "source_in": (lambda a, b: b, lambda a, b: F.lit(0.0)),
    "destination_in": (lambda a, b: F.lit(0.0), lambda a, b: a),
    "source_out": (lambda a, b: _one() - b, lambda a, b: F.lit(0.0)),
    "destination_out": (lambda a, b: F.lit(0.0), lambda a, b: _one() - a),
    "xor": (lambda a, b: _one() - b, lambda a, b: _one() - a),
}


def porter_duff(operator: str, b: Column, ab: Column, s: Column, a: Column) -> tuple[Column, Column]:
    """A channel (not premultiplied) and the alpha under an operator."""
    keep_s, keep_b = PORTER_DUFF[operator]
    alpha = a * keep_s(a, ab) + ab * keep_b(a, ab)
    value = s * a * keep_s(a, ab) + b * ab * keep_b(a, ab)
    return F.when(alpha > 0, value / F.when(alpha > 0, alpha).otherwise(_one())).otherwise(F.lit(0.0)), alpha
