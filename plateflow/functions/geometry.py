"""Lengths, page boxes and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import half_up

# Points in a unit; a circle's control length.
POINTS = {"in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4, "pt": 1.0, "px": 72.0 / 96.0, "twip": 1 / 20.0, "emu": 1 / 12700.0, "dip": 0.75}
KAPPA = 0.5522847498


def length(text: Column, default: float = 612.0) -> Column:
    """Points of a length such as `21 cm`; what isn't a length is the default, a bare number is points."""
    low = F.lower(F.trim(text))
    number = F.regexp_extract(low, r"^([0-9]*\.?[0-9]+|[0-9]+\.)\s*(in|cm|mm|pt|px)?$", 1)
    unit = F.regexp_extract(low, r"^[0-9.]+\s*(in|cm|mm|pt|px)?$", 1)
    scale = F.lit(1.0)
    for name in ("in", "cm", "mm", "px"):
        scale = F.when(unit == name, F.lit(POINTS[name])).otherwise(scale)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit(default)).otherwise(F.expr("double(1)") * F.when(number != "", number).cast("double") * scale)


def pixels_to_points(pixels: Column, dpi: Column) -> Column:
    return pixels / dpi * F.lit(72.0)


def proof_pixels(points: Column, dpi: Column) -> Column:
    """An axis of a proof, at least one pixel."""
    return F.greatest(F.lit(1).cast("long"), half_up(points * dpi / F.lit(72.0)))


def boxes(media: Column, crop: Column, bleed: Column, trim: Column) -> dict[str, Column]:
    """A page's boxes, each in place of the one before it; no media box is Letter."""
    m = F.coalesce(media, F.array(*[F.lit(v) for v in (0.0, 0.0, 612.0, 792.0)]))
    c = F.coalesce(crop, m)
    b = F.coalesce(bleed, c)
    return {"media": m, "crop": c, "bleed": b, "trim": F.coalesce(trim, b)}


def quadratic_to_cubic(start: Column, control: Column, end: Column) -> tuple[Column, Column]:
    """The cubic's two controls, on one axis."""
    third = F.lit(2.0) / F.lit(3.0)
    return start + third * (control - start), end + third * (control - end)


def ellipse(cx: Column, cy: Column, rx: Column, ry: Column) -> Column:
    """Commands (op, args) of an ellipse: a start, four cubics, the end."""
    k, z = F.lit(KAPPA), F.lit(0.0)

    def point(x: tuple, y: tuple) -> list[Column]:
        return [cx + (x[0] * rx * (k if x[1] else F.lit(1.0)) if x[0] is not z else z), cy + (y[0] * ry * (k if y[1] else F.lit(1.0)) if y[0] is not z else z)]

    one, minus = F.lit(1.0), F.lit(-1.0)
    at = lambda x, y, kx=False, ky=False: point((x, kx), (y, ky))
    turns = [
        at(one, one, False, True) + at(one, one, True, False) + at(z, one),
        at(minus, one, True, False) + at(minus, one, False, True) + at(minus, z),
        at(minus, minus, False, True) + at(minus, minus, True, False) + at(z, minus),
        at(one, minus, True, False) + at(one, minus, False, True) + at(one, z),
    ]
    command = lambda op, args: F.struct(F.lit(op).alias("op"), (F.array(*args) if args else F.array().cast("array<double>")).alias("args"))
    return F.array(command("M", at(one, z)), *[command("C", t) for t in turns], command("Z", []))


def number(v: Column) -> Column:
    """A number for a path: at most three decimals, no zeros behind."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.3f", F.round(v, 3) + F.lit(0.0)), r"0+$", ""), r"\.$", "")


def pdf_path(commands: Column) -> Column:
    """PDF path operators of commands (op, args): operands with three decimals, an operator to a line."""
    operator = lambda c: F.when(c["op"] == "M", F.lit("m")).when(c["op"] == "L", F.lit("l")).when(c["op"] == "C", F.lit("c")).otherwise(F.lit("h"))
    operands = lambda c: F.array_join(F.transform(c["args"], lambda v: F.format_string("%.3f", v)), " ")
    return F.array_join(F.transform(commands, lambda c: F.when(F.size(c["args"]) > 0, F.concat(operands(c), F.lit(" "), operator(c))).otherwise(operator(c))), "\n")


def path_data(commands: Column) -> Column:
    """SVG path data of commands (op, args)."""
    return F.array_join(F.transform(commands, lambda c: F.concat(c["op"], F.when(F.size(c["args"]) > 0, F.concat(F.lit(" "), F.array_join(F.transform(c["args"], number), " "))).otherwise(F.lit("")))), " ")
