"""Vector paths, drawings and shapes in markup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def path_bounds(commands: DataFrame, key: list[str]) -> DataFrame:
    """(key, x0, y0, x1, y1) over all arguments, control points too; a path without any has zeros."""
    even = lambda odd: F.filter("args", lambda v, i: i % 2 == odd)
    ends = [f(even(i)) for f in (F.array_min, F.array_max) for i in (0, 1)]
    t = commands.select(*key, *[e.alias(n) for e, n in zip(ends, ("x0", "y0", "x1", "y1"))])
    return t.groupBy(*key).agg(*[F.coalesce(f(n), F.lit(0.0)).alias(n) for f, n in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])


def attribute(tag: Column, name: str) -> Column:
    """A number in a tag's attribute, or null."""
    return F.regexp_extract(tag, rf'\b{name}="([-+0-9.eE]+)"', 1).try_cast("double")


def svg_rects(markup: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, n, x, y, width, height): the rectangles of each text, in order; those without an area are left out."""
    tags = F.posexplode(F.regexp_extract_all(column, F.lit(r"<rect\b[^>]*>"), 0)).alias("n", "tag")
    t = markup.select(*key, tags)
    zero = lambda n: F.coalesce(attribute(F.col("tag"), n), F.lit(0.0)).alias(n)
    return t.select(*key, "n", *[zero(n) for n in ("x", "y", "width", "height")]).where("width > 0 and height > 0")


def path_tokens(markup: DataFrame, key: list[str], column: str) -> DataFrame:
    """(key, n, op, args): the commands of path data, as they stand."""
    parts = F.posexplode(F.regexp_extract_all(column, F.lit(r"[MmLlHhVvCcSsQqTtAaZz][^MmLlHhVvCcSsQqTtAaZz]*"), 0)).alias("n", "part")
    numbers = F.transform(F.regexp_extract_all("part", F.lit(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"), 0), lambda v: v.cast("double"))
    return markup.select(*key, parts).select(*key, "n", F.substring("part", 1, 1).alias("op"), numbers.alias("args"))


def resolve_path(data: Column) -> Column:
    """Absolute commands (op: M, L, C or Z; args) of SVG path data, by a fold over its commands.

    H and V become lines, S gets its control from the one before, Q and T become cubics, an arc becomes a line.
    """
    point = "struct<x:double,y:double>"
    numbers = lambda part: F.transform(F.regexp_extract_all(part, F.lit(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"), 0), lambda v: v.cast("double"))
    size = lambda op: F.when(op.isin("M", "L", "T"), 2).when(op.isin("H", "V"), 1).when(op.isin("S", "Q"), 4).when(op == "C", 6).when(op == "A", 7).otherwise(0)

    def steps(part: Column) -> Column:
        """A command with more numbers than it takes is said again; a move goes on as lines."""
        letter = F.substring(part, 1, 1)
        op, values = F.upper(letter), numbers(part)
        n = size(op)
        count = F.when(n == 0, 1).otherwise(F.floor(F.size(values) / F.when(n == 0, F.lit(1)).otherwise(n))).cast("int")
        return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.struct(F.when((op == "M") & (i > 0), F.lit("L")).otherwise(op).alias("op"), (letter != op).alias("rel"), F.slice(values, (i * n + 1).cast("int"), F.greatest(n, F.lit(1))).alias("v")))).otherwise(F.array().cast("array<struct<op:string,rel:boolean,v:array<double>>>"))

    told = F.flatten(F.transform(F.regexp_extract_all(data, F.lit(r"[MmLlHhVvCcSsQqTtAaZz][^MmLlHhVvCcSsQqTtAaZz]*"), 0), steps))
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")).cast(point)
    begin = F.struct(zero.alias("at"), zero.alias("start"), zero.alias("bend"), F.array().cast("array<struct<op:string,args:array<double>>>").alias("out"))

    def move(s: Column, c: Column) -> Column:
        op, v, here = c["op"], c["v"], s["at"]
        ox, oy = F.when(c["rel"], here["x"]).otherwise(F.lit(0.0)), F.when(c["rel"], here["y"]).otherwise(F.lit(0.0))
        g = lambda i: F.get(v, F.lit(i))
        px = lambda i: g(i) + ox
        py = lambda i: g(i) + oy
        mirror = at(here["x"] * 2 - s["bend"]["x"], here["y"] * 2 - s["bend"]["y"])
        end = F.when(op.isin("M", "L", "T"), at(px(0), py(1))).when(op == "H", at(px(0), here["y"])).when(op == "V", at(here["x"], py(0))).when(op.isin("S", "Q"), at(px(2), py(3))).when(op == "C", at(px(4), py(5))).when(op == "A", at(px(5), py(6))).otherwise(s["start"])
        quad = F.when(op == "Q", at(px(0), py(1))).otherwise(mirror)
        third = F.lit(2.0) / F.lit(3.0)
        q = lambda p, e: e + third * (p - e)
        one = F.when(op == "C", at(px(0), py(1))).when(op == "S", mirror).otherwise(at(q(quad["x"], here["x"]), q(quad["y"], here["y"])))
        two = F.when(op == "C", at(px(2), py(3))).when(op == "S", at(px(0), py(1))).otherwise(at(q(quad["x"], end["x"]), q(quad["y"], end["y"])))
        curve = op.isin("C", "S", "Q", "T")
        args = F.when(curve, F.array(one["x"], one["y"], two["x"], two["y"], end["x"], end["y"])).when(op == "Z", F.array().cast("array<double>")).otherwise(F.array(end["x"], end["y"]))
        name = F.when(curve, F.lit("C")).when(op.isin("M", "Z"), op).otherwise(F.lit("L"))
        bend = F.when(op.isin("C", "S"), two).when(op.isin("Q", "T"), quad).otherwise(end)
        return F.struct(end.alias("at"), F.when(op == "M", end).otherwise(s["start"]).alias("start"), bend.alias("bend"), F.concat(s["out"], F.array(F.struct(name.alias("op"), args.alias("args")))).alias("out")).cast(f"struct<at:{point},start:{point},bend:{point},out:array<struct<op:string,args:array<double>>>>")

    return F.aggregate(told, begin.cast(f"struct<at:{point},start:{point},bend:{point},out:array<struct<op:string,args:array<double>>>>"), move)["out"]


def fit(drawings: DataFrame, key: list[str], x: str, y: str, width: float, height: float, margin: float = 72.0) -> DataFrame:
    """Points of drawings moved and scaled evenly into the middle of a paper's inside; (key, ..., fx, fy).

    A drawing without an extent counts as 0 to 100. The extents are aggregated, then joined back.
    """
    box = drawings.groupBy(*key).agg(*[f(c).cast("double").alias(n) for f, c, n in ((F.min, x, "__x0"), (F.max, x, "__x1"), (F.min, y, "__y0"), (F.max, y, "__y1"))])
    flat = lambda a: F.col(f"__{a}1") <= F.col(f"__{a}0")
    w, h = (F.when(flat(a), F.lit(100.0)).otherwise(F.col(f"__{a}1") - F.col(f"__{a}0")) for a in "xy")
    inside = (width - 2 * margin, height - 2 * margin)
    scale = F.least(F.lit(inside[0]) / w, F.lit(inside[1]) / h)
    t = drawings.join(box.select(*key, "__x0", "__y0", scale.alias("__scale"), w.alias("__w"), h.alias("__h")), key)
    place = lambda c, low, size, room: F.lit(margin) + (F.lit(room) - F.col(size) * F.col("__scale")) / F.lit(2.0) + (F.col(c) - F.col(low)) * F.col("__scale")
    t = t.withColumns({"fx": place(x, "__x0", "__w", inside[0]), "fy": place(y, "__y0", "__h", inside[1])})
    return t.drop("__x0", "__y0", "__scale", "__w", "__h")
