"""Layers: clipping, compositing by a fold, and the decomposition into regions without edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import blend
from ..functions.numeric import clamp, to_byte


def clip_bases(layers: DataFrame) -> DataFrame:
    """Visible layers with base_z, the layer that a clipping one is clipped to: the latest before it that isn't clipping."""
    before = Window.partitionBy("image").orderBy("z").rowsBetween(Window.unboundedPreceding, -1)
    base = F.last(F.when(~F.col("clipping"), F.col("z")), ignorenulls=True).over(before)
    return layers.where("visible").withColumn("base_z", F.when(F.col("clipping"), base))


def covers(layer: str, x, y):
    c = lambda n: F.col(f"{layer}{n}")
    return (c("x0") <= x) & (x < c("x0") + c("w")) & (c("y0") <= y) & (y < c("y0") + c("h"))


def composite(layers: DataFrame, points: list[tuple[int, int]], paper: float = 1.0) -> DataFrame:
    """(image, x, y, v): what is seen at points of canvases whose layers are (image, z, x0, y0, w, h, opacity, mode, visible, clipping, v).

    Each layer is one gray in its box. Layers are blended in the order of z over the paper; a clipping layer has its base's
    alpha at the point, none where the base isn't. A layer gives a row for each point that it covers, and the rows of one
    point are folded together; points without a layer aren't listed.
    """
    at = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in points]))
    based = clip_bases(layers)
    bases = based.select("image", F.col("z").alias("base_z"), *[F.col(n).alias(f"b_{n}") for n in ("x0", "y0", "w", "h")], F.col("opacity").alias("b_opacity"))
    rows = based.join(bases, ["image", "base_z"], "left").select("*", at.alias("p")).where(covers("", F.col("p.x"), F.col("p.y")))
    under = F.when(covers("b_", F.col("p.x"), F.col("p.y")), clamp(F.col("b_opacity"))).otherwise(F.lit(0.0))
    alpha = clamp(F.col("opacity")) * F.when(F.col("base_z").isNotNull(), under).otherwise(F.lit(1.0))
    stack = rows.groupBy("image", "p.x", "p.y").agg(F.array_sort(F.collect_list(F.struct("z", (F.col("v") / F.lit(255.0)).alias("s"), alpha.alias("a"), "mode"))).alias("stack"))
    over = lambda b, t: F.when(t["a"] <= 0, b).otherwise(blend.blended(blend.blend_by(t["mode"], b, t["s"]), b, F.lit(1.0), t["s"], t["a"]))
    return stack.select("image", "x", "y", to_byte(F.round(F.aggregate("stack", F.lit(paper), over), 9)).alias("v"))


def composite_samples(layers: DataFrame, samples: DataFrame, paper: list[float]) -> DataFrame:
    """(image, x, y, v: an array of bytes): the layers' own pixels, blended in the order of z over the paper.

    layers: (image, z, opacity, mode, visible, folder, clipping); samples: (image, z, x, y, s: an array of bytes, one for each
    channel, be they of light or of ink, alpha, mask), alpha and mask being bytes or null (255). Folders and layers that can't
    be seen are left out; a clipping layer's alpha is multiplied by its base's at the pixel. Pixels without a sample aren't
    listed. The rows of one pixel, one for each layer, are folded together.
    """
    based = clip_bases(layers.where("not folder")).select("image", "z", "base_z", "opacity", "mode")
    unit = lambda c: F.coalesce(F.col(c) / F.lit(255.0), F.lit(1.0))
    rows = samples.join(based, ["image", "z"]).select("image", "x", "y", "z", "base_z", "mode", F.transform("s", lambda v: v / F.lit(255.0)).alias("s"), (clamp(F.col("opacity")) * unit("alpha") * unit("mask")).alias("a"))
    stack = rows.groupBy("image", "x", "y").agg(F.array_sort(F.collect_list(F.struct("z", "base_z", "mode", "s", "a"))).alias("stack"))
    base = lambda t: F.coalesce(F.aggregate("stack", F.lit(0.0), lambda a, u: F.when(u["z"] == t["base_z"], u["a"]).otherwise(a)), F.lit(0.0))
    clipped = F.transform("stack", lambda t: F.struct(t["mode"].alias("mode"), t["s"].alias("s"), (t["a"] * F.when(t["base_z"].isNull(), F.lit(1.0)).otherwise(base(t))).alias("a")))
    one = lambda b, s, t: F.when(t["a"] <= 0, b).otherwise(blend.blended(blend.blend_by(t["mode"], b, s), b, F.lit(1.0), s, t["a"]))
    seen = F.aggregate("stack", F.array(*[F.lit(v) for v in paper]), lambda c, t: F.zip_with(c, t["s"], lambda b, s: one(b, s, t)))
    return stack.select("image", "x", "y", clipped.alias("stack")).select("image", "x", "y", F.transform(seen, lambda v: to_byte(F.round(v, 9))).alias("v"))


def flattened(cells: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image, x0, y0, w, h, x, y, ...): the composited pixels of each region that isn't opaque; what is opaque stays as it is.

    cells: regions() or merge_regions(); pixels: (image, x, y, ...) of whole canvases. A join on the image, of whose regions
    each pixel lies in one.
    """
    some = cells.where("transparent").select("image", "x0", "y0", "w", "h")
    return pixels.join(some, "image").where(covers("", F.col("x"), F.col("y")))


def regions(layers: DataFrame, width: int, height: int, transparent=None) -> DataFrame:
    """(image, x0, y0, w, h, layers, transparent): the cells between the layers' edges, cell by cell.

    layers: the z of those that cover the cell, in order. transparent: a predicate on a layer (by default: opacity below 1 or
    a mode that isn't normal). Cut lines come from the layers of one image alone, which are few; cells number as the square
    of them.
    """
    transparent = transparent if transparent is not None else (F.col("opacity") < 1) | (F.col("mode") != "normal")
    seen = layers.where("visible").withColumns({"l": F.greatest(F.lit(0), F.col("x0")), "r": F.least(F.lit(width), F.col("x0") + F.col("w")), "t": F.greatest(F.lit(0), F.col("y0")), "b": F.least(F.lit(height), F.col("y0") + F.col("h")), "clear": transparent})
    seen = seen.where("l < r and t < b")
    lines = lambda a, b, low, high: F.array_sort(F.array_distinct(F.concat(F.collect_set(a), F.collect_set(b), F.array(F.lit(low).cast("long"), F.lit(high).cast("long")))))
    grid = seen.groupBy("image").agg(lines("l", "r", 0, width).alias("xs"), lines("t", "b", 0, height).alias("ys"), F.array_sort(F.collect_list(F.struct("z", "l", "r", "t", "b", "clear"))).alias("boxes"))
    empty = layers.select("image").distinct().join(grid, "image", "left")
    grid = empty.select("image", *[F.coalesce(n, d).alias(n) for n, d in (("xs", F.array(F.lit(0).cast("long"), F.lit(width).cast("long"))), ("ys", F.array(F.lit(0).cast("long"), F.lit(height).cast("long"))))], F.coalesce("boxes", F.filter(F.array(F.struct(*[F.lit(0).cast(k).alias(n) for n, k in _box(grid)])), lambda x: F.lit(False))).alias("boxes"))
    cells = lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - 1), lambda i: F.struct(F.element_at(a, i).alias("low"), F.element_at(a, i + 1).alias("high")))
    t = grid.select("image", "boxes", "xs", F.explode(cells(F.col("ys"))).alias("row")).select("image", "boxes", "row", F.explode(cells(F.col("xs"))).alias("col"))
    x, y = (F.col("col.low") + F.col("col.high")) / 2, (F.col("row.low") + F.col("row.high")) / 2
    active = F.filter("boxes", lambda b: (b["l"] <= x) & (x < b["r"]) & (b["t"] <= y) & (y < b["b"]))
    t = t.withColumn("active", active)
    return t.select("image", F.col("col.low").alias("x0"), F.col("row.low").alias("y0"), (F.col("col.high") - F.col("col.low")).alias("w"), (F.col("row.high") - F.col("row.low")).alias("h"), F.transform("active", lambda b: b["z"]).alias("layers"), F.exists("active", lambda b: b["clear"]).alias("transparent"))


def _box(grid: DataFrame) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in grid.schema["boxes"].dataType.elementType.fields]


def merge_regions(cells: DataFrame) -> DataFrame:
    """Cells side by side with the same layers become one: islands along each row."""
    row = Window.partitionBy("image", "y0", "h").orderBy("x0")
    before = lambda n: F.lag(n).over(row)
    same = (before("layers") == F.col("layers")) & (before("transparent") == F.col("transparent")) & (before("x0") + before("w") == F.col("x0"))
    t = cells.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(row))
    return t.groupBy("image", "y0", "h", "island").agg(F.min("x0").alias("x0"), F.sum("w").alias("w"), F.first("layers").alias("layers"), F.first("transparent").alias("transparent")).select("image", "x0", "y0", "w", "h", "layers", "transparent")
