"""Separable resampling as two joins with a table of weights."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import clamp, half_up


def _cubic(x: Column, b: float, c: float) -> Column:
    """Mitchell and Netravali's family."""
    x = F.abs(x)
    near = (F.lit(12 - 9 * b - 6 * c) * x * x * x + F.lit(-18 + 12 * b + 6 * c) * x * x + F.lit(6 - 2 * b)) / F.lit(6.0)
    far = (F.lit(-b - 6 * c) * x * x * x + F.lit(6 * b + 30 * c) * x * x + F.lit(-12 * b - 48 * c) * x + F.lit(8 * b + 24 * c)) / F.lit(6.0)
    return F.when(x < 1, near).when(x < 2, far).otherwise(F.lit(0.0))


def _lanczos3(x: Column) -> Column:
    p = F.abs(x) * F.lit(math.pi)
    safe = F.when(p == 0, F.lit(1.0)).otherwise(p)
    return F.when(p == 0, F.lit(1.0)).when(F.abs(x) < 3, F.lit(3.0) * F.sin(safe) * F.sin(safe / F.lit(3.0)) / (safe * safe)).otherwise(F.lit(0.0))


#: Kernels by name: radius and value.
KERNELS = {
    "box": (0.5, lambda x: F.when(F.abs(x) <= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))),
    "bilinear": (1.0, lambda x: F.greatest(F.lit(0.0), F.lit(1.0) - F.abs(x))),
    "catmull_rom": (2.0, lambda x: _cubic(x, 0.0, 0.5)),
    "mitchell": (2.0, lambda x: _cubic(x, 1 / 3, 1 / 3)),
    "lanczos3": (3.0, _lanczos3),
}


def kernel(name: str | None):
    """By name; none is Lanczos, an unknown name Catmull-Rom."""
    return KERNELS["lanczos3"] if name is None else KERNELS.get(name, KERNELS["catmull_rom"])


def weights(sizes: DataFrame, name: str | None = None) -> DataFrame:
    """(src, dst, d, s, w) for the distinct (src, dst) of sizes: the share of source sample s in d, 1 in all for each d.

    A table as large as the axes are long, whatever the number of images.
    """
    radius, value = kernel(name)
    t = sizes.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    t = t.withColumns({"scale": F.col("dst") / F.col("src")}).withColumn("fs", F.least(F.col("scale"), F.lit(1.0)))
    t = t.withColumn("d", F.explode(F.sequence(F.lit(0).cast("long"), F.col("dst") - 1)))
    t = t.withColumn("at", (F.col("d") + F.lit(0.5)) / F.col("scale") - F.lit(0.5)).withColumn("reach", F.lit(radius) / F.col("fs"))
    low, high = F.greatest(F.lit(0), F.floor(F.col("at") - F.col("reach"))), F.least(F.col("src") - 1, F.ceil(F.col("at") + F.col("reach")))
    t = t.withColumn("s", F.explode(F.sequence(low.cast("long"), high.cast("long"))))
    t = t.withColumn("w", value((F.col("s") - F.col("at")) * F.col("fs")) * F.col("fs"))
    total = F.sum("w").over(Window.partitionBy("src", "dst", "d"))
    return t.withColumn("total", total).select("src", "dst", "d", "s", F.when(F.col("total") != 0, F.col("w") / F.col("total")).otherwise(F.when(F.col("s") == low, F.lit(1.0)).otherwise(F.lit(0.0))).alias("w")).where("w <> 0")


def resample(pixels: DataFrame, sizes: DataFrame, name: str | None = None) -> DataFrame:
    """pixels (image, y, x, v) of images whose sizes (image, width, height, to_width, to_height) are given, resampled.

    Rows first, then columns; sums in between stay fractions, and the result is rounded and within 0 to 255. Both sums are
    of keys that hold the image, so partial sums go before each shuffle.
    """
    across = weights(sizes.select(F.col("width").alias("src"), F.col("to_width").alias("dst")), name)
    down = weights(sizes.select(F.col("height").alias("src"), F.col("to_height").alias("dst")), name)
    p = pixels.join(sizes, "image")
    a = across.select(F.col("src").alias("width"), F.col("dst").alias("to_width"), F.col("s").alias("x"), "d", "w")
    p = p.join(a, ["width", "to_width", "x"]).groupBy("image", "height", "to_height", "y", F.col("d").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    b = down.select(F.col("src").alias("height"), F.col("dst").alias("to_height"), F.col("s").alias("y"), "d", "w")
    p = p.join(b, ["height", "to_height", "y"]).groupBy("image", F.col("d").alias("y"), "x").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return p.select("image", "y", "x", half_up(clamp(F.round("v", 9), 0.0, 255.0)).alias("v"))


def print_size(size: Column, dpi_x: Column, dpi_y: Column, dpi: Column, target: float = 300.0, threshold: float = 450.0) -> Column:
    """An axis' length for printing: reduced to the target if either axis is beyond the threshold."""
    return F.when((dpi_x > threshold) | (dpi_y > threshold), F.greatest(F.lit(1).cast("long"), half_up(size * F.lit(target) / dpi))).otherwise(size.cast("long"))
