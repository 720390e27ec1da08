"""Operators on blocks and rasters: demosaicing, cosine transforms, predictors, quantisation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import half_up

#: What a sensor cell sees, by pattern: the letters of row 0, then of row 1.
PATTERNS = ("rggb", "bggr", "grbg", "gbrg")


def cell(pattern: str, y: Column, x: Column) -> Column:
    """The colour of a cell."""
    place = (y % 2) * 2 + x % 2
    out = F.lit(pattern[3])
    for i in range(3):
        out = F.when(place == i, F.lit(pattern[i])).otherwise(out)
    return out


def demosaic(images: DataFrame, pattern: str, width: int, height: int, black: float = 0.0, white: float = 255.0, balance: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> DataFrame:
    """(image, y, x, r, g, b) bytes of images (image, cells: an array of width * height numbers, row by row).

    Bilinear: a colour that a cell lacks is the mean of its neighbours that have it; neighbours beyond the edge are the edge
    itself. Values are normalised, balanced, and written with sRGB's curve. An image is an array, so nothing is shuffled.
    """
    gains = dict(zip("rgb", balance))
    last = F.lit(height - 1)
    line = lambda y: F.slice("cells", F.greatest(F.lit(0), F.least(last, y)) * width + 1, F.lit(width))
    # an image becomes its lines with those above and below, and a line its cells with their neighbours: no cell has the whole
    rows = images.select("image", F.explode(F.transform(F.sequence(F.lit(0), last), lambda y: F.struct(y.alias("y"), line(y - 1).alias("n"), line(y).alias("o"), line(y + 1).alias("s")))).alias("l")).select("image", "l.*")
    shifted = lambda c, by: c if not by else F.concat(F.array(c[0]), F.slice(c, 1, width - 1)) if by < 0 else F.concat(F.slice(c, 2, width - 1), F.array(c[width - 1]))
    near = [shifted(F.col(c), by).alias(f"{c}{by + 1}") for c in ("n", "o", "s") for by in (-1, 0, 1)]
    cells = rows.select("image", "y", F.posexplode(F.arrays_zip(*near)).alias("x", "c"))
    y, x = F.col("y"), F.col("x")

    def at(dy: int, dx: int) -> Column:
        row, col = F.greatest(F.lit(0), F.least(last, y + dy)), F.greatest(F.lit(0), F.least(F.lit(width - 1), x + dx))
        gain = F.lit(gains["g"])
        for c in "rb":
            gain = F.when(cell(pattern, row, col) == c, F.lit(gains[c])).otherwise(gain)
        level = F.greatest(F.lit(0.0), F.col("c")[f"{'nos'[dy + 1]}{dx + 1}"] - F.lit(black)) / F.lit(max(1.0, white - black))
        return F.least(F.lit(1.0), level * gain)

    # each neighbour's level once, then the means by name
    cells = cells.select("image", "y", "x", *[at(dy, dx).alias(f"l{dy + 1}{dx + 1}") for dy in (-1, 0, 1) for dx in (-1, 0, 1)])
    mean = lambda *places: sum((F.col(f"l{p[0] + 1}{p[1] + 1}") for p in places[1:]), F.col(f"l{places[0][0] + 1}{places[0][1] + 1}")) / F.lit(float(len(places)))
    own, cross, corners = F.col("l11"), mean((-1, 0), (1, 0), (0, -1), (0, 1)), mean((-1, -1), (-1, 1), (1, -1), (1, 1))
    sides, above = mean((0, -1), (0, 1)), mean((-1, 0), (1, 0))
    here = cell(pattern, y, x)
    # a green cell's row is red if red cells stand beside it
    red_row = F.lit(pattern[0] == "r" or pattern[1] == "r") == (y % 2 == 0)
    r = F.when(here == "r", own).when(here == "b", corners).when(red_row, sides).otherwise(above)
    g = F.when(here == "g", own).otherwise(cross)
    b = F.when(here == "b", own).when(here == "r", corners).when(red_row, above).otherwise(sides)
    cells = cells.select("image", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"))
    # fixed values: sRGB's curve
    encode = lambda v: F.when(v <= 0.0031308, v * F.lit(12.92)).otherwise(F.lit(1.055) * F.pow(v, F.lit(1 / 2.4)) - F.lit(0.055))
    return cells.select("image", "y", "x", *[half_up(F.round(encode(F.col(n)) * F.lit(255.0), 9)).alias(n) for n in "rgb"])


def basis(spark: SparkSession, n: int = 8) -> DataFrame:
    """(f, p, w): the share of frequency f at place p of n places, scaled for blocks of 8."""
    rows = [(f, p, 0.5 * (1 / math.sqrt(2) if f == 0 else 1.0) * math.cos((2 * p + 1) * f * math.pi / (2 * n))) for f in range(n) for p in range(n)]
    return spark.createDataFrame(rows, "f int, p int, w double")


def dct8(blocks: DataFrame, shift: int = 128) -> DataFrame:
    """(block, v, u, c): the cosine transform of 8 x 8 blocks (block, y, x, v). v and u are the frequencies down and across."""
    t = F.broadcast(basis(blocks.sparkSession))
    rows = blocks.join(t, F.col("x") == F.col("p")).groupBy("block", "y", F.col("f").alias("u")).agg(F.sum((F.col("v") - shift) * F.col("w")).alias("c"))
    return rows.join(t, F.col("y") == F.col("p")).groupBy("block", F.col("f").alias("v"), "u").agg(F.sum(F.col("c") * F.col("w")).alias("c"))


def idct(coefficients: DataFrame, n: int = 8, shift: int = 128) -> DataFrame:
    """(block, y, x, s): n x n samples (n of 8, 4, 2, 1) from the lowest frequencies of (block, v, u, c), as bytes."""
    spark = coefficients.sparkSession
    if n == 1:
        return coefficients.where("u = 0 and v = 0").select("block", F.lit(0).alias("y"), F.lit(0).alias("x"), _sample(F.col("c") / F.lit(8.0), shift).alias("s"))
    t = F.broadcast(basis(spark, n))
    kept = coefficients.where((F.col("u") < n) & (F.col("v") < n))
    rows = kept.join(t, F.col("u") == F.col("f")).groupBy("block", "v", F.col("p").alias("x")).agg(F.sum(F.col("c") * F.col("w")).alias("c"))
    return rows.join(t, F.col("v") == F.col("f")).groupBy("block", F.col("p").alias("y"), "x").agg(_sample(F.sum(F.col("c") * F.col("w")), shift).alias("s"))


def _sample(v: Column, shift: int) -> Column:
    return half_up(F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.round(v + F.lit(float(shift)), 9))))


def undo_predictor(pixels: DataFrame, modulus: int = 256) -> DataFrame:
    """(image, y, x, v): horizontal differences summed up along each row."""
    row = Window.partitionBy("image", "y").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    return pixels.select("image", "y", "x", F.pmod(F.sum("v").over(row), F.lit(modulus)).alias("v"))


def apply_predictor(pixels: DataFrame, modulus: int = 256) -> DataFrame:
    """The other way round."""
    row = Window.partitionBy("image", "y").orderBy("x")
    return pixels.select("image", "y", "x", F.pmod(F.col("v") - F.lag("v", 1, 0).over(row), F.lit(modulus)).alias("v"))


def dc_differences(blocks: DataFrame) -> DataFrame:
    """(scan, block, dc, diff): each block's level against the one before it in its scan (scan, block, dc)."""
    order = Window.partitionBy("scan").orderBy("block")
    return blocks.select("scan", "block", "dc", (F.col("dc") - F.lag("dc", 1, 0).over(order)).alias("diff"))


# The standard's tables for brightness and colour (ISO 10918-1, annex K), row by row.
LUMINANCE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMINANCE = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32


def quantiser(base: list[int], quality: Column) -> Column:
    """A table scaled to a quality of 1 to 100, as an array."""
    q = F.greatest(F.lit(1), F.least(F.lit(100), quality))
    scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(F.lit(200) - q * 2)
    return F.transform(F.array(*[F.lit(v) for v in base]), lambda v: F.greatest(F.lit(1), F.least(F.lit(255), F.floor((v * scale + 50) / 100))).cast("long"))


def decode_scale(ratio: Column) -> Column:
    """How far a decoder may reduce when ratio of the size is wanted."""
    return F.when(ratio <= 0.15, 8).when(ratio <= 0.35, 4).when(ratio <= 0.70, 2).otherwise(1)
