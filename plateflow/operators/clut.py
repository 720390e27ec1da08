"""Colour lookup tables: built from expressions, and interpolated by joins on node numbers.

Every table here has a fixed number of nodes (625, 125, 35,937 or 256). It becomes one row of arrays, one for each value,
which is broadcast once; the vertices of the simplex around a point are elements of these arrays, so a lookup is arithmetic
within generated code: no shuffle, and no join on nodes, whatever the number of pixels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color
from ..functions.numeric import clamp, half_up, to_byte, transform3
from .plates import limit_inks

INKS = ("c", "m", "y", "k")


def _grid(spark: SparkSession, n: int, axes: list[str]) -> DataFrame:
    """Every node of a grid: its number, and its place on each axis (the last runs fastest)."""
    t, rest = spark.range(n ** len(axes)).withColumnRenamed("id", "node"), F.col("node")
    places = []
    for a in reversed(axes):
        places.append((rest % n).cast("double").alias(a))
        rest = F.floor(rest / n)
    return t.select("node", *reversed(places))


def cmyk_to_lab_table(spark: SparkSession) -> DataFrame:
    """(node, l, a, b) bytes of the built-in ink model on a grid of 5 ** 4."""
    g = _grid(spark, 5, list(INKS)).select("node", *[(F.col(v) / 4.0).alias(v) for v in INKS])
    c, m, y, k = (F.col(v) for v in INKS)
    gray = F.least(c, m, y)
    # fixed values: the model's weights
    cover = F.least(F.lit(1.0), F.lit(0.333333) * c + F.lit(0.333333) * m + F.lit(0.333334) * y + F.lit(0.9) * k)
    light = F.lit(1.0) - F.lit(0.8) * k
    a = ((m - gray) * F.lit(75.0) - (c - gray) * F.lit(37.0)) * light
    b = ((y - gray) * F.lit(90.0) - (c - gray) * F.lit(48.0)) * light
    return g.select("node", half_up(F.lit(100.0) * (F.lit(1.0) - cover) / F.lit(100.0) * F.lit(255.0)).alias("l"), half_up(a + F.lit(128.0)).alias("a"), half_up(b + F.lit(128.0)).alias("b"))


def lab_to_cmyk_table(spark: SparkSession) -> DataFrame:
    """(node, c, m, y, k) bytes of the built-in ink model's inverse on a grid of 5 ** 3."""
    g = _grid(spark, 5, ["l", "a", "b"])
    light, a, b = F.col("l") * F.lit(25.0), F.col("a") / 4.0 * 255.0 - 128.0, F.col("b") / 4.0 * 255.0 - 128.0
    # fixed values: the model's weights
    dark = F.greatest(F.lit(0.0), (F.lit(100.0) - light) / F.lit(100.0))
    k = F.when(dark > 0.8, (dark - F.lit(0.8)) * F.lit(5.0)).otherwise(F.lit(0.0))
    rest = F.greatest(F.lit(0.0), dark - k * F.lit(0.9))
    inks = (rest - a * F.lit(0.005) - b * F.lit(0.003), rest + a * F.lit(0.006), rest + b * F.lit(0.007), k)
    return g.select("node", *[to_byte(v).alias(n) for v, n in zip(inks, INKS)])


def _with_table(pixels: DataFrame, table: DataFrame, values: list[str], divide: float | None) -> DataFrame:
    """pixels with the table's values as arrays by node (__t_...); the table has a row for each node, so it is one row of arrays."""
    nodes = table.agg(F.sort_array(F.collect_list(F.struct("node", *[F.col(v).cast("double").alias(v) for v in values]))).alias("t"))
    scaled = lambda v: F.transform(F.col("t")[v], lambda x: x / F.lit(divide)) if divide else F.col("t")[v]
    return pixels.crossJoin(F.broadcast(nodes.select(*[scaled(v).alias(f"__t_{v}") for v in values])))


def _interpolated(p: DataFrame, values: list[str], nodes: list[str], weights: list[Column]) -> tuple[DataFrame, list[Column]]:
    """The sums of the tables' values at nodes by weights, added up in that order; the arrays go."""
    kept = [c for c in p.columns if not c.startswith("__")]
    sums = []
    for v in values:
        total = F.get(f"__t_{v}", F.col(nodes[0])) * weights[0]
        for node, w in zip(nodes[1:], weights[1:]):
            total = total + F.get(f"__t_{v}", F.col(node)) * w
        sums.append(total.alias(f"__{v}"))
    return p.select(*kept, *sums), [F.col(f"__{v}") for v in values]


def tetrahedral(pixels: DataFrame, table: DataFrame, n: int, place: tuple[Column, Column, Column], values: list[str], divide: float | None = 255.0, scaled: bool = False) -> tuple[DataFrame, list[Column]]:
    """pixels with the interpolated values, and these as Columns of that.

    place: unit coordinates (or, if scaled, grid coordinates). Vertices are walked from the cell's corner along the axes in
    descending order of what remains; on equal rests any order gives equal values.
    """
    at = place if scaled else tuple(clamp(v) * F.lit(float(n - 1)) for v in place)
    kept = [c for c in pixels.columns if not c.startswith("__")]
    p = pixels.select(*kept, *[v.alias(f"__s{i}") for i, v in enumerate(at)])
    p = p.select("*", *[F.least(F.floor(f"__s{i}"), F.lit(n - 2)).cast("int").alias(f"__i{i}") for i in range(3)])
    p = p.select(*kept, ((F.col("__i0") * n + F.col("__i1")) * n + F.col("__i2")).alias("__a"), *[(F.col(f"__s{i}") - F.col(f"__i{i}")).alias(f"__r{i}") for i in range(3)])
    x, y, z = (F.col(f"__r{i}") for i in range(3))
    top = F.when((x >= y) & (x >= z), F.lit(n * n)).when(y >= z, F.lit(n)).otherwise(F.lit(1))
    low = F.when((z <= x) & (z <= y), F.lit(1)).when(y <= x, F.lit(n)).otherwise(F.lit(n * n))
    whole = n * n + n + 1
    rests = (F.greatest(x, y, z), F.greatest(F.least(x, y), F.least(F.greatest(x, y), z)), F.least(x, y, z))
    p = p.select(*kept, "__a", (F.col("__a") + top).alias("__b"), (F.col("__a") + whole - low).alias("__c"), (F.col("__a") + whole).alias("__d"), *[r.alias(f"__d{i}") for i, r in enumerate(rests, 1)])
    d1, d2, d3 = F.col("__d1"), F.col("__d2"), F.col("__d3")
    return _interpolated(_with_table(p, table, values, divide), values, ["__a", "__b", "__c", "__d"], [F.lit(1.0) - d1, d1 - d2, d2 - d3, d3])


def simplex4(pixels: DataFrame, table: DataFrame, n: int, place: tuple[Column, ...], values: list[str], divide: float | None = 255.0) -> tuple[DataFrame, list[Column]]:
    """The same on four axes, whose order comes from their ranks: by what remains, of equal rests the longer step first."""
    kept = [c for c in pixels.columns if not c.startswith("__")]
    p = pixels.select(*kept, *[(clamp(v) * F.lit(float(n - 1))).alias(f"__s{i}") for i, v in enumerate(place)])
    p = p.select("*", *[F.least(F.floor(f"__s{i}"), F.lit(n - 2)).cast("int").alias(f"__i{i}") for i in range(4)])
    base = ((F.col("__i0") * n + F.col("__i1")) * n + F.col("__i2")) * n + F.col("__i3")
    p = p.select(*kept, base.alias("__m0"), *[(F.col(f"__s{i}") - F.col(f"__i{i}")).alias(f"__r{i}") for i in range(4)])
    rest = [F.col(f"__r{i}") for i in range(4)]
    before = lambda i, j: (rest[j] >= rest[i] if j < i else rest[j] > rest[i]).cast("int")
    p = p.select("*", *[sum((before(i, j) for j in range(4) if j != i), F.lit(0)).alias(f"__k{i}") for i in range(4)])
    steps = [n**3, n**2, n, 1]
    of_rank = lambda r, what: F.when(F.col("__k0") == r, what[0]).when(F.col("__k1") == r, what[1]).when(F.col("__k2") == r, what[2]).otherwise(what[3])
    p = p.select(*kept, "__m0", *[of_rank(r, [F.lit(s) for s in steps]).alias(f"__o{r}") for r in range(4)], *[of_rank(r, rest).alias(f"__d{r}") for r in range(4)])
    p = p.select("*", (F.col("__m0") + F.col("__o0")).alias("__m1"), (F.col("__m0") + F.col("__o0") + F.col("__o1")).alias("__m2"), (F.col("__m0") + F.lit(sum(steps)) - F.col("__o3")).alias("__m3"), (F.col("__m0") + F.lit(sum(steps))).alias("__m4"))
    d = [F.col(f"__d{r}") for r in range(4)]
    return _interpolated(_with_table(p, table, values, divide), values, [f"__m{i}" for i in range(5)], [F.lit(1.0) - d[0], d[0] - d[1], d[1] - d[2], d[2] - d[3], d[3]])


def lab_place(lab: tuple[Column, ...]) -> tuple[Column, ...]:
    return lab[0] / F.lit(100.0), (lab[1] + F.lit(128.0)) / F.lit(255.0), (lab[2] + F.lit(128.0)) / F.lit(255.0)


def lab_to_cmyk(pixels: DataFrame, lab: tuple[Column, ...]) -> tuple[DataFrame, list[Column]]:
    return tetrahedral(pixels, lab_to_cmyk_table(pixels.sparkSession), 5, lab_place(lab), list(INKS))


def rgb_to_cmyk(pixels: DataFrame, rgb: tuple[Column, ...]) -> tuple[DataFrame, list[Column]]:
    """Unit sRGB through the profiles: curve, matrix, XYZ, Lab, table."""
    kept = pixels.columns
    p = pixels.select(*kept, *[color.SRGB.evaluate(v).alias(f"__l{i}") for i, v in enumerate(rgb)])
    p = p.select(*kept, *[v.alias(f"__x{i}") for i, v in enumerate(transform3(color.srgb_matrix(), tuple(F.col(f"__l{i}") for i in range(3))))])
    p = p.select(*kept, *[v.alias(f"__lab{i}") for i, v in enumerate(color.xyz_to_lab(tuple(F.col(f"__x{i}") for i in range(3))))])
    return lab_to_cmyk(p, tuple(F.col(f"__lab{i}") for i in range(3)))


def cmyk_to_lab(pixels: DataFrame, inks: tuple[Column, ...]) -> tuple[DataFrame, list[Column]]:
    p, (l, a, b) = simplex4(pixels, cmyk_to_lab_table(pixels.sparkSession), 5, inks, ["l", "a", "b"])
    return p, [l * F.lit(100.0), a * F.lit(255.0) - F.lit(128.0), b * F.lit(255.0) - F.lit(128.0)]


def device_link(spark: SparkSession, percent: float | None = 300.0, n: int = 33) -> DataFrame:
    """(node, c, m, y, k) bytes for an RGB grid, within the ink limit."""
    g = _grid(spark, n, ["r", "g", "b"])
    p, inks = rgb_to_cmyk(g, tuple(F.col(v) / F.lit(float(n - 1)) for v in ("r", "g", "b")))
    p = p.select("node", *[clamp(v).alias(n_) for v, n_ in zip(inks, INKS)])
    return limit_inks(p, percent or None).select("node", *[to_byte(F.col(v)).alias(v) for v in INKS])


def apply_device_link(pixels: DataFrame, link: DataFrame, rgb: tuple[Column, ...], n: int = 33) -> tuple[DataFrame, list[Column]]:
    """Bytes to bytes through a device link."""
    place = tuple(v * F.lit((n - 1) / 255.0) for v in rgb)
    p, out = tetrahedral(pixels, link, n, place, list(INKS), divide=None, scaled=True)
    return p, [half_up(v) for v in out]


def gray_table(spark: SparkSession, percent: float | None = 300.0) -> DataFrame:
    """(v, c, m, y, k) bytes of the 256 grays."""
    t = spark.range(256).withColumnRenamed("id", "v")
    p, inks = rgb_to_cmyk(t, (F.col("v") / 255.0,) * 3)
    p = p.select("v", *[clamp(x).alias(n) for x, n in zip(inks, INKS)])
    return limit_inks(p, percent or None).select("v", *[to_byte(F.col(x)).alias(x) for x in INKS])
