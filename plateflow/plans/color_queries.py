"""Queries of colour science: curves, spaces, tables and differences."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color
from ..functions.numeric import to_byte
from ..operators import clut
from ..operators.difference import ciede2000 as ciede2000_of
from .ink_queries import limit_sql
from .views import CMYK, KEY, LAB, PX, cmyk, lab, named, px

QUERIES: dict = {}
SQL: dict = {}

RGB = ("r", "g", "b")
UNIT = f"{PX}, u AS (SELECT l_orderkey, l_linenumber, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM px)"


def unit(spark, sf_dir):
    return px(spark, sf_dir).select(*KEY, *[(F.col(v) / F.lit(255.0)).alias(v) for v in RGB])


def rounded(values, names):
    return [F.round(v, 6).alias(n) for v, n in zip(values, names)]


def num(x: float) -> str:
    return f"({x!r}::DOUBLE)"


def register(name: str, sql: str):
    return named(QUERIES, SQL, name, sql)


def clamp_sql(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


# Curves

S = color.SRGB


def srgb_sql(x: str) -> str:
    return clamp_sql(f"CASE WHEN {x} >= {num(S.d)} THEN pow(greatest(0, {num(S.a)} * {x} + {num(S.b)}), {num(S.g)}) ELSE {num(S.c)} * {x} END")


@register("srgb_linearize", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({srgb_sql(v)}, 6) AS {v}" for v in RGB) + " FROM u")
def srgb_linearize(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, *rounded([color.SRGB.evaluate(F.col(v)) for v in RGB], RGB))


@register("srgb_encode", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, " + ", ".join("round(" + clamp_sql(f"CASE WHEN {v} >= {num(S.c * S.d)} THEN (pow({v}, {num(1 / S.g)}) - {num(S.b)}) / {num(S.a)} ELSE {v} / {num(S.c)} END") + f", 6) AS {v}" for v in RGB) + " FROM u")
def srgb_encode(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, *rounded([color.SRGB.invert(F.col(v)) for v in RGB], RGB))


@register("gamma_curve", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, round(pow(r, 1.8), 6) AS eval, round(pow(r, {num(1 / 1.8)}), 6) AS inverse FROM u")
def gamma_curve(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, F.round(color.gamma(F.col("r"), 1.8), 6).alias("eval"), F.round(color.gamma(F.col("r"), 1 / 1.8), 6).alias("inverse"))


#: A rising table for the sampled curves.
SAMPLES = [0.0, 0.01, 0.06, 0.14, 0.26, 0.41, 0.6, 0.83, 1.0]
SEGMENTS = "seg AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {num(a)}, {num(b)})" for i, (a, b) in enumerate(zip(SAMPLES, SAMPLES[1:]))) + ") AS t(i, lo, hi))"


@register("sampled_curve_eval", f"WITH {UNIT}, {SEGMENTS} SELECT l_orderkey, l_linenumber, round(lo + (r * 8 - i) * (hi - lo), 6) AS v FROM u JOIN seg ON i = least(floor(r * 8), 7)")
def sampled_curve_eval(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, F.round(color.sampled(F.col("r"), SAMPLES), 6).alias("v"))


@register("sampled_curve_inverse", f"WITH {UNIT}, {SEGMENTS} SELECT l_orderkey, l_linenumber, round((i + (r - lo) / (hi - lo)) / 8, 6) AS v FROM u JOIN seg ON (r > lo OR i = 0) AND r <= hi")
def sampled_curve_inverse(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, F.round(color.sampled_inverse(F.col("r"), SAMPLES), 6).alias("v"))


#: A curve of each type.
CURVES = [color.Parametric(0, 2.2), color.Parametric(1, 2.0, 1.1, -0.1), color.Parametric(2, 1.8, 0.9, 0.02, 0.05), color.Parametric(3, 2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045), color.Parametric(4, 2.4, 0.9, 0.05, 0.08, 0.05, 0.03, 0.01)]


def parametric_sql(p: color.Parametric, x: str) -> str:
    power = f"pow(greatest(0, {num(p.a)} * {x} + {num(p.b)}), {num(p.g)})"
    if p.kind == 0:
        return f"pow({x}, {num(p.g)})"
    if p.kind in (1, 2):
        add = num(p.c if p.kind == 2 else 0.0)
        return clamp_sql(f"CASE WHEN {x} >= {num(-p.b / p.a)} THEN {power} + {add} ELSE {add} END")
    e, f = (p.e, p.f) if p.kind == 4 else (0.0, 0.0)
    return clamp_sql(f"CASE WHEN {x} >= {num(p.d)} THEN {power} + {num(e)} ELSE {num(p.c)} * {x} + {num(f)} END")


def parametric_inverse_sql(p: color.Parametric, y: str) -> str:
    root = lambda v: f"(pow(greatest(0, {v}), {num(1 / p.g)}) - {num(p.b)}) / {num(p.a)}"
    if p.kind == 0:
        return f"pow({y}, {num(1 / p.g)})"
    if p.kind in (1, 2):
        return clamp_sql(root(f"{y} - {num(p.c if p.kind == 2 else 0.0)}"))
    e, f = (p.e, p.f) if p.kind == 4 else (0.0, 0.0)
    return clamp_sql(f"CASE WHEN {y} >= {num(p.c * p.d + f)} THEN {root(f'{y} - {num(e)}')} ELSE ({y} - {num(f)}) / {num(p.c)} END")


@register("parametric_curves", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({parametric_sql(p, 'r')}, 6) AS t{p.kind}" for p in CURVES) + " FROM u")
def parametric_curves(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, *rounded([p.evaluate(F.col("r")) for p in CURVES], [f"t{p.kind}" for p in CURVES]))


@register("parametric_inverses", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({parametric_inverse_sql(p, 'r')}, 6) AS t{p.kind}" for p in CURVES) + " FROM u")
def parametric_inverses(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, *rounded([p.invert(F.col("r")) for p in CURVES], [f"t{p.kind}" for p in CURVES]))


# Spaces

MATRIX = color.srgb_matrix()


def matrix_sql(m, names, out) -> str:
    return ", ".join(f"{num(r[0])} * {names[0]} + {num(r[1])} * {names[1]} + {num(r[2])} * {names[2]} AS {o}" for r, o in zip(m, out))


XYZ = f"{UNIT}, lin AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"{srgb_sql(v)} AS {v}" for v in RGB) + f" FROM u), xyz AS (SELECT l_orderkey, l_linenumber, {matrix_sql(MATRIX, RGB, ('x', 'y', 'z'))} FROM lin)"


def xyz(spark, sf_dir):
    t = unit(spark, sf_dir)
    return t.select(*KEY, *[v.alias(n) for v, n in zip(color.rgb_to_xyz(tuple(F.col(v) for v in RGB)), "xyz")])


@register("rgb_to_xyz", f"WITH {XYZ} SELECT l_orderkey, l_linenumber, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM xyz")
def rgb_to_xyz(spark, sf_dir):
    return xyz(spark, sf_dir).select(*KEY, *rounded([F.col(v) for v in "xyz"], "xyz"))


def lab_sql(source: str, key: str = "l_orderkey, l_linenumber") -> str:
    f = lambda v, w: f"CASE WHEN {v} / {w} > {num(color.LAB_EPSILON)} THEN cbrt({v} / {w}) ELSE ({num(color.LAB_KAPPA)} * ({v} / {w}) + 16) / 116 END"
    return f"""f AS (SELECT {key}, {f('x', num(color.D50[0]))} AS fx, {f('y', num(color.D50[1]))} AS fy, {f('z', num(color.D50[2]))} AS fz FROM {source}),
labs AS (SELECT {key}, greatest(0, least(100, 116 * fy - 16)) AS l, greatest(-128, least(127, 500 * (fx - fy))) AS a, greatest(-128, least(127, 200 * (fy - fz))) AS b FROM f)"""


@register("xyz_to_lab", f"WITH {XYZ}, {lab_sql('xyz')} SELECT l_orderkey, l_linenumber, round(l, 5) AS l, round(a, 5) + 0 AS a, round(b, 5) + 0 AS b FROM labs")
def xyz_to_lab(spark, sf_dir):
    t = xyz(spark, sf_dir)
    values = color.xyz_to_lab(tuple(F.col(v) for v in "xyz"))
    return t.select(*KEY, *[(F.round(v, 5) + F.lit(0.0)).alias(n) for v, n in zip(values, "lab")])


def fi_sql(t: str, w: float) -> str:
    return f"greatest(0, (CASE WHEN {t} * {t} * {t} > {num(color.LAB_EPSILON)} THEN {t} * {t} * {t} ELSE (116 * {t} - 16) / {num(color.LAB_KAPPA)} END) * {num(w)})"


FY = f"{LAB}, fy AS (SELECT *, (l + 16) / 116 AS fy FROM lab), fxyz AS (SELECT l_orderkey, l_linenumber, fy + a / 500 AS fx, fy, fy - b / 200 AS fz FROM fy), labxyz AS (SELECT l_orderkey, l_linenumber, {fi_sql('fx', color.D50[0])} AS x, {fi_sql('fy', color.D50[1])} AS y, {fi_sql('fz', color.D50[2])} AS z FROM fxyz)"


def lab_xyz(spark, sf_dir):
    t = lab(spark, sf_dir)
    return t.select(*KEY, *[v.alias(n) for v, n in zip(color.lab_to_xyz(tuple(F.col(v) for v in "lab")), "xyz")])


@register("lab_to_xyz", f"WITH {FY} SELECT l_orderkey, l_linenumber, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM labxyz")
def lab_to_xyz(spark, sf_dir):
    return lab_xyz(spark, sf_dir).select(*KEY, *rounded([F.col(v) for v in "xyz"], "xyz"))


TO_D65 = color.adaptation(color.D50, color.D65)


@register("bradford_adapt", f"WITH {FY}, ad AS (SELECT l_orderkey, l_linenumber, {matrix_sql(TO_D65, ('x', 'y', 'z'), ('x', 'y', 'z'))} FROM labxyz) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(greatest(0, {v}), 6) AS {v}" for v in "xyz") + " FROM ad")
def bradford_adapt(spark, sf_dir):
    t = lab_xyz(spark, sf_dir)
    return t.select(*KEY, *rounded(color.adapt(tuple(F.col(v) for v in "xyz"), TO_D65), "xyz"))


@register("lab_chroma_hue", f"WITH {LAB}, h AS (SELECT *, degrees(atan2(b, a)) AS h FROM lab) SELECT l_orderkey, l_linenumber, round(sqrt(a * a + b * b), 6) AS chroma, round(CASE WHEN h < 0 THEN h + 360 ELSE h END, 6) AS hue FROM h")
def lab_chroma_hue(spark, sf_dir):
    return lab(spark, sf_dir).select(*KEY, F.round(color.chroma(F.col("a"), F.col("b")), 6).alias("chroma"), F.round(color.hue(F.col("a"), F.col("b")), 6).alias("hue"))


HUE = "CASE WHEN {a} = 0 AND {b} = 0 THEN 0 WHEN atan2({b}, {a}) < 0 THEN degrees(atan2({b}, {a})) + 360 ELSE degrees(atan2({b}, {a})) END"
DELTA_E = f"""{LAB},
d0 AS (SELECT l_orderkey, l_linenumber, l AS l1, a AS a1, b AS b1, 100 - l AS l2, b / 2 AS a2, a / 2 + 3 AS b2 FROM lab),
d1 AS (SELECT *, (sqrt(a1 * a1 + b1 * b1) + sqrt(a2 * a2 + b2 * b2)) / 2 AS cm FROM d0),
d2 AS (SELECT *, 0.5 * (1 - sqrt(pow(cm, 7) / (pow(cm, 7) + 6103515625.0::DOUBLE))) AS g FROM d1),
d3 AS (SELECT *, a1 * (1 + g) AS p1, a2 * (1 + g) AS p2 FROM d2),
d4 AS (SELECT *, sqrt(p1 * p1 + b1 * b1) AS c1, sqrt(p2 * p2 + b2 * b2) AS c2, {HUE.format(a='p1', b='b1')} AS h1, {HUE.format(a='p2', b='b2')} AS h2 FROM d3),
d5 AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN abs(h2 - h1) <= 180 THEN h2 - h1 WHEN h2 - h1 > 180 THEN h2 - h1 - 360 ELSE h2 - h1 + 360 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm,
  (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cp FROM d4),
d6 AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.20 * cos(radians(4 * hm - 63)) AS t,
  -sin(radians(60 * exp(-((hm - 275) / 25) * ((hm - 275) / 25)))) * 2 * sqrt(pow(cp, 7) / (pow(cp, 7) + 6103515625.0::DOUBLE)) AS rt,
  2 * sqrt(c1 * c2) * sin(radians(dh / 2)) AS bh FROM d5),
d7 AS (SELECT *, (l2 - l1) / (1 + 0.015 * (lm - 50) * (lm - 50) / sqrt(20 + (lm - 50) * (lm - 50))) AS x, (c2 - c1) / (1 + 0.045 * cp) AS y, bh / (1 + 0.015 * cp * t) AS z FROM d6)"""


@register("ciede2000", f"WITH {DELTA_E} SELECT l_orderkey, l_linenumber, round(sqrt(greatest(0, x * x + y * y + z * z + rt * y * z)), 4) AS de FROM d7")
def ciede2000(spark, sf_dir):
    l, a, b = (F.col(v) for v in "lab")
    t = lab(spark, sf_dir).withColumns({"l2": F.lit(100.0) - l, "a2": b / F.lit(2.0), "b2": a / F.lit(2.0) + F.lit(3.0)})
    return ciede2000_of(t, ("l", "a", "b"), ("l2", "a2", "b2")).select(*KEY, F.round("de", 4).alias("de"))


@register("rgb_to_cmyk_naive", f"WITH {UNIT}, n AS (SELECT *, least(1 - r, 1 - g, 1 - b) AS k FROM u) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(CASE WHEN k >= 1 THEN 0 ELSE ((1 - {v}) - k) / (1 - k) END, 6) AS {o}" for v, o in zip(RGB, "cmy")) + ", round(CASE WHEN k >= 1 THEN 1 ELSE k END, 6) AS k FROM n")
def rgb_to_cmyk_naive(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, *rounded(color.naive_cmyk(*(F.col(v) for v in RGB)), "cmyk"))


YCC_SQL = ", ".join(f"floor({num(m[0])} * r + {num(m[1])} * g + {num(m[2])} * b + {add} + 0.5)::BIGINT AS {o}" for m, add, o in zip(color.YCC, ("0", "128", "128"), ("y", "cb", "cr")))


@register("ycbcr_forward", f"WITH {PX} SELECT l_orderkey, l_linenumber, {YCC_SQL} FROM px")
def ycbcr_forward(spark, sf_dir):
    return px(spark, sf_dir).select(*KEY, *[v.alias(n) for v, n in zip(color.rgb_to_ycc(*(F.col(v) for v in RGB)), ("y", "cb", "cr"))])


BACK = {"r": "r + 1.402::DOUBLE * (b - 128)", "g": "r - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128)", "b": "r + 1.772::DOUBLE * (g - 128)"}


@register("ycbcr_inverse", f"WITH {PX} SELECT l_orderkey, l_linenumber, " + ", ".join(f"floor(greatest(0, least(255, {x})) + 0.5)::BIGINT AS {o}" for o, x in BACK.items()) + " FROM px")
def ycbcr_inverse(spark, sf_dir):
    t = px(spark, sf_dir).select(*KEY, *[F.col(v).cast("double").alias(v) for v in RGB])
    return t.select(*KEY, *[v.alias(n) for v, n in zip(color.ycc_to_rgb(*(F.col(v) for v in RGB)), RGB)])


# Tables

CMYK_TABLE = """grid4 AS (SELECT n AS node, (n // 125) / 4.0::DOUBLE AS c, (n // 25 % 5) / 4.0::DOUBLE AS m, (n // 5 % 5) / 4.0::DOUBLE AS y, (n % 5) / 4.0::DOUBLE AS k FROM (SELECT unnest(range(625)) AS n)),
gray4 AS (SELECT *, least(c, m, y) AS g, least(1, 0.333333::DOUBLE * c + 0.333333::DOUBLE * m + 0.333334::DOUBLE * y + 0.9::DOUBLE * k) AS ink, 1 - 0.8::DOUBLE * k AS s FROM grid4),
cmyktable AS (SELECT node, floor(100 * (1 - ink) / 100 * 255 + 0.5)::BIGINT AS l, floor(((m - g) * 75 - (c - g) * 37) * s + 128 + 0.5)::BIGINT AS a, floor(((y - g) * 90 - (c - g) * 48) * s + 128 + 0.5)::BIGINT AS b FROM gray4)"""
LAB_TABLE = """grid3 AS (SELECT n AS node, (n // 25) * 25.0::DOUBLE AS l, (n // 5 % 5) / 4.0::DOUBLE * 255 - 128 AS a, (n % 5) / 4.0::DOUBLE * 255 - 128 AS b FROM (SELECT unnest(range(125)) AS n)),
dark3 AS (SELECT *, greatest(0, (100 - l) / 100) AS d FROM grid3), key3 AS (SELECT *, CASE WHEN d > 0.8::DOUBLE THEN (d - 0.8::DOUBLE) * 5 ELSE 0 END AS k FROM dark3),
rest3 AS (SELECT *, greatest(0, d - k * 0.9::DOUBLE) AS r FROM key3),
labtable AS (SELECT node, floor(greatest(0, least(1, r - a * 0.005::DOUBLE - b * 0.003::DOUBLE)) * 255 + 0.5)::BIGINT AS c, floor(greatest(0, least(1, r + a * 0.006::DOUBLE)) * 255 + 0.5)::BIGINT AS m,
  floor(greatest(0, least(1, r + b * 0.007::DOUBLE)) * 255 + 0.5)::BIGINT AS y, floor(greatest(0, least(1, k)) * 255 + 0.5)::BIGINT AS k FROM rest3)"""


@register("cmyk_model_clut", f"WITH {CMYK_TABLE} SELECT * FROM cmyktable")
def cmyk_model_clut(spark, sf_dir):
    return clut.cmyk_to_lab_table(spark)


@register("lab_model_clut", f"WITH {LAB_TABLE} SELECT * FROM labtable")
def lab_model_clut(spark, sf_dir):
    return clut.lab_to_cmyk_table(spark)


def tetra_sql(name: str, source: str, table: str, n: int, place: tuple[str, str, str], values: str, divide: float | None, key: str, scaled: bool = False) -> str:
    """CTEs that end in `name`: source's rows (key) with the table's interpolated values."""
    at = [p if scaled else f"greatest(0, least(1, {p})) * {n - 1}" for p in place]
    w = f" / {divide}::DOUBLE" if divide else ""
    value = lambda v: " + ".join(f"({t}.{v}{w}) * {x}" for t, x in zip(("t0", "t1", "t2", "t3"), ("(1 - d1)", "(d1 - d2)", "(d2 - d3)", "d3")))
    return f"""{name}s AS (SELECT *, {at[0]} AS sx, {at[1]} AS sy, {at[2]} AS sz FROM {source}),
{name}i AS (SELECT *, least(floor(sx), {n - 2})::BIGINT AS ix, least(floor(sy), {n - 2})::BIGINT AS iy, least(floor(sz), {n - 2})::BIGINT AS iz FROM {name}s),
{name}d AS (SELECT *, sx - ix AS dx, sy - iy AS dy, sz - iz AS dz, (ix * {n} + iy) * {n} + iz AS n0 FROM {name}i),
{name}w AS (SELECT *, n0 + CASE WHEN dx >= dy AND dx >= dz THEN {n * n} WHEN dy >= dz THEN {n} ELSE 1 END AS n1, n0 + {n * n + n + 1} - CASE WHEN dz <= dx AND dz <= dy THEN 1 WHEN dy <= dx THEN {n} ELSE {n * n} END AS n2,
  n0 + {n * n + n + 1} AS n3, greatest(dx, dy, dz) AS d1, greatest(least(dx, dy), least(greatest(dx, dy), dz)) AS d2, least(dx, dy, dz) AS d3 FROM {name}d),
{name} AS (SELECT {key}, {', '.join(f'{value(v)} AS {v}' for v in values)} FROM {name}w p JOIN {table} t0 ON t0.node = n0 JOIN {table} t1 ON t1.node = n1 JOIN {table} t2 ON t2.node = n2 JOIN {table} t3 ON t3.node = n3)"""


PLACE = ("l / 100", "(a + 128) / 255", "(b + 128) / 255")
BOTH = "l_orderkey, l_linenumber"


@register("tetrahedral_rgb", f"WITH {LAB}, {LAB_TABLE}, {tetra_sql('t', 'lab', 'labtable', 5, PLACE, 'cmyk', 255.0, BOTH)} SELECT l_orderkey, l_linenumber, round(c, 6) AS c, round(m, 6) AS m, round(y, 6) AS y, round(k, 6) AS k FROM t")
def tetrahedral_rgb(spark, sf_dir):
    p, inks = clut.lab_to_cmyk(lab(spark, sf_dir), tuple(F.col(v) for v in "lab"))
    return p.select(*KEY, *rounded(inks, "cmyk"))


SIMPLEX = f"""{CMYK}, {CMYK_TABLE},
q0 AS (SELECT l_orderkey, l_linenumber, greatest(0, least(1, c)) * 4 AS s0, greatest(0, least(1, m)) * 4 AS s1, greatest(0, least(1, y)) * 4 AS s2, greatest(0, least(1, k)) * 4 AS s3 FROM cmyk),
q1 AS (SELECT *, least(floor(s0), 3)::BIGINT AS i0, least(floor(s1), 3)::BIGINT AS i1, least(floor(s2), 3)::BIGINT AS i2, least(floor(s3), 3)::BIGINT AS i3 FROM q0),
q2 AS (SELECT l_orderkey, l_linenumber, ((i0 * 5 + i1) * 5 + i2) * 5 + i3 AS n0, list_sort([{{'d': s0 - i0, 'o': 125}}, {{'d': s1 - i1, 'o': 25}}, {{'d': s2 - i2, 'o': 5}}, {{'d': s3 - i3, 'o': 1}}], 'DESC') AS w FROM q1),
q3 AS (SELECT *, n0 + w[1].o AS n1, n0 + w[1].o + w[2].o AS n2, n0 + w[1].o + w[2].o + w[3].o AS n3, n0 + 156 AS n4, w[1].d AS d1, w[2].d AS d2, w[3].d AS d3, w[4].d AS d4 FROM q2),
q4 AS (SELECT l_orderkey, l_linenumber, {', '.join(f"(t0.{v} / 255.0::DOUBLE) * (1 - d1) + (t1.{v} / 255.0::DOUBLE) * (d1 - d2) + (t2.{v} / 255.0::DOUBLE) * (d2 - d3) + (t3.{v} / 255.0::DOUBLE) * (d3 - d4) + (t4.{v} / 255.0::DOUBLE) * d4 AS {v}" for v in 'lab')}
  FROM q3 {' '.join(f'JOIN cmyktable t{i} ON t{i}.node = n{i}' for i in range(5))})"""


@register("simplex_cmyk_lab", f"WITH {SIMPLEX} SELECT l_orderkey, l_linenumber, round(l * 100, 5) AS l, round(a * 255 - 128, 5) + 0 AS a, round(b * 255 - 128, 5) + 0 AS b FROM q4")
def simplex_cmyk_lab(spark, sf_dir):
    p, values = clut.cmyk_to_lab(cmyk(spark, sf_dir), tuple(F.col(v) for v in "cmyk"))
    return p.select(*KEY, *[(F.round(v, 5) + F.lit(0.0)).alias(n) for v, n in zip(values, "lab")])


@register("rgb_to_cmyk_icc", f"WITH {XYZ}, {lab_sql('xyz')}, {LAB_TABLE}, {tetra_sql('t', 'labs', 'labtable', 5, PLACE, 'cmyk', 255.0, BOTH)} SELECT l_orderkey, l_linenumber, round(c, 5) AS c, round(m, 5) AS m, round(y, 5) AS y, round(k, 5) AS k FROM t")
def rgb_to_cmyk_icc(spark, sf_dir):
    p, inks = clut.rgb_to_cmyk(unit(spark, sf_dir), tuple(F.col(v) for v in RGB))
    return p.select(*KEY, *[F.round(v, 5).alias(n) for v, n in zip(inks, "cmyk")])


def link_sql(n: int, grid: str) -> str:
    """CTEs that end in `limited`: the inks, within 300 %, of grid's rows (node, r, g, b as unit values)."""
    lin = ", ".join(f"{srgb_sql(v)} AS {v}" for v in RGB)
    limits = limit_sql(300.0).replace(CMYK, "cmyk AS (SELECT node, greatest(0, least(1, c)) AS c, greatest(0, least(1, m)) AS m, greatest(0, least(1, y)) AS y, greatest(0, least(1, k)) AS k FROM lt)").replace("l_orderkey, l_linenumber", "node")
    return f"{grid}, lin AS (SELECT node, {lin} FROM grid), xyz AS (SELECT node, {matrix_sql(MATRIX, RGB, ('x', 'y', 'z'))} FROM lin), {lab_sql('xyz', 'node')}, {LAB_TABLE}, {tetra_sql('lt', 'labs', 'labtable', 5, PLACE, 'cmyk', 255.0, 'p.node AS node')}, {limits}"


GRID33 = "grid AS (SELECT n AS node, (n // 1089) / 32.0::DOUBLE AS r, (n // 33 % 33) / 32.0::DOUBLE AS g, (n % 33) / 32.0::DOUBLE AS b FROM (SELECT unnest(range(35937)) AS n))"
GRAYS = "grid AS (SELECT n AS node, n / 255.0::DOUBLE AS r, n / 255.0::DOUBLE AS g, n / 255.0::DOUBLE AS b FROM (SELECT unnest(range(256)) AS n))"
LINK = "link AS (SELECT node, " + ", ".join(f"floor(greatest(0, least(1, {v})) * 255 + 0.5)::BIGINT AS {v}" for v in "cmyk") + " FROM limited)"


@register("devicelink_clut", f"WITH {link_sql(33, GRID33)}, {LINK} SELECT * FROM link")
def devicelink_clut(spark, sf_dir):
    return clut.device_link(spark)


SCALED = tuple(f"{v} * {num(32 / 255.0)}" for v in RGB)


@register("devicelink_pixels", f"WITH {link_sql(33, GRID33)}, {LINK}, {PX}, {tetra_sql('dl', 'px', 'link', 33, SCALED, 'cmyk', None, BOTH, True)} SELECT l_orderkey, l_linenumber, " + ", ".join(f"floor({v} + 0.5)::BIGINT AS {v}" for v in "cmyk") + " FROM dl")
def devicelink_pixels(spark, sf_dir):
    p, inks = clut.apply_device_link(px(spark, sf_dir), clut.device_link(spark), tuple(F.col(v) for v in RGB))
    return p.select(*KEY, *[v.alias(n) for v, n in zip(inks, "cmyk")])


@register("gray_lut_join", f"WITH {link_sql(0, GRAYS)}, {LINK}, {PX} SELECT l_orderkey, l_linenumber, r AS v, c, m, y, k FROM px JOIN link ON node = r")
def gray_lut_join(spark, sf_dir):
    t = px(spark, sf_dir).select(*KEY, F.col("r").alias("v"))
    return t.join(F.broadcast(clut.gray_table(spark)), "v").select(*KEY, "v", "c", "m", "y", "k")


@register("byte_round_trip", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, floor(r * 255 + 0.5)::BIGINT AS r, floor(g * 255 + 0.5)::BIGINT AS g, floor(b * 255 + 0.5)::BIGINT AS b FROM u")
def byte_round_trip(spark, sf_dir):
    return unit(spark, sf_dir).select(*KEY, *[to_byte(F.col(v)).alias(v) for v in RGB])
