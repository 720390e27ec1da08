"""Queries of rasters, blocks and layers."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..operators import layers as L
from ..operators import raster as R
from ..operators.resample import KERNELS, print_size, resample, weights
from .blend_queries import MODE_SQL
from .views import BLOCK8, LAYERS, RASTER, block8, layers, named, raster, table

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    return named(QUERIES, SQL, name, sql)


# Resampling

CUBIC = "CASE WHEN abs({x}) < 1 THEN ((12 - 9 * {b} - 6 * {c}) * abs({x}) * abs({x}) * abs({x}) + (-18 + 12 * {b} + 6 * {c}) * abs({x}) * abs({x}) + (6 - 2 * {b})) / 6 WHEN abs({x}) < 2 THEN ((-{b} - 6 * {c}) * abs({x}) * abs({x}) * abs({x}) + (6 * {b} + 30 * {c}) * abs({x}) * abs({x}) + (-12 * {b} - 48 * {c}) * abs({x}) + (8 * {b} + 24 * {c})) / 6 ELSE 0 END"
KERNEL_SQL = {
    "box": "CASE WHEN abs({x}) <= 0.5 THEN 1.0::DOUBLE ELSE 0 END",
    "bilinear": "greatest(0, 1 - abs({x}))",
    "catmull_rom": CUBIC.replace("{b}", "0.0::DOUBLE").replace("{c}", "0.5::DOUBLE"),
    "mitchell": CUBIC.replace("{b}", "(1.0::DOUBLE / 3)").replace("{c}", "(1.0::DOUBLE / 3)"),
    "lanczos3": "CASE WHEN {x} = 0 THEN 1.0::DOUBLE WHEN abs({x}) < 3 THEN 3 * sin(pi() * abs({x})) * sin(pi() * abs({x}) / 3) / ((pi() * abs({x})) * (pi() * abs({x}))) ELSE 0 END",
}


def weights_sql(out: str, sizes: str, name: str) -> str:
    radius = KERNELS[name][0]
    return f"""{out}0 AS (SELECT src, dst, d, dst::DOUBLE / src AS scale, least(dst::DOUBLE / src, 1) AS fs FROM (SELECT src, dst, unnest(range(dst)) AS d FROM (SELECT DISTINCT src, dst FROM {sizes}))),
{out}1 AS (SELECT *, (d + 0.5) / scale - 0.5 AS ctr, {radius} / fs AS reach FROM {out}0),
{out}2 AS (SELECT *, unnest(range(greatest(0, floor(ctr - reach))::BIGINT, least(src - 1, ceil(ctr + reach))::BIGINT + 1)) AS s FROM {out}1),
{out}3 AS (SELECT src, dst, d, s, ({KERNEL_SQL[name].format(x='((s - ctr) * fs)')}) * fs AS k FROM {out}2),
{out} AS (SELECT src, dst, d, s, k / sum(k) OVER (PARTITION BY src, dst, d) AS w FROM {out}3)"""


def resample_sql(name: str, width: int, height: str) -> str:
    return f"""WITH {RASTER}, sizes AS (SELECT image, 64::BIGINT AS width, max(y) + 1 AS height, {width}::BIGINT AS to_width, ({height.format(h='(max(y) + 1)')})::BIGINT AS to_height FROM raster GROUP BY image),
across_sizes AS (SELECT width AS src, to_width AS dst FROM sizes), down_sizes AS (SELECT height AS src, to_height AS dst FROM sizes),
{weights_sql('across', 'across_sizes', name)}, {weights_sql('down', 'down_sizes', name)},
h AS (SELECT p.image, z.height, z.to_height, p.y, a.d AS x, sum(p.v * a.w) AS v FROM raster p JOIN sizes z USING (image) JOIN across a ON a.src = z.width AND a.dst = z.to_width AND a.s = p.x GROUP BY ALL),
f AS (SELECT h.image, b.d AS y, h.x, sum(h.v * b.w) AS v FROM h JOIN down b ON b.src = h.height AND b.dst = h.to_height AND b.s = h.y GROUP BY ALL)
SELECT image, y, x, floor(greatest(0, least(255, round(v, 9))) + 0.5)::BIGINT AS v FROM f"""


def sized(spark, sf_dir, width, height):
    p = raster(spark, sf_dir)
    sizes = p.groupBy("image").agg((F.max("y") + 1).cast("long").alias("height"))
    return p, sizes.select("image", F.lit(64).cast("long").alias("width"), "height", F.lit(width).cast("long").alias("to_width"), height(F.col("height")).cast("long").alias("to_height"))


def _resamples():
    cases = {f"resample_{k}": (k, 40, "floor({h} * 5 / 8) + 1", lambda h: F.floor(h * 5 / 8) + 1) for k in KERNELS}
    cases |= {"resample_up": ("catmull_rom", 96, "{h} + 7", lambda h: h + 7), "resample_down": ("lanczos3", 16, "floor({h} / 3) + 1", lambda h: F.floor(h / 3) + 1)}
    for name, (k, width, sql, height) in cases.items():

        def query(spark, sf_dir, k=k, width=width, height=height):
            return resample(*sized(spark, sf_dir, width, height), k)

        register(name, resample_sql(k, width, sql))(query)


_resamples()


@register("resample_weights", f"WITH sizes AS (SELECT DISTINCT p_size::BIGINT AS src, (1 + p_size // 2)::BIGINT AS dst FROM part), {weights_sql('w', 'sizes', 'lanczos3')} SELECT src, dst, d, s, round(w, 6) + 0 AS w FROM w WHERE round(w, 6) <> 0")
def resample_weights(spark, sf_dir):
    sizes = table(spark, sf_dir, "part").select(F.col("p_size").alias("src"), (F.lit(1) + F.floor(F.col("p_size") / 2)).alias("dst"))
    return weights(sizes, "lanczos3").select("src", "dst", "d", "s", F.round("w", 6).alias("w")).where("w <> 0")


@register("downsample_threshold", "SELECT p_partkey, p_size * 20 AS dpi_x, p_size * 10 + 200 AS dpi_y, CASE WHEN p_size * 20 > 450 OR p_size * 10 + 200 > 450 THEN greatest(1, floor(1000 * 300.0::DOUBLE / (p_size * 20) + 0.5))::BIGINT ELSE 1000 END AS width, CASE WHEN p_size * 20 > 450 OR p_size * 10 + 200 > 450 THEN greatest(1, floor(800 * 300.0::DOUBLE / (p_size * 10 + 200) + 0.5))::BIGINT ELSE 800 END AS height FROM part")
def downsample_threshold(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 20).alias("dpi_x"), (F.col("p_size") * 10 + 200).alias("dpi_y"))
    x, y = F.col("dpi_x"), F.col("dpi_y")
    return t.select("*", print_size(F.lit(1000), x, y, x).alias("width"), print_size(F.lit(800), x, y, y).alias("height"))


# Sensor cells

BALANCE, BLACK, WHITE = (1.4, 1.0, 1.25), 12.0, 240.0


def cell_sql(pattern: str, y: str, x: str) -> str:
    return f"(['{pattern[0]}', '{pattern[1]}', '{pattern[2]}', '{pattern[3]}'])[({y}) % 2 * 2 + ({x}) % 2 + 1]"


def demosaic_sql(pattern: str) -> str:
    gain = f"CASE c WHEN 'r' THEN {BALANCE[0]}::DOUBLE WHEN 'g' THEN {BALANCE[1]}::DOUBLE ELSE {BALANCE[2]}::DOUBLE END"
    at = lambda dy, dx: f"lv[greatest(0, least(7, y + {dy})) * 8 + greatest(0, least(7, x + {dx})) + 1]"
    mean = lambda *ps: "(" + " + ".join(at(*p) for p in ps) + f") / {len(ps)}"
    own, cross, corners = at(0, 0), mean((-1, 0), (1, 0), (0, -1), (0, 1)), mean((-1, -1), (-1, 1), (1, -1), (1, 1))
    sides, above = mean((0, -1), (0, 1)), mean((-1, 0), (1, 0))
    red = "y % 2 = 0" if "r" in pattern[:2] else "y % 2 = 1"
    enc = lambda v: f"floor(round((CASE WHEN {v} <= 0.0031308::DOUBLE THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({v}, 1 / 2.4::DOUBLE) - 0.055::DOUBLE END) * 255, 9) + 0.5)::BIGINT"
    return f"""WITH {BLOCK8}, lev AS (SELECT block, y, x, least(1, greatest(0, v - {BLACK}::DOUBLE) / {WHITE - BLACK}::DOUBLE * ({gain})) AS l FROM (SELECT *, {cell_sql(pattern, 'y', 'x')} AS c FROM block8)),
arr AS (SELECT block, list(l ORDER BY y, x) AS lv FROM lev GROUP BY block),
cells AS (SELECT block, (i // 8)::INT AS y, (i % 8)::INT AS x, lv FROM arr, (SELECT unnest(range(64)) AS i)),
k AS (SELECT *, {cell_sql(pattern, 'y', 'x')} AS c FROM cells),
rgb AS (SELECT block, y, x, CASE WHEN c = 'r' THEN {own} WHEN c = 'b' THEN {corners} WHEN {red} THEN {sides} ELSE {above} END AS r, CASE WHEN c = 'g' THEN {own} ELSE {cross} END AS g,
  CASE WHEN c = 'b' THEN {own} WHEN c = 'r' THEN {corners} WHEN {red} THEN {above} ELSE {sides} END AS b FROM k)
SELECT block AS image, y, x, {enc('r')} AS r, {enc('g')} AS g, {enc('b')} AS b FROM rgb"""


def cells(spark, sf_dir):
    level = lambda e: F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((e.cast("double") + F.lit(0.6)) / F.lit(1.2) * F.lit(255.0) + F.lit(0.5))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("image"), F.transform("embedding", level).alias("cells"))


def _demosaics():
    for pattern in R.PATTERNS:

        def query(spark, sf_dir, pattern=pattern):
            return R.demosaic(cells(spark, sf_dir), pattern, 8, 8, BLACK, WHITE, BALANCE)

        register(f"demosaic_{pattern}", demosaic_sql(pattern))(query)


_demosaics()


@register("cfa_channel", f"WITH {BLOCK8} SELECT " + ", ".join(f"{cell_sql(p, 'y', 'x')} AS {p}" for p in R.PATTERNS) + ", y % 2 AS y, x % 2 AS x, count(*) AS n, sum(v)::BIGINT AS level FROM block8 GROUP BY ALL")
def cfa_channel(spark, sf_dir):
    t = block8(spark, sf_dir)
    keys = [R.cell(p, F.col("y"), F.col("x")).alias(p) for p in R.PATTERNS] + [(F.col("y") % 2).alias("y"), (F.col("x") % 2).alias("x")]
    return t.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("v").alias("level"))


# Cosine transforms

def basis_sql(name: str, n: int) -> str:
    return f"{name} AS (SELECT f, p, 0.5 * (CASE WHEN f = 0 THEN 1 / sqrt(2) ELSE 1 END) * cos((2 * p + 1) * f * pi() / {2 * n}) AS w FROM (SELECT unnest(range({n})) AS f), (SELECT unnest(range({n})) AS p))"


DCT = f"{BLOCK8}, {basis_sql('b8', 8)}, rows8 AS (SELECT block, y, f AS u, sum((v - 128) * w) AS c FROM block8 JOIN b8 ON x = p GROUP BY ALL), dct AS (SELECT block, f AS v, u, sum(c * w) AS c FROM rows8 JOIN b8 ON y = p GROUP BY ALL)"


@register("dct8", f"WITH {DCT} SELECT block, v, u, round(c, 4) + 0 AS c FROM dct")
def dct8(spark, sf_dir):
    return R.dct8(block8(spark, sf_dir)).select("block", "v", "u", (F.round("c", 4) + F.lit(0.0)).alias("c"))


def _idcts():
    sample = "floor(greatest(0, least(255, round({v} + 128, 9))) + 0.5)::BIGINT AS s"
    for n in (8, 4, 2, 1):

        def query(spark, sf_dir, n=n):
            return R.idct(R.dct8(block8(spark, sf_dir)), n)

        if n == 1:
            sql = f"WITH {DCT} SELECT block, 0 AS y, 0 AS x, {sample.format(v='c / 8')} FROM dct WHERE u = 0 AND v = 0"
        else:
            sql = f"WITH {DCT}, {basis_sql('bn', n)}, r AS (SELECT block, v, p AS x, sum(c * w) AS c FROM dct JOIN bn ON u = f WHERE u < {n} AND v < {n} GROUP BY ALL) SELECT block, p AS y, x, {sample.format(v='sum(c * w)')} FROM r JOIN bn ON v = f GROUP BY block, p, x"
        register(f"idct{n}", sql)(query)


_idcts()


@register("dc_delta", "WITH b AS (SELECT label AS scan, vec_id AS block, list_sum(list_transform(embedding, lambda e: floor(e::DOUBLE * 100)))::BIGINT AS dc FROM embeddings) SELECT scan, block, dc, dc - coalesce(lag(dc) OVER (PARTITION BY scan ORDER BY block), 0) AS diff FROM b")
def dc_delta(spark, sf_dir):
    level = F.aggregate("embedding", F.lit(0).cast("long"), lambda a, e: a + F.floor(e.cast("double") * F.lit(100.0)))
    return R.dc_differences(table(spark, sf_dir, "embeddings").select(F.col("label").alias("scan"), F.col("vec_id").alias("block"), level.alias("dc")))


@register("predictor2_decode", f"WITH {RASTER} SELECT image, y, x, (sum(v) OVER (PARTITION BY image, y ORDER BY x ROWS UNBOUNDED PRECEDING) % 256)::BIGINT AS v FROM raster")
def predictor2_decode(spark, sf_dir):
    return R.undo_predictor(raster(spark, sf_dir))


@register("predictor2_encode", f"WITH {RASTER} SELECT image, y, x, ((v - coalesce(lag(v) OVER (PARTITION BY image, y ORDER BY x), 0) + 256) % 256)::BIGINT AS v FROM raster")
def predictor2_encode(spark, sf_dir):
    return R.apply_predictor(raster(spark, sf_dir))


@register("quant_scale", f"WITH q AS (SELECT DISTINCT p_size * 2 AS quality FROM part), s AS (SELECT quality, CASE WHEN quality < 50 THEN 5000 // quality ELSE 200 - 2 * quality END AS scale FROM q), b AS (SELECT unnest({R.LUMINANCE}) AS base, unnest({R.CHROMINANCE}) AS colour, unnest(range(64)) AS pos) SELECT quality, pos, greatest(1, least(255, (base * scale + 50) // 100))::BIGINT AS luminance, greatest(1, least(255, (colour * scale + 50) // 100))::BIGINT AS chrominance FROM s, b")
def quant_scale(spark, sf_dir):
    q = table(spark, sf_dir, "part").select((F.col("p_size") * 2).alias("quality")).distinct()
    both = F.arrays_zip(R.quantiser(R.LUMINANCE, F.col("quality")).alias("a"), R.quantiser(R.CHROMINANCE, F.col("quality")).alias("b"))
    return q.select("quality", F.posexplode(both).alias("pos", "t")).select("quality", F.col("pos").cast("long").alias("pos"), F.col("t").getField("a").alias("luminance"), F.col("t").getField("b").alias("chrominance"))


@register("jpeg_scale_choice", "SELECT scale, count(*) AS n, sum(l_quantity)::BIGINT AS total FROM (SELECT l_quantity, CASE WHEN l_quantity / 50 <= 0.15 THEN 8 WHEN l_quantity / 50 <= 0.35 THEN 4 WHEN l_quantity / 50 <= 0.7 THEN 2 ELSE 1 END AS scale FROM lineitem) GROUP BY scale")
def jpeg_scale_choice(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_quantity", R.decode_scale(F.col("l_quantity") / 50.0).alias("scale"))
    return t.groupBy("scale").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("total"))


# Layers

SEEN = f"{LAYERS}, seen AS (SELECT * FROM layers WHERE visible)"


@register("layer_visible_filter", f"WITH {SEEN} SELECT image, z, x0, y0, w, h, round(opacity, 6) AS opacity, mode, clipping, v FROM seen")
def layer_visible_filter(spark, sf_dir):
    return layers(spark, sf_dir).where("visible").select("image", "z", "x0", "y0", "w", "h", F.round("opacity", 6).alias("opacity"), "mode", "clipping", "v")


BASED = f"{SEEN}, based AS (SELECT *, CASE WHEN clipping THEN last_value(CASE WHEN NOT clipping THEN z END IGNORE NULLS) OVER (PARTITION BY image ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS base_z FROM seen)"


@register("clip_base_asof", f"WITH {BASED} SELECT image, z, clipping, base_z FROM based")
def clip_base_asof(spark, sf_dir):
    return L.clip_bases(layers(spark, sf_dir)).select("image", "z", "clipping", "base_z")


#: The middles of a proof of 4 x 4 pixels.
POINTS = [(x, y) for y in range(12, 100, 25) for x in range(12, 100, 25)]
BLENDS = "CASE mode " + " ".join(f"WHEN '{m}' THEN ({x.format(b='b', s='s')})::DOUBLE" for m, x in MODE_SQL.items()) + " ELSE s END"
COMPOSITE = f"""WITH RECURSIVE {BASED}, pts AS (SELECT * FROM (VALUES {', '.join(map(str, POINTS))}) AS t(x, y)),
hit AS (SELECT b.image, p.x, p.y, b.z, b.v / 255.0::DOUBLE AS s, b.mode, greatest(0, least(1, b.opacity)) * (CASE WHEN b.base_z IS NULL THEN 1 WHEN c.x0 <= p.x AND p.x < c.x0 + c.w AND c.y0 <= p.y AND p.y < c.y0 + c.h THEN greatest(0, least(1, c.opacity)) ELSE 0 END) AS a
  FROM based b JOIN pts p ON b.x0 <= p.x AND p.x < b.x0 + b.w AND b.y0 <= p.y AND p.y < b.y0 + b.h LEFT JOIN based c ON c.image = b.image AND c.z = b.base_z),
ord AS (SELECT *, row_number() OVER (PARTITION BY image, x, y ORDER BY z) AS n FROM hit),
fold AS (SELECT image, x, y, 0::BIGINT AS n, 1.0::DOUBLE AS b FROM ord WHERE n = 1
  UNION ALL SELECT image, x, y, n, CASE WHEN a <= 0 THEN b ELSE greatest(0, least(1, (1 - a) * b + a * m)) END FROM (SELECT o.image, o.x, o.y, o.n, o.a, f.b, greatest(0, least(1, m)) AS m FROM fold f JOIN ord o ON o.image = f.image AND o.x = f.x AND o.y = f.y AND o.n = f.n + 1, LATERAL (SELECT {BLENDS.replace('mode', 'o.mode', 1)} AS m FROM (SELECT f.b AS b, o.s AS s))))
SELECT image, x, y, floor(round(max_by(b, n), 9) * 255 + 0.5)::BIGINT AS v FROM fold GROUP BY image, x, y"""


@register("composite_pixels", COMPOSITE)
def composite_pixels(spark, sf_dir):
    return L.composite(layers(spark, sf_dir), POINTS)


SAMPLED = f"""WITH RECURSIVE {LAYERS}, seen AS (SELECT * FROM layers WHERE visible AND z % 5 <> 4), based AS {BASED.partition(', based AS ')[2]}, pts AS (SELECT * FROM (VALUES {', '.join(map(str, POINTS))}) AS t(x, y)),
own AS (SELECT b.image, b.z, b.base_z, b.mode, b.v, p.x, p.y, greatest(0, least(1, b.opacity)) * (((p.x * 7 + b.z * 11) % 256) / 255.0::DOUBLE) * (CASE WHEN b.z % 3 = 0 THEN 1 ELSE ((p.y * 5 + b.z) % 256) / 255.0::DOUBLE END) AS a FROM based b JOIN pts p ON b.x0 <= p.x AND p.x < b.x0 + b.w AND b.y0 <= p.y AND p.y < b.y0 + b.h),
hit AS (SELECT o.image, o.x, o.y, o.z, k, CASE k WHEN 0 THEN o.v WHEN 1 THEN o.v * 3 % 256 WHEN 2 THEN 255 - o.v ELSE o.v // 2 END / 255.0::DOUBLE AS s, o.mode, o.a * (CASE WHEN o.base_z IS NULL THEN 1 ELSE coalesce(c.a, 0) END) AS a
  FROM own o LEFT JOIN own c ON c.image = o.image AND c.x = o.x AND c.y = o.y AND c.z = o.base_z, (SELECT unnest(range(4)) AS k)),
ord AS (SELECT *, row_number() OVER (PARTITION BY image, x, y, k ORDER BY z) AS n FROM hit),
fold AS (SELECT image, x, y, k, 0::BIGINT AS n, CASE k WHEN 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS b FROM ord WHERE n = 1
  UNION ALL SELECT image, x, y, k, n, CASE WHEN a <= 0 THEN b ELSE greatest(0, least(1, (1 - a) * b + a * m)) END FROM (SELECT o.image, o.x, o.y, o.k, o.n, o.a, f.b, greatest(0, least(1, m)) AS m FROM fold f JOIN ord o ON o.image = f.image AND o.x = f.x AND o.y = f.y AND o.k = f.k AND o.n = f.n + 1, LATERAL (SELECT {BLENDS.replace('mode', 'o.mode', 1)} AS m FROM (SELECT f.b AS b, o.s AS s))))
SELECT image, x, y, max(v) FILTER (k = 0) AS r, max(v) FILTER (k = 1) AS g, max(v) FILTER (k = 2) AS b, max(v) FILTER (k = 3) AS k FROM (SELECT image, x, y, k, floor(round(max_by(b, n), 9) * 255 + 0.5)::BIGINT AS v FROM fold GROUP BY image, x, y, k) GROUP BY image, x, y"""


def layer_samples(spark, sf_dir):
    """Layers, a fifth of which are folders, and their pixels at the proof's points: four channels, alpha, and masks of two in three."""
    t = layers(spark, sf_dir).withColumn("folder", F.col("z") % 5 == 4)
    at = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in POINTS])).alias("p")
    rows = t.select("*", at).select("*", "p.x", "p.y").where(L.covers("", F.col("x"), F.col("y")))
    v = F.col("v")
    channels = F.array(v, v * 3 % 256, F.lit(255) - v, F.floor(v / 2))
    return t, rows.select("image", "z", "x", "y", channels.alias("s"), ((F.col("x") * 7 + F.col("z") * 11) % 256).alias("alpha"), F.when(F.col("z") % 3 != 0, (F.col("y") * 5 + F.col("z")) % 256).alias("mask"))


@register("composite_samples", SAMPLED)
def composite_samples(spark, sf_dir):
    t, samples = layer_samples(spark, sf_dir)
    return L.composite_samples(t, samples, [1.0, 1.0, 1.0, 0.0]).select("image", "x", "y", *[F.col("v")[i].alias(c) for i, c in enumerate("rgbk")])


REGIONS = f"""{SEEN}, boxes AS (SELECT image, z, greatest(0, x0) AS l, least(100, x0 + w) AS r, greatest(0, y0) AS t, least(100, y0 + h) AS b, opacity < 1 OR mode <> 'normal' AS clear FROM seen),
images AS (SELECT DISTINCT image FROM layers),
xs AS (SELECT image, l AS x FROM boxes UNION SELECT image, r FROM boxes UNION SELECT image, 0 FROM images UNION SELECT image, 100 FROM images),
ys AS (SELECT image, t AS y FROM boxes UNION SELECT image, b FROM boxes UNION SELECT image, 0 FROM images UNION SELECT image, 100 FROM images),
xc AS (SELECT * FROM (SELECT image, x, lead(x) OVER (PARTITION BY image ORDER BY x) AS x2 FROM xs) WHERE x2 IS NOT NULL),
yc AS (SELECT * FROM (SELECT image, y, lead(y) OVER (PARTITION BY image ORDER BY y) AS y2 FROM ys) WHERE y2 IS NOT NULL),
cells AS (SELECT c.image, c.x AS x0, d.y AS y0, c.x2 - c.x AS w, d.y2 - d.y AS h, coalesce(string_agg(b.z::VARCHAR, ',' ORDER BY b.z), '') AS layers, coalesce(bool_or(b.clear), false) AS transparent
  FROM xc c JOIN yc d ON c.image = d.image LEFT JOIN boxes b ON b.image = c.image AND b.l <= (c.x + c.x2) / 2 AND (c.x + c.x2) / 2 < b.r AND b.t <= (d.y + d.y2) / 2 AND (d.y + d.y2) / 2 < b.b GROUP BY c.image, c.x, d.y, c.x2, d.y2)"""
OUT = "image, x0, y0, w, h, layers, transparent"


def joined(t):
    return t.select("image", "x0", "y0", "w", "h", F.array_join(F.transform("layers", lambda z: z.cast("string")), ",").alias("layers"), "transparent")


@register("atomic_regions", f"WITH {REGIONS} SELECT {OUT} FROM cells")
def atomic_regions(spark, sf_dir):
    return joined(L.regions(layers(spark, sf_dir), 100, 100))


MERGED = f"""{REGIONS}, flagged AS (SELECT *, CASE WHEN lag(layers) OVER r = layers AND lag(transparent) OVER r = transparent AND lag(x0 + w) OVER r = x0 THEN 0 ELSE 1 END AS new FROM cells WINDOW r AS (PARTITION BY image, y0, h ORDER BY x0)),
islands AS (SELECT *, sum(new) OVER (PARTITION BY image, y0, h ORDER BY x0) AS island FROM flagged),
merged AS (SELECT image, min(x0) AS x0, y0, sum(w)::BIGINT AS w, h, any_value(layers) AS layers, any_value(transparent) AS transparent FROM islands GROUP BY image, y0, h, island)"""


@register("atomic_region_merge", f"WITH {MERGED} SELECT {OUT} FROM merged")
def atomic_region_merge(spark, sf_dir):
    return joined(L.merge_regions(L.regions(layers(spark, sf_dir), 100, 100)))


FLATTENED = f"{COMPOSITE.rpartition('SELECT image, x, y, floor')[0].rstrip()}, {MERGED[len(SEEN) + 2:]}, seen_at AS (SELECT image, x, y, floor{COMPOSITE.rpartition('SELECT image, x, y, floor')[2]}) SELECT s.image, m.x0, m.y0, m.w, m.h, s.x, s.y, s.v FROM seen_at s JOIN merged m ON m.image = s.image AND m.transparent AND m.x0 <= s.x AND s.x < m.x0 + m.w AND m.y0 <= s.y AND s.y < m.y0 + m.h"


@register("region_flattening", FLATTENED)
def region_flattening(spark, sf_dir):
    t = layers(spark, sf_dir)
    return L.flattened(L.merge_regions(L.regions(t, 100, 100)), L.composite(t, POINTS)).select("image", "x0", "y0", "w", "h", "x", "y", "v")


@register("region_area", f"WITH {MERGED} SELECT image, count(*) AS regions, sum(w * h)::BIGINT AS area, coalesce(sum(w * h) FILTER (transparent), 0)::BIGINT AS transparent FROM merged GROUP BY image")
def region_area(spark, sf_dir):
    t = L.merge_regions(L.regions(layers(spark, sf_dir), 100, 100))
    area = F.col("w") * F.col("h")
    return t.groupBy("image").agg(F.count("*").alias("regions"), F.sum(area).alias("area"), F.coalesce(F.sum(F.when(F.col("transparent"), area)), F.lit(0)).cast("long").alias("transparent"))


