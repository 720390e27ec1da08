"""Queries of inks: limits, plates, overprint and spots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import color, ink
from ..functions.numeric import to_byte
from ..operators.plates import limit_inks, split_plates, usage
from .views import CMYK, KEY, cmyk, named

QUERIES: dict = {}
SQL: dict = {}

INKS = ("c", "m", "y", "k")


def inks(*names: str):
    return tuple(F.col(n) for n in (names or INKS))


def rounded(values, names=INKS, places=6):
    return [F.round(v, places).alias(n) for v, n in zip(values, names)]


def limit_sql(percent: float) -> str:
    """The ink limit in steps, for a table cmyk."""
    return f"""{CMYK},
a AS (SELECT *, {percent / 100}::DOUBLE AS t, least(least(c, m, y) * 0.8::DOUBLE, 1 - k) AS d, c + m + y + k AS s FROM cmyk),
b AS (SELECT l_orderkey, l_linenumber, t, s, CASE WHEN s > t AND d > 0 THEN c - d ELSE c END AS c, CASE WHEN s > t AND d > 0 THEN m - d ELSE m END AS m,
  CASE WHEN s > t AND d > 0 THEN y - d ELSE y END AS y, CASE WHEN s > t AND d > 0 THEN k + d ELSE k END AS k FROM a),
u AS (SELECT *, s > t AND c + m + y + k > t AS fix, c + m + y + k - t AS e, c + m + y AS q FROM b),
v AS (SELECT l_orderkey, l_linenumber, t, s, CASE WHEN fix AND q > 0 THEN greatest(0, c - c * (e / q)) ELSE c END AS c, CASE WHEN fix AND q > 0 THEN greatest(0, m - m * (e / q)) ELSE m END AS m,
  CASE WHEN fix AND q > 0 THEN greatest(0, y - y * (e / q)) ELSE y END AS y, CASE WHEN fix AND q <= 0 THEN least(k, t) ELSE k END AS k FROM u),
limited AS (SELECT l_orderkey, l_linenumber, c * f AS c, m * f AS m, y * f AS y, k * f AS k
  FROM (SELECT *, CASE WHEN s > t AND c + m + y + k > t THEN t / (c + m + y + k) ELSE 1 END AS f FROM v))"""


def _limits():
    for name, percent in ink.LIMITS.items():

        def query(spark, sf_dir, percent=percent):
            return limit_inks(cmyk(spark, sf_dir), percent).select(*KEY, *rounded(inks()))

        named(QUERIES, SQL, f"tac_limit_{name}", f"WITH {limit_sql(percent)} SELECT l_orderkey, l_linenumber, round(c, 6) AS c, round(m, 6) AS m, round(y, 6) AS y, round(k, 6) AS k FROM limited")(query)


_limits()

BYTES = "floor(c * 255 + 0.5)::BIGINT AS c, floor(m * 255 + 0.5)::BIGINT AS m, floor(y * 255 + 0.5)::BIGINT AS y, floor(k * 255 + 0.5)::BIGINT AS k"
LONG = "SELECT l_orderkey, l_linenumber, 'Cyan' AS plate, c AS v FROM bytes UNION ALL SELECT l_orderkey, l_linenumber, 'Magenta', m FROM bytes UNION ALL SELECT l_orderkey, l_linenumber, 'Yellow', y FROM bytes UNION ALL SELECT l_orderkey, l_linenumber, 'Black', k FROM bytes"


def limited_bytes(spark, sf_dir):
    return limit_inks(cmyk(spark, sf_dir)).select(*KEY, *[to_byte(v).alias(n) for v, n in zip(inks(), INKS)])


@named(QUERIES, SQL, "plate_ink_usage", f"WITH {limit_sql(300.0)}, bytes AS (SELECT l_orderkey, l_linenumber, {BYTES} FROM limited), plates AS ({LONG}) SELECT plate, count(*) AS pixels, sum(v)::BIGINT AS ink, max(v) AS darkest, round(avg(v), 6) AS mean, count(*) FILTER (v = 0) AS blank FROM plates GROUP BY plate")
def plate_ink_usage(spark, sf_dir):
    return usage(split_plates(limited_bytes(spark, sf_dir), KEY))


@named(QUERIES, SQL, "plate_split", f"WITH {limit_sql(300.0)}, bytes AS (SELECT l_orderkey, l_linenumber, {BYTES} FROM limited) {LONG}")
def plate_split(spark, sf_dir):
    return split_plates(limited_bytes(spark, sf_dir), KEY)


@named(QUERIES, SQL, "tac_value", f"WITH {CMYK} SELECT l_orderkey, l_linenumber, round(100 * (c + m + y + k), 6) AS tac FROM cmyk")
def tac_value(spark, sf_dir):
    return cmyk(spark, sf_dir).select(*KEY, F.round(ink.coverage(inks()), 6).alias("tac"))


@named(QUERIES, SQL, "tac_violations", f"WITH {CMYK} SELECT l_orderkey, l_linenumber, round(100 * (c + m + y + k), 6) AS tac FROM cmyk WHERE c + m + y + k > 3.0")
def tac_violations(spark, sf_dir):
    return cmyk(spark, sf_dir).where(ink.total(inks()) > F.lit(3.0)).select(*KEY, F.round(ink.coverage(inks()), 6).alias("tac"))


ABOVE = "CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE y END AS fc, CASE WHEN l_partkey % 3 = 0 THEN 0 ELSE k END AS fm, c AS fy, CASE WHEN l_partkey % 5 = 0 THEN 0 ELSE m END AS fk"


def _overprints():
    kinds = {"opm0": (dict(mode=0), "f{0}"), "opm1": (dict(mode=1), "CASE WHEN f{0} = 0 THEN {0} ELSE f{0} END"), "mix": (dict(mode=1, mixing=True), "CASE WHEN f{0} = 0 THEN {0} ELSE {0} + f{0} - {0} * f{0} END"), "off": (dict(active=False), "f{0}")}
    for name, (options, expression) in kinds.items():

        def query(spark, sf_dir, options=options):
            t = cmyk(spark, sf_dir)
            lacks = lambda n, v: F.when(F.col("l_partkey") % n == 0, F.lit(0.0)).otherwise(F.col(v))
            above = (lacks(2, "y"), lacks(3, "k"), F.col("c"), lacks(5, "m"))
            return t.select(*KEY, *rounded(ink.overprint(inks(), above, **options)))

        out = ", ".join(f"round({expression.format(v)}, 6) AS {v}" for v in INKS)
        named(QUERIES, SQL, f"overprint_{name}", f"WITH {CMYK}, pair AS (SELECT *, {ABOVE} FROM cmyk) SELECT l_orderkey, l_linenumber, {out} FROM pair")(query)


_overprints()

SPOT_SQL = "spots AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE)" for i, (n, v) in enumerate(ink.SPOTS.items())) + ") AS t(i, spot, sc, sm, sy, sk))"


def with_spots(spark, sf_dir):
    """Ink pixels joined with a spot ink each: a table of five rows, which is broadcast."""
    rows = [(i, n, *v) for i, (n, v) in enumerate(ink.SPOTS.items())]
    spots = spark.createDataFrame(rows, "i long, spot string, sc double, sm double, sy double, sk double")
    t = cmyk(spark, sf_dir)
    return t.withColumn("i", F.col("l_partkey") % len(rows)).join(F.broadcast(spots), "i")


@named(QUERIES, SQL, "spot_tint", f"WITH {CMYK}, {SPOT_SQL} SELECT l_orderkey, l_linenumber, spot, round(y * sc, 9) AS c, round(y * sm, 9) AS m, round(y * sy, 9) AS y, round(y * sk, 9) AS k FROM cmyk JOIN spots ON l_partkey % 5 = i")
def spot_tint(spark, sf_dir):
    return with_spots(spark, sf_dir).select(*KEY, "spot", *rounded(ink.spot(F.col("y"), inks("sc", "sm", "sy", "sk")), places=9))


@named(QUERIES, SQL, "spot_overprint", f"WITH {CMYK}, {SPOT_SQL} SELECT l_orderkey, l_linenumber, spot, " + ", ".join(f"round({v} + k * s{v} - {v} * (k * s{v}), 9) AS {v}" for v in INKS) + " FROM cmyk JOIN spots ON l_partkey % 5 = i")
def spot_overprint(spark, sf_dir):
    t = with_spots(spark, sf_dir)
    return t.select(*KEY, "spot", *rounded(ink.spot_overprint(inks(), ink.spot(F.col("k"), inks("sc", "sm", "sy", "sk"))), places=9))


@named(QUERIES, SQL, "device_n_mix", f"WITH {CMYK} SELECT l_orderkey, l_linenumber, round(least(1, c + 0.5 * m), 6) AS c, round(m * y, 6) AS m, round(y, 6) AS y, round(least(c, m, y), 6) AS k FROM cmyk")
def device_n_mix(spark, sf_dir):
    mix = lambda t: (F.least(F.lit(1.0), t[0] + F.lit(0.5) * t[1]), t[1] * t[2], t[2], F.least(*t))
    return cmyk(spark, sf_dir).select(*KEY, *rounded(ink.device_n(list(inks("c", "m", "y")), mix)))


@named(QUERIES, SQL, "cmyk_to_rgb_proof", f"WITH {CMYK} SELECT l_orderkey, l_linenumber, floor(255 * (1 - c) * (1 - k) + 0.5)::BIGINT AS r, floor(255 * (1 - m) * (1 - k) + 0.5)::BIGINT AS g, floor(255 * (1 - y) * (1 - k) + 0.5)::BIGINT AS b FROM cmyk")
def cmyk_to_rgb_proof(spark, sf_dir):
    return cmyk(spark, sf_dir).select(*KEY, *[v.alias(n) for v, n in zip(color.cmyk_to_rgb(*inks()), "rgb")])


