"""Queries of blend modes and alpha compositing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blend
from .views import KEY, PX, named, px

QUERIES: dict = {}
SQL: dict = {}

#: The modes in SQL, of a backdrop b and a source s.
MODE_SQL = {
    "normal": "{s}",
    "multiply": "{b} * {s}",
    "screen": "{b} + {s} - {b} * {s}",
    "overlay": "CASE WHEN {b} <= 0.5 THEN 2 * {b} * {s} ELSE 2 * {b} - 1 + {s} - (2 * {b} - 1) * {s} END",
    "darken": "least({b}, {s})",
    "lighten": "greatest({b}, {s})",
    "color_dodge": "CASE WHEN {b} = 0 THEN 0 WHEN {s} >= 1 THEN 1 ELSE least(1, {b} / (1 - {s})) END",
    "color_burn": "CASE WHEN {b} >= 1 THEN 1 WHEN {s} <= 0 THEN 0 ELSE 1 - least(1, (1 - {b}) / {s}) END",
    "hard_light": "CASE WHEN {s} <= 0.5 THEN 2 * {s} * {b} ELSE {b} + (2 * {s} - 1) - {b} * (2 * {s} - 1) END",
    "soft_light": "CASE WHEN {s} <= 0.5 THEN {b} - (1 - 2 * {s}) * {b} * (1 - {b}) ELSE {b} + (2 * {s} - 1) * ((CASE WHEN {b} <= 0.25 THEN ((16 * {b} - 12) * {b} + 4) * {b} ELSE sqrt({b}) END) - {b}) END",
    "difference": "abs({b} - {s})",
    "exclusion": "{b} + {s} - 2 * {b} * {s}",
}
UNIT = f"{PX}, u AS (SELECT l_orderkey, l_linenumber, r / 255.0::DOUBLE AS b, g / 255.0::DOUBLE AS s, b / 255.0::DOUBLE AS a, ((r + g) % 256) / 255.0::DOUBLE AS ab FROM px)"


def unit(spark, sf_dir):
    """A backdrop b with alpha ab and a source s with alpha a."""
    return px(spark, sf_dir).select(*KEY, (F.col("r") / 255.0).alias("bb"), (F.col("g") / 255.0).alias("s"), (F.col("b") / 255.0).alias("a"), ((F.col("r") + F.col("g")) % 256 / 255.0).alias("ab")).withColumnRenamed("bb", "b")


def _modes():
    for name, expression in MODE_SQL.items():

        def query(spark, sf_dir, name=name):
            return unit(spark, sf_dir).select(*KEY, F.round(blend.blend(name, F.col("b"), F.col("s")), 6).alias("v"))

        named(QUERIES, SQL, f"blend_{name}", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, round({expression.format(b='b', s='s')}, 6)::DOUBLE AS v FROM u")(query)


_modes()

ALPHA_SQL = "CASE WHEN a <= 0 THEN b WHEN ab <= 0 THEN s ELSE least(1, greatest(0, ((1 - ab) * a * s + (1 - a) * ab * b + a * ab * ({m})) / (a + ab * (1 - a)))) END"


@named(QUERIES, SQL, "blend_alpha", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, round({ALPHA_SQL.format(m='b * s')}, 6) AS multiplied, round({ALPHA_SQL.format(m=MODE_SQL['soft_light'].format(b='b', s='s'))}, 6) AS soft, round(a + ab * (1 - a), 6) AS alpha FROM u")
def blend_alpha(spark, sf_dir):
    b, ab, s, a = (F.col(x) for x in ("b", "ab", "s", "a"))
    return unit(spark, sf_dir).select(*KEY, F.round(blend.blend_alpha("multiply", b, ab, s, a), 6).alias("multiplied"), F.round(blend.blend_alpha("soft_light", b, ab, s, a), 6).alias("soft"), F.round(blend.union_alpha(ab, a), 6).alias("alpha"))


@named(QUERIES, SQL, "src_over", f"WITH {UNIT} SELECT l_orderkey, l_linenumber, round(CASE WHEN a >= 1 THEN s WHEN a <= 0 THEN b ELSE (s * a + b * ab * (1 - a)) / (a + ab * (1 - a)) END, 6) AS v, round(a + ab * (1 - a), 6) AS alpha FROM u")
def src_over(spark, sf_dir):
    b, ab, s, a = (F.col(x) for x in ("b", "ab", "s", "a"))
    return unit(spark, sf_dir).select(*KEY, F.round(blend.source_over(b, ab, s, a), 6).alias("v"), F.round(blend.union_alpha(ab, a), 6).alias("alpha"))


#: Shares of source and backdrop under each operator, in SQL.
DUFF_SQL = {"clear": ("0", "0"), "source": ("1", "0"), "destination": ("0", "1"), "source_over": ("1", "1 - a"), "destination_over": ("1 - ab", "1"), "source_in": ("ab", "0"), "destination_in": ("0", "a"), "source_out": ("1 - ab", "0"), "destination_out": ("0", "1 - a"), "xor": ("1 - ab", "1 - a")}


@named(
    QUERIES,
    SQL,
    "porter_duff",
    f"WITH {UNIT}, shares AS ("
    + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{n}' AS operator, a * ({x}) AS fa, ab * ({y}) AS fb, s, b FROM u" for n, (x, y) in DUFF_SQL.items())
    + ") SELECT operator, count(*) AS pixels, round(sum(round(fa + fb, 6)), 2) AS alpha, round(sum(round(CASE WHEN fa + fb > 0 THEN (s * fa + b * fb) / (fa + fb) ELSE 0 END, 6)), 2) AS value FROM shares GROUP BY operator",
)
def porter_duff(spark, sf_dir):
    b, ab, s, a = (F.col(x) for x in ("b", "ab", "s", "a"))
    each = [F.struct(F.lit(n).alias("operator"), *[x.alias(y) for x, y in zip(blend.porter_duff(n, b, ab, s, a), ("value", "alpha"))]) for n in blend.PORTER_DUFF]
    t = unit(spark, sf_dir).select(F.inline(F.array(*each)))
    return t.groupBy("operator").agg(F.count("*").alias("pixels"), F.round(F.sum(F.round("alpha", 6)), 2).alias("alpha"), F.round(F.sum(F.round("value", 6)), 2).alias("value"))
