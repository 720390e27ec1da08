"""Pixels, inks, layers, pages and markup as projections of the relational tables, with the same in SQL.

The tables hold no images, so each query of this package runs on one of these views; every projection reads only the
columns that it names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["l_orderkey", "l_linenumber"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RGB pixels: r, g, b from 0 to 255."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(*KEY, (F.col("l_partkey") % 256).alias("r"), ((F.col("l_suppkey") * 37 + F.col("l_linenumber")) % 256).alias("g"), (F.floor("l_extendedprice").cast("long") % 256).alias("b"))


PX = "px AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS r, (l_suppkey * 37 + l_linenumber) % 256 AS g, CAST(floor(l_extendedprice) AS BIGINT) % 256 AS b FROM lineitem)"


def cmyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ink pixels: c, m, y, k from 0 to 1."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(*KEY, "l_partkey", (F.abs("l_discount") * F.lit(10.0)).alias("c"), (F.abs("l_tax") / F.lit(0.08)).alias("m"), (F.col("l_quantity") / F.lit(50.0)).alias("y"), ((F.col("l_partkey") % 101) / F.lit(100.0)).alias("k"))


CMYK = "cmyk AS (SELECT l_orderkey, l_linenumber, l_partkey, abs(l_discount) * 10.0::DOUBLE AS c, abs(l_tax) / 0.08::DOUBLE AS m, l_quantity / 50.0::DOUBLE AS y, (l_partkey % 101) / 100.0::DOUBLE AS k FROM lineitem)"


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab pixels: l, a, b."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(*KEY, ((F.col("l_partkey") % 1001) / F.lit(10.0)).alias("l"), ((F.col("l_suppkey") * 7 % 256) - 128).cast("double").alias("a"), ((F.col("l_orderkey") % 256) - 128).cast("double").alias("b"))


LAB = "lab AS (SELECT l_orderkey, l_linenumber, (l_partkey % 1001) / 10.0::DOUBLE AS l, ((l_suppkey * 7 % 256) - 128)::DOUBLE AS a, ((l_orderkey % 256) - 128)::DOUBLE AS b FROM lineitem)"


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gray images (image, y, x, v): a label is an image, a vector a row of 64 pixels."""
    t = table(spark, sf_dir, "embeddings").select(F.col("label").alias("image"), (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"), "embedding")
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("e").cast("double") + F.lit(0.6)) / F.lit(1.2) * F.lit(255.0) + F.lit(0.5))))
    return t.select("image", "y", F.posexplode("embedding").alias("x", "e")).select("image", "y", "x", v.cast("long").alias("v"))


RASTER = """rows0 AS (SELECT label AS image, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
raster AS (SELECT image, y, x, least(255, greatest(0, floor((embedding[x + 1]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 255.0::DOUBLE + 0.5::DOUBLE)))::BIGINT AS v
  FROM rows0, (SELECT unnest(range(64)) AS x))"""


def block8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 blocks (block, y, x, v): a vector is a block."""
    t = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("block"), F.posexplode("embedding").alias("i", "e"))
    v = F.least(F.lit(255.0), F.greatest(F.lit(0.0), F.floor((F.col("e").cast("double") + F.lit(0.6)) / F.lit(1.2) * F.lit(255.0) + F.lit(0.5))))
    return t.select("block", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), v.cast("long").alias("v"))


BLOCK8 = """block8 AS (SELECT vec_id AS block, (i // 8)::INT AS y, (i % 8)::INT AS x,
  least(255, greatest(0, floor((embedding[i + 1]::DOUBLE + 0.6::DOUBLE) / 1.2::DOUBLE * 255.0::DOUBLE + 0.5::DOUBLE)))::BIGINT AS v
  FROM embeddings, (SELECT unnest(range(64)) AS i))"""

MODES = ["normal", "multiply", "screen", "overlay", "darken", "lighten", "color_dodge", "color_burn", "hard_light", "soft_light", "difference", "exclusion"]
MODE_SQL = "list_value(" + ", ".join(f"'{m}'" for m in MODES) + ")"


def layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of 100 x 100 canvases (image, z, box, opacity, mode, visible, clipping, source gray and alpha)."""
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("z")).agg(
        F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_quantity").alias("quantity"), F.min(F.abs("l_discount")).alias("discount"), F.min("l_returnflag").alias("flag"), F.min("l_linestatus").alias("status")
    )
    modes = F.array(*[F.lit(m) for m in MODES])
    return t.select(
        "image", "z", (F.col("part") % 80).alias("x0"), (F.col("supp") * 13 % 80).alias("y0"), (F.lit(1) + F.col("quantity").cast("long") % 40).alias("w"), (F.lit(1) + F.col("part") % 40).alias("h"),
        (F.lit(1.0) - F.lit(5.0) * F.col("discount")).alias("opacity"), F.element_at(modes, (F.col("part") % 12 + 1).cast("int")).alias("mode"), (F.col("flag") != "R").alias("visible"), (F.col("status") == "F").alias("clipping"),
        ((F.col("part") * 7 + F.col("z")) % 256).alias("v"),
    )


LAYERS = f"""layers0 AS (SELECT l_orderkey AS image, l_linenumber AS z, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_quantity) AS quantity,
  min(abs(l_discount)) AS discount, min(l_returnflag) AS flag, min(l_linestatus) AS status FROM lineitem GROUP BY 1, 2),
layers AS (SELECT image, z, part % 80 AS x0, supp * 13 % 80 AS y0, 1 + quantity::BIGINT % 40 AS w, 1 + part % 40 AS h, 1.0::DOUBLE - 5.0::DOUBLE * discount AS opacity,
  ({MODE_SQL})[part % 12 + 1] AS mode, flag <> 'R' AS visible, status = 'F' AS clipping, (part * 7 + z) % 256 AS v FROM layers0)"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (doc, page_number, text): a conversation is a document, a turn a page."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page_number"), "text")


PAGES = "docpages AS (SELECT conv_id AS doc, turn + 1 AS page_number, text FROM conversations)"


def named(queries: dict, sql: dict, name: str, statement: str | None = None):
    """Registers a query, and its SQL, under a name."""

    def keep(fn):
        queries[name] = fn
        if statement:
            sql[name] = statement
        return fn

    return keep
