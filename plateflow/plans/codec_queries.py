"""Queries of readers and writers: files are made of table rows, written and read; the SQL says what the rows said."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from ..operators import packed
from ..sinks import pdfx
from ..sinks.tiff import write_plates, write_tiff
from ..sources import icc, jpeg
from ..sources import images as I
from ..sources.model import Image
from . import color_queries
from . import fixtures as X
from .views import RASTER, named, raster, table

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    return named(QUERIES, SQL, name, sql)


def gray(v: np.ndarray, dpi: int = 300) -> Image:
    return Image(v.shape[1], v.shape[0], 1, v.astype(np.uint8).tobytes(), 8, "GRAY", dpi, dpi)


def number(c: str = "path"):
    return F.col(c).cast("long")


# Rasters: gray images of 64 pixels in a row, written and read back

SAMPLES = f"WITH {RASTER} SELECT image::BIGINT AS image, y::INT AS y, x::INT AS x, v::INT AS v FROM raster"
THREE = f"WITH {RASTER} SELECT image::BIGINT AS image, y::INT AS y, x::INT AS x, {{}} AS r, {{}} AS g, {{}} AS b FROM raster"


def _rasters():
    one = {
        "png_filters": X.png_filtered, "png_interlaced": X.png_interlaced, "tiff_plain": X.tiff, "tiff_big_endian": lambda v: X.tiff(v, order=">"), "tiff_lzw_predictor": lambda v: X.tiff(v, 5, 2), "tiff_deflate_predictor": lambda v: X.tiff(v, 8, 2),
        "tiff_packbits": lambda v: X.tiff(v, 32773), "tga_runs": X.tga, "tiff_write_read": lambda v: write_tiff(gray(v)), "tiff_write_plain": lambda v: write_tiff(gray(v), False), "png_write_read": lambda v: I.raster_files.write_png(gray(v)),
    }
    for name, build in one.items():

        def query(spark, sf_dir, build=build):
            got = I.pixels(I.images(X.raster_files(raster(spark, sf_dir), build)))
            return got.select(number().alias("image"), "y", "x", F.col("v")[0].alias("v"))

        register(name, SAMPLES)(query)
    three = {"png_palette": (X.png_palette, ("v::INT", "(255 - v)::INT", "(v // 2)::INT")), "bmp_lines": (X.bmp, ("v::INT", "(255 - v)::INT", "(v // 2)::INT"))}
    for name, (build, values) in three.items():

        def query(spark, sf_dir, build=build):
            got = I.pixels(I.images(X.raster_files(raster(spark, sf_dir), build)))
            return got.select(number().alias("image"), "y", "x", *[F.col("v")[i].alias(c) for i, c in enumerate("rgb")])

        register(name, THREE.format(*values))(query)


_rasters()


@register("png_bits", f"WITH {RASTER} SELECT image::BIGINT AS image, y::INT AS y, x::INT AS x, CASE WHEN v >= 128 THEN 255 ELSE 0 END AS v FROM raster")
def png_bits(spark, sf_dir):
    got = I.pixels(I.images(X.raster_files(raster(spark, sf_dir), X.png_bits)))
    return got.select(number().alias("image"), "y", "x", F.col("v")[0].alias("v"))


#: A part's number makes the gray of each of 6 x 4 blocks of 8 x 8 pixels; at quality 100 such blocks come back as they are.
BLOCKS = "SELECT p_partkey, b, (p_partkey * 7 + b * 31) % 256 AS v FROM part, (SELECT unnest(range(24)) AS b)"


def _blocks(r: dict) -> np.ndarray:
    return np.kron((r["p_partkey"] * 7 + np.arange(24) * 31).reshape(4, 6) % 256, np.ones((8, 8), np.int64))


def _jpegs(spark, sf_dir):
    return X.files_of(X.dealt(table(spark, sf_dir, "part").select("p_partkey")), "p_partkey", lambda r: jpeg.encode(gray(_blocks(r)), 100))


@register("jpeg_blocks", f"SELECT p_partkey, b, v::INT AS darkest, v::INT AS lightest, 64::BIGINT AS samples FROM ({BLOCKS})")
def jpeg_blocks(spark, sf_dir):
    t = I.blocks(I.images(_jpegs(spark, sf_dir)), 8)
    return t.select(number().alias("p_partkey"), (F.col("y") * 6 + F.col("x")).cast("long").alias("b"), "darkest", "lightest", "samples")


@register("jpeg_eighth", f"SELECT p_partkey, b, v::INT AS v FROM ({BLOCKS})")
def jpeg_eighth(spark, sf_dir):
    t = I.pixels(I.images(_jpegs(spark, sf_dir), scale=8))
    return t.select(number().alias("p_partkey"), (F.col("y") * 6 + F.col("x")).cast("long").alias("b"), F.col("v")[0].alias("v"))


@register("webp_sizes", "SELECT p_partkey, 'webp' AS kind, (1 + p_partkey * 37 % 16000)::INT AS width, (1 + p_size * 300)::INT AS height, p_partkey % 2 = 0 AS alpha FROM part")
def webp_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    made = X.files_of(rows, "p_partkey", lambda r: X.webp_head(1 + r["p_partkey"] * 37 % 16000, 1 + r["p_size"] * 300, r["p_partkey"] % 2 == 0))
    return I.sizes(made).select(number().alias("p_partkey"), "kind", "width", "height", "alpha")


@register("camera_raw_gray", "WITH v AS (SELECT p_partkey, (p_size * 1300)::DOUBLE / 65535 AS u FROM part) SELECT p_partkey, 4 AS width, 4 AS height, floor(round((CASE WHEN u <= 0.0031308 THEN u * 12.92 ELSE 1.055 * pow(u, 1 / 2.4::DOUBLE) - 0.055 END) * 255, 9) + 0.5)::INT AS darkest, darkest AS lightest FROM v")
def camera_raw_gray(spark, sf_dir):
    rows = X.dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size"))
    got = I.images(X.files_of(rows, "p_partkey", lambda r: X.dng(np.full((4, 4), r["p_size"] * 1300))))
    return I.blocks(got).select(number().alias("p_partkey"), "width", "height", "darkest", "lightest")


# Layers

PSD_KEYS = [b"norm", b"mul ", b"scrn", b"over", b"dark", b"lite"]
PSD_MODES = ["normal", "multiply", "screen", "overlay", "darken", "lighten"]


def _psds(spark, sf_dir):
    def build(r):
        k, s = r["p_partkey"], r["p_size"]
        below = ("below", (0, 0, 6, 8), b"norm", 255, 0, 0, (k % 256, s, 255 - s, 255))
        above = (f"part {k}", (1, 2, 3 + s % 3, 5), PSD_KEYS[k % 6], k % 256, k % 2, 2 * (s % 2), (s, k % 256, 9, 255))
        return X.psd([below, above], 8, 6, 100 + s, s % 3)

    return X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", build)


@register("psd_layers", f"""SELECT p_partkey, z, CASE z WHEN 0 THEN 'below' ELSE 'part ' || p_partkey END AS name, CASE z WHEN 0 THEN 0 ELSE 2 END AS "left", CASE z WHEN 0 THEN 0 ELSE 1 END AS top, CASE z WHEN 0 THEN 8 ELSE 5 END AS "right",
CASE z WHEN 0 THEN 6 ELSE 3 + p_size % 3 END::INT AS bottom, round(CASE z WHEN 0 THEN 1 ELSE (p_partkey % 256) / 255::DOUBLE END, 9) AS opacity, CASE z WHEN 0 THEN 'normal' ELSE {PSD_MODES}[p_partkey % 6 + 1] END AS mode,
z = 0 OR p_size % 2 = 0 AS visible, z = 1 AND p_partkey % 2 = 1 AS clipping, 8 AS canvas_width, 6 AS canvas_height FROM part, (SELECT unnest([0, 1]) AS z)""")
def psd_layers(spark, sf_dir):
    return I.layers(_psds(spark, sf_dir)).select(number().alias("p_partkey"), "z", "name", "left", "top", "right", "bottom", F.round("opacity", 9).alias("opacity"), "mode", "visible", "clipping", "canvas_width", "canvas_height")


@register("psd_layer_samples", "SELECT p_partkey, z, CASE z WHEN 0 THEN 48 ELSE 3 * (2 + p_size % 3) END::BIGINT AS pixels, CASE z WHEN 0 THEN [p_partkey % 256, p_size, 255 - p_size] ELSE [p_size, p_partkey % 256, 9] END::VARCHAR AS colour FROM part, (SELECT unnest([0, 1]) AS z)")
def psd_layer_samples(spark, sf_dir):
    """The samples of RLE, Deflate and plain channels."""
    t = I.layers(_psds(spark, sf_dir)).select(number().alias("p_partkey"), "z", (F.octet_length("data") / 4).cast("long").alias("pixels"), F.hex(F.substring("data", 1, 4)).alias("first"), F.hex("data").alias("all"))
    byte = lambda i: F.conv(F.substring("first", 2 * i + 1, 2), 16, 10).cast("int")
    same = F.col("all") == F.expr("repeat(first, cast(pixels as int))")
    return t.where(same).select("p_partkey", "z", "pixels", F.format_string("[%d, %d, %d]", byte(0), byte(1), byte(2)).alias("colour"))


@register("psd_flattened", "SELECT p_partkey, p_partkey % 256 AS r, p_size AS g, 255 - p_size AS b, 8 AS width, 6 AS height, (100 + p_size)::INT AS dpi_x FROM part")
def psd_flattened(spark, sf_dir):
    """Of the canvas' last pixel, which only the layer below covers."""
    got = I.images(_psds(spark, sf_dir))
    last = I.pixels(got).where("x = 7 and y = 5").join(got.select("path", "width", "height", "dpi_x"), "path")
    return last.select(number().alias("p_partkey"), F.col("v")[0].cast("long").alias("r"), F.col("v")[1].alias("g"), F.col("v")[2].alias("b"), "width", "height", "dpi_x")


@register("xcf_layers", """SELECT p_partkey, z, CASE z WHEN 0 THEN 'lowest' ELSE p_name END AS name, CASE z WHEN 0 THEN 0 ELSE p_size - 25 END::INT AS "left", CASE z WHEN 0 THEN 0 ELSE -3 END AS top,
CASE z WHEN 0 THEN 100 ELSE p_size - 25 + 30 END::INT AS "right", CASE z WHEN 0 THEN 50 ELSE 17 END AS bottom, round(CASE z WHEN 0 THEN 1 ELSE (p_partkey % 256) / 255::DOUBLE END, 9) AS opacity, z = 0 OR p_size % 2 = 1 AS visible, 100 AS canvas_width FROM part, (SELECT unnest([0, 1]) AS z)""")
def xcf_layers(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    made = X.files_of(rows, "p_partkey", lambda r: X.xcf(100, 50, 144.0, [(r["p_name"], r["p_size"] - 25, -3, 30, 20, r["p_partkey"] % 256, r["p_size"] % 2 == 1), ("lowest", 0, 0, 100, 50, 255, True)]))
    return I.layers(made).select(number().alias("p_partkey"), "z", "name", "left", "top", "right", "bottom", F.round("opacity", 9).alias("opacity"), "visible", "canvas_width")


def _drawings(spark, sf_dir):
    """A database for each nation, whose layers are the customers' names and balances of that nation."""
    t = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))).alias("layers"))

    def build(r):
        layers = [(x["c_name"], x["c_custkey"] % 257, x["c_custkey"] % 2) for x in r["layers"]]
        return X.database({"Canvas": ("CanvasWidth, CanvasHeight, CanvasResolution", [(1000 + r["c_nationkey"], 700, 350)]), "Layer": ("LayerName, LayerOpacity, LayerVisibility", layers)})

    return X.files_of(t, "c_nationkey", build)


@register("clip_layers", "SELECT c_nationkey::BIGINT AS c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS z, c_name AS name, round((c_custkey % 257) / 256::DOUBLE, 9) AS opacity, c_custkey % 2 = 1 AS visible, (1000 + c_nationkey)::INT AS canvas_width FROM customer")
def clip_layers(spark, sf_dir):
    made = _drawings(spark, sf_dir).select("path", F.concat(F.lit("CSFCHUNK....").cast("binary"), "content").alias("content"))
    return I.layers(made).select(number().alias("c_nationkey"), "z", "name", F.round("opacity", 9).alias("opacity"), "visible", "canvas_width")


@register("database_rows", "SELECT c_nationkey::BIGINT AS c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1)::INT AS \"row\", c_name AS name, c_custkey % 257 AS opacity FROM customer")
def database_rows(spark, sf_dir):
    """The rows of SQLite files, over as many pages as they take."""
    got = I.database_rows(_drawings(spark, sf_dir)).where("table = 'Layer'")
    return got.select(number().alias("c_nationkey"), "row", F.get_json_object("values", "$.LayerName").alias("name"), F.get_json_object("values", "$.LayerOpacity").cast("long").alias("opacity"))


# Archives and documents


def _by_nation(spark, sf_dir):
    """(s_nationkey, names): the suppliers of each nation, in order."""
    t = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    return t.select("s_nationkey", F.col("s")["s_suppkey"].alias("keys"), F.col("s")["s_name"].alias("names"))


@register("zip_entries", "SELECT s_nationkey::BIGINT AS s_nationkey, 'dir/' || s_suppkey || '.txt' AS entry, (length(s_name) * (1 + s_suppkey % 5))::BIGINT AS size, CASE WHEN s_nationkey % 2 = 0 THEN 8 ELSE 0 END AS method, md5(repeat(s_name, (1 + s_suppkey % 5)::INT)) AS md5 FROM supplier")
def zip_entries(spark, sf_dir):
    made = X.files_of(_by_nation(spark, sf_dir), "s_nationkey", lambda r: X.archive([(f"dir/{k}.txt", n * (1 + k % 5)) for k, n in zip(r["keys"], r["names"])], r["s_nationkey"] % 2 == 0))
    return I.entries(made).select(number().alias("s_nationkey"), "entry", "size", "method", F.md5("content").alias("md5"))


@register("zip_unsafe_names", "SELECT p_partkey, p_size % 5 <> 0 AS refused FROM part")
def zip_unsafe_names(spark, sf_dir):
    """Archives with a name that leaves their folder are refused as a whole."""
    names = ["in/side.txt", "../out.txt", "/out.txt", "in/../../out.txt", "\\out.txt"]
    made = X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", lambda r: X.archive([("a.txt", "a"), (names[r["p_size"] % 5], "b")]))
    return I.entries(made).groupBy("path").agg(F.max(F.col("error").isNotNull()).alias("refused")).select(number().alias("p_partkey"), "refused")


def _pages(spark, sf_dir, build):
    return I.pages(X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey", build))


def _boxes(t, *more):
    return t.select(number().alias("p_partkey"), "kind", "page_number", *[F.round(F.col("media")[i], 6).alias(n) for i, n in ((2, "width"), (3, "height"))], *more)


TWO = "(SELECT unnest([1, 2]) AS page_number)"


@register("docx_pages", f"SELECT p_partkey, 'docx' AS kind, page_number, 600::DOUBLE + p_size AS width, 800::DOUBLE AS height, p_size::DOUBLE AS trim_left, 600::DOUBLE + p_size - 36 AS trim_right, CASE page_number WHEN 1 THEN p_name || ' &' ELSE p_brand END AS text FROM part, {TWO}")
def docx_pages(spark, sf_dir):
    def build(r):
        return X.archive([("word/document.xml", f'<w:document><w:body><w:p><w:r><w:t>{r["p_name"]}</w:t><w:t>&amp;</w:t><w:br w:type="page"/><w:t>{r["p_brand"]}</w:t></w:r></w:p><w:sectPr><w:pgSz w:w="{20 * (600 + r["p_size"])}" w:h="16000"/><w:pgMar w:top="1440" w:bottom="1440" w:left="{20 * r["p_size"]}" w:right="720"/></w:sectPr></w:body></w:document>')])

    return _boxes(_pages(spark, sf_dir, build), F.col("trim")[0].alias("trim_left"), F.col("trim")[2].alias("trim_right"), "text")


@register("xlsx_sheets", "SELECT p_partkey, 'xlsx' AS kind, 1 AS page_number, 792::DOUBLE AS width, 612::DOUBLE AS height, p_name || chr(9) || p_size || chr(9) || p_brand AS text FROM part")
def xlsx_sheets(spark, sf_dir):
    """Shared texts are looked up by their place, numbers stand for themselves."""

    def build(r):
        sheet = f'<worksheet><sheetData><row><c t="s"><v>1</v></c><c><v>{r["p_size"]}</v></c><c t="s"><v>0</v></c></row></sheetData></worksheet>'
        return X.archive([("xl/workbook.xml", "<workbook/>"), ("xl/sharedStrings.xml", f'<sst><si><t>{r["p_brand"]}</t></si><si><r><t>{r["p_name"][:3]}</t></r><r><t>{r["p_name"][3:]}</t></r></si></sst>'), ("xl/worksheets/sheet1.xml", sheet)])

    return _boxes(_pages(spark, sf_dir, build), "text")


@register("pptx_slides", "SELECT p_partkey, 'pptx' AS kind, i + 1 AS page_number, 720::DOUBLE AS width, 400::DOUBLE + p_size AS height, p_brand || ' ' || [1, 2, 10, 11][i + 1] AS text FROM part, (SELECT unnest(range(4))::INT AS i)")
def pptx_slides(spark, sf_dir):
    """Slides come in the order of their numbers, whatever the archive's."""

    def build(r):
        slides = [(f"ppt/slides/slide{i}.xml", f'<p:sld><a:t>{r["p_brand"]}</a:t><a:t>{i}</a:t></p:sld>') for i in (10, 2, 11, 1)]
        return X.archive([("ppt/presentation.xml", f'<p:sldSz cx="9144000" cy="{12700 * (400 + r["p_size"])}"/>'), *slides])

    return _boxes(_pages(spark, sf_dir, build), "text")


@register("odf_pages", f"SELECT p_partkey, 'odf' AS kind, page_number, 72::DOUBLE * (5 + p_size % 4) AS width, 144::DOUBLE AS height, CASE page_number WHEN 1 THEN p_name ELSE p_brand || ' <' END AS text FROM part, {TWO}")
def odf_pages(spark, sf_dir):
    def build(r):
        style = f'<style:page-layout-properties fo:page-width="{5 + r["p_size"] % 4}in" fo:page-height="144pt" fo:margin-left="0.5in"/>'
        return X.archive([("mimetype", "application/vnd.oasis.opendocument.text"), ("styles.xml", style), ("content.xml", f'<text:p>{r["p_name"]}</text:p><text:soft-page-break/><text:p>{r["p_brand"]}<text:s/>&lt;</text:p>')])

    return _boxes(_pages(spark, sf_dir, build), "text")


@register("idml_pages", "SELECT p_partkey, 'idml' AS kind, 1 AS page_number, 500::DOUBLE + 9 AS width, 700::DOUBLE + p_size + 9 AS height, -9::DOUBLE AS bleed_left, 500::DOUBLE AS trim_right, 700::DOUBLE + p_size AS trim_top FROM part")
def idml_pages(spark, sf_dir):
    build = lambda r: X.archive([("mimetype", "application/vnd.adobe.indesign-idml-package"), ("Spreads/s1.xml", f'<Spread><Page GeometricBounds="0 0 {700 + r["p_size"]} 500"/></Spread>')])
    return _boxes(_pages(spark, sf_dir, build), F.col("bleed")[0].alias("bleed_left"), F.col("trim")[2].alias("trim_right"), F.col("trim")[3].alias("trim_top"))


@register("xps_pages", f"SELECT p_partkey, 'xps' AS kind, page_number, CASE page_number WHEN 1 THEN 75 ELSE p_size * 0.75 END::DOUBLE AS width, 300::DOUBLE AS height, CASE page_number WHEN 1 THEN p_name || ' ' || p_brand ELSE '' END AS text FROM part, {TWO}")
def xps_pages(spark, sf_dir):
    def build(r):
        return X.archive([("Pages/10.fpage", f'<FixedPage Width="{r["p_size"]}" Height="400"/>'), ("Pages/9.fpage", f'<FixedPage Width="100" Height="400"><Glyphs UnicodeString="{r["p_name"]}"/><Glyphs UnicodeString="{r["p_brand"]}"/></FixedPage>')])

    return _boxes(_pages(spark, sf_dir, build), F.coalesce("text", F.lit("")).alias("text"))


@register("epub_spine", "WITH o AS (SELECT p_partkey, p_name, unnest(CASE WHEN p_size % 2 = 0 THEN ['b', 'a'] ELSE ['a', 'b', 'a'] END) AS item, unnest(CASE WHEN p_size % 2 = 0 THEN [1, 2] ELSE [1, 2, 3] END) AS page_number FROM part) SELECT p_partkey, 'epub' AS kind, page_number, p_name AS title, 'Chapter ' || item || ' of ' || p_name AS text FROM o")
def epub_spine(spark, sf_dir):
    """The spine's order, with items that come twice and ones that aren't there."""

    def build(r):
        order = ["b", "gone", "a"] if r["p_size"] % 2 == 0 else ["a", "b", "a"]
        opf = f'<dc:title>{r["p_name"]}</dc:title>' + "".join(f'<item id="{c}" href="text/{c}.xhtml"/>' for c in "ab") + "".join(f'<itemref idref="{c}"/>' for c in order)
        chapters = [(f"OEBPS/text/{c}.xhtml", f"<html><head><title>x</title></head><body><h1>Chapter  {c}</h1><p>of\n{r['p_name']}</p></body></html>") for c in "ab"]
        return X.archive([("META-INF/container.xml", '<rootfile full-path="OEBPS/c.opf"/>'), ("OEBPS/c.opf", opf), *chapters])

    return _pages(spark, sf_dir, build).select(number().alias("p_partkey"), "kind", "page_number", "title", "text")


@register("comic_pages", "SELECT p_partkey, 'comic' AS kind, i + 1 AS page_number, CASE i WHEN 2 THEN 40 ELSE 10 END::DOUBLE AS width, 20::DOUBLE AS height, p_name AS title, ['page_1.png', 'page_2.png', 'page_10.png'][i + 1] AS file, CASE i WHEN 2 THEN 'true' ELSE 'false' END AS spread FROM part, (SELECT unnest(range(3))::INT AS i)")
def comic_pages(spark, sf_dir):
    """Images in natural order; what is much wider than high is a spread."""

    def build(r):
        page = lambda w: I.raster_files.write_png(gray(np.full((20, w), r["p_size"]), 72))
        return X.archive([("page_10.png", page(40)), ("page_1.png", page(10)), ("__MACOSX/x.png", b""), ("page_2.png", page(10)), ("ComicInfo.xml", f"<Title>{r['p_name']}</Title>")])

    return _boxes(_pages(spark, sf_dir, build), "title", F.col("metadata")["file"].alias("file"), F.col("metadata")["spread"].alias("spread"))


@register("compound_kinds", "SELECT p_partkey, ['doc', 'xls', 'ppt'][p_size % 3 + 1] AS kind, 1 AS page_number, CASE p_size % 3 WHEN 0 THEN 612 ELSE 792 END::DOUBLE AS width, CASE p_size % 3 WHEN 0 THEN 792 ELSE 612 END::DOUBLE AS height FROM part")
def compound_kinds(spark, sf_dir):
    return _boxes(_pages(spark, sf_dir, lambda r: X.compound(["WordDocument", "Workbook", "PowerPoint Document"][r["p_size"] % 3])))


def _preview(r: dict) -> bytes:
    return X.pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d 30] >>" % r["p_size"]])


@register("iwork_previews", "SELECT p_partkey, 'iwork' AS kind, 1 AS page_number, CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 25 END::DOUBLE AS width, CASE WHEN p_partkey % 2 = 0 THEN 30 ELSE 5 END::DOUBLE AS height FROM part")
def iwork_previews(spark, sf_dir):
    """The preview's pages if there is one, else the picture's."""

    def build(r):
        more = ("QuickLook/Preview.pdf", _preview(r)) if r["p_partkey"] % 2 == 0 else ("preview.png", I.raster_files.write_png(gray(np.zeros((5, 25)), 72)))
        return X.archive([("Index/Document.iwa", b"\0"), more])

    return _boxes(_pages(spark, sf_dir, build))


KINDS = ["docx", "xlsx", "pptx", "epub", "odf", "xps", "idml", "comic", "pdf", "svg", "dxf", "eps", "djvu", "dwg", "emf", "wmf"]


@register("document_kinds", f"SELECT p_partkey, {KINDS}[p_partkey % {len(KINDS)} + 1] AS kind FROM part")
def document_kinds(spark, sf_dir):
    """Which reader a file goes to, by its entries where it is an archive."""
    entries = {"docx": "word/document.xml", "xlsx": "xl/workbook.xml", "pptx": "ppt/presentation.xml", "epub": "META-INF/container.xml", "xps": "Pages/1.fpage", "idml": "designmap.xml", "comic": "1.png"}
    heads = {"pdf": b"\n%PDF-1.4\n", "svg": b"<?xml version='1.0'?><svg/>", "dxf": b"  0\nSECTION\n", "eps": b"%!PS-Adobe-3.0", "djvu": X.djvu(1, 1, 1), "dwg": b"AC1032", "emf": X.emf(1, 1, [(0, 0)]), "wmf": X.wmf(1, 1, [(0, 0)])}

    def build(r):
        kind = KINDS[r["p_partkey"] % len(KINDS)]
        if kind in heads:
            return heads[kind]
        return X.archive([("content.xml", ""), ("styles.xml", "")] if kind == "odf" else [(entries[kind], "")])

    made = X.files_of(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", build)
    return I.kinds(made).select(number().alias("p_partkey"), "kind")


# PDF


def _objects(r: dict) -> list[bytes]:
    """Two pages, of which the second has a box of its own; the first's text is within a packed stream."""
    said = f"BT ({r['p_name']}) Tj ET".encode().hex().upper().encode() + b">"
    return [
        b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792] >>", b"<< /Type /Page /Parent 2 0 R /Contents 6 0 R >>",
        b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] >>" % (100 + r["p_size"], r["p_partkey"] % 900 + 1), b"<< /Title (A \\(nested\\) %s\\051) >>" % r["p_brand"].encode(),
        b"<< /Length %d /Filter /ASCIIHexDecode >> stream\n" % len(said) + said + b"\nendstream",
    ]


PDF_PAGES = f"SELECT p_partkey, 'pdf' AS kind, page_number, CASE page_number WHEN 1 THEN 612 ELSE {{}} END::DOUBLE AS width, CASE page_number WHEN 1 THEN 792 ELSE {{}} END::DOUBLE AS height, 'A (nested) ' || p_brand || ')' AS title FROM part, {TWO}"


@register("pdf_pages", PDF_PAGES.format("100 + p_size", "p_partkey % 900 + 1"))
def pdf_pages(spark, sf_dir):
    """Cross-reference tables, strings with escapes, and boxes that pages inherit."""
    return _boxes(_pages(spark, sf_dir, lambda r: X.pdf(_objects(r), info=5)), "title")


@register("pdf_repaired", PDF_PAGES.format("100 + p_size", "p_partkey % 900 + 1"))
def pdf_repaired(spark, sf_dir):
    """Files that have lost their cross-reference table, or whose table begins elsewhere, read all the same."""

    def build(r):
        whole = X.pdf(_objects(r), info=5, table=r["p_partkey"] % 2 == 0)
        return whole.replace(b"startxref\n", b"startxref\n9") if r["p_partkey"] % 4 == 0 else whole

    return _boxes(_pages(spark, sf_dir, build), "title")


@register("pdf_revisions", PDF_PAGES.format("CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 100 + p_size END", "CASE WHEN p_partkey % 2 = 0 THEN 20 ELSE p_partkey % 900 + 1 END"))
def pdf_revisions(spark, sf_dir):
    """The newest revision of an object counts."""

    def build(r):
        old = X.pdf(_objects(r), info=5).replace(b"/Root 1 0 R /Info", b"/Root 1 0 R /Info")
        return X.revised(old, 4, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d 20] >>" % r["p_size"]) if r["p_partkey"] % 2 == 0 else old

    return _boxes(_pages(spark, sf_dir, build), "title")


@register("pdf_object_streams", "SELECT p_partkey, 'pdf' AS kind, 1 AS page_number, p_size::DOUBLE AS width, (p_partkey % 500 + 1)::DOUBLE AS height FROM part")
def pdf_object_streams(spark, sf_dir):
    """Objects within packed streams, found through a packed cross-reference with a predictor."""

    def build(r):
        members = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>")]
        return X.pdf_streams(members, b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] >>" % (r["p_size"], r["p_partkey"] % 500 + 1))

    return _boxes(_pages(spark, sf_dir, build))


@register("pdf_text", "SELECT p_partkey, 'BT (' || p_name || ') Tj ET' AS text FROM part")
def pdf_text(spark, sf_dir):
    """The printable characters of a page's unpacked content."""
    got = _pages(spark, sf_dir, lambda r: X.pdf(_objects(r), info=5)).where("page_number = 1")
    return got.select(number().alias("p_partkey"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))


def _printed(kind: str):
    def build(v: np.ndarray) -> bytes:
        image = gray(v, 72) if kind == "x-4" else Image(v.shape[1], v.shape[0], 4, np.stack([v, 255 - v, v // 2, v // 3], axis=2).astype(np.uint8).tobytes(), 8, "CMYK", 72, 72)
        return pdfx.write_pdf([pdfx.page_of(image)], kind, "Job")

    return build


def _page_samples(spark, sf_dir, build):
    """(path, y, x, v): the samples of the picture on each file's first page."""
    from ..sources.pdf import read_pages

    def rows(data: bytes) -> list[dict]:
        return [I.image_row(p.image, "pdf") for p in read_pages(data)[1][:1] if p.image]

    return I.pixels(I._mapped(X.raster_files(raster(spark, sf_dir), build), rows, I.IMAGE_DDL))


@register("pdfx4_write_read", SAMPLES)
def pdfx4_write_read(spark, sf_dir):
    return _page_samples(spark, sf_dir, _printed("x-4")).select(number().alias("image"), "y", "x", F.col("v")[0].alias("v"))


@register("pdfx1a_write_read", f"WITH {RASTER} SELECT image::BIGINT AS image, y::INT AS y, x::INT AS x, v::INT AS c, (255 - v)::INT AS m, (v // 2)::INT AS y_ink, (v // 3)::INT AS k FROM raster")
def pdfx1a_write_read(spark, sf_dir):
    t = _page_samples(spark, sf_dir, _printed("x-1a"))
    return t.select(number().alias("image"), "y", "x", *[F.col("v")[i].alias(c) for i, c in enumerate(("c", "m", "y_ink", "k"))])


@register("plates_write_read", f"WITH {RASTER} SELECT image::BIGINT AS image, plate, y::INT AS y, x::INT AS x, CASE plate WHEN 'Cyan' THEN v WHEN 'Magenta' THEN 255 - v WHEN 'Yellow' THEN v // 2 ELSE v // 3 END::INT AS v FROM raster, (SELECT unnest(['Cyan', 'Magenta', 'Yellow', 'Black']) AS plate)")
def plates_write_read(spark, sf_dir):
    """A TIFF file for each ink, read back."""

    def build(v: np.ndarray) -> bytes:
        inks = np.stack([v, 255 - v, v // 2, v // 3], axis=2).astype(np.uint8)
        return X.archive(list(write_plates(Image(v.shape[1], v.shape[0], 4, inks.tobytes(), 8, "CMYK"), "job").items()))

    files = I.entries(X.raster_files(raster(spark, sf_dir), build)).select(F.concat_ws("/", "path", F.regexp_extract("entry", "job_(.*)[.]tif", 1)).alias("path"), "content")
    t = I.pixels(I.images(files))
    return t.select(F.substring_index("path", "/", 1).cast("long").alias("image"), F.substring_index("path", "/", -1).alias("plate"), "y", "x", F.col("v")[0].alias("v"))


# Drawings


def _commands(spark, sf_dir, build):
    t = I.path_commands(X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", build))
    return t.select(number().alias("p_partkey"), "path_no", "ord", "op", F.array_join(F.transform("args", lambda v: F.round(v, 4).cast("decimal(18,4)").cast("string")), " ").alias("args"))


def points_sql(paths: list[list[tuple[str, str, str]]], closed: set[int] = frozenset()) -> str:
    """Rows of path commands: for each path its (op, x, y), as SQL over part; closed ones end with Z."""
    said = lambda v: f"round(({v})::DOUBLE, 4)::DECIMAL(18,4)::VARCHAR"
    rows = []
    for i, p in enumerate(paths):
        rows += [f"SELECT p_partkey, {i} AS path_no, {j} AS ord, '{op}' AS op, {said(x)} || ' ' || {said(y)} AS args FROM part" for j, (op, x, y) in enumerate(p)]
        rows += [f"SELECT p_partkey, {i}, {len(p)}, 'Z', '' FROM part"] if i in closed else []
    return " UNION ALL ".join(rows)


@register("svg_shapes", points_sql([[("M", "10", "p_size"), ("L", "15", "p_size + 5"), ("L", "25", "p_size + 5"), ("L", "25", "p_size")], [("M", "1", "2"), ("L", "1 + p_size", "2"), ("L", "1 + p_size", "6"), ("L", "1", "6")], [("M", "0", "0"), ("L", "p_size", "p_partkey % 100")], [("M", "0", "0"), ("L", "1", "0"), ("L", "1", "p_size")]], {0, 1, 3}))
def svg_shapes(spark, sf_dir):
    def build(r):
        s = r["p_size"]
        return f'<svg viewBox="0 0 500 400"><rect x="1" y="2" width="{s}" height="4"/><polygon points="0,0 1,0 1,{s}"/><path d="m 10 {s} l 5 5 h 10 v -5 z"/><line x1="0" y1="0" x2="{s}" y2="{r["p_partkey"] % 100}"/></svg>'.encode()

    return _commands(spark, sf_dir, build)


def _points(r: dict) -> list[tuple[int, int]]:
    return [(0, 0), (r["p_size"] * 20, 100), (200, r["p_partkey"] % 500)]


@register("wmf_lines", points_sql([[("M", "0", "0"), ("L", "p_size * 20 / 20", "5")], [("M", "p_size", "5"), ("L", "10", "(p_partkey % 500) / 20")], [("M", "0", "0"), ("L", "72", "0"), ("L", "72", "36"), ("L", "0", "36")]], {2}))
def wmf_lines(spark, sf_dir):
    return _commands(spark, sf_dir, lambda r: X.wmf(1440, 720, _points(r)))


@register("emf_lines", points_sql([[("M", "0", "0"), ("L", "p_size * 15", "75")], [("M", "p_size * 15", "75"), ("L", "150", "(p_partkey % 500) * 0.75")]]))
def emf_lines(spark, sf_dir):
    return _commands(spark, sf_dir, lambda r: X.emf(960, 480, _points(r)))


@register("dxf_lines", points_sql([[("M", "72", "72"), ("L", "2520", "72 + 24.48 * 64.70588235294117647")], [("M", "72", "72"), ("L", "72 + 24.48 * p_size", "72"), ("L", "72 + 24.48 * p_size", "72 + 24.48")]], {1}).replace("24.48 * 64.70588235294117647", "1584"))
def dxf_lines(spark, sf_dir):
    """A line from corner to corner of the paper's room, and a closed polyline within."""

    def build(r):
        s = r["p_size"]
        height = repr(1584 / 24.48)
        return f"0\nSECTION\n2\nENTITIES\n0\nLINE\n10\n0\n20\n0\n11\n100\n21\n{height}\n0\nLWPOLYLINE\n70\n1\n10\n0\n20\n0\n10\n{s}\n20\n0\n10\n{s}\n20\n1\n0\nENDSEC\n0\nEOF\n".encode()

    return _commands(spark, sf_dir, build)


@register("drawing_sizes", """SELECT p_partkey, ['eps', 'djvu', 'dwg', 'svg'][p_size % 4 + 1] AS kind, round(CASE p_size % 4 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN (p_partkey % 1000 + 1) * 72 / 300::DOUBLE WHEN 2 THEN 2592 ELSE 100 END::DOUBLE, 6) AS width,
round(CASE p_size % 4 WHEN 0 THEN 50 WHEN 1 THEN 144 WHEN 2 THEN 1728 ELSE p_size END::DOUBLE, 6) AS height, CASE p_size % 4 WHEN 0 THEN p_partkey % 7 + 1 ELSE 1 END::INT AS n_pages, CASE p_size % 4 WHEN 2 THEN ['R13', '2000', '2018'][p_partkey % 3 + 1] ELSE '' END AS text FROM part""")
def drawing_sizes(spark, sf_dir):
    """What drawings tell without being drawn: comments of EPS, heads of DjVu, releases of DWG, view boxes of SVG."""

    def build(r):
        k, s = r["p_partkey"], r["p_size"]
        kind = s % 4
        if kind == 0:
            return f"%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 9 9\n%%HiResBoundingBox: 0 0 {s + 0.5} 50\n%%Pages: {k % 7 + 1}\n".encode()
        return X.djvu(k % 1000 + 1, 600, 300) if kind == 1 else [b"AC1012", b"AC1015", b"AC1032"][k % 3] + bytes(20) if kind == 2 else f'<svg viewBox="0 0 100 {s}"></svg>'.encode()

    got = I.drawings(X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", build))
    return got.select(number().alias("p_partkey"), "kind", F.round("width", 6).alias("width"), F.round("height", 6).alias("height"), "n_pages", F.coalesce("text", F.lit("")).alias("text"))


@register("cdr_drawings", points_sql([[("M", "0", "0"), ("L", "p_size", "3")]]))
def cdr_drawings(spark, sf_dir):
    """The drawing that an archive of this kind holds as SVG."""
    return _commands(spark, sf_dir, lambda r: X.archive([("content/riffData.cdr", b""), ("previews/page1.svg", f'<svg><line x1="0" y1="0" x2="{r["p_size"]}" y2="3"/></svg>')]))


# Profiles


def _profile(r: dict) -> bytes:
    """Curves of each kind, primaries, and a table that gives 1 - v (a grid of 3 nodes, straight curves)."""
    s, k = r["p_size"], r["p_partkey"]
    para = b"para\0\0\0\0" + struct.pack(">HH", 3, 0) + struct.pack(">5i", *(round(v * 65_536) for v in (1 + s / 64, 0.5, 0.25, 0.125, k % 16 / 16)))
    grid = np.stack(np.meshgrid(*[255 - np.array([0, 51 * (1 + s % 4), 255])] * 3, indexing="ij"), axis=-1).astype(np.uint8)
    straight = np.tile(np.arange(256, dtype=np.uint8), 3).tobytes()
    lut = b"mft1\0\0\0\0" + bytes([3, 3, 3, 0]) + struct.pack(">9i", *[65_536, 0, 0, 0, 65_536, 0, 0, 0, 65_536]) + straight + grid.tobytes() + straight
    tags = {"rXYZ": icc.xyz_tag((s / 64, 0.25, 0.5)), "rTRC": para, "gTRC": b"curv\0\0\0\0" + struct.pack(">IH", 1, 256 + k % 512), "bTRC": b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, s * 1285, 65_535)}
    return icc.build("RGB", "Lab" if k % 2 else "XYZ", "mntr", tags | ({"A2B0": lut} if k % 3 else {"gXYZ": icc.xyz_tag((0, 0, 0)), "bXYZ": icc.xyz_tag((0, 0, 0))}))


def _profiles(spark, sf_dir):
    return X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", _profile)


@register("icc_heads", "SELECT p_partkey, '4.3.0' AS version, 'mntr' AS device, 'RGB' AS space, CASE p_partkey % 2 WHEN 1 THEN 'Lab' ELSE 'XYZ' END AS pcs, p_partkey % 3 = 0 AS is_matrix, p_partkey % 3 <> 0 AS is_table, CASE WHEN p_partkey % 3 = 0 THEN 'bTRC bXYZ gTRC gXYZ rTRC rXYZ' ELSE 'A2B0 bTRC gTRC rTRC rXYZ' END AS tags FROM part")
def icc_heads(spark, sf_dir):
    return I.profiles(_profiles(spark, sf_dir)).select(number().alias("p_partkey"), "version", "device", "space", "pcs", "is_matrix", "is_table", F.array_join("tags", " ").alias("tags"))


@register("icc_curves", """WITH n AS (SELECT p_partkey, 'rTRC' AS tag, 'parametric 3' AS kind, [1 + p_size / 64::DOUBLE, 0.5, 0.25, 0.125, (p_partkey % 16) / 16::DOUBLE] AS v FROM part
UNION ALL SELECT p_partkey, 'gTRC', 'gamma', [1 + (p_partkey % 512) / 256::DOUBLE] FROM part UNION ALL SELECT p_partkey, 'bTRC', 'table', [0.0::DOUBLE, p_size * 1285 / 65535::DOUBLE, 1] FROM part
UNION ALL SELECT p_partkey, 'rXYZ', 'XYZ', [p_size / 64::DOUBLE, 0.25, 0.5] FROM part)
SELECT p_partkey, tag, kind, len(v) AS n, round(v[1], 6) AS first, round(v[-1], 6) AS last, round(list_sum(v), 6) AS total FROM n""")
def icc_curves(spark, sf_dir):
    t = I.profile_numbers(_profiles(spark, sf_dir)).where("tag not in ('gXYZ', 'bXYZ')")
    return t.select(number().alias("p_partkey"), "tag", "kind", F.size("numbers").cast("long").alias("n"), F.round(F.col("numbers")[0], 6).alias("first"), F.round(F.element_at("numbers", -1), 6).alias("last"), F.round(F.aggregate("numbers", F.lit(0.0), lambda a, v: a + v), 6).alias("total"))


POINTS = [(0.0, 0.0, 0.0), (1.0, 0.25, 0.5), (0.125, 0.75, 1.0), (0.5, 0.5, 0.5)]


@register("icc_tables", f"""WITH p AS (SELECT unnest({[list(x) for x in POINTS]}) AS v, unnest(range({len(POINTS)}))::INT AS point),
m AS (SELECT p_partkey, 0.2::DOUBLE * (1 + p_size % 4) AS m FROM part WHERE p_partkey % 3 <> 0)
SELECT p_partkey, point, round(1 - CASE WHEN v[1] < 0.5 THEN v[1] * 2 * m ELSE m + (v[1] * 2 - 1) * (1 - m) END, 6) AS a, round(1 - CASE WHEN v[2] < 0.5 THEN v[2] * 2 * m ELSE m + (v[2] * 2 - 1) * (1 - m) END, 6) AS b,
round(1 - CASE WHEN v[3] < 0.5 THEN v[3] * 2 * m ELSE m + (v[3] * 2 - 1) * (1 - m) END, 6) AS c FROM m, p""")
def icc_tables(spark, sf_dir):
    """Values through a profile's table: along each axis of it two straight pieces, the second value's place from the part's size."""
    t = I.through_profiles(_profiles(spark, sf_dir), "A2B0", POINTS).where("error IS NULL")
    return t.select(number().alias("p_partkey"), "point", *[F.round(F.col("result")[i], 6).alias(c) for i, c in enumerate("abc")])


# Fonts


def _fonts(spark, sf_dir):
    """A: a square as wide as the part's size; B: a curve."""
    build = lambda r: X.truetype([[(0, 0, True), (10 * r["p_size"], 0, True), (10 * r["p_size"], 500, True), (0, 500, True)], [(0, 0, True), (50, 10 * r["p_size"], False), (100, 0, True)]])
    return X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", build)


@register("glyph_points", """SELECT p_partkey, "ord", character, glyph, contour, point, x, y, "on" FROM (
SELECT p_partkey, 0 AS "ord", 'B' AS character, 2 AS glyph, 0 AS contour, i AS point, [0, 50, 100][i + 1]::DOUBLE AS x, CASE i WHEN 1 THEN 10 * p_size ELSE 0 END::DOUBLE AS y, i <> 1 AS "on" FROM part, (SELECT unnest(range(3))::INT AS i)
UNION ALL SELECT p_partkey, 1, 'A', 1, 0, i, CASE WHEN i IN (1, 2) THEN 10 * p_size ELSE 0 END::DOUBLE, CASE WHEN i >= 2 THEN 500 ELSE 0 END::DOUBLE, true FROM part, (SELECT unnest(range(4))::INT AS i))""")
def glyph_points(spark, sf_dir):
    """Characters to glyphs, and running sums of glyphs' steps."""
    return I.glyphs(_fonts(spark, sf_dir), "BA?").select(number().alias("p_partkey"), "ord", "character", "glyph", "contour", "point", "x", "y", "on")


@register("text_advance", """SELECT p_partkey, i AS "line", round(x, 6) AS x FROM (
SELECT p_partkey, 0 AS i, 0::DOUBLE AS x FROM part UNION ALL SELECT p_partkey, 1, 0.12 * p_size + 1.2 FROM part UNION ALL SELECT p_partkey, 2, 0.24 * p_size + 2.4 + 3.6 FROM part)""")
def text_advance(spark, sf_dir):
    """Where each letter of a line of text begins: after the widths of those before it, and of blanks."""
    t = I.text_paths(_fonts(spark, sf_dir), "AA A", 12.0).where("op = 'M'")
    place = (F.floor(F.col("ord") / 5)).cast("int")
    return t.select(number().alias("p_partkey"), place.alias("line"), F.round(F.col("args")[0], 6).alias("x"))


@register("glyph_curves", "SELECT p_partkey, round(100 / 3::DOUBLE, 6) AS x1, round(p_size * 20 / 3::DOUBLE, 6) AS y1, round(200 / 3::DOUBLE, 6) AS x2, round(p_size * 20 / 3::DOUBLE, 6) AS y2 FROM part")
def glyph_curves(spark, sf_dir):
    """A quadratic piece as a cubic one."""
    t = I.text_paths(_fonts(spark, sf_dir), "B", 1000.0).where("op = 'C'")
    return t.select(number().alias("p_partkey"), *[F.round(F.abs(F.col("args")[i]), 6).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@register("type2_charstrings", points_sql([[("M", "p_size", "20"), ("L", "p_size + 5", "20"), ("L", "p_size + 8", "20")]], {0}).replace(" AS path_no", " AS path_no").replace("p_partkey, 0 AS path_no, ", "p_partkey, ").replace("p_partkey, 0, 3, 'Z', ''", "p_partkey, 3, 'Z', ''"))
def type2_charstrings(spark, sf_dir):
    """rmoveto, rlineto and hlineto with operands of one byte."""
    build = lambda r: bytes([139 + r["p_size"], 139 + 20, 21, 139 + 5, 139, 5, 139 + 3, 6, 14])
    t = I.charstrings(X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", build))
    return t.select(number().alias("p_partkey"), "ord", "op", F.array_join(F.transform("args", lambda v: F.round(v, 4).cast("decimal(18,4)").cast("string")), " ").alias("args"))


# Packed plans: the same numbers as the plans over pixels give


@register("devicelink_packed", color_queries.SQL["devicelink_pixels"])
def devicelink_packed(spark, sf_dir):
    from .convert import device_link_array
    from .views import KEY, px

    link = spark.sparkContext.broadcast(device_link_array(spark, 300.0))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rgb = np.stack([b.column(i).to_numpy() for i in (2, 3, 4)], axis=1).astype(np.uint8)
            inks = packed.apply_link(link.value, rgb).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(np.ascontiguousarray(inks[:, i])) for i in range(4))], names=["l_orderkey", "l_linenumber", "c", "m", "y", "k"])

    return px(spark, sf_dir).select(*KEY, "r", "g", "b").mapInArrow(run, "l_orderkey long, l_linenumber int, c long, m long, y long, k long")


PICTURE_KINDS = ["png", "jpeg", "tiff", "bmp", "psd", "xcf", "clip", "webp", "raw", "raw", "raw", "tga", "doc", "cdr", "cdr", "zip", "riff"]


@register("picture_kinds", f"SELECT p_partkey, {PICTURE_KINDS}[p_partkey % {len(PICTURE_KINDS)} + 1] AS kind FROM part")
def picture_kinds(spark, sf_dir):
    """Which reader a picture goes to: camera files before plain TIFF, archives by their entries, and TGA for what nothing else is."""
    small = np.zeros((2, 2), np.uint8)
    heads = [
        X.png_filtered(small), jpeg.encode(gray(np.zeros((8, 8)))), X.tiff(small), X.bmp(small), X.psd([], 1, 1), X.xcf(1, 1, 72.0, []), X.database({"Canvas": ("a, b", [(1, 2)])}), X.webp_head(1, 1, False), X.dng(small), b"FUJIFILMCCD-RAW " + bytes(100),
        b"\0MRM" + bytes(100), X.tga(small), X.compound("WordDocument"), X.archive([("content/riffData1.cdr", b"")]), b"RIFF\0\0\0\0CDRvrsn", X.archive([("a.txt", "a")]), b"RIFF\0\0\0\0WAVE",
    ]
    kind = ["ole2" if k == "doc" else k for k in PICTURE_KINDS]
    made = X.files_of(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", lambda r: heads[r["p_partkey"] % len(kind)])
    return I.kinds(made).select(number().alias("p_partkey"), F.when(F.col("kind") == "ole2", "doc").otherwise(F.col("kind")).alias("kind"))


CAMERAS = "SELECT s_suppkey, s_suppkey % 2 AS kind, s_suppkey % 15 * 1000 AS v FROM supplier WHERE s_suppkey % 10 < 3"


@register("camera_raw_makers", f"SELECT s_suppkey, CASE kind WHEN 0 THEN 600 ELSE 400 END AS width, CASE kind WHEN 0 THEN 400 ELSE 300 END AS height, floor(round((CASE WHEN u <= 0.0031308 THEN u * 12.92 ELSE 1.055 * pow(u, 1 / 2.4::DOUBLE) - 0.055 END) * 255, 9) + 0.5)::INT AS v FROM (SELECT *, least(1, v / CASE kind WHEN 0 THEN 16383 ELSE 4095 END::DOUBLE) AS u FROM ({CAMERAS}))")
def camera_raw_makers(spark, sf_dir):
    """Files of two makers, with cells of one level: sizes, depths and places of their own."""

    def build(r):
        level = r["s_suppkey"] % 15 * 1000
        if r["s_suppkey"] % 2 == 0:
            return (b"FUJIFILMCCD-RAW ".ljust(84, b"\0") + struct.pack(">II", 200, 480_000)).ljust(200, b"\0") + struct.pack(">H", level) * 240_000
        return b"\0MRM".ljust(128, b"\0") + struct.pack(">H", level) * 120_000

    rows = table(spark, sf_dir, "supplier").select("s_suppkey").where("s_suppkey % 10 < 3")
    got = I.images(X.files_of(rows, "s_suppkey", build))
    value = F.conv(F.hex(F.substring("data", 1, 1)), 16, 10).cast("int")
    same = F.hex("data") == F.expr("repeat(hex(substring(data, 1, 1)), cast(octet_length(data) as int))")
    return got.where(same).select(number().alias("s_suppkey"), "width", "height", value.alias("v"))
