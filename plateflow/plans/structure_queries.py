"""Queries of what readers do with entries, runs, references and chunks."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import clut
from ..operators import structure as S
from ..operators.plates import limit_inks
from ..sources import icc
from ..sources import images as I
from . import color_queries as C
from . import fixtures as X
from .codec_queries import gray, number
from .convert import Options, convert, report
from .views import KEY, PX, named, px, table

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    return named(QUERIES, SQL, name, sql)


ENTRY = "(['a.png', 'dir/', '../up.jpg', '__MACOSX/a.png', '/root.png', 'in/b.JPG', '\\root.gif', 'in/../c.png', '.hidden.png', 'notes.txt', '..png'])[p_partkey % 11 + 1]"


@register("entry_guards", f"SELECT p_partkey, p_size, {ENTRY} AS entry, p_partkey % 11 NOT IN (2, 4, 6, 7) AS safe, p_partkey % 11 IN (0, 4, 5, 6, 7) AS picture FROM part")
def entry_guards(spark, sf_dir):
    names = F.array(*[F.lit(n) for n in ("a.png", "dir/", "../up.jpg", "__MACOSX/a.png", "/root.png", "in/b.JPG", "\\root.gif", "in/../c.png", ".hidden.png", "notes.txt", "..png")])
    t = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.element_at(names, (F.col("p_partkey") % 11 + 1).cast("int")).alias("entry"))
    return t.withColumns({"safe": S.safe_entry(F.col("entry")), "picture": S.picture_entry(F.col("entry"))})


@register("size_guards", "SELECT p_partkey, CASE WHEN p_size * 1500 > 65535 OR p_partkey % 7 = 0 THEN 'side' WHEN p_size::BIGINT * 1500 * 60000 * (1 + p_partkey % 4) > 2147483648 THEN 'bytes' ELSE 'read' END AS said FROM part")
def size_guards(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    said = S.size_error(F.col("p_size").cast("long") * 1500, F.when(F.col("p_partkey") % 7 == 0, 0).otherwise(60_000), 1 + F.col("p_partkey") % 4, F.lit(8))
    return t.select("p_partkey", F.coalesce(said, F.lit("read")).alias("said"))


@register("required_entries", "SELECT o_orderkey AS file, o_orderstatus AS status FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def required_entries(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderstatus").alias("status"))
    return S.with_entry(files, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_returnflag").alias("entry")), "R")


@register("object_lookup", "SELECT l_orderkey AS file, l_linenumber AS place, l_suppkey % 9 AS ref, o.name AS body FROM lineitem LEFT JOIN (SELECT r_regionkey AS k, r_name AS name FROM region) o ON o.k = l_suppkey % 9")
def object_lookup(spark, sf_dir):
    """References to objects of five files' worth, some of which aren't there."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 1).alias("file"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("place"), (F.col("l_suppkey") % 9).alias("ref"))
    objects = table(spark, sf_dir, "region").select(F.lit(0).cast("long").alias("file"), F.col("r_regionkey").cast("long").alias("object"), F.col("r_name").alias("body"))
    return S.resolved(t, objects).select(F.col("k").alias("file"), "place", "ref", "body")


@register("database_tables", "SELECT n_regionkey::BIGINT AS file, n_name AS name, c_custkey AS row, c_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
def database_tables(spark, sf_dir):
    master = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("file"), F.col("n_name").alias("name"), F.col("n_nationkey").alias("root"))
    cells = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey"), "c_nationkey")
    cells = cells.select(F.col("n_regionkey").cast("long").alias("file"), F.col("c_nationkey").alias("root"), F.col("c_custkey").alias("row"), F.col("c_name").alias("value"))
    return S.table_rows(master, cells)


@register("text_runs", "SELECT l_orderkey, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_returnflag || l_linestatus) AS text FROM lineitem GROUP BY l_orderkey")
def text_runs(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("t"))
    return S.joined_runs(t, ["l_orderkey"], "l_linenumber", "t")


@register("profile_chunks", "SELECT l_orderkey, CASE WHEN count(DISTINCT l_linenumber) = max(l_linenumber) THEN md5(string_agg(l_partkey::VARCHAR || ';', '' ORDER BY l_linenumber)) END AS md5 FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def profile_chunks(spark, sf_dir):
    """Chunks in the order of their numbers; those of files that lack one are no profile."""
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("sequence")).agg(F.min("l_partkey").alias("p"))
    total = t.groupBy("l_orderkey").agg(F.max("sequence").alias("total"))
    chunks = t.join(total, "l_orderkey").select("l_orderkey", "sequence", "total", F.concat(F.col("p").cast("string"), F.lit(";")).cast("binary").alias("chunk"))
    return S.joined_chunks(chunks, "l_orderkey").select("l_orderkey", F.md5("content").alias("md5"))


@register("marked_pages", "SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 4 ELSE 1 + p_size % 5 END::INT AS pages, (1 + p_size % 3)::INT AS breaks FROM part")
def marked_pages(spark, sf_dir):
    """Slides count, or else soft breaks; a word file's explicit breaks."""
    k, s = F.col("p_partkey"), F.col("p_size")
    times = lambda text, n: F.expr("repeat('{}', cast({} as int))".format(text.replace("'", "''"), n))
    xml = F.concat(times("<draw:page a=1/>", "p_partkey % 4"), times("<text:p>x</text:p><text:soft-page-break/>", "p_size % 5"), times("<draw:pages/>", "2"))
    word = F.concat(F.lit("<w:p>"), times('<w:br w:type="page"/>', "p_size % 3"), F.lit('<w:br w:type="column"/></w:p>'))
    return table(spark, sf_dir, "part").select(k.alias("p_partkey"), S.drawn_pages(xml).alias("pages"), S.marked_pages(word, r'<w:br\s[^>]*w:type="page"[^>]*/?>').alias("breaks")).drop(s)


@register("first_pages", "SELECT conv_id AS doc, min(turn) + 1 AS page_number, length(arg_min(text, turn)) AS n_chars FROM conversations GROUP BY conv_id")
def first_pages(spark, sf_dir):
    from .views import pages

    return S.first_pages(pages(spark, sf_dir)).select("doc", "page_number", F.length("text").cast("long").alias("n_chars"))


@register("byte_slices", "SELECT p_partkey, CASE WHEN p_size % 20 <= strlen(p_name) THEN substr(p_name, (1 + p_size % 20)::BIGINT, (p_partkey % 6)::BIGINT) END AS part, CASE WHEN p_size % 20 > strlen(p_name) THEN 'RangeError' END AS error FROM part")
def byte_slices(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return S.slices(t, "p_name", F.col("p_size") % 20, F.col("p_partkey") % 6).select("p_partkey", F.col("part").cast("string").alias("part"), "error")


@register("tag_directories", "SELECT l_orderkey, string_agg(tag::VARCHAR, ',' ORDER BY tag) AS tags FROM (SELECT l_orderkey, l_suppkey * 7 % 317 AS tag FROM lineitem) GROUP BY l_orderkey")
def tag_directories(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") * 7 % 317).alias("tag"), F.col("l_partkey").alias("value"))
    return S.sorted_tags(t, "l_orderkey").select("l_orderkey", F.array_join(F.transform("tags", lambda x: x["tag"].cast("string")), ",").alias("tags"))


@register("palette_pixels", f"WITH {PX} SELECT l_orderkey, l_linenumber, CASE WHEN r < 200 THEN r ELSE 0 END AS r, CASE WHEN r < 200 THEN 255 - r ELSE 0 END AS g, CASE WHEN r < 200 THEN r // 2 ELSE 0 END AS b FROM px")
def palette_pixels(spark, sf_dir):
    """A palette of 200 colours; an index beyond it is black."""
    t = px(spark, sf_dir).select(*KEY, F.lit(0).cast("long").alias("image"), F.col("r").alias("i"))
    palette = spark.range(200).select(F.lit(0).cast("long").alias("image"), F.col("id").alias("i"), F.col("id").alias("r"), (255 - F.col("id")).alias("g"), F.floor(F.col("id") / 2).alias("b"))
    return S.expanded_palette(t, palette).select(*KEY, "r", "g", "b")


@register("glyph_steps", "SELECT l_orderkey, l_linenumber, l_partkey, sum(l_suppkey % 21 - 10) OVER w::BIGINT AS x, sum(l_partkey % 31 - 15) OVER w::BIGINT AS y FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def glyph_steps(spark, sf_dir):
    order = (F.col("l_linenumber") * F.lit(1_000_000_000).cast("long") + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("o")
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", order, (F.col("l_suppkey") % 21 - 10).alias("dx"), (F.col("l_partkey") % 31 - 15).alias("dy"))
    return S.running_points(t, ["l_orderkey"], "o").select("l_orderkey", "l_linenumber", "l_partkey", "x", "y")


@register("page_stream", "SELECT conv_id AS doc, turn + 1 AS page_number, CASE WHEN turn % 3 = 0 THEN 612 ELSE 100 + turn END::DOUBLE AS width, 'M 1 ' || turn AS d, role AS made_by, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS position FROM conversations")
def page_stream(spark, sf_dir):
    """Pages in order with a box for each; paths and metadata stay."""
    t = table(spark, sf_dir, "conversations")
    turn = F.col("turn").cast("double")
    box = F.when(F.col("turn") % 3 != 0, F.array(F.lit(0.0), F.lit(0.0), turn + 100, F.lit(50.0)))
    paths = F.array(F.struct(F.lit("M").alias("op"), F.array(F.lit(1.0), turn).alias("args")))
    got = S.page_stream(t.select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page_number"), box.alias("media"), paths.alias("paths"), F.create_map(F.lit("by"), F.col("role")).alias("metadata"), "text"))
    return got.select("doc", "page_number", F.col("media")[2].alias("width"), G.path_data(F.col("paths")).alias("d"), F.col("metadata")["by"].alias("made_by"), "position")


# Files to print files


def _pdfs(spark, sf_dir):
    """A document of one to three gray pages for each supplier."""
    from ..sinks.pdfx import page_of, write_pdf

    def build(r):
        pages = [page_of(gray(np.full((6, 8), (r["s_suppkey"] * 5 + i * 40) % 256), 72), i + 1) for i in range(1 + r["s_suppkey"] % 3)]
        return write_pdf(pages, "x-4", r["s_name"])

    return X.files_of(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", build)


@register("converted_names", "SELECT s_suppkey, name || ext AS filename FROM (SELECT s_suppkey, 'page_' || unnest(range(1, 2 + s_suppkey % 3)) AS name FROM supplier), (SELECT unnest(['.pdf', '_72dpi.jpg', '_native.jpg']) AS ext)")
def converted_names(spark, sf_dir):
    got = convert(_pdfs(spark, sf_dir), Options(format="pdf/x-4", split=True, proofs=(72, "native")))
    return got.select(number().alias("s_suppkey"), "filename")


@register("named_pages", "SELECT s_suppkey, 'sheet-' || lpad(unnest(range(1, 2 + s_suppkey % 3))::VARCHAR, 3, '0') || '.pdf' AS filename FROM supplier")
def named_pages(spark, sf_dir):
    """Names of pages by a function of one's own."""
    return convert(_pdfs(spark, sf_dir), Options(format="pdf/x-4", split=True, naming=lambda n: f"sheet-{n:03d}")).select(number().alias("s_suppkey"), "filename")


@register("first_page_only", "SELECT s_suppkey, 8 AS width, 6 AS height, (s_suppkey * 5 % 256)::INT AS v FROM supplier")
def first_page_only(spark, sf_dir):
    """Of documents, the first page as a TIFF file, read back."""
    made = convert(_pdfs(spark, sf_dir), Options(format="tiff", first_page_only=True)).select("path", "content")
    got = I.images(made)
    return I.pixels(got).where("x = 3 and y = 3").join(got.select("path", "width", "height"), "path").select(number().alias("s_suppkey"), "width", "height", F.col("v")[0].alias("v"))


@register("proof_pixels", "SELECT s_suppkey, 16 AS width, 12 AS height, (s_suppkey * 5 % 256)::INT AS darkest, (s_suppkey * 5 % 256)::INT AS lightest FROM supplier")
def proof_pixels(spark, sf_dir):
    """Proofs of the first pages at twice the size, as TIFF files, read back."""
    made = convert(_pdfs(spark, sf_dir), Options(format="pdf/x-4", proofs=(144,), proof_format="tiff", first_page_only=True)).where("filename like 'page_1%.tif'").select("path", "content")
    got = I.images(made)
    return I.pixels(got).join(got.select("path", "width", "height"), "path").groupBy("path", "width", "height").agg(F.min(F.col("v")[0]).alias("darkest"), F.max(F.col("v")[0]).alias("lightest")).select(number().alias("s_suppkey"), "width", "height", "darkest", "lightest")


@register("conversion_report", """SELECT s_suppkey, (1 + s_suppkey % 3)::INT AS files, 'page_1.jpg' AS first, 'jpg' AS format FROM supplier""")
def conversion_report(spark, sf_dir):
    got = report(convert(_pdfs(spark, sf_dir), Options(format="jpeg", split=True)))
    read = F.from_json("report", "generator string, files array<struct<name: string, sizeBytes: long, format: string>>")
    t = got.select(number().alias("s_suppkey"), read.alias("r"))
    return t.where("r.files[0].sizeBytes > 100").select("s_suppkey", F.size("r.files").alias("files"), F.col("r.files")[0]["name"].alias("first"), F.col("r.files")[0]["format"].alias("format"))


@register("pages_not_there", "SELECT s_suppkey, s_suppkey % 3 < 2 AS failed FROM supplier")
def pages_not_there(spark, sf_dir):
    """A document without the third page gives an error, others give a file."""
    got = convert(_pdfs(spark, sf_dir), Options(format="pdf/x-4", pages=(3, 1)))
    return got.select(number().alias("s_suppkey"), F.col("error").isNotNull().alias("failed"))


@register("vector_print_files", "SELECT p_partkey, '10.000 ' || printf('%.3f', p_size::DOUBLE) || ' m' AS start, 3 AS strokes, true AS black FROM part")
def vector_print_files(spark, sf_dir):
    """Drawings as print files: their paths are strokes of the page."""

    def build(r):
        s = r["p_size"]
        return f'<svg viewBox="0 0 500 400"><path d="M 10 {s} L 15 5"/><rect x="1" y="2" width="{s}" height="4"/><line x1="0" y1="0" x2="{s}" y2="9"/></svg>'.encode()

    made = convert(X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", build), Options(format="pdf/x-1a")).select("path", "content")
    text = I.pages(made).select(number().alias("p_partkey"), "text")
    return text.select("p_partkey", F.regexp_extract("text", r"([0-9.]+ [0-9.]+ m)\s", 1).alias("start"), F.size(F.regexp_extract_all("text", F.lit(r"(?m)^S$"), 0)).alias("strokes"), F.contains("text", F.lit("0 0 0 1 K")).alias("black"))


@register("illustrator_pages", "SELECT p_partkey, 'pdf' AS kind, p_size::DOUBLE AS width FROM part")
def illustrator_pages(spark, sf_dir):
    """Drawings whose print file begins behind other bytes."""

    def build(r):
        whole = X.pdf([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d 30] >>" % r["p_size"]])
        return b"\x00AI private data\n" * (r["p_partkey"] % 1800) + whole

    return I.pages(X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", build)).select(number().alias("p_partkey"), "kind", F.col("media")[2].alias("width"))


@register("clip_previews", "SELECT p_partkey, 40 AS width, 30 AS height, (p_partkey % 256)::INT AS v FROM part")
def clip_previews(spark, sf_dir):
    """The preview that a drawing's database holds."""

    def build(r):
        picture = I.raster_files.write_png(gray(np.full((30, 40), r["p_partkey"] % 256)))
        return b"CSFCHUNK...." + X.database({"Canvas": ("CanvasWidth, CanvasHeight, CanvasResolution", [(40, 30, 300)]), "CanvasPreview": ("ImageType, ImageData", [(1, picture)])})

    got = I.images(X.files_of(X.dealt(table(spark, sf_dir, "part").select("p_partkey")), "p_partkey", build))
    return got.where("error IS NULL").select(number().alias("p_partkey"), "width", "height", I.sample_at(39, 29).alias("v"))


# Profiles with tables between curves


def _mab(r: dict) -> bytes:
    """A table of 2 nodes on each axis whose corners are (a, b, c) themselves, behind squares and before roots."""
    para = lambda g: b"para\0\0\0\0" + struct.pack(">HHi", 0, 0, round(g * 65_536))
    grid = np.stack(np.meshgrid(*[np.array([0, r["p_size"] * 1000])] * 3, indexing="ij"), axis=-1).astype(">u2").tobytes()
    lut = bytes([2, 2, 2] + [0] * 13) + bytes([2, 0, 0, 0]) + grid
    b, a = para(0.5) * 3, para(2.0) * 3
    at_b = 32
    at_lut = at_b + len(b)
    at_a = at_lut + len(lut) + -len(lut) % 4
    tag = b"mAB \0\0\0\0" + bytes([3, 3, 0, 0]) + struct.pack(">5I", at_b, 0, 0, at_lut, at_a) + b + lut + b"\0" * (-len(lut) % 4) + a
    return icc.build("RGB", "Lab", "mntr", {"A2B0": tag})


@register("icc_curve_tables", "SELECT p_partkey, round(sqrt(0.25 * 0.25 * (p_size * 1000 / 65535::DOUBLE)), 6) AS a, round(sqrt(p_size * 1000 / 65535::DOUBLE), 6) AS b, 0.0::DOUBLE AS c FROM part")
def icc_curve_tables(spark, sf_dir):
    made = X.files_of(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_partkey", _mab)
    t = I.through_profiles(made, "A2B0", [(0.25, 1.0, 0.0)]).where("error IS NULL")
    return t.select(number().alias("p_partkey"), *[F.round(F.col("result")[i], 6).alias(c) for i, c in enumerate("abc")])


# Whole conversions by colour space


SPACED = """t AS (SELECT DISTINCT l_orderkey, l_linenumber % 3 AS space, l_partkey % 256 AS v FROM lineitem)"""


@register("convert_by_space", f"WITH {C.link_sql(0, C.GRAYS)}, {C.LINK}, {SPACED} SELECT l_orderkey, space, v, CASE space WHEN 0 THEN v ELSE link.c END AS c, CASE space WHEN 0 THEN 255 - v ELSE link.k END AS k FROM t JOIN link ON node = v WHERE space < 2")
def convert_by_space(spark, sf_dir):
    """Inks pass through, grays take the exact table: a union of plans by colour space."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("space"), (F.col("l_partkey") % 256).alias("v")).distinct()
    inks = t.where("space = 0").select("l_orderkey", "space", "v", F.col("v").alias("c"), (255 - F.col("v")).alias("k"))
    grays = t.where("space = 1").join(F.broadcast(clut.gray_table(spark)), "v").select("l_orderkey", "space", "v", "c", "k")
    return inks.unionByName(grays)


@register("limited_samples", f"WITH {C.limit_sql(240.0)} SELECT l_orderkey, l_linenumber, round(c + m + y + k, 6) AS total FROM limited")
def limited_samples(spark, sf_dir):
    from .views import cmyk

    t = limit_inks(cmyk(spark, sf_dir), 240.0)
    return t.select(*KEY, F.round(F.col("c") + F.col("m") + F.col("y") + F.col("k"), 6).alias("total"))
