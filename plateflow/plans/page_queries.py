"""Queries of pages, names, markup and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import pages as P
from ..operators import vector as V
from .views import PAGES, named, pages, table

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    return named(QUERIES, SQL, name, sql)


# Pages

WANTED = [3, 1, 1, 7, 2]


@register("page_select_list", f"WITH {PAGES}, w AS (SELECT unnest({WANTED}) AS page_number, unnest(range({len(WANTED)}))::INT AS position) SELECT doc, position, page_number, length(text) AS n_chars FROM w JOIN docpages USING (page_number)")
def page_select_list(spark, sf_dir):
    return P.select_pages(pages(spark, sf_dir), WANTED).select("doc", "position", "page_number", F.length("text").cast("long").alias("n_chars"))


RANGES = "concat(p_size::VARCHAR, ',', (p_partkey % 5)::VARCHAR, '-', (p_size % 9)::VARCHAR, ', x,', (p_size + 50)::VARCHAR, ',7-')"


@register("page_range_parse", f"""WITH r AS (SELECT p_partkey, p_size::BIGINT AS a, p_partkey % 5 AS lo, (p_size % 9)::BIGINT AS hi FROM part)
SELECT p_partkey, {RANGES.replace('p_size', 'a')} AS ranges, list_sum(n)::BIGINT AS total, len(n) AS pages, n[-1]::BIGINT AS last FROM (SELECT p_partkey, a, list_concat(list_concat([a], CASE WHEN lo <= hi THEN range(lo, hi + 1) ELSE [] END), [a + 50]) AS n FROM r)""")
def page_range_parse(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    s = lambda c: c.cast("string")
    ranges = F.concat(s(F.col("p_size")), F.lit(","), s(F.col("p_partkey") % 5), F.lit("-"), s(F.col("p_size") % 9), F.lit(", x,"), s(F.col("p_size") + 50), F.lit(",7-"))
    t = t.select("p_partkey", ranges.alias("ranges"), P.page_numbers(ranges).alias("n"))
    return t.select("p_partkey", "ranges", F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.size("n").cast("long").alias("pages"), F.element_at("n", -1).cast("long").alias("last"))


@register("natural_sort", "WITH n AS (SELECT s_suppkey, s_nationkey, 'Page_' || (s_suppkey * 7 % 1000)::VARCHAR || CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'B' END || (s_suppkey % 13)::VARCHAR || '.png' AS name FROM supplier) SELECT s_suppkey, name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 7 % 1000, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END, s_suppkey % 13, s_suppkey)::BIGINT AS place FROM n")
def natural_sort(spark, sf_dir):
    s = lambda c: c.cast("string")
    name = F.concat(F.lit("Page_"), s(F.col("s_suppkey") * 7 % 1000), F.when(F.col("s_suppkey") % 2 == 0, F.lit("a")).otherwise(F.lit("B")), s(F.col("s_suppkey") % 13), F.lit(".png"))
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", name.alias("name"))
    return P.in_order(t, "s_nationkey", P.natural_key(F.col("name")), "s_suppkey").drop("s_nationkey")


@register("numeric_sort", "WITH n AS (SELECT s_suppkey, s_nationkey, 'ppt/slides/slide' || (s_suppkey * 7 % 1000)::VARCHAR || '.xml' AS name FROM supplier) SELECT s_suppkey, name, s_suppkey * 7 % 1000 AS key, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey * 7 % 1000, s_suppkey)::BIGINT AS place, row_number() OVER (PARTITION BY s_nationkey ORDER BY name, s_suppkey)::BIGINT AS lexical FROM n")
def numeric_sort(spark, sf_dir):
    from pyspark.sql.window import Window

    name = F.concat(F.lit("ppt/slides/slide"), (F.col("s_suppkey") * 7 % 1000).cast("string"), F.lit(".xml"))
    t = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", name.alias("name"))
    t = t.withColumn("key", P.digits_key(F.col("name")))
    by = lambda c: F.row_number().over(Window.partitionBy("s_nationkey").orderBy(c, "s_suppkey")).cast("long")
    return t.select("s_suppkey", "name", "key", by("key").alias("place"), by("name").alias("lexical"))


@register("proof_fanout", f"WITH {PAGES} SELECT doc, page_number, dpi, greatest(1, floor(612.0::DOUBLE * dpi / 72 + 0.5))::BIGINT AS width, greatest(1, floor((700 + page_number) * dpi::DOUBLE / 72 + 0.5))::BIGINT AS height FROM docpages, (SELECT unnest([1, 72, 300, 600]) AS dpi)")
def proof_fanout(spark, sf_dir):
    t = pages(spark, sf_dir).select("doc", "page_number", F.explode(F.array(*[F.lit(d) for d in (1, 72, 300, 600)])).alias("dpi"))
    return t.select("doc", "page_number", "dpi", G.proof_pixels(F.lit(612.0), F.col("dpi")).alias("width"), G.proof_pixels(F.col("page_number") + F.lit(700.0), F.col("dpi")).alias("height"))


@register("output_names", f"WITH {PAGES}, d AS (SELECT unnest(['72', '300', 'native']) AS dpi) SELECT doc, page_number, dpi, 'page_' || page_number || CASE dpi WHEN 'native' THEN '_native' ELSE '_' || dpi || 'dpi' END || '.jpg' AS name FROM docpages, d UNION ALL SELECT doc, page_number, '150', 'page_' || page_number || '_proof.tif' FROM docpages")
def output_names(spark, sf_dir):
    t = pages(spark, sf_dir)
    return P.proof_names(t, ["72", "300", "native"], "jpg", "pdf").unionByName(P.proof_names(t, ["150"], "tif", "tif"))


@register("output_map_merge", f"WITH {PAGES}, f AS (SELECT doc, page_number, 'page_' || (page_number % 3)::VARCHAR || '.pdf' AS name FROM docpages) SELECT doc, name, max(page_number) AS page_number FROM f GROUP BY doc, name")
def output_map_merge(spark, sf_dir):
    t = pages(spark, sf_dir).select("doc", "page_number", F.concat(F.lit("page_"), (F.col("page_number") % 3).cast("string"), F.lit(".pdf")).alias("name"))
    return P.last_wins(t, "name", "page_number")


@register("box_fallback", """WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN [0.0, 0.0, p_size * 10.0, p_retailprice] END AS media, CASE WHEN p_partkey % 3 = 0 THEN [1.0, 1.0, p_size * 9.0, p_retailprice] END AS crop,
  CASE WHEN p_partkey % 5 = 0 THEN [2.0, 2.0, p_size * 8.0, p_retailprice] END AS bleed, CASE WHEN p_partkey % 7 = 0 THEN [3.0, 3.0, p_size * 7.0, p_retailprice] END AS trim FROM part),
f AS (SELECT p_partkey, coalesce(media, [0.0, 0.0, 612.0, 792.0]) AS m, crop, bleed, trim FROM b)
SELECT p_partkey, round(abs(m[3] - m[1]), 6)::DOUBLE AS media, round(abs(coalesce(crop, m)[3] - coalesce(crop, m)[1]), 6)::DOUBLE AS crop, round(abs(coalesce(bleed, crop, m)[3] - coalesce(bleed, crop, m)[1]), 6)::DOUBLE AS bleed,
  round(abs(coalesce(trim, bleed, crop, m)[3] - coalesce(trim, bleed, crop, m)[1]), 6)::DOUBLE AS trim, round(abs(coalesce(trim, bleed, crop, m)[4] - coalesce(trim, bleed, crop, m)[2]), 6)::DOUBLE AS height FROM f""")
def box_fallback(spark, sf_dir):
    t = table(spark, sf_dir, "part")
    box = lambda n, low, size: F.when(F.col("p_partkey") % n == 0, F.array(F.lit(low), F.lit(low), F.col("p_size") * F.lit(size), F.col("p_retailprice")))
    b = G.boxes(box(2, 0.0, 10.0), box(3, 1.0, 9.0), box(5, 2.0, 8.0), box(7, 3.0, 7.0))
    width = lambda v, i: F.round(F.abs(v[i + 2] - v[i]), 6)
    return t.select("p_partkey", *[width(v, 0).alias(n) for n, v in b.items()], width(b["trim"], 1).alias("height"))


@register("unit_to_points", """WITH u AS (SELECT p_partkey, p_size, ['in', 'cm', 'mm', 'pt', 'px', '', 'furlong', ' CM'][p_partkey % 8 + 1] AS unit FROM part)
SELECT p_partkey, p_size || '.5' || unit AS said, round(CASE trim(lower(unit)) WHEN 'in' THEN (p_size + 0.5) * 72 WHEN 'cm' THEN (p_size + 0.5) * (72 / 2.54::DOUBLE) WHEN 'mm' THEN (p_size + 0.5) * (72 / 25.4::DOUBLE) WHEN 'px' THEN (p_size + 0.5) * 0.75 WHEN 'furlong' THEN 612 ELSE p_size + 0.5 END, 6)::DOUBLE AS points FROM u""")
def unit_to_points(spark, sf_dir):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("in", "cm", "mm", "pt", "px", "", "furlong", " CM")]), (F.col("p_partkey") % 8 + 1).cast("int"))
    t = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".5"), unit).alias("said"))
    return t.select("p_partkey", "said", F.round(G.length(F.col("said")), 6).alias("points"))


@register("page_sizes", "SELECT p_partkey, round(p_size * 100 / (72.0::DOUBLE + p_size) * 72, 6) AS points, round(p_size * 1440 / 20.0::DOUBLE, 6) AS twips, round(p_partkey * 9525 / 12700.0::DOUBLE, 6) AS emu, round(p_size * 0.75::DOUBLE, 6) AS dip FROM part")
def page_sizes(spark, sf_dir):
    size = F.col("p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(G.pixels_to_points(size * 100, size + F.lit(72.0)), 6).alias("points"), F.round(size * 1440 / F.lit(20.0), 6).alias("twips"), F.round(F.col("p_partkey") * 9525 / F.lit(12700.0), 6).alias("emu"), F.round(size * F.lit(G.POINTS["dip"]), 6).alias("dip"))


# Structure

@register("spine_join", "WITH manifest AS (SELECT o_orderkey AS item, o_custkey AS entry FROM orders), spine AS (SELECT l_partkey AS book, l_linenumber AS position, l_orderkey + l_suppkey % 3 * 1000000 AS item, l_quantity FROM lineitem) SELECT s.book, s.position, s.item, c.c_name AS file, count(*) AS n FROM spine s JOIN manifest m USING (item) JOIN customer c ON c.c_custkey = m.entry GROUP BY ALL")
def spine_join(spark, sf_dir):
    manifest = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item"), F.col("o_custkey").alias("entry"))
    spine = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("book"), F.col("l_linenumber").alias("position"), (F.col("l_orderkey") + F.col("l_suppkey") % 3 * 1000000).alias("item"))
    entries = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entry"), F.col("c_name").alias("file"))
    return P.spine(spine, manifest, entries).groupBy("book", "position", "item", "file").agg(F.count("*").alias("n"))


@register("xref_newest", "SELECT o_custkey AS object, max(o_orderkey) AS revision, arg_max(o_orderstatus, o_orderkey) AS status, arg_max(o_orderpriority, o_orderkey) AS priority FROM orders GROUP BY o_custkey")
def xref_newest(spark, sf_dir):
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("object"), F.col("o_orderkey").alias("revision"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return P.newest(t, ["object"], "revision")


@register("xref_offsets", "WITH o AS (SELECT DISTINCT l_orderkey AS file, l_linenumber AS object FROM lineitem), s AS (SELECT file, object, 20 + object * 3 AS size FROM o) SELECT file, object, size, (15 + coalesce(sum(size) OVER (PARTITION BY file ORDER BY object ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS \"offset\" FROM s")
def xref_offsets(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("object")).distinct()
    return P.offsets(t.withColumn("size", F.lit(20) + F.col("object") * 3), "file", "object", "size", 15)


@register("page_tree_inherit", """WITH RECURSIVE tree AS (SELECT n_nationkey AS node, CASE WHEN n_nationkey > 0 THEN (n_nationkey - 1) // 2 END AS parent, CASE WHEN n_nationkey % 4 = 1 OR n_nationkey = 0 THEN 500 + n_nationkey END AS box FROM nation),
walk AS (SELECT node, 0 AS depth, box FROM tree WHERE parent IS NULL UNION ALL SELECT t.node, w.depth + 1, coalesce(t.box, w.box) FROM tree t JOIN walk w ON t.parent = w.node) SELECT node::BIGINT AS node, depth, box FROM walk""")
def page_tree_inherit(spark, sf_dir):
    node = F.col("n_nationkey")
    tree = table(spark, sf_dir, "nation").select(node.cast("long").alias("node"), F.when(node > 0, F.floor((node - 1) / 2)).alias("parent"), F.when((node % 4 == 1) | (node == 0), node + 500).alias("box"))
    return P.inherit(tree)


@register("latency_percentiles", "SELECT event_type, count(*) AS n, round((list_sort(list(value)))[floor(count(*) * 0.5)::BIGINT + 1], 6) AS p50, round((list_sort(list(value)))[floor(count(*) * 0.95)::BIGINT + 1], 6) AS p95, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return P.order_statistics(table(spark, sf_dir, "events").select("event_type", "value"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


HEX = "['89504E470D0A1A0A0000', 'FFD8FFE000104A46', '49492A0008000000', '4D4D002A00000008', '524946460000000057454250', '5249464600000000', '424D3600', '3842505300010000', '53514C69746520666F726D6174203300', '67696D702078636620763031', '255044462D312E34', '2521505341646F62', 'D0CF11E0A1B11AE1', '504B030414000000', '46554A4946494C4D', '004D524D', '41433130', '00000200']"


@register("format_sniff", f"WITH h AS (SELECT p_partkey, ({HEX})[p_partkey % 18 + 1] AS head FROM part) SELECT head, (['png', 'jpeg', 'tiff', 'tiff', 'webp', 'tga', 'bmp', 'psd', 'clip', 'xcf', 'pdf', 'eps', 'ole2', 'zip', 'raf', 'mrw', 'dwg', 'tga'])[min(p_partkey) % 18 + 1] AS kind, count(*) AS n FROM h GROUP BY head")
def format_sniff(spark, sf_dir):
    heads = F.array(*[F.lit(h) for h in HEX.strip("[]").replace("'", "").split(", ")])
    t = table(spark, sf_dir, "part").select(F.element_at(heads, (F.col("p_partkey") % 18 + 1).cast("int")).alias("head"))
    return t.groupBy("head", P.sniff(F.col("head")).alias("kind")).agg(F.count("*").alias("n"))


# Markup

@register("xhtml_text", r"SELECT page_id, md5(substr(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 10000)) AS text, length(substr(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')), 1, 10000)) AS n_chars FROM pages")
def xhtml_text(spark, sf_dir):
    t = table(spark, sf_dir, "pages").select("page_id", P.plain_text(F.col("html")).alias("text"))
    return t.select("page_id", F.md5("text").alias("text"), F.length("text").cast("long").alias("n_chars"))


@register("pdfx_preflight", r"""WITH t AS (SELECT l_orderkey, l_linenumber, concat('/ca ', (100 - l_quantity::BIGINT % 3 * 5), '.0 ', CASE WHEN l_partkey % 3 = 0 THEN '/S /Transparency ' ELSE '' END, CASE WHEN l_partkey % 4 = 0 THEN '/SMask /None ' WHEN l_partkey % 5 = 0 THEN '/SMask 7 0 R ' ELSE '' END,
  CASE WHEN l_suppkey % 2 = 0 THEN '/BM /Multiply ' ELSE '/BM /Normal ' END, '/CA 0.', (l_linenumber + 2)::VARCHAR) AS said, l_partkey, l_suppkey FROM lineitem)
SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_partkey % 3 = 0 THEN 'transparency group' END, CASE WHEN l_partkey % 4 <> 0 AND l_partkey % 5 = 0 THEN 'soft mask' END, CASE WHEN l_suppkey % 2 = 0 THEN 'blend mode Multiply' END, 'opacity 0.' || (l_linenumber + 2)) AS found FROM t""")
def pdfx_preflight(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    said = F.concat(
        F.lit("/ca "), (F.lit(100) - F.col("l_quantity").cast("long") % 3 * 5).cast("string"), F.lit(".0 "),
        F.when(part % 3 == 0, F.lit("/S /Transparency ")).otherwise(F.lit("")),
        F.when(part % 4 == 0, F.lit("/SMask /None ")).when(part % 5 == 0, F.lit("/SMask 7 0 R ")).otherwise(F.lit("")),
        F.when(supp % 2 == 0, F.lit("/BM /Multiply ")).otherwise(F.lit("/BM /Normal ")), F.lit("/CA 0."), (line + 2).cast("string"),
    )
    return t.select("l_orderkey", "l_linenumber", F.array_join(P.preflight(said), ",").alias("found"))


# Paths

@register("quad_to_cubic", "SELECT l_orderkey, l_linenumber, round(l_quantity + 2.0::DOUBLE / 3 * (l_tax - l_quantity), 6) AS c1, round(l_discount + 2.0::DOUBLE / 3 * (l_tax - l_discount), 6) + 0 AS c2 FROM lineitem")
def quad_to_cubic(spark, sf_dir):
    one, two = G.quadratic_to_cubic(F.col("l_quantity").cast("double"), F.col("l_tax"), F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(one, 6).alias("c1"), (F.round(two, 6) + F.lit(0.0)).alias("c2"))


CIRCLES = "c AS (SELECT p_partkey, (p_partkey % 97)::DOUBLE AS cx, (p_size * 3)::DOUBLE AS cy, p_size::DOUBLE AS r, p_size * 0.55228474980000005::DOUBLE AS k FROM part)"


def circles(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 97).cast("double").alias("cx"), (F.col("p_size") * 3).cast("double").alias("cy"), F.col("p_size").cast("double").alias("r"))
    return t.select("p_partkey", F.posexplode(G.ellipse(F.col("cx"), F.col("cy"), F.col("r"), F.col("r"))).alias("n", "c")).select("p_partkey", "n", "c.op", "c.args")


@register("circle_to_cubics", f"""WITH {CIRCLES}, a AS (SELECT p_partkey, 0 AS n, 'M' AS op, [cx + r, cy] AS args FROM c UNION ALL SELECT p_partkey, 1, 'C', [cx + r, cy + k, cx + k, cy + r, cx, cy + r] FROM c UNION ALL SELECT p_partkey, 2, 'C', [cx - k, cy + r, cx - r, cy + k, cx - r, cy] FROM c
  UNION ALL SELECT p_partkey, 3, 'C', [cx - r, cy - k, cx - k, cy - r, cx, cy - r] FROM c UNION ALL SELECT p_partkey, 4, 'C', [cx + k, cy - r, cx + r, cy - k, cx + r, cy] FROM c UNION ALL SELECT p_partkey, 5, 'Z', [] FROM c)
SELECT p_partkey, n, op, array_to_string(list_transform(args, lambda v: floor(v * 1000 + 0.5)::BIGINT), ' ') AS args FROM a""")
def circle_to_cubics(spark, sf_dir):
    milli = F.transform("args", lambda v: F.floor(v * F.lit(1000.0) + F.lit(0.5)).cast("string"))
    return circles(spark, sf_dir).select("p_partkey", "n", "op", F.array_join(milli, " ").alias("args"))


@register("path_bounds", f"WITH {CIRCLES} SELECT p_partkey, round(cx - r, 6) + 0 AS x0, round(cy - r, 6) + 0 AS y0, round(cx + r, 6) AS x1, round(cy + r, 6) AS y1 FROM c")
def path_bounds(spark, sf_dir):
    t = V.path_bounds(circles(spark, sf_dir), ["p_partkey"])
    return t.select("p_partkey", *[(F.round(n, 6) + F.lit(0.0)).alias(n) for n in ("x0", "y0", "x1", "y1")])


NUMBER = "regexp_replace(regexp_replace(printf('%.3f', round({v}, 3) + 0), '0+$', ''), '\\.$', '')"


@register("svg_path_data", "SELECT p_partkey, concat('M ', " + NUMBER.format(v="p_retailprice") + ", ' ', p_size, ' L ', " + NUMBER.format(v="p_retailprice / 7") + ", ' -', " + NUMBER.format(v="p_size / 8.0::DOUBLE") + ", ' Z') AS d FROM part")
def svg_path_data(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size")
    command = lambda op, *args: F.struct(F.lit(op).alias("op"), (F.array(*args) if args else F.array().cast("array<double>")).alias("args"))
    path = F.array(command("M", price, size.cast("double")), command("L", price / F.lit(7.0), F.lit(0.0) - size / F.lit(8.0)), command("Z"))
    return table(spark, sf_dir, "part").select("p_partkey", G.path_data(path).alias("d"))


@register("pdf_path_data", "SELECT p_partkey, printf('%.3f', p_retailprice) || ' ' || printf('%.3f', p_size::DOUBLE) || ' m' || chr(10) || printf('%.3f', p_retailprice / 7) || ' ' || printf('%.3f', -p_size / 8.0::DOUBLE) || ' l' || chr(10) || '1.000 2.000 3.000 ' || printf('%.3f', p_size / 4.0::DOUBLE) || ' 5.500 -6.000 c' || chr(10) || 'h' AS d FROM part")
def pdf_path_data(spark, sf_dir):
    price, size = F.col("p_retailprice"), F.col("p_size")
    command = lambda op, *args: F.struct(F.lit(op).alias("op"), (F.array(*args) if args else F.array().cast("array<double>")).alias("args"))
    lit = lambda v: F.lit(float(v))
    path = F.array(command("M", price, size.cast("double")), command("L", price / F.lit(7.0), F.lit(0.0) - size / F.lit(8.0)), command("C", lit(1), lit(2), lit(3), size / F.lit(4.0), lit(5.5), lit(-6)), command("Z"))
    return table(spark, sf_dir, "part").select("p_partkey", G.pdf_path(path).alias("d"))


@register("svg_rect_extract", "SELECT p_partkey, n, x, y, w AS width, h AS height FROM (SELECT p_partkey, 0 AS n, (p_partkey % 50)::DOUBLE AS x, 0.0::DOUBLE AS y, p_size / 2.0::DOUBLE AS w, 3.0::DOUBLE AS h FROM part UNION ALL SELECT p_partkey, 1, 0, -1.5, (p_partkey % 3)::DOUBLE, p_size FROM part) WHERE w > 0 AND h > 0")
def svg_rect_extract(spark, sf_dir):
    s = lambda c: c.cast("string")
    svg = F.concat(F.lit('<svg><rect x="'), s(F.col("p_partkey") % 50), F.lit('" width="'), s(F.col("p_size") / F.lit(2.0)), F.lit('" height="3"/><circle r="4"/><rect y="-1.5" width="'), s(F.col("p_partkey") % 3), F.lit('" height="'), s(F.col("p_size")), F.lit('"></rect></svg>'))
    return V.svg_rects(table(spark, sf_dir, "part").select("p_partkey", svg.alias("svg")), ["p_partkey"], "svg")


def path_text():
    s = lambda c: c.cast("string")
    return F.concat(F.lit("m "), s(F.col("p_size")), F.lit(" 20 l 5-5.5 h"), s(F.col("p_partkey") % 10), F.lit(" V -2 Q 1 1 4,4 t2 2 c 1 1 2 2 3 3 S"), s(F.col("p_size")), F.lit(" 1 2 .5 a 3 3 0 0 1 6 6 z"))


@register("svg_path_tokens", "SELECT p_partkey, unnest(range(10))::INT AS n, unnest(['m', 'l', 'h', 'V', 'Q', 't', 'c', 'S', 'a', 'z']) AS op, unnest([p_size || '.0 20.0', '5.0 -5.5', p_partkey % 10 || '.0', '-2.0', '1.0 1.0 4.0 4.0', '2.0 2.0', '1.0 1.0 2.0 2.0 3.0 3.0', p_size || '.0 1.0 2.0 0.5', '3.0 3.0 0.0 0.0 1.0 6.0 6.0', '']) AS args FROM part")
def svg_path_tokens(spark, sf_dir):
    t = V.path_tokens(table(spark, sf_dir, "part").select("p_partkey", path_text().alias("d")), ["p_partkey"], "d")
    return t.select("p_partkey", "n", "op", F.array_join(F.transform("args", lambda v: v.cast("string")), " ").alias("args"))


@register("svg_path_resolve", "WITH p AS (SELECT p_partkey, p_size::DOUBLE AS x, (p_partkey % 10)::DOUBLE AS h FROM part), q AS (SELECT *, x + 5 + h AS hx FROM p) SELECT p_partkey, 10 AS commands, 'MLLLCCCCLZ' AS ops, round(hx + 2.0::DOUBLE / 3 * (1 - hx), 4) AS quad, 7.0::DOUBLE AS t_control, 11.0::DOUBLE AS s_control, round(2.0::DOUBLE + 6, 4) AS arc FROM q")
def svg_path_resolve(spark, sf_dir):
    t = table(spark, sf_dir, "part").select("p_partkey", V.resolve_path(path_text()).alias("c"))
    arg = lambda i, j: F.round(F.get(F.get("c", F.lit(i))["args"], F.lit(j)), 4)
    mirrored = F.lit(2.0) * F.get(F.get("c", F.lit(4))["args"], F.lit(4)) - F.lit(1.0)
    return t.select("p_partkey", F.size("c").alias("commands"), F.array_join(F.transform("c", lambda c: c["op"]), "").alias("ops"), arg(4, 0).alias("quad"), F.round(mirrored, 4).alias("t_control"), (arg(6, 4) * 2 - arg(6, 2) + F.lit(1.0)).alias("s_control"), arg(8, 0).alias("arc"))


@register("dxf_extents_fit", """WITH e AS (SELECT l_orderkey, min(l_quantity)::DOUBLE AS x0, max(l_quantity)::DOUBLE AS x1, min(l_partkey)::DOUBLE AS y0, max(l_partkey)::DOUBLE AS y1 FROM lineitem GROUP BY l_orderkey),
s AS (SELECT *, CASE WHEN x1 <= x0 THEN 100 ELSE x1 - x0 END AS w, CASE WHEN y1 <= y0 THEN 100 ELSE y1 - y0 END AS h FROM e), f AS (SELECT *, least(2448 / w, 1584 / h) AS k FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, round(72 + (2448 - w * k) / 2 + (l_quantity - x0) * k, 4) AS fx, round(72 + (1584 - h * k) / 2 + (l_partkey - y0) * k, 4) AS fy FROM lineitem JOIN f USING (l_orderkey)""")
def dxf_extents_fit(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    t = V.fit(t, ["l_orderkey"], "l_quantity", "l_partkey", 2592.0, 1728.0)
    return t.select("l_orderkey", "l_linenumber", "l_partkey", F.round("fx", 4).alias("fx"), F.round("fy", 4).alias("fy"))
