import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from plateflow.functions import blend, color, geometry, ink
from plateflow.operators import clut, packed
from plateflow.operators import layers as L
from plateflow.operators import pages as P
from plateflow.operators import raster as R
from plateflow.operators import vector as V
from plateflow.operators.resample import resample
from plateflow.plans.convert import Options, apart, convert, device_link_array, report
from plateflow.plans.queries import QUERIES, SQL
from plateflow.sources import images, jpeg, pdf, raster_files
from plateflow.sources.model import Image
from plateflow.sinks.files import save

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return db


def plain(v):
    return round(v + 0.0, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert len(got) == len(want) > 0
    assert got == want


def value(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def lits(*v):
    return tuple(F.lit(float(x)) for x in v)


# Pairs from Sharma, Wu and Dalal (2005).
PAIRS = [(50, 2.6772, -79.7751, 50, 0, -82.7485, 2.0425), (50, 3.1571, -77.2803, 50, 0, -82.7485, 2.8615), (50, -1.3802, -84.2814, 50, 0, -82.7485, 1.0), (50, 0, 0, 50, -1, 2, 2.3669), (50, 2.49, -0.001, 50, -2.49, 0.0009, 7.1792), (50, 2.49, -0.001, 50, -2.49, 0.0011, 7.2195), (50, -0.001, 2.49, 50, 0.0009, -2.49, 4.8045), (50, 2.5, 0, 73, 25, -18, 27.1492), (50, 2.5, 0, 50, 3.2592, 0.335, 1.0), (60.2574, -34.0099, 36.2677, 60.4626, -34.1751, 39.4387, 1.2644), (22.7233, 20.0904, -46.694, 23.0331, 14.973, -42.5619, 2.0373), (2.0776, 0.0795, -1.135, 0.9033, -0.0636, -0.5514, 0.9082)]


def test_ciede2000(spark):
    df = spark.createDataFrame([tuple(map(float, p)) for p in PAIRS], "l1 double, a1 double, b1 double, l2 double, a2 double, b2 double, want double")
    one, two = ([F.col(f"{c}{i}") for c in "lab"] for i in (1, 2))
    for r in df.select("want", color.ciede2000(tuple(one), tuple(two)).alias("got")).collect():
        assert abs(r["got"] - r["want"]) < 1e-4


@pytest.mark.parametrize(("inks", "percent", "want"), [((0.6, 0.4, 0.3, 0.1), 300, (0.6, 0.4, 0.3, 0.1)), ((1, 1, 1, 1), 300, (2 / 3, 2 / 3, 2 / 3, 1)), ((0, 0, 0, 1), 50, (0, 0, 0, 0.5))])
def test_limits(spark, inks, percent, want):
    got = value(spark, *ink.limit(lits(*inks), percent))
    assert np.allclose(list(got), want) and sum(got) <= percent / 100 + 1e-9


def test_nan_is_clamped_low(spark):
    from plateflow.functions.numeric import clamp, half_up

    assert list(value(spark, clamp(F.lit(math.nan)), clamp(F.lit(2.0)), half_up(F.lit(-2.5)), half_up(F.lit(2.5)))) == [0.0, 1.0, -2, 3]


@pytest.mark.parametrize(("mode", "b", "s", "want"), [("multiply", 0.5, 0.5, 0.25), ("screen", 0.5, 0.5, 0.75), ("darken", 0.3, 0.7, 0.3), ("lighten", 0.3, 0.7, 0.7), ("difference", 0.8, 0.3, 0.5), ("exclusion", 0.5, 0.5, 0.5), ("overlay", 0.25, 0.5, 0.25), ("soft_light", 0.5, 0.5, 0.5), ("color_dodge", 0.0, 1.0, 0.0), ("color_burn", 1.0, 0.0, 1.0), ("unknown", 0.1, 0.9, 0.9)])
def test_blends(spark, mode, b, s, want):
    assert abs(value(spark, blend.blend(mode, *lits(b, s)))[0] - want) < 1e-9
    assert abs(value(spark, blend.blend_by(F.lit(mode), *lits(b, s)))[0] - want) < 1e-9
    assert np.isclose(packed.MODES.get(mode, packed.MODES["normal"])(np.array(b), np.array(s)), want)


def test_alpha(spark):
    got = value(spark, blend.union_alpha(*lits(0.5, 0.5)), blend.source_over(*lits(0.0, 0.5, 1.0, 0.5)), blend.blend_alpha("multiply", *lits(1.0, 1.0, 0.5, 0.5)))
    assert np.allclose(list(got), [0.75, 2 / 3, 0.75])


def test_spots_and_overprint(spark):
    assert np.allclose(list(value(spark, *ink.spot(F.lit(0.5), lits(*ink.SPOTS["PANTONE 185 C"])))), [0, 0.465, 0.395, 0])
    assert list(value(spark, *ink.overprint(lits(0.7, 0.2, 0, 0), lits(0, 0, 0, 1)))) == [0.7, 0.2, 0, 1]
    assert list(value(spark, *ink.overprint(lits(0.7, 0.2, 0, 0), lits(0, 0, 0, 1), active=False))) == [0, 0, 0, 1]


def test_round_trips_of_colour(spark):
    rows = [(r / 7, g / 7, b / 7) for r in range(8) for g in range(8) for b in range(8)]
    df = spark.createDataFrame(rows, "r double, g double, b double")
    xyz = color.rgb_to_xyz(tuple(F.col(c) for c in "rgb"))
    back = color.lab_to_xyz(color.xyz_to_lab(xyz))
    worst = df.select(*[F.max(F.abs(a - b)) for a, b in zip(xyz, back)]).first()
    assert max(worst) < 0.02
    for c in (color.SRGB, color.Parametric(0, 1.8), color.Parametric(4, 2.2, 0.9, 0.05, 0.1, 0.05, 0.02, 0.01)):
        low, high = df.select(F.min(c.invert(c.evaluate(F.col("r"))) - F.col("r")), F.max(c.invert(c.evaluate(F.col("r"))) - F.col("r"))).first()
        assert -0.01 < low <= high < 0.01


def test_device_link_plans_agree(spark):
    link = device_link_array(spark, 300.0)
    rgb = np.random.default_rng(5).integers(0, 256, (500, 3)).astype(np.uint8)
    df = spark.createDataFrame([(i, *map(int, v)) for i, v in enumerate(rgb)], "i int, r int, g int, b int")
    p, inks = clut.apply_device_link(df, clut.device_link(spark), tuple(F.col(c) for c in "rgb"))
    got = np.array([list(r) for r in p.select(*[v.alias(n) for v, n in zip(inks, "cmyk")], "i").orderBy("i").drop("i").collect()])
    assert (got == packed.apply_link(link, rgb)).all()
    assert link.astype(int).sum(axis=1).max() <= 3 * 255 + 2 and link[-1].max() < 13  # white has hardly any ink


def test_resampling_plans_agree(spark):
    rng = np.random.default_rng(6)
    arrays = {i: rng.integers(0, 256, (h, w)).astype(np.uint8) for i, (h, w) in enumerate([(9, 13), (17, 6)])}
    px = spark.createDataFrame([(i, y, x, int(a[y, x])) for i, a in arrays.items() for y in range(a.shape[0]) for x in range(a.shape[1])], "image int, y long, x long, v long")
    sizes = spark.createDataFrame([(i, a.shape[1], a.shape[0], 7, 11) for i, a in arrays.items()], "image int, width long, height long, to_width long, to_height long")
    for k in (None, "mitchell", "box"):
        got = {(r["image"], r["y"], r["x"]): r["v"] for r in resample(px, sizes, k).collect()}
        for i, a in arrays.items():
            want = packed.resample(Image(a.shape[1], a.shape[0], 1, a.tobytes(), color_space="GRAY"), 7, 11, k).array()[:, :, 0]
            assert all(got[i, y, x] == want[y, x] for y in range(11) for x in range(7))


@pytest.mark.parametrize("pattern", R.PATTERNS)
def test_demosaicing_plans_agree(spark, pattern):
    cells = np.random.default_rng(7).integers(0, 256, (6, 4))
    df = spark.createDataFrame([(1, [float(v) for v in cells.ravel()])], "image int, cells array<double>")
    got = {(r["y"], r["x"]): (r["r"], r["g"], r["b"]) for r in R.demosaic(df, pattern, 4, 6, 10, 250, (1.2, 1.0, 1.5)).collect()}
    want = packed.demosaic(cells, pattern, 10, 250, (1.2, 1.0, 1.5))
    assert all(got[y, x] == tuple(want[y, x]) for y in range(6) for x in range(4))


def test_transforms_undo_each_other(spark):
    rng = np.random.default_rng(8)
    rows = [(b, y, x, int(rng.integers(0, 256))) for b in range(3) for y in range(8) for x in range(8)]
    df = spark.createDataFrame(rows, "block int, y int, x int, v long")
    assert {(r["block"], r["y"], r["x"]): r["s"] for r in R.idct(R.dct8(df)).collect()} == {r[:3]: r[3] for r in rows}
    lines = df.withColumnRenamed("block", "image")
    assert sorted(map(tuple, R.undo_predictor(R.apply_predictor(lines)).collect())) == sorted(rows)


LAYER = "image long, z int, x0 long, y0 long, w long, h long, opacity double, mode string, visible boolean, clipping boolean, v long"


def test_compositing(spark):
    rows = [(1, 1, 0, 0, 2, 1, 1.0, "normal", True, False, 0), (1, 2, 1, 0, 3, 1, 1.0, "normal", True, True, 255), (1, 3, 0, 0, 9, 1, 0.5, "multiply", False, False, 0), (2, 1, 0, 0, 4, 4, 0.5, "normal", True, False, 0)]
    got = {(r["image"], r["x"]): r["v"] for r in L.composite(spark.createDataFrame(rows, LAYER), [(0, 0), (1, 0), (2, 0)]).collect()}
    assert got == {(1, 0): 0, (1, 1): 255, (1, 2): 255, (2, 0): 128, (2, 1): 128, (2, 2): 128}


def test_regions(spark):
    rows = [(1, 1, 10, 10, 50, 50, 0.5, "normal", True, False, 0), (1, 2, 30, 30, 50, 50, 1.0, "multiply", True, False, 0), (2, 1, 0, 0, 9, 9, 1.0, "normal", False, False, 0)]
    t = L.merge_regions(L.regions(spark.createDataFrame(rows, LAYER), 100, 100)).collect()
    assert {i: sum(r["w"] * r["h"] for r in t if r["image"] == i) for i in (1, 2)} == {1: 10_000, 2: 10_000}
    both = [r for r in t if list(r["layers"]) == [1, 2]]
    assert sum(r["w"] * r["h"] for r in both) == 900 and all(r["transparent"] for r in both)
    assert [(r["w"], r["h"], r["layers"], r["transparent"]) for r in t if r["image"] == 2] == [(100, 100, [], False)]


def test_names_and_selection(spark):
    df = spark.createDataFrame([(n,) for n in ("page_10", "Page_2", "page_1", "page_2b")], "n string")
    assert [r["n"] for r in df.orderBy(P.natural_key(F.col("n"))).collect()] == ["page_1", "Page_2", "page_2b", "page_10"]
    assert value(spark, P.page_numbers(F.lit("1,3,5-8, 9-7,x,12-")))[0] == [1, 3, 5, 6, 7, 8]
    t = spark.createDataFrame([(1, n) for n in (1, 2, 3)], "doc int, page_number long")
    assert [r["page_number"] for r in P.select_pages(t, [3, 1, 3]).orderBy("position").collect()] == [3, 1, 3]
    found = value(spark, P.preflight(F.lit("/Group << /S /Transparency >> /SMask 4 0 R /ca .5 /BM /Normal")))[0]
    assert found == ["transparency group", "soft mask", "opacity .5"] and value(spark, P.preflight(F.lit("/SMask /None /CA 1")))[0] == []


def test_paths(spark):
    got = value(spark, V.resolve_path(F.lit("M0 0 C 10 20 30 40 50 60 S 90 100 110 120 m 1 1 2 2 z")))[0]
    from plateflow.sources.vector_files import path

    assert [(c["op"], list(c["args"])) for c in got] == path("M0 0 C 10 20 30 40 50 60 S 90 100 110 120 m 1 1 2 2 z")
    assert value(spark, geometry.path_data(V.resolve_path(F.lit("m 10 20 l 5.5 5 h 10 v -5.1239 z"))))[0] == "M 10 20 L 15.5 25 L 25.5 25 L 25.5 19.876 Z"


# From files to files

@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("files")
    rgb = np.random.default_rng(9).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    image = Image(30, 20, 3, rgb.tobytes(), dpi_x=100, dpi_y=100)
    (base / "a.png").write_bytes(raster_files.write_png(image))
    (base / "b.jpg").write_bytes(jpeg.encode(image))
    (base / "c.svg").write_text('<svg width="10" height="20"><rect width="3" height="4"/></svg>')
    (base / "broken.png").write_bytes(raster_files.write_png(image)[:60])
    from plateflow.sinks.pdfx import page_of, write_pdf

    pages = [page_of(Image(30, 20, 3, bytes([i * 40] * 1800), dpi_x=100, dpi_y=100), i + 1) for i in range(3)]
    (base / "d.pdf").write_bytes(write_pdf(pages, "x-4", "Three"))
    return base


def test_sources(spark, folder):
    files = images.files(spark, str(folder))
    name = F.substring_index("path", "/", -1)
    kinds = {r["n"]: r["kind"] for r in images.kinds(files).select(name.alias("n"), "kind").collect()}
    assert kinds == {"a.png": "png", "b.jpg": "jpeg", "broken.png": "png", "c.svg": "svg", "d.pdf": "pdf"}
    got = {r["n"]: r for r in images.images(files).select(name.alias("n"), "*").collect()}
    assert got["a.png"]["width"] == 30 and got["broken.png"]["error"] and "Unsupported" in got["c.svg"]["error"]
    pages = images.pages(files.where("path LIKE '%.pdf'")).orderBy("page_number").collect()
    assert [(p["title"], p["page_number"], p["media"][2]) for p in pages] == [("Three", i, 21.6) for i in (1, 2, 3)]
    assert images.path_commands(files.where("path LIKE '%.svg'")).count() == 5
    px = images.pixels(images.images(files.where("path LIKE '%a.png'")))
    first = px.where("y = 0 AND x = 0").first()
    assert px.count() == 600 and first["v"] == list(got["a.png"]["data"][:3])


def made(spark, folder, pattern, **options):
    rows = convert(images.files(spark, str(folder), pattern), Options(**options)).collect()
    assert not [r["error"] for r in rows if r["error"]]
    return {r["filename"]: bytes(r["content"]) for r in rows}


def test_convert(spark, folder, tmp_path):
    one = made(spark, folder, "a.png")
    assert list(one) == ["image.pdf"] and pdf.read_pages(one["image.pdf"])[1][0].image.color_space == "CMYK"
    plates = made(spark, folder, "a.png", format="tiffsep", job="j")
    assert sorted(plates) == ["j_Black.tif", "j_Cyan.tif", "j_Magenta.tif", "j_Yellow.tif"]
    split = made(spark, folder, "d.pdf", split=True, proofs=(72, "native"), pages=(3, 1))
    assert sorted(split) == ["page_1.pdf", "page_1_72dpi.jpg", "page_1_native.jpg", "page_3.pdf", "page_3_72dpi.jpg", "page_3_native.jpg"]
    assert jpeg.decode(split["page_1_72dpi.jpg"]).width == 22 and jpeg.decode(split["page_3_native.jpg"]).width == 30
    whole = made(spark, folder, "d.pdf")
    assert len(pdf.read_pages(whole["document.pdf"])[1]) == 3
    assert sorted(made(spark, folder, "d.pdf", format="jpeg", dpi=72)) == ["page_1.jpg", "page_2.jpg", "page_3.jpg"]
    rows = convert(images.files(spark, str(folder)), Options(format="tiff"))
    errors = {r["path"].rpartition("/")[2] for r in rows.where("error IS NOT NULL").collect()}
    assert errors == {"broken.png", "c.svg"}
    named = apart(rows.where("error IS NULL"))
    save(named, f"file://{tmp_path}")
    (place,) = [r["filename"] for r in named.where("path LIKE '%a.png'").collect()]
    assert place.startswith("a-") and raster_files.tiff((tmp_path / place).read_bytes()).width == 30
    with pytest.raises(Exception, match="several outputs are named"):
        save(rows.where("error IS NULL"), f"file://{tmp_path}/twice")
    assert '"name":"image.tif"' in report(rows).where("path LIKE '%a.png'").first()["report"]


def test_pages_as_tasks(spark, folder):
    """Each page on its own gives the very bytes that the whole document gives."""
    from plateflow.plans.convert import convert_pages

    files = images.files(spark, str(folder))
    options = Options(format="pdf/x-4", split=True, proofs=(72,))
    rows = lambda t: sorted((r["path"], r["filename"] or "", r["content"] and bytes(r["content"]), bool(r["error"])) for r in t.collect())
    many = [r for r in rows(convert_pages(files, options, tasks=5))]
    assert [r for r in many if r[0].endswith(".pdf")] == [r for r in rows(convert(files, options)) if r[0].endswith(".pdf")]
    assert len([r for r in many if r[0].endswith(".pdf")]) == 6 and [r[3] for r in many if "broken" in r[0]] == [True]


def test_vectors_are_written(spark, folder):
    """A drawing's paths become strokes of the print file, in both kinds; y is turned."""
    for kind, black in (("pdf/x-1a", "0 0 0 1 K"), ("pdf/x-4", "0 0 0 RG")):
        (page,) = pdf.read_pages(made(spark, folder, "c.svg", format=kind)["document.pdf"])[1]
        assert black in page.text and "1 0 0 -1 0" in page.text and page.text.count(" m\n") == page.text.count("S") >= 1


def test_layers_without_samples_are_an_error(spark, tmp_path):
    from plateflow.plans import fixtures

    (tmp_path / "x.xcf").write_bytes(fixtures.xcf(10, 10, 72.0, [("a", 0, 0, 10, 10, 255, True)]))
    (r,) = convert(images.files(spark, str(tmp_path)), Options()).collect()
    assert r["error"].startswith("Unsupported")


def test_own_kernels_limits_and_profiles(spark, folder):
    from plateflow.sources import icc

    flat = lambda x: np.where(np.abs(x) < 1, 1.0, 0.0)
    assert made(spark, folder, "a.png", kernel=(1.0, flat), dpi=50.0, threshold=60.0)
    black = lambda t: t.select(*[c for c in t.columns if c not in "cmy"], *[F.lit(0.0).alias(c) for c in "cmy"])
    image = pdf.read_pages(made(spark, folder, "a.png", limiter=black)["image.pdf"])[1][0].image
    assert image.array()[:, :, :3].max() == 0
    line = b"curv\0\0\0\0" + (0).to_bytes(4, "big")
    source = icc.build("RGB", "XYZ", "mntr", {f"{c}TRC": line for c in "rgb"} | {"rXYZ": icc.xyz_tag((0.4361, 0.2225, 0.0139)), "gXYZ": icc.xyz_tag((0.3851, 0.7169, 0.0971)), "bXYZ": icc.xyz_tag((0.1431, 0.0606, 0.7139))})
    straight = lambda n: np.tile(np.arange(256, dtype=np.uint8), n).tobytes()
    grid = np.zeros((2, 2, 2, 4), np.uint8)
    grid[0, :, :, 3] = 255  # black where there is no light, and nothing else
    import struct

    lut = b"mft1\0\0\0\0" + bytes([3, 4, 2, 0]) + struct.pack(">9i", *[65_536, 0, 0, 0, 65_536, 0, 0, 0, 65_536]) + straight(3) + grid.tobytes() + straight(4)
    target = icc.build("CMYK", "Lab", "prtr", {"B2A0": lut})
    image = pdf.read_pages(made(spark, folder, "a.png", source_profile=source, target_profile=target)["image.pdf"])[1][0].image
    rgb = raster_files.png((folder / "a.png").read_bytes()).array() / 255
    y = rgb @ [0.2225, 0.7169, 0.0606]
    light = np.where(y > 216 / 24389, 116 * np.cbrt(y) - 16, y * 24389 / 27) / 100
    assert image.array()[:, :, :3].max() == 0 and np.abs(image.array()[:, :, 3] / 255 - (1 - light)).max() < 0.05


def test_selection_of_pages_that_are_not_there(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "doc int, page_number long")
    assert P.select_pages(df, [1, 1], strict=True).count() == 4
    with pytest.raises(Exception, match="lacks some of the pages"):
        P.select_pages(df, [1, 2], strict=True).collect()


def test_limits_in_steps(spark):
    """The plan over pixels, the Column expression and the packed plan have one result."""
    rng = np.random.default_rng(4)
    v = rng.random((300, 4))
    df = spark.createDataFrame([tuple(map(float, r)) for r in v], "c double, m double, y double, k double")
    from plateflow.operators.plates import limit_inks

    got = np.array([tuple(r) for r in limit_inks(df, 240.0).collect()])
    want = np.array([tuple(r) for r in df.select(*ink.limit(tuple(F.col(c) for c in "cmyk"), 240.0)).collect()])
    assert np.allclose(got, want) and np.allclose(packed.limit_inks(v.copy(), 240.0), want) and got.sum(axis=1).max() <= 2.4 + 1e-9


def test_page_that_is_not_there(spark, folder):
    (r,) = convert(images.files(spark, str(folder), "d.pdf"), Options(pages=(9,))).collect()
    assert "no pages [9]" in r["error"]


def test_stream(spark, folder, tmp_path):
    from plateflow.streaming import feed

    q = feed.convert_arrivals(spark, str(folder), f"file://{tmp_path}/out", f"{tmp_path}/state", Options(format="pdf/x-4"))
    q.awaitTermination()
    assert sorted(p.parent.name.partition("-")[0] for p in (tmp_path / "out").glob("*/*.pdf") if not p.name.startswith(".")) == ["a", "b", "c", "d"]
    q = feed.images(spark, str(folder)).writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT * FROM arrived WHERE error IS NULL").count() == 2


def test_driver_contract():
    import importlib

    entry = importlib.import_module("__spark_entry__")
    assert set(SQL) <= set(entry.oracle_sql()) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_command_line(spark, folder, tmp_path):
    from plateflow.__main__ import arguments, main, page_numbers

    assert page_numbers("1,3,5-8, x,9-7,2") == (1, 3, 5, 6, 7, 8, 2)
    a = arguments(["in", "out", "--tac", "newsprint", "--proofs", "72,native"])
    assert (a.tac, a.proofs) == (240.0, (72, "native"))
    a = arguments(["-i", "in", "--output", "out", "-p", "-j", "4", "--page", "2", "--keep-resolution"])
    assert (a.input, a.output, a.proofs, a.parallel, a.pages, a.keep_resolution) == ("in", "out", (72,), 4, (2,), True)
    a = arguments(["-dBATCH", "-dSAFER", "-q", "-sDEVICE=tiffsep", "-r150x150", "-dFirstPage=2", "-dLastPage=4", "-dJPEGQ=70", "-sOutputFile=out", "in"])
    assert (a.input, a.output, a.format, a.dpi, a.pages, a.quality, a.quiet) == ("in", "out", "tiffsep", 150.0, (2, 3, 4), 70, True)
    assert arguments(["-dPDFSETTINGS=/screen", "-sDEVICE=tiff24nc", "-dLastPage=3", "a", "b"]).format == "tiff"
    with pytest.raises(SystemExit):
        arguments(["only-one"])
    assert main([str(folder / "d.pdf"), f"file://{tmp_path}", "--format", "pdf/x-4", "--split"]) == 0
    assert sorted(p.name for p in tmp_path.glob("d-*/*") if not p.name.startswith(".")) == ["page_1.pdf", "page_2.pdf", "page_3.pdf"]
