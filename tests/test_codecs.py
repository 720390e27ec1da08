import io
import random
import sqlite3
import struct
import zipfile
import zlib

import numpy as np
import pytest

from plateflow.operators import packed
from plateflow.sinks import pdfx
from plateflow.sinks.tiff import write_plates, write_tiff
from plateflow.sources import compression as C
from plateflow.sources import fonts, icc, images, jpeg, layered_files, office, pdf, raster_files, raw_files, vector_files
from plateflow.sources.containers import Archive, safe_name, sqlite_tables
from plateflow.sources.model import Damaged, Image, Unsupported


def picture(w=37, h=21, channels=3, bits=8, space="RGB", dpi=300):
    y, x = np.mgrid[0:h, 0:w]
    planes = np.stack([(x * (7 + c) + y * (5 - c)) % 256 for c in range(channels)], axis=2)
    data = planes.astype(np.uint8).tobytes() if bits == 8 else (planes * 257).astype(">u2").tobytes()
    return Image(w, h, channels, data, bits, space, dpi, dpi, channels in (2, 4) and space != "CMYK")


def zipped(entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in entries:
            z.writestr(name, data)
    return out.getvalue()


# Compression

def test_packbits():
    rng = random.Random(1)
    for _ in range(50):
        data = bytes(rng.choice([0, 0, 0, 7, 255]) for _ in range(rng.randrange(400)))
        assert C.packbits(C.pack(data)) == data
    assert C.packbits(bytes([2, 1, 2, 3, 254, 9, 128, 0, 5])) == b"\1\2\3\x09\x09\x09\5"
    assert C.packbits(bytes([0, 5, 128, 0, 6]), end_mark=True) == b"\5"


def lzw_encode(data):
    """TIFF's LZW the other way, for the test."""
    table, out, before = {bytes([i]): i for i in range(256)}, [], b""
    width, bits = 9, []
    put = lambda code, n: bits.append(format(code, f"0{n}b"))
    put(256, 9)
    size = 258
    for b in data:
        now = before + bytes([b])
        if now in table:
            before = now
            continue
        put(table[before], width)
        table[now] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256, 12)
            table, size, width = {bytes([i]): i for i in range(256)}, 258, 9
        before = bytes([b])
    if before:
        put(table[before], width)
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257, width)
    text = "".join(bits)
    text += "0" * (-len(text) % 8)
    out = int(text, 2).to_bytes(len(text) // 8, "big")
    return out


def test_lzw():
    rng = random.Random(2)
    for n in (0, 1, 300, 20_000):
        data = bytes(rng.choice(b"abcd") for _ in range(n))
        assert C.lzw(lzw_encode(data)) == data


def test_inflate():
    raw = b"some bytes " * 100
    packer = zlib.compressobj(wbits=-15)
    assert C.inflate(zlib.compress(raw)) == raw == C.inflate(packer.compress(raw) + packer.flush())
    assert raw.startswith(C.inflate(zlib.compress(raw)[:-20])[:50])
    with pytest.raises(Damaged):
        C.inflate(b"\xff\xff\xff nothing")


# Rasters

@pytest.mark.parametrize(("channels", "bits"), [(1, 8), (2, 8), (3, 8), (4, 8), (3, 16), (1, 16)])
def test_png(channels, bits):
    image = picture(channels=channels, bits=bits, space="GRAY" if channels < 3 else "RGB", dpi=150)
    got = raster_files.png(raster_files.write_png(image))
    assert (got.width, got.height, got.channels, got.bits, got.data, got.dpi_x) == (37, 21, channels, bits, image.data, 150)


def png_file(width, height, depth, color, rows, extra=b""):
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, color, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_filters():
    rng = np.random.default_rng(3)
    raw = rng.integers(0, 256, (10, 12), dtype=np.uint8)
    rows = b""
    for y, line in enumerate(raw.astype(int)):
        kind = y % 5
        up = raw[y - 1].astype(int) if y else np.zeros(12, int)
        left, corner = np.r_[0, 0, 0, line[:-3]], np.r_[0, 0, 0, up[:-3]]
        p = left + up - corner
        paeth = np.where((abs(p - left) <= abs(p - up)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - up) <= abs(p - corner), up, corner))
        rows += bytes([kind]) + ((line - [0 * line, left, up, (left + up) // 2, paeth][kind]) & 255).astype(np.uint8).tobytes()
    assert raster_files.png(png_file(4, 10, 8, 2, rows)).data == raw.tobytes()


def test_png_depths_palette_and_damage():
    assert raster_files.png(png_file(4, 1, 1, 0, b"\0\xa0")).data == bytes([255, 0, 255, 0])
    assert raster_files.png(png_file(4, 1, 2, 0, b"\0\x1b")).data == bytes([0, 85, 170, 255])
    plte = struct.pack(">I", 6) + b"PLTE" + b"\1\2\3\4\5\6" + struct.pack(">I", zlib.crc32(b"PLTE\1\2\3\4\5\6"))
    assert raster_files.png(png_file(2, 1, 8, 3, b"\0\1\0", plte)).data == b"\4\5\6\1\2\3"
    raw = raster_files.write_png(picture())
    for cut in (0, 1, 2, 4, 8, 16, 32, len(raw) // 2, len(raw) - 30):
        with pytest.raises((Damaged, struct.error, ValueError)):
            raster_files.png(raw[:cut])
    broken = bytearray(raw)
    broken[60] ^= 255
    with pytest.raises(Damaged):
        raster_files.png(bytes(broken))
    with pytest.raises(Damaged):
        raster_files.png(png_file(70_000, 70_000, 8, 2, b""))


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize(("channels", "bits", "space"), [(1, 8, "GRAY"), (3, 8, "RGB"), (4, 8, "RGB"), (4, 8, "CMYK"), (3, 16, "RGB")])
def test_tiff(channels, bits, space, compress):
    image = picture(channels=channels, bits=bits, space=space, dpi=225)
    image.icc = b"profile bytes"
    got = raster_files.tiff(write_tiff(image, compress))
    assert (got.data, got.color_space, got.bits, got.dpi_x, got.icc, got.alpha) == (image.data, space, bits, 225, b"profile bytes", image.alpha)


def tiff_file(order, tags, body):
    entries = b"".join(struct.pack(order + "HHI", t, k, n) + v for t, k, n, v in sorted(tags))
    mark = b"II" if order == "<" else b"MM"
    return mark + struct.pack(order + "HI", 42, 8 + len(body)) + body + struct.pack(order + "H", len(tags)) + entries + bytes(4)


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize(("packing", "predictor"), [(1, 1), (5, 2), (8, 2), (32773, 1)])
def test_tiff_packings(order, packing, predictor):
    gray = np.arange(60, dtype=np.uint8).reshape(6, 10) ** 2
    raw = np.diff(gray, axis=1, prepend=np.uint8(0)) if predictor == 2 else gray
    body = {1: bytes, 5: lzw_encode, 8: zlib.compress, 32773: C.pack}[packing](raw.tobytes())
    short = lambda v: struct.pack(order + "HH", v, 0)
    long = lambda v: struct.pack(order + "I", v)
    tags = [(256, 3, 1, short(10)), (257, 3, 1, short(6)), (258, 3, 1, short(8)), (259, 3, 1, short(packing)), (262, 3, 1, short(0)), (273, 4, 1, long(8)), (279, 4, 1, long(len(body))), (317, 3, 1, short(predictor))]
    assert raster_files.tiff(tiff_file(order, tags, body)).data == (255 - gray).tobytes()


def test_bmp_and_tga():
    image = picture(5, 3)
    rgb = image.array()
    rows = b"".join(line[:, ::-1].tobytes() + b"\0" for line in rgb[::-1])
    head = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 54 + len(rows), 0, 0, 54, 40, 5, 3, 1, 24, 0, len(rows), 2835, 2835, 0, 0)
    got = raster_files.bmp(head + rows)
    assert got.data == image.data and got.dpi_x == 72
    assert raster_files.bmp(head.replace(struct.pack("<i", 3), struct.pack("<i", -3), 1) + rows).data == rgb[::-1].tobytes()
    assert raster_files.bmp((head + rows)[:-16]).data[: 5 * 3] == bytes(15)
    tga = struct.pack("<BBBHHBHHHHBB", 0, 0, 2, 0, 0, 0, 0, 0, 5, 3, 24, 0x20) + rgb[:, :, ::-1].tobytes()
    assert raster_files.tga(tga).data == image.data
    runs = struct.pack("<BBBHHBHHHHBB", 0, 0, 11, 0, 0, 0, 0, 0, 6, 1, 8, 0x20) + bytes([0x83, 9, 1, 4, 5])
    assert raster_files.tga(runs).data == bytes([9, 9, 9, 9, 4, 5])
    mapped = struct.pack("<BBBHHBHHHHBB", 0, 1, 1, 0, 2, 24, 0, 0, 2, 1, 8, 0x20) + b"\3\2\1\6\5\4" + b"\1\0"
    assert raster_files.tga(mapped).data == b"\4\5\6\1\2\3"


def test_webp_size():
    raw = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\x10\0\0\0" + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert raster_files.webp_size(raw) == (100, 50, True)
    with pytest.raises(Unsupported):
        raster_files.webp(raw)


# JPEG

@pytest.mark.parametrize(("channels", "space"), [(1, "GRAY"), (3, "RGB"), (4, "CMYK")])
def test_jpeg(channels, space):
    y, x = np.mgrid[0:45, 0:67]
    planes = np.stack([np.clip(128 + 90 * np.sin(x / (9 + c)) + 30 * np.cos(y / (7 + c)), 0, 255) for c in range(channels)], axis=2).astype(np.uint8)
    image = Image(67, 45, channels, planes.tobytes(), 8, space, 200, 200)
    image.icc = bytes(range(256)) * 300
    got = jpeg.decode(jpeg.encode(image, 95))
    assert (got.width, got.height, got.color_space, got.dpi_x, got.icc) == (67, 45, space, 200, image.icc)
    assert np.abs(got.array().astype(int) - planes).mean() < 2


def test_jpeg_scaled():
    image = Image(64, 48, 3, np.full((48, 64, 3), (180, 90, 30), np.uint8).tobytes())
    raw = jpeg.encode(image, 92)
    for scale in (1, 2, 4, 8):
        got = jpeg.decode(raw, scale)
        assert (got.width, got.height) == (64 // scale, 48 // scale)
        assert np.abs(got.array().astype(int) - (180, 90, 30)).max() <= 3
    assert [jpeg.scale_for(r) for r in (0.1, 0.3, 0.6, 1.0)] == [8, 4, 2, 1]


def test_jpeg_alpha_is_laid_over_white():
    image = Image(8, 8, 4, np.tile(np.array([255, 0, 0, 0], np.uint8), 64).tobytes(), alpha=True)
    assert jpeg.decode(jpeg.encode(image)).array().min() > 250


def test_jpeg_damage():
    raw = jpeg.encode(picture(16, 16))
    for cut in (0, 1, 2, 20, 100, 300):
        with pytest.raises((Damaged, struct.error, IndexError)):
            jpeg.decode(raw[:cut])


# Layers

def psd_file(layers, width=4, height=4, mode=3):
    res = b"8BIM" + struct.pack(">HBBI", 0x03ED, 0, 0, 16) + struct.pack(">IHHIHH", 150 << 16, 1, 1, 150 << 16, 1, 1)
    records, planes = b"", b""
    for name, box, key, opacity, clipping, flags, rgba, packing in layers:
        top, left, bottom, right = box
        w, h = right - left, bottom - top
        parts = b""
        n = 0
        for ident, value in zip((0, 1, 2, -1), rgba):
            rows = [bytes([value]) * w] * h
            if packing == 1:
                packed_rows = [C.pack(r) for r in rows]
                body = struct.pack(">H", 1) + b"".join(struct.pack(">H", len(r)) for r in packed_rows) + b"".join(packed_rows)
            else:
                body = struct.pack(">H", packing) + (b"".join(rows) if packing == 0 else zlib.compress(b"".join(rows)))
            parts += struct.pack(">hI", ident, len(body))
            planes += body
            n += 1
        label = bytes([len(name)]) + name.encode()
        label += b"\0" * (-len(label) % 4)
        extra = struct.pack(">II", 0, 0) + label
        records += struct.pack(">iiiiH", top, left, bottom, right, n) + parts + b"8BIM" + key + bytes([opacity, clipping, flags, 0]) + struct.pack(">I", len(extra)) + extra
    info = struct.pack(">h", len(layers)) + records + planes
    section = struct.pack(">I", len(info)) + info
    return b"8BPS" + struct.pack(">H6xHIIHH", 1, 3, height, width, 8, mode) + struct.pack(">I", 0) + struct.pack(">I", len(res)) + res + struct.pack(">I", len(section)) + section


@pytest.mark.parametrize("packing", [0, 1, 2])
def test_psd(packing):
    raw = psd_file([("below", (0, 0, 4, 4), b"norm", 255, 0, 0, (0, 0, 255, 255), packing), ("half", (0, 0, 2, 2), b"norm", 128, 0, 0, (255, 0, 0, 255), packing), ("gone", (0, 0, 4, 4), b"mul ", 255, 0, 2, (0, 0, 0, 255), packing)])
    doc = layered_files.psd(raw)
    assert [(x.name, x.mode, x.visible) for x in doc.layers] == [("below", "normal", True), ("half", "normal", True), ("gone", "multiply", False)] and doc.dpi_x == 150
    flat = layered_files.flatten(doc).array()
    assert flat[0, 0].tolist() == [128, 0, 127] and flat[3, 3].tolist() == [0, 0, 255]
    for cut in (0, 3, 10, 40, 80, len(raw) // 2):
        with pytest.raises(Damaged):
            layered_files.psd(raw[:cut])


def test_xcf_and_clip():
    name = b"top\0"
    layer = struct.pack(">III", 30, 20, 0) + struct.pack(">I", 4) + name + struct.pack(">III", 6, 4, 128) + struct.pack(">III", 8, 4, 0) + struct.pack(">IIii", 15, 8, 5, 6) + struct.pack(">II", 0, 0)
    head = b"gimp xcf v003\0" + struct.pack(">III", 100, 50, 0) + struct.pack(">IIff", 19, 8, 144, 144) + struct.pack(">II", 0, 0)
    raw = head + struct.pack(">II", len(head) + 8, 0) + layer
    doc = layered_files.xcf(raw)
    assert (doc.width, doc.height, doc.dpi_x) == (100, 50, 144)
    assert (doc.layers[0].name, doc.layers[0].left, doc.layers[0].right, doc.layers[0].visible) == ("top", 5, 35, False)
    db = sqlite3.connect(":memory:")
    db.execute("CREATE TABLE Canvas (CanvasWidth, CanvasHeight, CanvasResolution)")
    db.execute("INSERT INTO Canvas VALUES (1920, 1080, 300)")
    db.execute("CREATE TABLE Layer (LayerName, LayerOpacity, LayerVisibility)")
    db.executemany("INSERT INTO Layer VALUES (?, ?, ?)", [("a", 256, 1), ("b", 128, 0)])
    doc = layered_files.clip(b"CSFCHUNK...." + db.serialize())
    assert (doc.width, [(x.name, x.opacity, x.visible) for x in doc.layers]) == (1920, [("a", 1.0, True), ("b", 0.5, False)])
    assert sqlite_tables(db.serialize())["Canvas"][1] == [(1920, 1080, 300)]


# Containers and documents

def test_archives():
    z = Archive(zipped([("a.txt", "hello"), ("b/c", "x" * 1000)]))
    assert z.text("a.txt") == "hello" and "b/c" in z and len(z.read("b/c")) == 1000
    for name in ("../x", "/x", "a/../../x", "\\x"):
        assert not safe_name(name)
    with pytest.raises(Damaged):
        Archive(zipped([("../evil", "x")]))
    with pytest.raises(Damaged):
        Archive(b"PK\3\4 nothing")


def test_office():
    doc = '<w:document><w:body><w:p><w:r><w:t>One &amp;</w:t><w:t>two</w:t><w:br w:type="page"/><w:t>three</w:t></w:r></w:p><w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:bottom="1440" w:left="1440" w:right="1440"/></w:sectPr></w:body></w:document>'
    kind, _, pages = office.read(zipped([("word/document.xml", doc)]))
    assert kind == "docx" and [p.text for p in pages] == ["One & two", "three"] and pages[0].media == [0, 0, 612, 792] and pages[0].trim == [72, 72, 540, 720]
    sheet = '<worksheet><sheetData><row><c t="s"><v>1</v></c><c><v>42</v></c></row></sheetData></worksheet>'
    kind, _, pages = office.read(zipped([("xl/workbook.xml", ""), ("xl/sharedStrings.xml", "<sst><si><t>a</t></si><si><t>b</t></si></sst>"), ("xl/worksheets/sheet1.xml", sheet)]))
    assert kind == "xlsx" and pages[0].text == "b\t42" and pages[0].media == [0, 0, 792, 612]
    slides = [("ppt/presentation.xml", '<p:sldSz cx="9144000" cy="5143500"/>')] + [(f"ppt/slides/slide{i}.xml", f"<a:t>s{i}</a:t>") for i in (10, 2, 1)]
    kind, _, pages = office.read(zipped(slides))
    assert kind == "pptx" and [p.text for p in pages] == ["s1", "s2", "s10"] and pages[0].media == [0, 0, 720, 405]
    odt = [("mimetype", "application/vnd.oasis.opendocument.text"), ("styles.xml", '<style:page-layout-properties fo:page-width="21cm" fo:page-height="29.7cm" fo:margin-left="1in"/>'), ("content.xml", "<text:p>a</text:p><text:soft-page-break/><text:p>b</text:p>")]
    kind, _, pages = office.read(zipped(odt))
    assert kind == "odf" and [p.text for p in pages] == ["a", "b"] and abs(pages[0].media[2] - 595.28) < 0.01 and pages[0].trim[0] == 72
    book = [("META-INF/container.xml", '<rootfile full-path="OEBPS/c.opf"/>'), ("OEBPS/c.opf", '<dc:title>T</dc:title><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/><itemref idref="b"/><itemref idref="gone"/><itemref idref="a"/>'), ("OEBPS/a.xhtml", "<p>A  text</p>"), ("OEBPS/b.xhtml", "<head><title>x</title></head><p>B</p>")]
    assert [(k, t, [p.text for p in pages]) for k, t, pages in [office.read(zipped(book))]] == [("epub", "T", ["B", "A text"])]
    idml = [("mimetype", "application/vnd.adobe.indesign-idml-package"), ("Spreads/s1.xml", '<Page GeometricBounds="0 0 792 612"/>')]
    kind, _, pages = office.read(zipped(idml))
    assert kind == "idml" and pages[0].trim == [0, 0, 612, 792] and pages[0].media == [-9, -9, 621, 801]
    kind, _, pages = office.read(zipped([("Pages/2.fpage", '<FixedPage Width="800" Height="400"/>'), ("Pages/10.fpage", '<FixedPage Width="96" Height="96"><Glyphs UnicodeString="hi"/></FixedPage>')]))
    assert kind == "xps" and [p.media[2] for p in pages] == [600, 72] and pages[1].text == "hi"


def test_comics():
    page = lambda w, h: raster_files.write_png(picture(w, h, dpi=72))
    raw = zipped([("page_10.png", page(200, 100)), ("page_1.png", page(50, 100)), ("page_2.png", page(50, 100)), ("__MACOSX/x.png", b""), ("ComicInfo.xml", "<Title>Book</Title>")])
    kind, title, pages = office.read(raw)
    assert (kind, title) == ("comic", "Book") and [p.metadata["file"] for p in pages] == ["page_1.png", "page_2.png", "page_10.png"]
    assert [p.metadata["spread"] for p in pages] == ["false", "false", "true"] and pages[0].bleed == [-9, -9, 59, 109]


def test_ole2():
    name = "WordDocument".encode("utf-16-le")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(22) + struct.pack("<H", 9) + bytes(16) + struct.pack("<I", 0)
    raw = head.ljust(512, b"\0") + (name.ljust(64, b"\0") + struct.pack("<H", len(name) + 2)).ljust(128, b"\0").ljust(512, b"\0")
    assert office.read(raw)[0] == "doc"


# PDF

def inherited_pdf(tail=True):
    parts = [b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n", b"2 0 obj << /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /MediaBox [0 0 612 792] >> endobj\n", b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 6 0 R >> endobj\n", b"4 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 792 612] >> endobj\n", b"5 0 obj << /Title (A \\(nested\\) title\\051) >> endobj\n", b"6 0 obj << /Length 9 /Filter /ASCIIHexDecode >> stream\n6869206F>\nendstream endobj\n"]
    out, table = b"%PDF-1.4\n", b"0000000000 65535 f \n"
    for p in parts:
        table += b"%010d 00000 n \n" % len(out)
        out += p
    end = b"xref\n0 7\n" + table + b"trailer << /Size 7 /Root 1 0 R /Info 5 0 R >>\nstartxref\n%d\n%%%%EOF" % len(out)
    return out + (end if tail else b"trailer << /Root 1 0 R /Info 5 0 R >>")


@pytest.mark.parametrize("tail", [True, False])
def test_pdf_pages(tail):
    title, pages = pdf.read_pages(inherited_pdf(tail))
    assert title == "A (nested) title)" and [p.media for p in pages] == [[0, 0, 612, 792], [0, 0, 792, 612]] and pages[0].text == "hi o"


def test_pdf_newest_revision_wins():
    old = inherited_pdf()
    new = b"\n4 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 10 20] >> endobj\n"
    at = len(old) + 1
    start = old.rindex(b"xref\n0 7")
    more = new + b"xref\n4 1\n%010d 00000 n \ntrailer << /Size 7 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (at, start, len(old) + len(new))
    assert pdf.read_pages(old + more)[1][1].media == [0, 0, 10, 20]


def test_pdf_object_streams():
    members = b"1 0 2 33 << /Type /Catalog /Pages 2 0 R >> << /Type /Pages /Kids [3 0 R] /Count 1 >>"
    first = members.index(b"<<")
    offsets = [0, members.index(b"<< /Type /Pages") - first]
    head = b"1 %d 2 %d " % tuple(offsets)
    body = zlib.compress(head + members[first:])
    out = b"%PDF-1.5\n"
    places = {}
    places[3] = len(out)
    out += b"3 0 obj << /Type /Page /Parent 2 0 R /MediaBox [0 0 5 6] >> endobj\n"
    places[4] = len(out)
    out += b"4 0 obj << /Type /ObjStm /N 2 /First %d /Length %d /Filter /FlateDecode >> stream\n" % (len(head), len(body)) + body + b"\nendstream endobj\n"
    at = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (1, places[3], 0), (1, places[4], 0), (1, at, 0)]
    raw = b"".join(bytes([a]) + struct.pack(">H", b) + bytes([c]) for a, b, c in rows)
    up = b"".join(bytes([2]) + bytes((x - y) & 255 for x, y in zip(raw[i : i + 4], raw[i - 4 : i] if i else bytes(4))) for i in range(0, 24, 4))
    table = zlib.compress(up)
    out += b"5 0 obj << /Type /XRef /Size 6 /W [1 2 1] /Root 1 0 R /Length %d /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> >> stream\n" % len(table) + table + b"\nendstream endobj\nstartxref\n%d\n%%%%EOF" % at
    assert pdf.read_pages(out)[1][0].media == [0, 0, 5, 6]


def test_pdf_values():
    read = lambda raw: pdf.Parser(raw).read()
    assert read(b"<< /A#20b [1 -2.5 .5 true null (a\\n\\101(x)\\\n) <48 6> 7 0 R] % note\n >>") == {"A b": [1, -2.5, 0.5, True, None, b"a\nA(x)", b"H`", pdf.Ref(7, 0)]}
    assert pdf.ascii85(b"<~9jqo^BlbD-BleB1DJ+*+F(f,q~>") == b"Man is distinguished"
    with pytest.raises(Damaged):
        read(b"[" * 500)


@pytest.mark.parametrize(("kind", "space", "channels"), [("x-1a", "CMYK", 4), ("x-4", "RGB", 3), ("x-4", "GRAY", 1)])
def test_pdfx(kind, space, channels):
    image = picture(30, 20, channels, space=space, dpi=100)
    raw = pdfx.write_pdf([pdfx.page_of(image)], kind, "Job (1)")
    title, pages = pdf.read_pages(raw)
    assert title == "Job (1)" and pages[0].media == [0, 0, 21.6, 14.4] and pages[0].image.data == image.data
    doc = pdf.Document(raw)
    assert doc.info("GTS_PDFXVersion").startswith("PDF/X") and doc.get(doc.get(doc.trailer["Root"])["OutputIntents"])
    with pytest.raises(Unsupported):
        pdfx.write_pdf([pdfx.page_of(picture())], "x-1a")


def test_pdf_damage():
    raw = pdfx.write_pdf([pdfx.page_of(picture(4, 4, 4, space="CMYK"))])
    for cut in (0, 1, 8, 64, len(raw) // 2):
        try:
            pdf.read_pages(raw[:cut])
        except images.ERRORS:
            pass
    assert pdf.read_pages(raw.replace(b"startxref\n", b"startxref\nabc"))[1][0].image.width == 4


# Drawings

def test_svg():
    d = vector_files.svg('<svg viewBox="0 0 500 400"><path d="m 10 20 l 5 5 h 10 v -5 z"/><rect x="1" y="2" width="3" height="4"/><circle cx="5" cy="5" r="2"/><line x1="0" y1="0" x2="1" y2="1"/><polygon points="0,0 1,0 1,1"/></svg>')
    assert (d.width, d.height, len(d.paths)) == (500, 400, 5)
    assert d.paths[0] == [("M", [10, 20]), ("L", [15, 25]), ("L", [25, 25]), ("L", [25, 20]), ("Z", [])]
    assert vector_files.path("M0 0 C 10 20 30 40 50 60 S 90 100 110 120")[2][1][:2] == [70, 80]


def test_dxf():
    said = "0\nSECTION\n2\nENTITIES\n0\nLINE\n10\n0\n20\n0\n11\n100\n21\n50\n0\nCIRCLE\n10\n50\n20\n25\n40\n10\n0\nLWPOLYLINE\n70\n1\n10\n0\n20\n0\n10\n100\n20\n0\n0\nENDSEC\n0\nEOF\n"
    d = vector_files.dxf(said)
    assert (d.width, d.height, len(d.paths)) == (2592, 1728, 3) and d.paths[0][0] == ("M", [72, 252]) and d.paths[0][1] == ("L", [2520, 1476])
    assert d.paths[2][-1] == ("Z", [])
    assert images.kind_of(said.encode()) == "dxf"


def test_metafiles_and_others():
    words = lambda kind, *v: struct.pack(f"<IH{len(v)}h", 3 + len(v), kind, *v)
    raw = b"\xd7\xcd\xc6\x9a" + struct.pack("<H4hHIH", 0, 0, 0, 1440, 720, 1440, 0, 0) + struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0) + words(0x0214, 0, 0) + words(0x0213, 720, 1440) + words(0x041B, 720, 1440, 0, 0) + words(0)
    d = vector_files.wmf(raw)
    assert (d.width, d.height) == (72, 36) and d.paths[0] == [("M", [0, 0]), ("L", [72, 36])] and len(d.paths[1]) == 5
    head = struct.pack("<II8i", 1, 88, 0, 0, 96, 48, 0, 0, 0, 0) + b" EMF"
    emf = head.ljust(88, b"\0") + struct.pack("<IIii", 0x1B, 16, 0, 0) + struct.pack("<IIii", 0x36, 16, 96, 48) + struct.pack("<II", 14, 20)
    assert vector_files.emf(emf).paths == [[("M", [0, 0]), ("L", [72, 36])]]
    d = vector_files.eps(b"%!PS-Adobe-3.0 EPSF-3.0\n%%BoundingBox: 0 0 100 50\n%%HiResBoundingBox: 0.5 0 100.25 50\n%%Pages: 2\n")
    assert (d.width, d.height, d.pages) == (99.75, 50, 2)
    assert vector_files.dwg(b"AC1032" + bytes(20)).text == "2018"
    d = vector_files.djvu(b"AT&TFORM\0\0\0\0DJVUINFO" + struct.pack(">IHH", 10, 300, 600) + b"\x18\0" + struct.pack("<H", 300) + b"\x16\1")
    assert (d.width, d.height) == (72, 144)


def test_raw():
    gray = struct.pack("<" + "H" * 16, *[32_768] * 16)
    short, long = (lambda v: struct.pack("<HH", v, 0)), (lambda v: struct.pack("<I", v))
    tags = [(256, 3, 1, short(4)), (257, 3, 1, short(4)), (258, 3, 1, short(16)), (259, 3, 1, short(1)), (273, 4, 1, long(8)), (0x828E, 1, 4, bytes([0, 1, 1, 2])), (0xC612, 1, 4, bytes([1, 4, 0, 0]))]
    raw = tiff_file("<", tags, gray)
    assert images.kind_of(raw) == "raw" and set(raw_files.raw(raw).data) == {188}


def test_icc():
    para = b"para\0\0\0\0" + struct.pack(">HH", 3, 0) + struct.pack(">5i", *(round(v * 65_536) for v in (2.4, 0.9, 0.1, 0.08, 0.04)))
    grid = np.stack(np.meshgrid(*[np.linspace(0, 255, 5)] * 3, indexing="ij"), axis=-1).astype(np.uint8)
    identity = np.tile(np.arange(256, dtype=np.uint8), 3).tobytes()
    lut = b"mft1\0\0\0\0" + bytes([3, 3, 5, 0]) + struct.pack(">9i", *[65_536, 0, 0, 0, 65_536, 0, 0, 0, 65_536]) + identity + grid.tobytes() + identity
    raw = icc.build("RGB", "XYZ", "mntr", {"rXYZ": icc.xyz_tag((0.4, 0.2, 0.1)), "rTRC": para, "A2B0": lut, "gTRC": b"curv\0\0\0\0" + struct.pack(">IH", 1, 563), "bTRC": b"curv\0\0\0\0" + struct.pack(">I3H", 3, 0, 30_000, 65_535)})
    p = icc.parse(raw)
    assert (p.space, p.pcs, p.version, p.is_matrix, p.is_table) == ("RGB", "XYZ", "4.3.0", False, True)
    assert icc.curve(p.tags["rTRC"])[1] == 3 and abs(icc.curve(p.tags["gTRC"])[1] - 2.2) < 0.001 and len(icc.curve(p.tags["bTRC"])[1]) == 3
    assert np.allclose(icc.xyz(p.tags["rXYZ"]), (0.4, 0.2, 0.1), atol=1e-4)
    v = np.random.default_rng(0).random((50, 3))
    assert np.allclose(icc.evaluate(icc.table(p.tags["A2B0"]), v), v, atol=0.005)
    for cut in (0, 100, 140, 200):
        with pytest.raises((Damaged, struct.error)):
            icc.parse(raw[:cut])


def test_fonts():
    square = fonts.Glyph([[(0.0, 0.0, True), (10.0, 0.0, True), (10.0, 10.0, True), (0.0, 10.0, True)]])
    assert fonts.outline(square)[:2] == [("M", [0, 0]), ("L", [10, 0])]
    round_one = fonts.outline(fonts.Glyph([[(0.0, 0.0, True), (5.0, 5.0, False), (10.0, 0.0, True)]]))
    assert round_one[1][0] == "C" and round_one[1][1][4:] == [10, 0]
    code = bytes([139 + 10, 139 + 20, 21, 139 + 5, 139, 5, 139 + 3, 6, 14])
    assert fonts.charstring(code) == [("M", [10, 20]), ("L", [15, 20]), ("L", [18, 20]), ("Z", [])]


def test_ranges(spark, tmp_path):
    from plateflow.sources import ranges

    data = random.Random(4).randbytes(3_000_000)
    (tmp_path / "big.bin").write_bytes(data)
    f = ranges.RangeFile(str(tmp_path / "big.bin"))
    assert f.size == len(data) and f.read(10, 20) == data[10:30] and f.read(2_999_990, 100) == data[-10:] and f.read(len(data), 5) == b""
    assert f.read(5, 2_000_000) == data[5:2_000_005] and f.slice(100, 50).read(40, 20) == data[140:150]
    for offset in (-1, len(data) + 1):
        with pytest.raises(ValueError):
            f.read(offset, 1)
    f.close()
    path = f"file://{tmp_path}/big.bin"
    rows = spark.createDataFrame([(path, 7, 9), (path, -8, 100), (path, 10**9, 1), (f"file://{tmp_path}/none", 0, 1)], "path string, offset long, length long")
    got = {r["offset"]: r for r in ranges.byte_ranges(rows).collect()}
    assert bytes(got[7]["content"]) == data[7:16] and bytes(got[-8]["content"]) == data[-8:]
    assert got[10**9]["error"].startswith("ValueError") and got[0]["error"]
    assert [(r["length"]) for r in ranges.listed(images.files(spark, str(tmp_path))).collect()] == [len(data)]


# Whole images

def test_packed_resampling():
    image = picture(40, 30, 1, space="GRAY")
    assert packed.resample(image, 40, 30) is image
    flat = Image(9, 9, 1, bytes([77]) * 81, color_space="GRAY")
    for k in packed.KERNELS:
        assert set(packed.resample(flat, 4, 13, k).data) == {77}
    assert np.allclose(packed.weights(50, 20).sum(axis=1), 1)
    big = Image(400, 400, 1, bytes(160_000), color_space="GRAY", dpi_x=600, dpi_y=600)
    assert (packed.for_print(big).width, packed.for_print(big).dpi_x) == (200, 300)
    same = Image(400, 400, 1, bytes(160_000), color_space="GRAY")
    assert packed.for_print(same) is same


def test_plates():
    raw = np.arange(16, dtype=np.uint8).repeat(4).reshape(4, 4, 4) * [16, 1, 0, 0] + [0, 0, 128, 64]
    plates = write_plates(Image(4, 4, 4, raw.astype(np.uint8).tobytes(), color_space="CMYK"), "job", composite=True)
    assert list(plates) == ["job_Cyan.tif", "job_Magenta.tif", "job_Yellow.tif", "job_Black.tif", "job_composite.tif"]
    assert set(raster_files.tiff(plates["job_Yellow.tif"]).data) == {128}
    spots = Image(2, 2, 5, bytes(20), color_space="DEVICE_N", spots=["PANTONE 185 C"])
    assert "job_PANTONE_185_C.tif" in write_plates(spots)


def test_blocks_and_samples_are_those_of_pixels(spark):
    """Squares and single samples come without a row for each pixel, and are what the pixels say; damaged files don't count."""
    from plateflow.plans import fixtures as X
    from plateflow.sources import images as I

    rng = np.random.default_rng(8)
    made = [(str(i), bytearray(X.png_filtered(rng.integers(0, 256, (5 + i, 19 - i)).astype(np.uint8)))) for i in range(6)]
    got = I.images(spark.createDataFrame([*made, ("bad", bytearray(b"\x89PNG\r\n\x1a\n"))], "path string, content binary"))
    assert got.where("error IS NOT NULL").count() == 1
    pixels = I.pixels(got).collect()
    for side in (4, None):
        want = {}
        for p in pixels:
            want.setdefault((p["path"], p["y"] // side if side else 0, p["x"] // side if side else 0), []).append(p["v"][0])
        found = {(r["path"], r["y"], r["x"]): (r["darkest"], r["lightest"], r["samples"]) for r in I.blocks(got, side).collect()}
        assert found == {k: (min(v), max(v), len(v)) for k, v in want.items()}
    at = {p["path"]: p["v"][0] for p in pixels if (p["y"], p["x"]) == (4, 15)}
    assert {r["path"]: r["v"] for r in got.where("error IS NULL").select("path", I.sample_at(15, 4).alias("v")).collect()} == {str(i): at.get(str(i)) for i in range(6)}


def test_tables_of_codes_are_made_once():
    assert jpeg.lookup((0, 2), (1, 2)) is jpeg.lookup((0, 2), (1, 2))
