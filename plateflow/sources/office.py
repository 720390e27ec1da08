"""Office files, books and comics: pages with their sizes and text."""

from __future__ import annotations

import html
import re
from posixpath import dirname, join, normpath

from .containers import Archive, ole2_kind
from .model import Damaged, Image, Unsupported
from .pdf import Page

LETTER = (612.0, 792.0)
UNITS = {"in": 72.0, "cm": 72.0 / 2.54, "mm": 72.0 / 25.4, "pt": 1.0, "px": 0.75, "": 1.0}


def length(said: str | None, default: float) -> float:
    m = re.fullmatch(r"\s*(\d*\.?\d+|\d+\.)\s*(in|cm|mm|pt|px)?\s*", said or "", re.I)
    return float(m[1]) * UNITS[(m[2] or "").lower()] if m else default


def attribute(tag: str, name: str) -> str | None:
    m = re.search(rf"""(?<![\w:]){re.escape(name)}\s*=\s*(?:"([^"]*)"|'([^']*)')""", tag)
    return html.unescape(m[1] if m[1] is not None else m[2]) if m else None


def tags(xml: str, name: str) -> list[str]:
    return re.findall(rf"<{re.escape(name)}(?=[\s/>])[^>]*>", xml)


def contents(xml: str, name: str) -> list[str]:
    return [html.unescape(re.sub(r"<[^>]*>", "", x)) for x in re.findall(rf"<{re.escape(name)}(?:\s[^>]*)?>(.*?)</{re.escape(name)}>", xml, re.S)]


def page(n: int, width: float, height: float, said: str = "", trim: list[float] | None = None, bleed: list[float] | None = None, **more) -> Page:
    media = [0.0, 0.0, width, height]
    return Page(n, media, media, bleed or media, trim or bleed or media, said, **more)


def digits(name: str) -> int:
    return int("".join(re.findall(r"\d", name)) or 0)


def natural(name: str) -> list:
    return [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", name.lower())]


def docx(z: Archive) -> list[Page]:
    xml = z.text("word/document.xml")
    size, margin = (tags(xml, "w:pgSz") or [""])[-1], (tags(xml, "w:pgMar") or [""])[-1]
    twips = lambda tag, name, default: float(attribute(tag, name) or default * 20) / 20
    w, h = twips(size, "w:w", LETTER[0]), twips(size, "w:h", LETTER[1])
    if attribute(size, "w:orient") == "landscape" and w < h:
        w, h = h, w
    left, right, top, bottom = (twips(margin, f"w:{n}", 72.0) for n in ("left", "right", "top", "bottom"))
    parts = re.split(r"""<w:br\s[^>]*w:type="page"[^>]*/?>|<w:lastRenderedPageBreak\s*/>""", xml)
    texts = [" ".join(contents(p, "w:t")) for p in parts]
    whole = " ".join(texts).strip()
    return [page(i + 1, w, h, t or whole, [left, bottom, w - right, h - top]) for i, t in enumerate(texts)]


def xlsx(z: Archive) -> list[Page]:
    """A page for each sheet, in the order of names; cells joined by tabs, shared texts in their places."""
    shared = ["".join(contents(x, "t")) for x in re.findall(r"<si(?:\s[^>]*)?>(.*?)</si>", z.text("xl/sharedStrings.xml"), re.S)] if "xl/sharedStrings.xml" in z else []
    out = []
    for n in sorted(x for x in z.names() if re.fullmatch(r"xl/worksheets/[^/]+\.xml", x)):
        xml = z.text(n)
        cells = []
        for tag, body in re.findall(r"(<c(?=[\s>])[^>]*?)(?:/>|>(.*?)</c>)", xml, re.S):
            value = (contents(body, "v") or contents(body, "t") or [None])[0]
            if value is not None:
                at = int(value) if attribute(tag, "t") == "s" and value.isdigit() else -1
                cells.append(shared[at] if 0 <= at < len(shared) else value)
        setup = (tags(xml, "pageSetup") or [""])[0]
        w, h = LETTER if attribute(setup, "orientation") == "portrait" else LETTER[::-1]
        out.append(page(len(out) + 1, w, h, "\t".join(cells)))
    return out


def pptx(z: Archive) -> list[Page]:
    size = (tags(z.text("ppt/presentation.xml"), "p:sldSz") or [""])[0] if "ppt/presentation.xml" in z else ""
    w, h = float(attribute(size, "cx") or 9_144_000) / 12_700, float(attribute(size, "cy") or 6_858_000) / 12_700
    names = sorted((x for x in z.names() if re.fullmatch(r"ppt/slides/slide\d+\.xml", x)), key=digits)
    return [page(i + 1, w, h, " ".join(contents(z.text(n), "a:t"))) for i, n in enumerate(names)]


def odf(z: Archive) -> list[Page]:
    style = (tags(z.text("styles.xml"), "style:page-layout-properties") or [""])[0] if "styles.xml" in z else ""
    w, h = length(attribute(style, "fo:page-width"), LETTER[0]), length(attribute(style, "fo:page-height"), LETTER[1])
    left, right, top, bottom = (length(attribute(style, f"fo:margin-{n}"), 0.0) for n in ("left", "right", "top", "bottom"))
    xml = z.text("content.xml")
    slides = re.findall(r"<draw:page(?=[\s>]).*?</draw:page>", xml, re.S)
    parts = slides or re.split(r"<text:soft-page-break\s*/>", xml)
    say = lambda x: " ".join(t for t in (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()),) if t)
    return [page(i + 1, w, h, say(x), [left, bottom, w - right, h - top]) for i, x in enumerate(parts)]


def idml(z: Archive) -> list[Page]:
    """Pages of spreads in the order of names; bleed from the document's preferences (9 points by default)."""
    prefs = z.text("Resources/Preferences.xml") if "Resources/Preferences.xml" in z else ""
    tag = (tags(prefs, "DocumentPreference") or [""])[0]
    edge = [float(attribute(tag, f"DocumentBleed{n}Offset") or 9) for n in ("InsideOrLeft", "Bottom", "OutsideOrRight", "Top")]
    out = []
    for name in sorted(x for x in z.names() if x.startswith("Spreads/") and x.endswith(".xml")):
        for t in tags(z.text(name), "Page"):
            bounds = [float(v) for v in (attribute(t, "GeometricBounds") or "0 0 792 612").split()]
            w, h = abs(bounds[3] - bounds[1]), abs(bounds[2] - bounds[0])
            full = [-edge[0], -edge[1], w + edge[2], h + edge[3]]
            out.append(Page(len(out) + 1, full, full, full, [0.0, 0.0, w, h]))
    return out


def xps(z: Archive) -> list[Page]:
    out = []
    for name in sorted((x for x in z.names() if x.lower().endswith(".fpage")), key=digits):
        xml = z.text(name)
        tag = (tags(xml, "FixedPage") or [""])[0]
        said = " ".join(t for t in (attribute(g, "UnicodeString") for g in tags(xml, "Glyphs")) if t)
        out.append(page(len(out) + 1, float(attribute(tag, "Width") or 816) * 0.75, float(attribute(tag, "Height") or 1056) * 0.75, said))
    return out


def iwork(z: Archive) -> list[Page]:
    from .images import decode_image
    from .pdf import read_pages

    for name in z.names():
        if re.search(r"QuickLook/Preview\.pdf$", name, re.I):
            return read_pages(z.read(name))[1]
    for name in z.names():
        if re.search(r"(QuickLook/Thumbnail|preview(-web)?)\.(jpe?g|png)$", name, re.I):
            image = decode_image(z.read(name))
            return [page(1, image.width / image.dpi_x * 72, image.height / image.dpi_y * 72, image=image)]
    return [page(1, *LETTER)]


def epub(z: Archive, most: int = 10_000) -> tuple[str | None, list[Page]]:
    """The spine's files, in its order; items that aren't there are left out. `most` is the format's cap on a page's text."""
    root = attribute((tags(z.text("META-INF/container.xml"), "rootfile") or [""])[0], "full-path")
    if not root or root not in z:
        raise Damaged("no package file")
    opf = z.text(root)
    manifest = {attribute(t, "id"): attribute(t, "href") for t in tags(opf, "item")}
    title = (contents(opf, "dc:title") or [None])[0]
    out = []
    for ref in tags(opf, "itemref"):
        href = manifest.get(attribute(ref, "idref"))
        name = normpath(join(dirname(root), href)) if href else None
        if name and name in z:
            xml = re.sub(r"(?is)<(script|style|head)\b.*?</\1>", " ", z.text(name))
            out.append(page(len(out) + 1, *LETTER, " ".join(html.unescape(re.sub(r"<[^>]*>", " ", xml)).split())[:most]))
    return title, out


IMAGES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif")


def comic(z: Archive) -> tuple[str | None, list[Page]]:
    """Images in natural order; a page that is much wider than high is a spread; 9 points of bleed."""
    from .images import decode_image

    names = [n for n in z.names() if not n.startswith(("__MACOSX", ".")) and not n.endswith("/") and n.rpartition(".")[2].lower() in IMAGES]
    if not names:
        raise Damaged("no images")
    info = next((z.text(n) for n in z.names() if n.lower().endswith("comicinfo.xml")), "")
    out = []
    for name in sorted(names, key=natural):
        try:
            image: Image | None = decode_image(z.read(name))
        except Unsupported:
            image = None
        w, h = (image.width / image.dpi_x * 72, image.height / image.dpi_y * 72) if image else LETTER
        p = Page(len(out) + 1, [0.0, 0.0, w, h], [0.0, 0.0, w, h], [-9.0, -9.0, w + 9, h + 9], [0.0, 0.0, w, h], image=image)
        p.metadata = {"file": name, "spread": str(w / h > 1.2).lower()}
        out.append(p)
    return (contents(info, "Title") or [None])[0], out


def kind_of(data: bytes) -> str:
    """Which of these a ZIP or OLE2 file is: the most telling entries first."""
    if data[:8] == bytes.fromhex("D0CF11E0A1B11AE1"):
        return ole2_kind(data)
    z = Archive(data)
    names = set(z.names())
    mime = z.text("mimetype").strip() if "mimetype" in names else ""
    if mime == "application/vnd.adobe.indesign-idml-package" or "designmap.xml" in names:
        return "idml"
    for name, kind in (("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx"), ("META-INF/container.xml", "epub")):
        if name in names:
            return kind
    if mime.startswith("application/vnd.oasis.opendocument") or {"content.xml", "styles.xml"} <= names:
        return "odf"
    if any(n.lower().endswith(".fpage") for n in names):
        return "xps"
    if any(n.startswith("Index/") and n.endswith(".iwa") or n == "Index.zip" for n in names):
        return "iwork"
    if any(n.rpartition(".")[2].lower() in IMAGES for n in names):
        return "comic"
    raise Unsupported("a ZIP archive of no known kind")


def read(data: bytes) -> tuple[str, str | None, list[Page]]:
    """Kind, title and pages."""
    kind = kind_of(data)
    if kind in ("doc", "xls", "ppt", "vsd", "pub", "ole2"):
        return kind, None, [page(1, *(LETTER[::-1] if kind in ("xls", "ppt") else LETTER))]
    z = Archive(data)
    if kind == "epub":
        return kind, *epub(z)
    if kind == "comic":
        return kind, *comic(z)
    return kind, None, {"docx": docx, "xlsx": xlsx, "pptx": pptx, "odf": odf, "idml": idml, "xps": xps, "iwork": iwork}[kind](z)
