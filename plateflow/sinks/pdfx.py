"""PDF/X-1a and PDF/X-4 files."""

from __future__ import annotations

import zlib

from ..sources.model import Image, Unsupported
from ..sources.pdf import Name, Page, Ref

#: What a version asks for: PDF version, conformance, condition, colour spaces.
KINDS = {"x-1a": ("1.3", "PDF/X-1a:2001", "CGATS TR 001", ("CMYK",)), "x-4": ("1.6", "PDF/X-4", "FOGRA39", ("CMYK", "RGB", "GRAY"))}
SPACES = {"CMYK": "DeviceCMYK", "RGB": "DeviceRGB", "GRAY": "DeviceGray"}


def number(v: float) -> str:
    text = f"{v:.4f}".rstrip("0").rstrip(".")
    return "0" if text in ("", "-0") else text


def text(v) -> bytes:
    """A value as PDF writes it."""
    if v is None:
        return b"null"
    if isinstance(v, bool):
        return b"true" if v else b"false"
    if isinstance(v, Name):
        return b"/" + b"".join(bytes([c]) if 33 <= c <= 126 and c not in b"#()<>[]{}/%" else b"#%02X" % c for c in v.encode("latin1", "replace"))
    if isinstance(v, (int, float)):
        return (str(v) if isinstance(v, int) else number(v)).encode()
    if isinstance(v, Ref):
        return f"{v.number} {v.generation} R".encode()
    if isinstance(v, (bytes, str)):
        raw = v if isinstance(v, bytes) else v.encode("latin1") if v.isascii() else b"\xfe\xff" + v.encode("utf-16-be")
        return b"(" + raw.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r") + b")"
    if isinstance(v, (list, tuple)):
        return b"[" + b" ".join(map(text, v)) + b"]"
    return b"<< " + b" ".join(text(Name(k)) + b" " + text(x) for k, x in v.items()) + b" >>"


class Writer:
    """Objects one after the other; the cross-reference follows from their lengths."""

    def __init__(self, version: str):
        self.version, self.objects = version, []

    def add(self, value, stream: bytes | None = None) -> Ref:
        self.objects.append(b"")
        self.put(ref := Ref(len(self.objects), 0), value, stream)
        return ref

    def put(self, ref: Ref, value, stream: bytes | None = None) -> None:
        body = text(value)
        if stream is not None:
            body = text(value | {"Length": len(stream)}) + b"\nstream\n" + stream + b"\nendstream"
        self.objects[ref.number - 1] = f"{ref.number} 0 obj\n".encode() + body + b"\nendobj\n"

    def compile(self, trailer: dict) -> bytes:
        out = f"%PDF-{self.version}\n".encode() + b"%\xe2\xe3\xcf\xd3\n"
        table = b"0000000000 65535 f \n"
        at = len(out)
        for o in self.objects:
            table += f"{at:010d} 00000 n \n".encode()
            at += len(o)
        out += b"".join(self.objects)
        return out + f"xref\n0 {len(self.objects) + 1}\n".encode() + table + b"trailer\n" + text(trailer | {"Size": len(self.objects) + 1}) + f"\nstartxref\n{at}\n%%EOF\n".encode()


def path_operators(paths: list, height: float) -> str:
    """Strokes of paths whose y grows downward, on a page of that height."""
    operator = {"M": "m", "L": "l", "C": "c", "Z": "h"}
    lines = []
    for p in paths:
        lines += [" ".join([*(f"{v:.3f}" for v in args), operator[op]]) for op, args in p]
        lines += ["S"] * bool(p)
    return "\n".join([f"1 0 0 -1 0 {number(height)} cm", *lines])


def write_pdf(pages: list[Page], kind: str = "x-1a", title: str = "Untitled", condition: str | None = None, profile: bytes | None = None) -> bytes:
    """A file of pages with their images and, over these, their paths as black strokes one point wide."""
    import hashlib

    version, conformance, standard, spaces = KINDS[kind]
    w = Writer(version)
    root, tree = w.add(None), w.add(None)
    kids, seed = [], hashlib.md5(title.encode())
    for page in pages:
        entries = {"Type": Name("Page"), "Parent": tree, "MediaBox": page.media, "BleedBox": page.bleed, "TrimBox": page.trim}
        resources: dict = {"ProcSet": [Name("PDF"), Name("ImageC")]}
        content = []
        if page.image is not None:
            resources["XObject"] = {"Im0": w.add(_image_entries(page.image, spaces), zlib.compress(page.image.data))}
            width, height = (abs(page.media[i + 2] - page.media[i]) for i in (0, 1))
            content.append(f"q {number(width)} 0 0 {number(height)} {number(page.media[0])} {number(page.media[1])} cm /Im0 Do Q")
            seed.update(page.image.data)
        if any(page.paths):
            black = "0 0 0 1 K 0 0 0 1 k" if kind == "x-1a" else "0 0 0 RG 0 0 0 rg"
            operators = path_operators(page.paths, page.media[1] + page.media[3])
            content.append(f"q {black} 1 w\n{operators}\nQ")
            seed.update(operators.encode())
        entries |= {"Resources": resources, "Contents": w.add({"Filter": Name("FlateDecode")}, zlib.compress("\n".join(content).encode()))}
        if kind == "x-4":
            entries["Group"] = {"S": Name("Transparency"), "CS": Name("DeviceCMYK")}
        kids.append(w.add({"Type": Name("Page")} | entries))
    intent = {"Type": Name("OutputIntent"), "S": Name("GTS_PDFX"), "OutputConditionIdentifier": condition or standard, "OutputCondition": condition or standard, "RegistryName": "http://www.color.org", "Info": condition or standard}
    if profile:
        intent["DestOutputProfile"] = w.add({"N": 4, "Filter": Name("FlateDecode")}, zlib.compress(profile))
    info = w.add({"Title": title, "Creator": "plateflow", "Producer": "plateflow", "CreationDate": "D:20000101000000Z", "ModDate": "D:20000101000000Z", "GTS_PDFXVersion": conformance, "Trapped": Name("False")})
    w.put(tree, {"Type": Name("Pages"), "Kids": kids, "Count": len(kids)})
    w.put(root, {"Type": Name("Catalog"), "Pages": tree, "OutputIntents": [w.add(intent)]})
    ident = seed.digest()
    return w.compile({"Root": root, "Info": info, "ID": [ident, ident]})


def _image_entries(image: Image, spaces: tuple[str, ...]) -> dict:
    if image.color_space not in spaces or image.bits != 8 or image.channels != {"CMYK": 4, "RGB": 3, "GRAY": 1}[image.color_space]:
        raise Unsupported(f"an image of {image.channels} channels of {image.color_space}")
    return {"Type": Name("XObject"), "Subtype": Name("Image"), "Width": image.width, "Height": image.height, "ColorSpace": Name(SPACES[image.color_space]), "BitsPerComponent": 8, "Filter": Name("FlateDecode")}


def page_of(image: Image, n: int = 1) -> Page:
    """A page as large as the image."""
    box = [0.0, 0.0, image.width / image.dpi_x * 72, image.height / image.dpi_y * 72]
    return Page(n, box, box, box, box, image=image)
