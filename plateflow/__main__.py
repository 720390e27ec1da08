"""python -m plateflow INPUT OUTPUT: converts files to print files on the session's cluster."""

from __future__ import annotations

import argparse
import math
import re
import sys
import time

VERSION = "0.2"


def page_numbers(said: str) -> tuple[int, ...]:
    """`1,3,5-8` as numbers, in order; parts that make no sense are left out."""
    out: list[int] = []
    for part in said.split(","):
        low, dash, high = (x.strip() for x in part.partition("-"))
        if dash and low.isdigit() and high.isdigit():
            out += range(int(low), int(high) + 1)
        elif not dash and low.isdigit():
            out.append(int(low))
    return tuple(out)


def resolutions(said: str) -> tuple[int | str, ...]:
    return tuple(int(x) if x.strip().isdigit() else x.strip() for x in said.split(",") if x.strip())


# Devices and presets of page interpreters' command lines, and what they stand for here.
DEVICES = {"pdfwrite": "pdf/x-1a", "jpeg": "jpeg", "jpeggray": "jpeg", "tiffsep": "tiffsep", "tiffsep1": "tiffsep", "pngalpha": "tiff", "png16m": "tiff", "png256": "tiff", "pnggray": "tiff"}
PRESETS = {"screen": "72", "ebook": "150", "prepress": "300"}


def translated(argv: list[str]) -> list[str]:
    """argv with a page interpreter's switches (-dNAME=VALUE, -sNAME=VALUE, -rDPI) as options of this program; those that have no meaning here go."""
    out, first, last = [], None, None
    for arg in argv:
        m = re.fullmatch(r"-([ds])([A-Z]\w*)(?:=(.*))?", arg)
        if r := re.fullmatch(r"-r(\d+)(?:x\d+)?", arg):
            out += ["--dpi", r[1]]
        elif arg == "-q":
            out.append("--quiet")
        elif not m:
            out.append(arg)
        else:
            name, value = m[2], m[3] or ""
            if name == "FirstPage" and value.isdigit():
                first = int(value)
            elif name == "LastPage" and value.isdigit():
                last = int(value)
            elif name == "JPEGQ" and value.isdigit():
                out += ["--quality", value]
            elif name == "PDFSETTINGS":
                out += next((["--dpi", dpi] for preset, dpi in PRESETS.items() if preset in value.lower()), [])
            elif name == "DEVICE":
                device = value.lower()
                out += ["--format", "tiff" if device.startswith("tiff") and device not in DEVICES else DEVICES.get(device, "pdf/x-1a")]
            elif name == "OutputFile":
                out += ["--output", value]
            elif name in ("DownsampleColorImages", "DownsampleGrayImages") and value == "false":
                out.append("--keep-resolution")
            elif name == "QUIET":
                out.append("--quiet")
    if first or last:
        out += ["--pages", f"{first or last}-{last or first}"]
    return out


def arguments(argv: list[str]) -> argparse.Namespace:
    from .functions.ink import LIMITS
    from .plans.convert import FORMATS

    p = argparse.ArgumentParser("plateflow", description=__doc__)
    p.add_argument("places", nargs="*", metavar="INPUT OUTPUT", help="a file or folder that Spark reads, and a folder that all executors reach")
    p.add_argument("-i", "--input")
    p.add_argument("-o", "--output")
    p.add_argument("-f", "--format", choices=FORMATS, default="pdf/x-1a")
    p.add_argument("--dpi", type=float, default=300.0)
    p.add_argument("--threshold", type=float, default=450.0, help="resolution above which pictures are reduced")
    p.add_argument("--keep-resolution", "--preserve-resolution", "--bypass-downsample", action="store_true")
    p.add_argument("--kernel", help="of the reduction: box, bilinear, catmull_rom, mitchell or lanczos3")
    p.add_argument("--tac", default="300", help=f"per cent of ink, `none`, or one of {', '.join(LIMITS)}")
    p.add_argument("--source-profile", help="an ICC profile of light, with a matrix")
    p.add_argument("--target-profile", help="an ICC profile of inks, with a table from Lab")
    p.add_argument("--pages", "--page", type=page_numbers, default=())
    p.add_argument("--first-page-only", action="store_true")
    p.add_argument("-s", "--split", action="store_true")
    p.add_argument("-p", "--proofs", "--proof", nargs="?", const="72", default="", help="resolutions, or native, with commas between")
    p.add_argument("--proof-format", choices=("jpeg", "tiff"), default="jpeg")
    p.add_argument("--quality", "--proof-quality", type=int, default=85)
    p.add_argument("--composite", action="store_true", help="the picture of all plates beside them")
    p.add_argument("--job")
    p.add_argument("-j", "--parallel", nargs="?", type=int, const=0, help="each page on its own, over so many tasks")
    p.add_argument("--report", "--json", action="store_true", help="prints each file's outputs as JSON")
    p.add_argument("--benchmark", action="store_true", help="prints seconds and bytes")
    p.add_argument("--quiet", action="store_true")
    p.add_argument("-v", "--version", action="version", version=f"plateflow {VERSION}")
    a = p.parse_args(translated(argv))
    places = list(a.places)
    a.input = a.input or (places.pop(0) if places else None)
    a.output = a.output or (places.pop(0) if places else None)
    if not a.input or not a.output or places:
        p.error("an input and an output, please")
    a.tac = None if a.tac == "none" else LIMITS.get(a.tac) or float(a.tac)
    a.proofs = resolutions(a.proofs)
    return a


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .plans.convert import Options, apart, convert, convert_pages, report
    from .sinks.files import save
    from .sources.images import files
    from .sources.ranges import RangeFile

    a = arguments(argv)
    began = time.time()
    spark = SparkSession.builder.appName("plateflow").getOrCreate()

    def whole(path: str | None) -> bytes | None:
        if not path:
            return None
        file = RangeFile(path)
        return file.read(0, file.size)

    options = Options(
        format=a.format, dpi=a.dpi, threshold=math.inf if a.keep_resolution else a.threshold, kernel=a.kernel, tac=a.tac, source_profile=whole(a.source_profile), target_profile=whole(a.target_profile), pages=a.pages or None,
        first_page_only=a.first_page_only, split=a.split, proofs=a.proofs, proof_format=a.proof_format, quality=a.quality, composite=a.composite, job=a.job,
    )
    source = files(spark, a.input)
    made = (convert(source, options) if a.parallel is None else convert_pages(source, options, a.parallel or None)).persist()
    save(apart(made.where("error IS NULL")), a.output)
    failed = made.where("error IS NOT NULL").select("path", "error")
    for r in failed.toLocalIterator():
        if not a.quiet:
            print(f"{r['path']}: {r['error']}", file=sys.stderr)
    if a.report:
        for r in report(made).toLocalIterator():
            print(r["report"])
    if a.benchmark:
        n, size = made.where("error IS NULL").agg(F.count("*"), F.sum(F.octet_length("content"))).first()
        print(f"{n} files, {size or 0} bytes, {time.time() - began:.2f} s")
    return 1 if failed.limit(1).count() else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
