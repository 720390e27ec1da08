"""From files to print files: one lazy plan for decoding, selection, reduction, colour and output."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clut, packed
from ..sinks.pdfx import page_of, write_pdf
from ..sinks.tiff import write_plates, write_tiff
from ..sources import images as I
from ..sources import icc, jpeg
from ..sources.model import Damaged, Image, Unsupported
from ..sources.pdf import Page

FORMATS = ("pdf/x-1a", "pdf/x-4", "tiff", "tiffsep", "jpeg")
EXTENSIONS = {"pdf/x-1a": "pdf", "pdf/x-4": "pdf", "tiff": "tif", "tiffsep": "tif", "jpeg": "jpg"}
#: Resolutions that leave a proof as large as its source.
NATIVE = ("native", "source", "original")


@dataclass(frozen=True)
class Options:
    """What to make. pages: numbers in the order wanted, repeats included; tac: per cent of ink, none for no limit.

    kernel: a name, or a radius and a function of one's own; limiter: an ink limit of one's own, from and to a DataFrame with
    inks c, m, y, k; source_profile and target_profile: ICC profiles (RGB by a matrix, inks by a table) in place of the
    built-in ones.
    """

    format: str = "pdf/x-1a"
    dpi: float = 300.0
    threshold: float = 450.0
    tac: float | None = 300.0
    pages: tuple[int, ...] | None = None
    split: bool = False
    proofs: tuple[int | str, ...] = ()
    proof_format: str = "jpeg"
    quality: int = 85
    kernel: str | tuple[float, Callable] | None = None
    limiter: Callable[[DataFrame], DataFrame] | None = None
    source_profile: bytes | None = None
    target_profile: bytes | None = None
    job: str | None = None
    composite: bool = False
    first_page_only: bool = False
    naming: Callable[[int], str] | None = None


#: Nodes on each axis of the device link.
GRID = 33


def device_link_array(spark: SparkSession, tac: float | None, limiter=None) -> np.ndarray:
    """The device link's 35,937 rows as an array, and the 256 grays' behind them: tables of fixed size.

    limiter: in place of the ink limit, a function from a DataFrame with inks c, m, y, k (0 to 1) to one with other inks.
    """
    if limiter:
        grid, grays = clut.device_link(spark, None), clut.gray_table(spark, None)
        unit = lambda t, key: limiter(t.select(key, *[(F.col(c) / F.lit(255.0)).alias(c) for c in clut.INKS])).select(key, *[clut.to_byte(F.col(c)).alias(c) for c in clut.INKS])
        grid, grays = unit(grid, "node"), unit(grays, "v")
    else:
        grid, grays = clut.device_link(spark, tac), clut.gray_table(spark, tac)
    rows = [*grid.orderBy("node").collect(), *grays.orderBy("v").collect()]
    return np.array([[r[c] for c in clut.INKS] for r in rows], np.uint8)


def profile_link(source: bytes, target: bytes, tac: float | None) -> np.ndarray:
    """The same tables by ICC profiles: source's curves and primaries (a matrix profile) to target's table B2A0 from Lab."""
    r = np.arange(GRID) / (GRID - 1)
    grid = np.stack(np.meshgrid(r, r, r, indexing="ij"), axis=-1).reshape(-1, 3)
    values = np.concatenate([grid, np.repeat(np.arange(256)[:, None] / 255, 3, axis=1)])
    inks = icc.to_inks(icc.parse(source), icc.parse(target), values)
    if tac is not None:
        inks = packed.limit_inks(inks, tac)
    return np.floor(np.clip(inks, 0, 1) * 255 + 0.5).astype(np.uint8)


def convert(files: DataFrame, options: Options = Options()) -> DataFrame:
    """(path, filename, content, error) of the outputs of files (path, content).

    A file that can't be read, or a page that isn't there, gives one row with its error. Each file is decoded and written
    where it is read; nothing is shuffled, and the colour table is broadcast.
    """
    if options.format not in FORMATS:
        raise ValueError(f"{options.format} is none of {FORMATS}")
    spark = files.sparkSession
    if options.source_profile and options.target_profile:
        link = profile_link(options.source_profile, options.target_profile, options.tac)
    else:
        link = device_link_array(spark, options.tac, options.limiter)
    link = spark.sparkContext.broadcast(link)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    made = list(outputs(content.as_py() or b"", options, link.value).items())
                    rows = ([path] * len(made), [n for n, _ in made], [b for _, b in made], [None] * len(made))
                except I.ERRORS as e:
                    rows = ([path], [None], [None], [f"{type(e).__name__}: {e}"])
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.binary()), pa.array(rows[3], pa.string())], names=["path", "filename", "content", "error"])

    return files.select(F.col("path"), F.col("content")).mapInArrow(run, "path string, filename string, content binary, error string")


def convert_pages(files: DataFrame, options: Options = Options(split=True), tasks: int | None = None) -> DataFrame:
    """convert() with a row, and so a share of a task, for each page: what long documents need, whose pages are written apart.

    Pages are numbered where files are read; then (path, page) rows are dealt over the tasks, and each reads its file by its
    path and decodes that page alone. Outputs are those of convert() with split.
    """
    spark = files.sparkSession
    options = replace(options, split=True)
    link = spark.sparkContext.broadcast(device_link_array(spark, options.tac, options.limiter))
    numbered = I.page_numbers(files)
    failed = numbered.where("error IS NOT NULL").select("path", F.lit(None).cast("string").alias("filename"), F.lit(None).cast("binary").alias("content"), "error")
    wanted = numbered.where("error IS NULL").select("path", "page_number")
    if options.pages:
        wanted = wanted.where(F.col("page_number").isin(list(options.pages)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..sources.ranges import RangeFile

        for batch in batches:
            for path, n in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    file = RangeFile(path)
                    data = file.read(0, file.size)
                    file.close()
                    made = list(outputs(data, replace(options, pages=(n,)), link.value).items())
                    rows = [[path] * len(made), [k for k, _ in made], [b for _, b in made], [None] * len(made)]
                except I.ERRORS as e:
                    rows = [[path], [None], [None], [f"{type(e).__name__}: {e}"]]
                yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, (pa.string(), pa.string(), pa.binary(), pa.string()))], names=["path", "filename", "content", "error"])

    dealt = wanted.repartition(tasks or spark.sparkContext.defaultParallelism)
    return dealt.mapInArrow(run, "path string, filename string, content binary, error string").unionByName(failed)


def apart(outputs: DataFrame) -> DataFrame:
    """convert()'s rows, each file name below a folder of its input's: the input's name and a hash of its whole path.

    So inputs of one name, in other folders or with other endings, don't write over each other's outputs.
    """
    stem = F.regexp_replace(F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""), r"[^A-Za-z0-9_-]", "_")
    folder = F.concat(stem, F.lit("-"), F.substring(F.sha2(F.col("path"), 256), 1, 12))
    return outputs.withColumn("filename", F.concat_ws("/", folder, F.col("filename")))


def source_pages(data: bytes, options: Options) -> tuple[str, list[Page]]:
    """The job's default name and the pages."""
    kind = I.kind_of(data)
    if kind == "xcf":
        raise Unsupported(f"the samples of a file of kind {kind} aren't read")
    if kind in ("clip", "png", "jpeg", "tiff", "bmp", "tga", "webp", "raw", "psd"):
        return "image", [page_of(I.decode_image(data, kind))]
    return "document", I.decode_pages(data, images=True, only=set(options.pages) if options.pages else None)[2]


def select(pages: list[Page], wanted: tuple[int, ...] | None) -> list[Page]:
    if not wanted:
        return pages
    by = {p.number: p for p in pages}
    missing = [n for n in wanted if n not in by]
    if missing:
        raise Damaged(f"no pages {missing}")
    return [by[n] for n in wanted]


def white(width: int, height: int, dpi: float) -> Image:
    return Image(width, height, 3, b"\xff" * (width * height * 3), 8, "RGB", int(dpi), int(dpi))


def proof(page: Page, dpi: int | str, options: Options) -> bytes:
    """A page's picture at a resolution, or at its own; a page without an image is white."""
    width, height = (abs(page.media[i + 2] - page.media[i]) for i in (0, 1))
    native = dpi in NATIVE
    step = 72.0 if native else float(dpi)
    size = [max(1, int(v * step / 72 + 0.5)) for v in (width, height)]
    image = page.image or white(*size, step)
    if not native:
        image = packed.resample(image, *size, "catmull_rom")
        image.dpi_x = image.dpi_y = int(step)
    image = packed.to_rgb(image)
    return write_tiff(image) if options.proof_format in ("tif", "tiff") else jpeg.encode(image, options.quality)


def outputs(data: bytes, options: Options, link: np.ndarray) -> dict[str, bytes]:
    """Files by name; a later file of the same name replaces an earlier one."""
    kind, pages = source_pages(data, options)
    pages = select(pages, options.pages)
    job = options.job or kind
    fmt, ext = options.format, EXTENSIONS[options.format]
    name = options.naming or (lambda n: f"page_{n}" if kind == "document" else job)
    if options.first_page_only:
        pages = pages[:1]
    if not pages:
        raise Damaged("no pages")
    ready = []
    for p in pages:
        image = packed.for_print(p.image, options.dpi, options.threshold, options.kernel) if p.image else None
        if image and fmt in ("pdf/x-1a", "tiffsep"):
            image = packed.to_cmyk(image, link[: GRID**3], link[GRID**3 :])
        ready.append(Page(p.number, p.media, p.crop, p.bleed, p.trim, p.text, image, p.metadata, p.paths))
    out: dict[str, bytes] = {}

    def write(base: str, some: list[Page], sources: list[Page]) -> None:
        first = next((p for p in some if p.image), None)
        if fmt.startswith("pdf"):
            out[f"{base}.pdf"] = write_pdf(some, fmt[4:], job, profile=options.target_profile)
        elif fmt == "jpeg":
            out[f"{base}.jpg"] = proof(sources[0], options.dpi if kind == "document" else "native", options)
        elif first is None:
            raise Damaged("no image to write")
        elif fmt == "tiff":
            out[f"{base}.tif"] = write_tiff(first.image)
        else:
            out.update(write_plates(first.image, base, options.composite))

    apart = options.split or fmt == "jpeg" and len(ready) > 1
    if apart:
        for p, source in zip(ready, pages):
            write(name(p.number), [p], [source])
    else:
        write(job, ready, pages)
    suffix = "tif" if options.proof_format in ("tif", "tiff") else "jpg"
    for source in pages if options.proofs else []:
        for dpi in options.proofs:
            behind = "_native" if dpi in NATIVE else f"_{dpi}dpi" if len(options.proofs) > 1 else ""
            base = name(source.number) if kind == "document" else f"{job}_proof"
            named = f"{base}{behind}.{suffix}"
            out[f"{base}{'_proof' if kind == 'document' else '2'}{behind}.{suffix}" if named in out else named] = proof(source, dpi, options)
    return out


def report(results: DataFrame) -> DataFrame:
    """(path, report): each file's outputs as JSON."""
    size = F.octet_length("content")
    one = F.struct(F.col("filename").alias("name"), size.cast("long").alias("sizeBytes"), F.substring_index("filename", ".", -1).alias("format"))
    grouped = results.where("error IS NULL").groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("files"))
    return grouped.select("path", F.to_json(F.struct(F.lit("plateflow").alias("generator"), "files")).alias("report"))
