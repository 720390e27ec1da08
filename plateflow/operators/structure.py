"""What readers do with entries, runs, references and chunks, as plans over rows: lookups, order, guards and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Endings of pictures in comics; the largest side, and bytes, of an image; bytes of an archive's entry.
PICTURES = ("jpg", "jpeg", "png", "webp", "bmp", "tif", "tiff", "gif")
SIDE, IMAGE_BYTES, ENTRY_BYTES = 65_535, 2 << 30, 512 << 20


def safe_entry(name: Column) -> Column:
    """Whether an archive's entry stays within its folder."""
    return ~(F.startswith(name, F.lit("/")) | F.startswith(name, F.lit("\\")) | F.exists(F.split(F.replace(name, F.lit("\\"), F.lit("/")), "/"), lambda p: p == ".."))


def picture_entry(name: Column) -> Column:
    """Whether an entry is a comic's picture; other systems' extras aren't."""
    return F.lower(F.substring_index(name, ".", -1)).isin(*PICTURES) & ~F.startswith(name, F.lit("__MACOSX")) & ~F.startswith(name, F.lit(".")) & ~F.endswith(name, F.lit("/"))


def size_error(width: Column, height: Column, channels: Column, bits: Column) -> Column:
    """Why an image of that size isn't read; null if it is."""
    side = (width <= 0) | (width > SIDE) | (height <= 0) | (height > SIDE)
    return F.when(side, F.lit("side")).when(width * height * channels * bits / 8 > IMAGE_BYTES, F.lit("bytes"))


def with_entry(files: DataFrame, entries: DataFrame, name: str) -> DataFrame:
    """The files (file, ...) that have an entry (file, entry) of that name."""
    return files.join(entries.where(F.col("entry") == name).select("file"), "file", "left_semi")


def resolved(references: DataFrame, objects: DataFrame) -> DataFrame:
    """references (file, ref, ...) with what objects (file, object, body) say; null where an object isn't there."""
    return references.join(objects.withColumnRenamed("object", "ref"), ["file", "ref"], "left")


def table_rows(master: DataFrame, cells: DataFrame) -> DataFrame:
    """(file, name, row, ...): the rows of a database's tables, from master (file, name, root) and cells (file, root, row, ...)."""
    return master.join(cells, ["file", "root"]).drop("root")


def joined_runs(runs: DataFrame, key: list[str], order: str, text: str, between: str = " ") -> DataFrame:
    """(key, text): runs of text in their order, joined; only the runs of one page meet."""
    return runs.groupBy(*key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]), between).alias("text"))


def joined_chunks(chunks: DataFrame, key: str) -> DataFrame:
    """(key, content): chunks (key, sequence, total, chunk) in the order of their numbers; null if one of them is missing."""
    grouped = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sequence", "chunk"))).alias("c"), F.max("total").alias("total"), F.count_distinct("sequence").alias("n"))
    return grouped.select(key, F.when(F.col("n") == F.col("total"), F.aggregate(F.col("c")["chunk"], F.lit("").cast("binary"), lambda a, x: F.concat(a, x))).alias("content"))


def marked_pages(xml: Column, marker: str) -> Column:
    """Pages of a text that a marker (a regular expression) parts."""
    return F.size(F.regexp_extract_all(xml, F.lit(marker), 0)) + 1


def drawn_pages(xml: Column) -> Column:
    """Pages of an open document: its slides, or one more than its soft breaks."""
    slides = F.size(F.regexp_extract_all(xml, F.lit(r"<draw:page[\s>]"), 0))
    return F.when(slides > 0, slides).otherwise(marked_pages(xml, r"<text:soft-page-break\s*/>"))


def first_pages(pages: DataFrame) -> DataFrame:
    """The first page of each document (doc, page_number, ...)."""
    w = Window.partitionBy("doc").orderBy("page_number")
    return pages.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def slices(rows: DataFrame, content: str, offset: Column, length: Column) -> DataFrame:
    """rows with `part`: so many bytes from an offset on, fewer at the end; an offset beyond the content is an error, in `error`."""
    size = F.octet_length(content)
    outside = (offset < 0) | (offset > size)
    part = F.substring(F.col(content).cast("binary"), (offset + 1).cast("int"), F.greatest(F.lit(0), F.least(length, size - offset)).cast("int"))
    return rows.withColumns({"part": F.when(~outside, part), "error": F.when(outside, F.lit("RangeError"))})


def sorted_tags(tags: DataFrame, file: str) -> DataFrame:
    """(file, tags): a directory's tags (file, tag, value) in the order that the format wants."""
    return tags.groupBy(file).agg(F.array_sort(F.collect_list(F.struct("tag", "value"))).alias("tags"))


def expanded_palette(pixels: DataFrame, palette: DataFrame) -> DataFrame:
    """pixels (image, ..., i) with the colours of palette (image, i, r, g, b); an index beyond the palette is black."""
    return pixels.join(palette, ["image", "i"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in "rgb"}).drop("i")


def running_points(steps: DataFrame, key: list[str], order: str) -> DataFrame:
    """steps (key, order, dx, dy) with x and y: sums of the steps up to each, as a glyph's points are written."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumns({"x": F.sum("dx").over(w), "y": F.sum("dy").over(w)})


def page_stream(pages: DataFrame) -> DataFrame:
    """Pages (doc, page_number, media, paths, metadata, ...) ready to be written, in order: a box for each, its paths and metadata.

    Layers, texts and resources are left behind. Pages without a number are an error.
    """
    number = F.when(F.col("page_number").isNull(), F.raise_error(F.lit("a page without a number"))).otherwise(F.col("page_number"))
    media = F.coalesce("media", F.array(*[F.lit(v) for v in (0.0, 0.0, 612.0, 792.0)]))
    ready = pages.select("doc", number.alias("page_number"), media.alias("media"), "paths", "metadata")
    return ready.withColumn("position", F.row_number().over(Window.partitionBy("doc").orderBy("page_number")) - 1)
