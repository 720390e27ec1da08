"""Pages: selection, order, names and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page_numbers(ranges: Column) -> Column:
    """The pages of a list such as `1,3,5-8`, in its order; parts that make no sense are left out."""
    part = lambda p: F.trim(p)
    bound = lambda p, i: F.regexp_extract(part(p), r"^\s*(\d+)[^-]*-\s*(\d+)", i)
    single = lambda p: F.regexp_extract(part(p), r"^(\d+)", 1)
    none = F.array().cast("array<int>")

    def numbers(p: Column) -> Column:
        low, high = F.when(bound(p, 1) != "", bound(p, 1)).cast("int"), F.when(bound(p, 2) != "", bound(p, 2)).cast("int")
        spread = F.when(low.isNotNull() & high.isNotNull() & (low <= high), F.sequence(F.coalesce(low, F.lit(0)), F.greatest(F.coalesce(low, F.lit(0)), F.coalesce(high, F.lit(0))))).otherwise(none)
        return F.when(F.contains(p, F.lit("-")), spread).otherwise(F.when(single(p) != "", F.array(F.when(single(p) != "", single(p)).cast("int"))).otherwise(none))

    return F.flatten(F.transform(F.split(F.coalesce(ranges, F.lit("")), ","), numbers))


def select_pages(pages: DataFrame, wanted: list[int], strict: bool = False) -> DataFrame:
    """Pages (doc, page_number, ...) by a list of numbers: position is a page's place in it, and repeated numbers repeat pages.

    strict: a document that lacks one of them is an error, when the rows are read.
    """
    at = F.posexplode(F.array(*[F.lit(n).cast("long") for n in wanted])).alias("position", "page_number")
    found = pages.sparkSession.range(1).select(at).hint("broadcast").join(pages, "page_number")
    if not strict:
        return found
    own = pages.groupBy("doc").agg(F.count_distinct(F.when(F.col("page_number").isin(wanted), F.col("page_number"))).alias("__found"))
    said = F.concat(F.lit("document "), F.col("doc").cast("string"), F.lit(f" lacks some of the pages {list(wanted)}"))
    all_there = F.when(F.col("__found") < len(set(wanted)), F.raise_error(said)).otherwise(F.lit(True))
    return own.where(all_there).select("doc").join(found, "doc")


def natural_key(name: Column) -> Column:
    """Sorts names without case, and runs of digits as numbers."""
    padded = F.regexp_replace(F.lower(name), r"(\d+)", "000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{18})(?!\d)", "$1")


def digits_key(name: Column) -> Column:
    """All digits of a name as one number."""
    digits = F.regexp_replace(name, r"[^0-9]", "")
    return F.when(digits != "", digits).cast("long")


def in_order(files: DataFrame, doc: str, key: Column, *more: str) -> DataFrame:
    """files with `place`: each one's place in its document, by a key such as natural_key() and further columns."""
    return files.withColumn("place", F.row_number().over(Window.partitionBy(doc).orderBy(key, *more)).cast("long"))


def spine(references: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """The files of a book's spine: references (book, position, item) to manifest items (item, entry) to files (entry, file).

    Items that the manifest lacks, and entries that aren't there, are left out; an item that comes again comes again.
    """
    return references.join(manifest, "item").join(files, "entry").select("book", "position", "item", "file")


def inherit(nodes: DataFrame) -> DataFrame:
    """(node, depth, box): a tree's nodes (node, parent, box) with the box of the nearest node above that has one, or their own.

    A recursive query: each round joins the nodes of one depth with their children, so rounds are the tree's depth.
    """
    return nodes.sparkSession.sql(
        """WITH RECURSIVE walk(node, depth, box) AS (SELECT node, 0, box FROM {nodes} WHERE parent IS NULL
        UNION ALL SELECT t.node, w.depth + 1, coalesce(t.box, w.box) FROM {nodes} t JOIN walk w ON t.parent = w.node) SELECT node, depth, box FROM walk""",
        nodes=nodes,
    )


def order_statistics(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, mean, ...): of each group's sorted values the one at floor(n * share), by the names of shares."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"), F.round(F.avg(value), 4).alias("mean"))
    ranked = rows.withColumn("__at", F.row_number().over(Window.partitionBy(group).orderBy(value)) - 1).join(counts, group)
    pick = lambda share: F.round(F.max(F.when(F.col("__at") == F.floor(F.col("n") * F.lit(share)), F.col(value))), 6)
    return ranked.groupBy(group, "n", "mean").agg(*[pick(s).alias(n) for n, s in shares.items()])


def proof_names(pages: DataFrame, dpis: list[str], extension: str, main_extension: str | None) -> DataFrame:
    """(doc, page_number, dpi, name): a proof of each page at each resolution, named apart from the page's own file.

    The suffix is the resolution if there are several, `_native` for the source's; a name that is taken gets `_proof`.
    """
    native = F.col("dpi").isin("native", "source", "original")
    rows = pages.select("doc", "page_number", F.explode(F.array(*[F.lit(d) for d in dpis])).alias("dpi"))
    suffix = F.when(native, F.lit("_native")).when(F.lit(len(dpis) > 1), F.concat(F.lit("_"), F.col("dpi"), F.lit("dpi"))).otherwise(F.lit(""))
    base = F.concat(F.lit("page_"), F.col("page_number").cast("string"))
    taken = F.lit(main_extension == extension) & (suffix == "")
    return rows.select("doc", "page_number", "dpi", F.concat(base, F.when(taken, F.lit("_proof")).otherwise(F.lit("")), suffix, F.lit(f".{extension}")).alias("name"))


def last_wins(files: DataFrame, name: str, order: str) -> DataFrame:
    """Of files of one name in a document the last written stays."""
    w = Window.partitionBy("doc", name).orderBy(F.desc(order))
    return files.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def newest(objects: DataFrame, key: list[str], revision: str) -> DataFrame:
    """The newest revision of each object."""
    others = [c for c in objects.columns if c not in key]
    return objects.groupBy(*key).agg(F.max_by(F.struct(*others), revision).alias("__top")).select(*key, *[F.col(f"__top.{c}").alias(c) for c in others])


def offsets(objects: DataFrame, file: str, order: str, size: str, start: int) -> DataFrame:
    """Where each object of a file begins when they are written one after the other behind a head."""
    before = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return objects.withColumn("offset", F.lit(start) + F.coalesce(F.sum(size).over(before), F.lit(0)))


def plain_text(xhtml: Column, most: int = 10_000) -> Column:
    """A book page's text: tags go, white space is one space; `most` is the format's cap."""
    bare = F.regexp_replace(F.regexp_replace(xhtml, r"<[^>]*>", " "), r"[ \t\n\x0B\f\r]+", " ")
    return F.substring(F.trim(bare), 1, most)


def preflight(text: Column) -> Column:
    """What in a print file's objects isn't allowed in PDF/X-1a, as an array of findings."""
    one = lambda found, said: F.when(found, F.array(F.lit(said))).otherwise(F.array().cast("array<string>"))
    modes = F.regexp_extract_all(text, F.lit(r"/BM\s*/([A-Za-z]+)"), 1)
    alphas = F.regexp_extract_all(text, F.lit(r"/(?:CA|ca)\s+([0-9.]+)"), 1)
    return F.concat(
        one(F.rlike(text, F.lit(r"/S\s*/Transparency\b")), "transparency group"),
        one(F.rlike(text, F.lit(r"/SMask\b")) & ~F.rlike(text, F.lit(r"/SMask\s*/None\b")), "soft mask"),
        F.transform(F.filter(modes, lambda m: ~m.isin("Normal", "Compatible")), lambda m: F.concat(F.lit("blend mode "), m)),
        F.transform(F.filter(alphas, lambda a: a.try_cast("double") < 0.999), lambda a: F.concat(F.lit("opacity "), a)),
    )


#: Kinds of files by their first bytes, in order (fixed values).
MAGIC = [("png", "89504E470D0A1A0A"), ("jpeg", "FFD8FF"), ("tiff", "49492A00"), ("tiff", "4D4D002A"), ("webp", "52494646"), ("bmp", "424D"), ("psd", "38425053"), ("clip", "53514C69746520666F726D6174203300"), ("xcf", "67696D702078636620"), ("pdf", "25504446"), ("eps", "25215053"), ("eps", "C5D0D3C6"), ("ole2", "D0CF11E0A1B11AE1"), ("djvu", "41542654464F524D"), ("zip", "504B0304"), ("raf", "46554A4946494C4D"), ("mrw", "004D524D"), ("x3f", "464F5662"), ("orf", "4949524F"), ("wmf", "D7CDC69A"), ("dwg", "41433130")]


def sniff(hexadecimal: Column) -> Column:
    """A file's kind from its first bytes in hexadecimal; what nothing else is, is a TGA."""
    out = F.lit("tga")
    for kind, head in reversed(MAGIC):
        found = F.startswith(hexadecimal, F.lit(head))
        if kind == "webp":
            found = found & (F.substring(hexadecimal, 17, 8) == "57454250")
        out = F.when(found, F.lit(kind)).otherwise(out)
    return out
