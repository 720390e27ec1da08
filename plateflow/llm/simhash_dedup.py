"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has 64 bits. For radius r, bit i gets a vector m(i) of r + 1 bits that isn't zero, and each v of r + 1 bits
that isn't zero makes a mask of the bits with odd <m(i), v>. The vectors of r differing bits span at most r dimensions, so
some v is orthogonal to all of them and its mask leaves the differing bits out: every pair within the radius is equal
under at least one of the 2 ** (r + 1) - 1 masks. Fingerprints, one for all documents that have it, meet in the tables'
buckets, are compared there, and each bucket gives the links of a spanning forest. A bucket of more than BUCKET
fingerprints isn't gathered: its members meet, as exactly, in the values that lie within half the radius of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_lineage, edit_rows, field, per_block, releasing
from .components import connected_components
from .shingle_links import SKETCH, similar, sketch

BITS, SEED = 64, 42
#: Fingerprints that are compared with each other in one place.
BUCKET = 4096
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SHINGLES_AT_ONCE = 1 << 16
#: Ids up to which they are broadcast, so that texts aren't shuffled.
IDS = 1 << 21


def shingle_codes(text: str | None, shingle: int = 3) -> np.ndarray:
    """Each shingle's XXH64 (UTF-8, seed 42), as often as it occurs.

    A-Z are lower-cased; words lie between ASCII white space. Fewer words than a shingle has: all of them are one; no words
    or null: none.
    """
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [" ".join(words)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def simhash(text: str | None, shingle: int = 3) -> int:
    """The fingerprint, unsigned: a bit is 1 if it is set in over half the shingle_codes(); 0 without any."""
    return _majority(shingle_codes(text, shingle))


def _majority(codes: np.ndarray) -> int:
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(codes), SHINGLES_AT_ONCE):
        part = codes[i : i + SHINGLES_AT_ONCE]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(codes), bitorder="little").view(np.uint64)[0]) if len(codes) else 0


def fingerprints(df: DataFrame, id_col: str, text_col: str, shingle: int = 3) -> DataFrame:
    """(id, fp) of each row; fp is the fingerprint as a signed long."""

    def block(columns):
        return [columns[0], np.array([simhash(t, shingle) for t in columns[1]], np.uint64).view(np.int64)]

    return per_block(df, {"id": f"`{id_col}`", "text": f"`{text_col}`"}, block, T.StructType([field(df, id_col, "id"), T.StructField("fp", T.LongType())]))


def masks(radius: int) -> list[int]:
    """The covering masks, as signed longs."""
    size = 2 ** (radius + 1) - 1
    found = [sum(1 << i for i in range(BITS) if ((i % size + 1) & v).bit_count() % 2) for v in range(1, size + 1)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def links(fps: DataFrame, radius: int = 3, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fps (fp) that connect whatever chains of pairs within the radius do."""
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks(radius))]))
    dealt = fps.select("fp", keys.alias("k")).select("k.table", "k.key", "fp").repartition("table", "key").sortWithinPartitions("table", "key")
    found = cut_lineage(dealt.mapInArrow(_Buckets(radius, bucket), "large boolean, a long, b long"))
    large = found.where("large").select(F.col("a").alias("fp")).distinct()
    return found.where("not large").select("a", "b").unionByName(_by_balls(large, radius)).distinct()


def _by_balls(fps: DataFrame, radius: int) -> DataFrame:
    """The same links by meeting places: x and y within r share a value within r // 2 of x and within r - r // 2 of y.

    A value's members number as many as a ball has values, whatever the number of rows.
    """
    near, far = radius // 2, radius - radius // 2
    flips = [[sum(1 << i for i in c) for c in combinations(range(BITS), n)] for n in range(far + 1)]
    inner = np.array([x for f in flips[: near + 1] for x in f], np.uint64)
    outer = np.array([x for f in flips for x in f], np.uint64)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(values), 256):
                part = values[i : i + 256]
                at = (part.view(np.uint64)[:, None] ^ outer).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.repeat(part, len(outer))), pa.array(np.tile(np.arange(len(outer)) < len(inner), len(part)))], names=["at", "fp", "inner"])

    met = fps.mapInArrow(expand, "at long, fp long, inner boolean").groupBy("at").agg(F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("members"))
    return met.where("a is not null and size(members) > 1").select("a", F.explode("members").alias("b")).where("a <> b").distinct()


class _Buckets:
    """Reads (table, key, fp), sorted by table and key; gives links of each bucket, or its members if it is large."""

    def __init__(self, radius: int, bucket: int):
        self.radius, self.bucket = radius, bucket

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, key, held, large = None, None, np.zeros(0, np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            tables, keys, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            starts = np.flatnonzero(np.r_[True, (tables[1:] != tables[:-1]) | (keys[1:] != keys[:-1])])
            ends = np.r_[starts[1:], len(fps)]
            out: list[np.ndarray] = []
            goes_on = (tables[0], keys[0]) == (table, key)
            if not goes_on and not large:
                out.append(self.compared(held))
            # the first run may end what the batch before began, the last may go on in the next one
            for i in sorted({0, len(starts) - 1}):
                if i or not goes_on:
                    held, large = np.zeros(0, np.int64), False
                held = np.r_[held, fps[starts[i] : ends[i]]]
                if large or len(held) > self.bucket:
                    out.append(np.stack([np.ones(len(held), np.int64), held, held]))
                    held, large = np.zeros(0, np.int64), True
                if i < len(starts) - 1 and not large:
                    out.append(self.compared(held))
            table, key = tables[-1], keys[-1]
            inner = np.arange(1, len(starts) - 1)
            for i in inner[(ends - starts)[1:-1] > 1].tolist():
                run = fps[starts[i] : ends[i]]
                out.append(self.compared(run) if len(run) <= self.bucket else np.stack([np.ones(len(run), np.int64), run, run]))
            yield from self.rows(out)
        if not large:
            yield from self.rows([self.compared(held)])

    def compared(self, fps: np.ndarray) -> np.ndarray:
        """A spanning forest of the pairs within the radius; pairs that are connected already aren't looked at."""
        values, found = fps.astype(np.int64).view(np.uint64), []
        label = np.arange(len(values))
        for i in range(len(values) - 1):
            rest = label[i + 1 :]
            near = np.flatnonzero((np.bitwise_count(values[i + 1 :] ^ values[i]) <= self.radius) & (rest != label[i]))
            if near.size:
                others, first = np.unique(rest[near], return_index=True)
                found += [(0, int(fps[i]), int(fps[i + 1 + j])) for j in near[first].tolist()]
                label[np.isin(label, others)] = label[i]
        return np.array(found, np.int64).reshape(-1, 3).T

    @staticmethod
    def rows(out: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if out and (all_rows := np.concatenate(out, axis=1)).shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(all_rows[0] == 1), pa.array(all_rows[1]), pa.array(all_rows[2])], names=["large", "a", "b"])


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _labelled(marks: DataFrame, radius: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, root, least): every fingerprint of marks (id, fp), its component by links and more (a, b), and the least id of that."""
    fps = cut_lineage(marks.groupBy("fp").agg(F.min("id").alias("least")))
    found = links(fps.select("fp"), radius)
    roots = connected_components(found.unionByName(more) if more is not None else found)
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    rooted = cut_lineage(rooted)
    return rooted.drop("least").join(rooted.groupBy("root").agg(F.min("least").alias("least")), "root")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row for each row of df: id, fingerprint (hexadecimal) and component_id.

    Fingerprints within the radius are linked; component_id is the least id that is reachable. Null and empty texts have
    fingerprint 0, linked like any other. Repeated rows stay; null ids are never the least unless all are null; other
    columns are ignored; an empty table gives an empty result.
    """
    marks = cut_lineage(fingerprints(df, id_col, text_col, shingle))
    labels = _labelled(marks, radius).select("fp", "least")
    return marks.join(labels, "fp").select(F.col("id").alias(id_col), hexadecimal(F.col("fp")).alias("fingerprint"), F.col("least").alias("component_id"))


def _similar(df: DataFrame, marks: DataFrame, id_col: str, text_col: str, shingle: int, least: float) -> DataFrame:
    """Links (a, b) between fingerprints of texts whose shingles have a Jaccard similarity of least or more; marks has the sets' sketches."""
    pairs = marks.where("n > 0").select("own", "fp").distinct()
    low = cut_lineage(pairs.groupBy("own").agg(F.min("fp").alias("low")))
    alike = pairs.join(low, "own").where("fp <> low").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    a, b = (low.select(F.col("own").alias(x), F.col("low").alias(f"low_{x}")) for x in "ab")
    found = similar(df, marks, lambda text: shingle_codes(text, shingle), id_col, text_col, least).join(a, "a").join(b, "b").where("low_a <> low_b")
    return alike.unionByName(found.select(F.col("low_a").alias("a"), F.col("low_b").alias("b")))


def _kept(df: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, least: float | None) -> tuple[DataFrame, DataFrame]:
    """What stays (__id, __fp, __times, __rows: how many rows have that id and fingerprint, and that id), and all ids (__id)."""
    if least is None:
        marks, more = cut_lineage(fingerprints(df, id_col, text_col, shingle)), None
    else:

        def block(columns):
            codes = [shingle_codes(t, shingle) for t in columns[1]]
            return [columns[0], np.array([_majority(c) for c in codes], np.uint64).view(np.int64), *zip(*map(sketch, codes))]

        fields = [field(df, id_col, "id"), T.StructField("fp", T.LongType()), *T.StructType.fromDDL(SKETCH).fields]
        marks = cut_lineage(per_block(df, {"id": f"`{id_col}`", "text": f"`{text_col}`"}, block, T.StructType(fields)))
        more = _similar(df, marks, id_col, text_col, shingle, least)
        marks = marks.select("id", "fp")
    own = marks.groupBy("id", "fp").agg(F.count("*").alias("times"))
    rooted = _labelled(marks, radius, more).select("fp", "root")
    kept = own.join(rooted, "fp").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp", "times")).alias("k")).select("k.id", "k.fp", "k.times")
    rows = marks.groupBy("id").agg(F.count("*").alias("rows"))
    kept = cut_lineage(kept.join(rows.select(F.col("id").alias("own"), "rows"), F.col("id").eqNullSafe(F.col("own"))).select(F.col("id").alias("__id"), F.col("fp").alias("__fp"), F.col("times").alias("__times"), F.col("rows").alias("__rows")))
    return kept, marks.select(F.col("id").alias("__id")).distinct()


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3, least: float | None = None) -> DataFrame:
    """df's rows, one of each component: that of the least id, and of these that of the least fingerprint.

    With least, texts whose distinct shingles have that Jaccard similarity or more are linked too, whatever their
    fingerprints. All columns stay. Repeated rows of that id and fingerprint become one.
    """
    with releasing(df.sparkSession):
        kept, ids = _kept(df, id_col, text_col, shingle, radius, least)
        one, several = kept.where("__rows = 1").select("__id"), kept.where("__rows > 1")
        own = one.withColumnRenamed("__id", "__own")
        rest = cut_lineage(ids.join(own, F.col("__id").eqNullSafe(F.col("__own")), "left_anti"))
        again, stay, go = cut_lineage(several.select("__id").distinct()), one.count(), rest.count()
        repeated = again.count()
    # an id that only one row has tells which row; texts are read once, and for other ids alone marked again
    told, how = (rest, "left_anti") if go < stay else (one, "left_semi")
    told = F.broadcast(told) if min(go, stay) <= IDS else told
    out = df.join(told, df[id_col].eqNullSafe(told["__id"]), how)
    if not repeated:
        return out
    place = df.schema.names.index(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField("__own", T.LongType())])

    def marked(rows: pa.RecordBatch, texts: list) -> pa.RecordBatch:
        fps = np.array([simhash(t, shingle) for t in texts], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(fps)], names=[*rows.schema.names, "__own"])

    again = F.broadcast(again) if repeated <= IDS else again
    rows = edit_rows(df.join(again, df[id_col].eqNullSafe(again["__id"]), "left_semi"), df.schema.names[place], marked, schema)
    rows = rows.join(several, rows["__own"].eqNullSafe(several["__fp"]) & rows[id_col].eqNullSafe(several["__id"]))
    once = rows.where("__times > 1").dropDuplicates(["__id", "__fp"])
    return out.unionByName(rows.where("__times = 1").unionByName(once).select(*[f"`{c}`" for c in df.columns]))
