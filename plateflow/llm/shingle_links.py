"""Links between texts whose sets of word shingles have a Jaccard similarity of `least` or more: all of them, up to chains.

First, minimum hashes. BANDS keys of four of them say where a set meets others; it is held against the first set of each
place (in an order of its own) and linked with the likest of these, if that is similar. What is linked has one label, and in
the next of ROUNDS the likest pair of each label with another one is taken. So a group of near copies gets about one link for
each member, and most of what belongs together has one label.

Then, exactly. In an order of all shingles (those that are common in a sample last) two sets of n and m shingles with that
similarity share one of the first n - least * n + 1 and m - least * m + 1. There the sets meet whose labels differ; at the
first shingle they share, no more can follow than either has left, which leaves out most pairs. The others are judged.
A place of more than BUCKET sets is dealt over pairs of its parts.

A pair is judged by its minimum hashes if these are clear beyond chance, and else by the sets, WHOLE shingles at a time,
unless the sets' parities (for each of PARITIES kinds of shingles, whether their number is odd) differ in more kinds than
similar sets have shingles that aren't shared.
Texts of one set are one node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, mixed, per_block, release
from .components import connected_components

#: Minimum hashes of a set, its keys and the values in each, rounds against the first set of a place, and sets compared in one place.
VALUES, BANDS, ROWS, ROUNDS, BUCKET = 128, 16, 4, 3, 4096
#: Kinds of shingles whose number's parity is kept.
PARITIES = 1024
#: How far above and below the threshold an estimate has to be to decide (a pair at the threshold is 0.3 below once in 10 ** 12 times).
ABOVE, BELOW = 0.15, 0.3
#: Shingles of a set that are compared at once.
WHOLE = 4096
#: Pairs of a place that are looked at at once, and pairs of a batch: what a task holds besides a place.
PAIRS_AT_ONCE, PAIRS_OUT = 1 << 18, 1 << 16
#: The sample that tells common shingles: a share of the rows, within bounds; in how many sets a common one is, and how many are kept.
SAMPLE_SHARE, SAMPLE_LEAST, SAMPLE_MOST, COMMON, COMMON_MOST = 64, 2048, 65_536, 3, 1 << 20
#: Bits of the table that tells which rows' sets are needed.
TABLE_BITS = 24
_TURNS = mixed(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)

#: Labels up to which they are broadcast.
LABELS = 1 << 21
#: Links up to which the driver joins them.
FEW = 1 << 20
#: Columns of sketch(): the set's code, size, keys, and the low 16 bits of its minimum hashes with its parities.
SKETCH = "own long, n long, bands array<long>, values binary"


def minima(codes: np.ndarray) -> np.ndarray:
    """The set's minimum hashes: the least of its codes, each turned by one of VALUES odd factors."""
    least = np.full(VALUES, ~np.uint64(0))
    for i in range(0, len(codes), 512):
        least = np.minimum(least, ((codes[i : i + 512, None] ^ (_TURNS >> np.uint64(7))) * _TURNS).min(axis=0))
    return least


def sketch(codes: np.ndarray) -> tuple[int, int, list[int], bytes]:
    """The columns of SKETCH, from a text's shingle codes (repeats included); a text without words has no keys."""
    codes = np.unique(codes)
    if not len(codes):
        return 0, 0, [], b"\0" * (2 * VALUES + PARITIES // 8)
    found = minima(codes)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) ^ found[k * BANDS : (k + 1) * BANDS])
    odd = np.packbits(np.bincount((codes % np.uint64(PARITIES)).view(np.int64), minlength=PARITIES) & 1 == 1)
    return signed(codes), len(codes), keys.view(np.int64).tolist(), (mixed(found) & np.uint64(0xFFFF)).astype("<u2").tobytes() + odd.tobytes()


def prefix(codes: np.ndarray, least: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles of a set (sorted codes), one of which every similar set has among its own: uncommon ones first."""
    names, times = common
    size = len(codes) - ceil(least * len(codes) - 1e-9) + 1
    if len(names):
        at = np.minimum(np.searchsorted(names, codes), len(names) - 1)
        hit = names[at] == codes
        if hit.any():
            usual = codes[hit]
            codes = np.concatenate([codes[~hit], usual[np.lexsort((usual, times[at[hit]]))]])
    return codes[:size].view(np.int64)


def common_codes(df: DataFrame, codes_of: Callable, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted codes of shingles that are common in a sample of the texts, and in how many of its sets each is.

    What is taken for common decides how many sets meet, and not which links are found.
    """
    share = max(1, int(rows / min(max(rows / SAMPLE_SHARE, SAMPLE_LEAST), SAMPLE_MOST))) if (rows := df.count()) else 1

    def block(columns):
        sets = {signed(c): c for t in columns[0] if len(c := np.unique(codes_of(t)))}
        return [[own for own, c in sets.items() for _ in range(len(c))], np.concatenate([np.zeros(0, np.uint64), *sets.values()]).view(np.int64)]

    seen = per_block(df.where(F.pmod(F.xxhash64(F.col(f"`{text_col}`")), F.lit(share)) == 0), {"text": f"`{text_col}`"}, block, "own long, code long").distinct()
    often = cut_lineage(seen.groupBy("code").agg(F.count("*").alias("times")).where(F.col("times") >= COMMON))
    bound, total = COMMON, 0
    for r in sorted(often.groupBy("times").count().collect(), reverse=True):
        if (total := total + r["count"]) > COMMON_MOST:
            bound = r["times"] + 1
            break
    top = often.where(F.col("times") >= bound).toArrow()
    names, times = top.column(0).to_numpy().astype(np.int64).view(np.uint64), top.column(1).to_numpy().astype(np.int64)
    order = np.argsort(names)
    return names[order], times[order]


def signed(codes: np.ndarray) -> int:
    """The code of a set (its sorted shingle codes), as a signed long."""
    own = xxhash.xxh3_64_intdigest(codes.tobytes())
    return own - (1 << 64) if own >> 63 else own


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Estimated similarities, from low bits of minimum hashes in the last axis."""
    return (x == y).mean(axis=-1)


def _values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Low bits of minimum hashes, and parities."""
    rows = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * VALUES + PARITIES // 8)
    return np.ascontiguousarray(rows[:, : 2 * VALUES]).view("<u2"), rows[:, 2 * VALUES :]


class _Estimated:
    """Reads (a, b, most, total, values of a, values of b); gives (a, b, most, estimate) of pairs that parities don't rule out."""

    def __init__(self, least: float):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, odd_x), (y, odd_y) = _values(batch.column(4)), _values(batch.column(5))
            apart = (1 - self.least) / (1 + self.least) * batch.column(3).to_numpy(zero_copy_only=False) + 1e-6
            may = pa.array(np.bitwise_count(odd_x ^ odd_y).sum(axis=1, dtype=np.int64) <= apart)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(likeness(x, y))], names=["a", "b", "most", "estimate"]).filter(may)


class _Meetings:
    """Reads (key, own, size, label), sorted by key; gives pairs (a, b) of sets of different labels that may be similar if this
    is the first shingle they share, and, of places of more than bucket sets, what it has read (own as a; b is null).

    size: n << 32 | how many shingles there are from this one on; label: null for own. With a fifth column, side, only sets
    of different sides are compared, and no place is too large.
    """

    NAMES = ["key", "a", "b", "size", "label"]

    def __init__(self, least: float, bucket: int | None):
        self.least, self.bucket = least, bucket

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowd = None, None
        release(__name__)
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = list(batch.columns)
            columns[3] = pc.coalesce(columns[3], columns[1])
            rows = np.stack([c.to_numpy(zero_copy_only=False) for c in columns])
            if held is not None:
                rows = np.concatenate([held, rows], axis=1)
            starts = np.flatnonzero(np.r_[True, rows[0, 1:] != rows[0, :-1]])
            if crowd is not None and rows[0, 0] == crowd:  # the rest of a place that was too large before
                end = starts[1] if len(starts) > 1 else rows.shape[1]
                yield self.crowded(rows[:, :end])
                rows, starts = rows[:, end:], starts[1:] - end
                if not rows.shape[1]:
                    held = None
                    continue
            crowd = None
            last = starts[-1]
            yield from self.places(rows[:, :last], starts[:-1])
            held = rows[:, last:]
            if self.bucket and held.shape[1] > self.bucket:
                yield self.crowded(held)
                held, crowd = None, held[0, 0]
        if held is not None:
            yield from self.places(held, np.zeros(1, np.int64))
        release(__name__)

    def places(self, rows: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not rows.shape[1]:
            return
        ends = np.r_[starts[1:], rows.shape[1]]
        mixed_up = np.minimum.reduceat(rows[3], starts) != np.maximum.reduceat(rows[3], starts)
        found = []
        for i in np.flatnonzero(mixed_up).tolist():
            place = rows[:, starts[i] : ends[i]]
            if self.bucket and place.shape[1] > self.bucket:
                yield self.crowded(place)
                continue
            for pairs in self.compared(place):
                found.append(pairs)
                if sum(p.shape[1] for p in found) > PAIRS_OUT:
                    yield from self.pairs(found)
                    found = []
        if found:
            yield from self.pairs(found)

    def compared(self, place: np.ndarray) -> Iterator[np.ndarray]:
        own, label, n, left = place[1], place[3], place[2] >> 32, place[2] & 0xFFFFFFFF
        step = max(1, PAIRS_AT_ONCE // len(own))
        for i in range(0, len(own), step):
            part = slice(i, i + step)
            may = np.minimum(left[part, None], left) >= self.least / (1 + self.least) * (n[part, None] + n) - 1e-9
            may &= (label[part, None] != label) & (own[part, None] < own)
            if len(place) > 4:
                may &= place[4][part, None] != place[4]
            x, y = np.nonzero(may)
            if x.size:
                yield np.stack([own[part][x], own[y]])

    @staticmethod
    def pairs(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        for i in range(0, both.shape[1], PAIRS_OUT):
            a, b = (pa.array(x[i : i + PAIRS_OUT]) for x in both)
            none = pa.nulls(len(a), pa.int64())
            yield pa.RecordBatch.from_arrays([none, a, b, none, none], names=_Meetings.NAMES)

    @staticmethod
    def crowded(rows: np.ndarray) -> pa.RecordBatch:
        key, own, size, label = (pa.array(r) for r in rows[:4])
        return pa.RecordBatch.from_arrays([key, own, pa.nulls(rows.shape[1], pa.int64()), size, label], names=_Meetings.NAMES)


def similar(df: DataFrame, marks: DataFrame, codes_of: Callable, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between codes of sets that connect what chains of pairs of that similarity do.

    marks: (id, own, n, bands, values) of df's rows; codes_of: a text's shingle codes.
    """
    sets = cut_lineage(marks.where("n > 0").select("own", "n", "bands", "values").dropDuplicates(["own"]))
    judged = lambda pairs: _judged(df, marks, pairs, codes_of, id_col, text_col, least)
    values = sets.select("own", "n", "values")
    rows, links, labels = _shared(sets.select("own", F.explode("bands").alias("key"))), None, None
    for turn in range(ROUNDS):
        labelled = rows.withColumn("label", F.col("own")) if labels is None else rows.join(labels, "own", "left").withColumn("label", F.coalesce("label", "own"))
        found = judged(_likest(labelled, values, least, turn))
        links = found if links is None else links.unionByName(found)
        labels = cut_lineage(connected_components(links, FEW).select(F.col("node").alias("own"), F.col("root").alias("label")))
    met = _meeting(_prefixes(df, codes_of, text_col, least), labels, least, bucket)
    return links.unionByName(judged(_estimates(met, values, least).where(F.col("estimate") >= least - BELOW)))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (own, key) of keys that several sets have; few sets share one, and only such rows are needed in each round."""
    several = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return cut_lineage(rows.join(several, "key"))


def _shared(rows: DataFrame) -> DataFrame:
    """The rows (own, key) whose key several sets have; others meet none, in any round."""
    several = rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    return cut_lineage(rows.join(several, "key"))


def _prefixes(df: DataFrame, codes_of: Callable, text_col: str, least: float) -> DataFrame:
    """(own, n, prefix) of df's rows; a set may come from several."""
    common = df.sparkSession.sparkContext.broadcast(common_codes(df, codes_of, text_col))

    def block(columns):
        sets = {signed(c): c for t in columns[0] if len(c := np.unique(codes_of(t)))}
        return [list(sets), [len(c) for c in sets.values()], [prefix(c, least, common.value) for c in sets.values()]]

    return per_block(df, {"text": f"`{text_col}`"}, block, "own long, n long, prefix array<long>")


def _likest(rows: DataFrame, values: DataFrame, least: float, turn: int) -> DataFrame:
    """(a, b, most, estimate): the likest pair of each label with the first sets of its places; rows: (own, key, label)."""
    order = F.struct(F.xxhash64("own", "key", F.lit(turn)), "own", "label")  # another one in each place and turn
    first = rows.groupBy("key").agg(F.min(order).alias("top"), F.count("*").alias("size")).where("size > 1").select("key", F.col("top.own").alias("b"), F.col("top.label").alias("other"))
    met = rows.join(first, "key").where("label <> other").select("label", F.col("own").alias("a"), "b").distinct()
    near = _estimates(met.select("a", "b"), values, least).where(F.col("estimate") >= least - ABOVE)
    likest = near.join(met.select("label", "a").distinct(), "a").groupBy("label").agg(F.max(F.struct("estimate", "a", "b", "most")).alias("m"))
    return likest.select(F.least("m.a", "m.b").alias("a"), F.greatest("m.a", "m.b").alias("b"), "m.most", "m.estimate").distinct()


def _meeting(prefixes: DataFrame, labels: DataFrame, least: float, bucket: int) -> DataFrame:
    """(a, b), once each: all pairs of sets of different labels that may be similar."""
    labels = F.broadcast(labels) if labels.count() <= LABELS else labels
    rows = prefixes.join(labels, "own", "left").select("own", "n", "label", F.posexplode("prefix").alias("at", "key"))
    rows = rows.select("key", "own", (F.shiftleft("n", 32) + F.col("n") - F.col("at")).alias("size"), "label")
    told = "key long, a long, b long, size long, label long"
    found = cut_lineage(rows.repartition("key").sortWithinPartitions("key").mapInArrow(_Meetings(least, bucket), told))
    pairs, crowds = found.where("b is not null").select("a", "b"), found.where("b is null").select("key", F.col("a").alias("own"), "size", "label").distinct()
    if not crowds.isEmpty():
        places = crowds.groupBy("key").agg(F.ceil(2 * F.count("*") / F.lit(bucket)).cast("int").alias("parts"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "parts")
        dealt = crowds.join(places, "key").withColumn("part", F.pmod(F.xxhash64("own"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        # within one part all are of different sides
        side = F.when(F.col("part") == F.col("other"), F.col("own")).otherwise(F.col("part"))
        dealt = dealt.select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("place"), "own", "size", "label", side.alias("side"))
        pairs = pairs.unionByName(cut_lineage(dealt.repartition("place").sortWithinPartitions("place").mapInArrow(_Meetings(least, None), told)).select("a", "b"))
    return pairs.distinct()


def _estimates(pairs: DataFrame, values: DataFrame, least: float) -> DataFrame:
    """(a, b, the larger set's size, estimate) of the pairs (a, b) that parities don't rule out."""
    sides = [values.select(F.col("own").alias(x), F.col("n").alias(f"n_{x}"), F.col("values").alias(f"values_{x}")) for x in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b")
    return both.select("a", "b", F.greatest("n_a", "n_b").alias("most"), (F.col("n_a") + F.col("n_b")).alias("total"), "values_a", "values_b").mapInArrow(_Estimated(least), "a long, b long, most long, estimate double")


def _bits(n: int) -> int:
    """So many low bits of its codes cut a set of n into parts of about WHOLE."""
    return ((n - 1) // WHOLE).bit_length()


def _judged(df: DataFrame, marks: DataFrame, pairs: DataFrame, codes_of: Callable, id_col: str, text_col: str, least: float) -> DataFrame:
    """(a, b) of the pairs (a, b, estimate) of that similarity: by estimates far above it, else by sets, made of the rows that have them alone."""
    told = cut_lineage(pairs)
    clear, gray = told.where(F.col("estimate") > least + ABOVE).select("a", "b"), told.where(F.col("estimate") <= least + ABOVE).select("a", "b", "most")
    if gray.isEmpty():
        return clear
    ends = gray.select(F.col("a").alias("own"), "*").unionByName(gray.select(F.col("b").alias("own"), "*"))
    wanted = marks.join(ends, "own", "left_semi").groupBy("own").agg(F.min(F.xxhash64("id")).alias("at")).select(F.shiftrightunsigned("at", 64 - TABLE_BITS).cast("int").alias("part")).distinct()
    table = np.zeros(1 << TABLE_BITS, bool)
    table[wanted.toArrow().column(0).to_numpy()] = True
    table = df.sparkSession.sparkContext.broadcast(np.packbits(table))

    def needed(columns):
        at, found = np.array(columns[0], np.int64).view(np.uint64) >> np.uint64(64 - TABLE_BITS), {}
        hit = (table.value[at >> np.uint64(3)] >> (7 - (at & np.uint64(7))).astype(np.uint8)) & 1
        for i in np.flatnonzero(hit).tolist():
            if len(codes := np.unique(codes_of(columns[1][i]))):
                found[signed(codes)] = codes
        out = []
        for own, codes in found.items():
            # a similar set may be larger, and cut into more parts
            for bits in range(_bits(len(codes)), _bits(ceil(len(codes) / least)) + 1):
                low = codes & np.uint64((1 << bits) - 1)
                order = np.argsort(low, kind="stable")
                edges = np.searchsorted(low[order], np.arange((1 << bits) + 1, dtype=np.uint64))
                out += [(own, len(codes), bits, p, codes[order[edges[p] : edges[p + 1]]].view(np.int64)) for p in range(1 << bits)]
        return list(zip(*out)) if out else [[]] * 5

    sets = per_block(df, {"at": f"xxhash64(`{id_col}`)", "text": f"`{text_col}`"}, needed, "own long, n long, bits int, part int, said array<long>")
    # sets are compared as the larger one is cut; a set may come from several rows
    bits = F.when(F.col("most") <= WHOLE, 0).otherwise(F.length(F.bin(F.floor((F.col("most") - 1) / WHOLE))))
    met = ends.withColumn("bits", bits).join(sets, ["own", "bits"]).repartition("a", "b")
    sides = [F.first(F.when(F.col("own") == F.col(x), F.col(c)), ignorenulls=True).alias(f"{c}_{x}") for x in "ab" for c in ("n", "said")]
    shared = met.groupBy("a", "b", "part").agg(*sides).groupBy("a", "b").agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.sum(F.size(F.array_intersect("said_a", "said_b"))).alias("shared"))
    good = shared.where(F.col("shared") >= least * (F.col("n_a") + F.col("n_b") - F.col("shared")) - 1e-9)
    return clear.unionByName(cut_lineage(good.select("a", "b")))
