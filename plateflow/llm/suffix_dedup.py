"""Exact removal of repeated passages by a logarithmic family of suffix arrays.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Every window of that length has an
anchor, the least hash among its 16-byte strings (the leftmost of equals), so equal windows have equal anchors. Windows
next to each other that share one make a stretch. Stretches meet by their anchors' hashes, which decide nothing else:

- an anchor that occurs once rules out all its windows, and nothing but its hash is moved;
- stretches that are equal as a whole (by 128 bits of XXH3) are repeated as a whole. Those of one shard are found there,
  and one of them goes on for all; of those of different shards only counts are moved;
- the distinct stretches that share an anchor's hash are compared in one place. There a batch of windows gets a suffix array
  (suffixes in byte order, as far as `length` goes); suffix arrays of equal size are merged, geometrically, and the scan
  of each merge finds the matches that are long enough;
- a hash with more than CROWD distinct stretches isn't gathered: 128-bit hashes of pieces of them, and at the edges of
  repeated passages of single windows, are counted instead, as exactly.

A family lives as long as the anchors that it compares: the levels are kept in memory, and are not stored for later runs.
Texts are written once, in shards, to the shared folder, and each later step reads a shard where it needs it; shuffles
hold hashes, positions and the bytes of stretches that are yet to be compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, file_system, mixed, powers, prefix_sums, release, shared_dir

#: Bytes of an anchor, of a shard, and positions that are handled at once (2 ** PLACE_BITS at most).
ANCHOR, SHARD_BYTES, PLACE_BITS = 16, 8_000_000, 20
#: Stretches of one anchor's hash that are compared in one place, windows of a piece of others; windows of a batch and, about, of a
#: family; most tasks that families are dealt to, each of which has one after the other.
CROWD, PIECE, BATCH, FAMILY_WINDOWS, TASKS = 2000, 16, 1 << 15, 150_000, 1 << 14


# Suffix arrays


class SuffixFamily:
    """Suffix arrays of windows of a text, whose sizes grow geometrically, over buffer (bytes as uint8)."""

    def __init__(self, buffer: np.ndarray, length: int):
        self.buffer, self.length = buffer, length
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []  # rank, the windows' starts in order of their bytes, their strings
        self.repeated = np.zeros(len(buffer), bool)

    def strings(self, starts: np.ndarray) -> np.ndarray:
        view = np.ndarray((len(self.buffer) - self.length + 1,), f"S{self.length}", self.buffer, strides=(1,))
        return view[starts]

    def add(self, starts: np.ndarray) -> None:
        """A batch of windows: its suffix array, matched within, then merged with levels of its size while there are any."""
        strings = self.strings(starts)
        order = np.argsort(strings)
        level = 0, *self.scan(starts[order], strings[order])
        while self.levels and self.levels[-1][0] <= level[0]:
            level = level[0] + 1, *self.merge(self.levels.pop()[1:], level[1:])
        self.levels.append(level)

    def merge(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        starts, strings = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        order = np.argsort(strings, kind="stable")  # two sorted runs: merged in linear time
        return self.scan(starts[order], strings[order])

    def scan(self, starts: np.ndarray, strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Marks windows that equal a neighbour; one of those that are equal stays."""
        same = strings[1:] == strings[:-1]
        if same.any():
            self.repeated[starts[1:][same]] = True
            self.repeated[starts[:-1][same]] = True
            first = np.r_[True, ~same]
            return starts[first], strings[first]
        return starts, strings

    def finish(self) -> np.ndarray:
        """Merges what levels there are; returns for each start whether its window occurs elsewhere."""
        while len(self.levels) > 1:
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append((max(a[0], b[0]) + 1, *self.merge(a[1:], b[1:])))
        return self.repeated


# Stretches


def digests(raw: bytes, starts: list[int], ends: list[int]) -> list[bytes]:
    """128 bits of each stretch's content."""
    digest = xxhash.xxh3_128_digest
    return [digest(raw[a:b]) for a, b in zip(starts, ends)]


def stretches_of(data: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """For documents that lie one after the other (ends: where each ends): arrays of anchor hash, two halves of the content's, start, windows.

    A stretch is of windows within one document that have the same anchor.
    """
    span = length - ANCHOR + 1
    for low in range(0, max(0, len(data) - length + 1), step := (1 << PLACE_BITS) - length):
        part = data[low : low + step + length - 1]
        sums, back = prefix_sums(part), powers(len(part) + 1, inverse=True)
        codes = mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * back[: len(part) - ANCHOR + 1])
        places = np.arange(len(codes), dtype=np.uint64)
        low_bits = np.uint64((1 << PLACE_BITS) - 1)
        keys = (codes & ~low_bits) | places
        # least of each span, from the leasts of blocks up to and from a place
        n = len(codes) - span + 1
        blocks = np.r_[keys, np.full(-len(keys) % span, ~np.uint64(0))].reshape(-1, span)
        up_to, onward = np.minimum.accumulate(blocks, axis=1).ravel(), np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        anchor = (np.minimum(onward[:n], up_to[span - 1 : span - 1 + n]) & low_bits).astype(np.int64)
        first = np.searchsorted(ends, low + np.arange(n), side="right")
        inside = low + np.arange(n) + length <= ends[np.minimum(first, len(ends) - 1)]
        new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1]) | (first[1:] != first[:-1])])
        stop = np.r_[new[1:], n]
        keep = inside[new]
        new, stop = new[keep], stop[keep]
        content = np.frombuffer(b"".join(digests(part.tobytes(), new.tolist(), (stop + length - 1).tolist())), np.int64).reshape(-1, 2)
        yield codes[anchor[new]].view(np.int64), content[:, 0], content[:, 1], new + low, stop - new


# Steps over DataFrames


class _Shards:
    """Reads (id, text); writes shards and gives (shard, k, c, d, g, n, times): each stretch's shard, hashes, start in it and windows.

    Of stretches of the shard that are equal one row stands for all, which are so many; rows with times = 0 are runs of
    windows that are known to occur elsewhere: these stretches', and one of none for the shard itself.
    """

    def __init__(self, folder: str, length: int):
        self.folder, self.length = folder, length

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(__name__)
        held, size = [], 0
        for batch in batches:
            rows = batch.num_rows
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            first = 0
            for i, t in enumerate(texts):
                size += len(t)
                if size >= SHARD_BYTES or i == rows - 1:
                    held.append((batch.column(0).slice(first, i + 1 - first), texts[first : i + 1]))
                    first = i + 1
                if size >= SHARD_BYTES:
                    yield from self.shard(held)
                    held, size = [], 0
        if held:
            yield from self.shard(held)

    def shard(self, held: list) -> Iterator[pa.RecordBatch]:
        shard = uuid4().int >> 65
        raw = [t for _, part in held for t in part]
        files, folder = file_system(self.folder)
        with files.open_output_stream(f"{folder}/{shard:x}") as out:
            ids = pa.chunked_array([c for c, _ in held])
            pq.write_table(pa.table({"id": ids, "text": pa.array(raw, pa.large_binary())}), out, compression="zstd", compression_level=1, use_dictionary=False, write_statistics=False)
        data = np.frombuffer(b"".join(raw), np.uint8)
        found = list(stretches_of(data, np.cumsum([len(r) for r in raw]), self.length))
        k, c, d, g, n = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*found)) if found else [np.zeros(0, np.int64)] * 5
        order = np.lexsort((d, c))
        k, c, d, g, n = k[order], c[order], d[order], g[order], n[order]
        first = np.flatnonzero(np.r_[np.ones(min(1, len(c)), bool), (c[1:] != c[:-1]) | (d[1:] != d[:-1])])
        times = np.diff(np.r_[first, len(c)])
        known = np.repeat(times > 1, times)
        none = np.zeros(1 + int(known.sum()), np.int64)
        yield self.rows(shard, k[first], c[first], d[first], g[first], n[first], times)
        yield self.rows(shard, none, none, none, np.r_[0, g[known]], np.r_[0, n[known]], none)

    @staticmethod
    def rows(shard: int, *columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), shard, np.int64)), *(pa.array(x.astype(np.int64)) for x in columns)], names=["shard", "k", "c", "d", "g", "n", "times"])


class _ByShard:
    """Reads rows (shard, g, ...) sorted by shard, and hands each shard's rows with its ids and texts to fn."""

    def __init__(self, folder: str, fn):
        self.folder, self.fn = folder, fn

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            shards = batch.column(0).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]]).tolist()
            for a, b in zip(starts, [*starts[1:], len(shards)]):
                if shards[a] != shard and held:
                    yield from self.one(shard, held)
                    held = []
                shard = int(shards[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from self.one(shard, held)

    def one(self, shard: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = file_system(self.folder)
        with files.open_input_file(f"{folder}/{shard:x}") as f:
            table = pq.read_table(f)
        yield from self.fn(shard, pa.Table.from_batches(held), table.column("id").combine_chunks(), table.column("text").to_pylist())


def _bytes_of(length: int):
    def rows(shard: int, wanted: pa.Table, ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """(k, shard, g, n, crowded, bytes) of stretches."""
        data = b"".join(texts)
        for batch in wanted.to_batches(max_chunksize=20_000):
            g, n = batch.column("g").to_pylist(), batch.column("n").to_pylist()
            part = pa.array([data[a : a + b + length - 1] for a, b in zip(g, n)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("shard"), batch.column("g"), batch.column("n"), batch.column("crowded"), part], names=["k", "shard", "g", "n", "crowded", "bytes"])

    return rows


def _ranges(shard: np.ndarray, g: np.ndarray, hit: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(shard, g, n) of the runs of windows that are hit; owner and offset: each window's stretch and place in it."""
    at = np.flatnonzero(hit)
    if at.size:
        first = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]
        begin = at[first]
        count = np.diff(np.r_[np.flatnonzero(first), at.size])
        yield pa.RecordBatch.from_arrays([pa.array(shard[owner[begin]]), pa.array(g[owner[begin]] + offset[begin]), pa.array(count)], names=["shard", "g", "n"])


class _Compare:
    """Reads stretches (k, shard, g, n, bytes), sorted by k; gives (shard, g, n): runs of windows that occur elsewhere.

    Stretches of neighbouring hashes share a family until that has FAMILY_WINDOWS windows; then the next one begins.
    """

    def __init__(self, length: int):
        self.length = length

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(__name__)
        held, windows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]).tolist()
            counts = np.add.reduceat(n, starts).tolist()
            first = 0
            for at, more in zip(starts, counts):
                goes_on = at == 0 and held and held[-1].column(0)[-1].as_py() == k[0]
                if not goes_on and windows + more > FAMILY_WINDOWS and windows:
                    if at > first:
                        held.append(batch.slice(first, at - first))
                    yield from self.compared(held)
                    held, windows, first = [], 0, at
                windows += more
            held.append(batch.slice(first))
        if held:
            yield from self.compared(held)

    def compared(self, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, g, n = (np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (1, 2, 3))
        data = np.frombuffer(b"".join(x for b in held for x in b.column(4).to_pylist()), np.uint8)
        owner = np.repeat(np.arange(len(n)), n)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        size = n + self.length - 1
        starts = (np.cumsum(size) - size)[owner] + offset
        family = SuffixFamily(data, self.length)
        for i in range(0, len(starts), BATCH):
            family.add(starts[i : i + BATCH])
        yield from _ranges(shard, g, family.finish()[starts], owner, offset)


def _pieces(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(k, o, core, whole, shard, g, names): runs of up to PIECE windows whose places before the anchor have o in common.

        core: a hash of what all windows of that place share, so windows of pieces with different cores differ; whole: a hash
        of all their bytes; names: each window's hash. Hashes have 128 bits.
        """
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(pa.binary())]
        for wide in batches:
            for at in range(0, wide.num_rows, 1000):
                out: list[list] = [[], [], [], [], [], [], []]
                for k, shard, g, n, raw in zip(*(c.to_pylist() for c in wide.slice(at, 1000).columns)):
                    data = np.frombuffer(raw, np.uint8)
                    sums, back = prefix_sums(data), powers(len(data) + 1, inverse=True)
                    grams = np.arange(len(data) - ANCHOR + 1)
                    anchor = int(np.argmax(mixed((sums[grams + ANCHOR] - sums[grams]) * back[grams]).view(np.int64) == k))
                    names = digests(raw, list(range(n)), list(range(length, n + length)))
                    place = (np.arange(n) - anchor) // PIECE
                    first = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
                    last = (np.r_[first[1:], n] - 1).tolist()
                    low = place[first] * PIECE + anchor
                    cores = digests(raw, (low + PIECE - 1).tolist(), (low + length).tolist())
                    wholes = digests(raw, first.tolist(), [x + length for x in last])
                    for column, x in zip(out, ([k] * len(first), place[first].tolist(), cores, wholes, [shard] * len(first), (g + first).tolist(), [names[i : j + 1] for i, j in zip(first.tolist(), last)])):
                        column += x
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["k", "o", "core", "whole", "shard", "g", "names"])

    return rows


def _crowded(named: DataFrame, length: int, folder: str) -> DataFrame:
    """(shard, g, n) of windows that occur elsewhere, for anchors with too many stretches to gather: by counts of 128-bit hashes.

    Pieces that are equal as a whole are repeated as a whole, and one stands for all. Of these, those that no other one
    shares its core with are done with; what is left, at the edges of repeated passages, is counted window by window.
    Equal pieces of one shard are one row, so no piece has more rows than there are shards.
    """
    pieces = named.mapInArrow(_pieces(length), "k long, o long, core binary, whole binary, shard long, g long, names array<binary>")
    same = ["k", "o", "whole", "n"]
    pieces = pieces.withColumn("n", F.size("names").cast("long")).groupBy(*same, "shard").agg(F.collect_list("g").alias("all"), F.first("core").alias("core"), F.first("names").alias("names"))
    pieces = _kept(pieces, f"{folder}/pieces")
    one = F.min(F.struct("shard", F.array_min("all").alias("g"), "core", "names")).alias("one")
    equal = _kept(pieces.groupBy(*same).agg(F.sum(F.size("all")).alias("times"), one), f"{folder}/equal")
    repeated = pieces.select(*same, "shard", "all").join(equal.where("times > 1").select(*same), same).select("shard", F.explode("all").alias("g"), "n")
    single = equal.select("k", "o", "one.*")
    cores = _kept(single.groupBy("k", "o", "core").agg(F.count("*").alias("times")).where("times > 1").drop("times"), f"{folder}/cores")
    alone = single.join(cores, ["k", "o", "core"]).select("k", "shard", "g", F.posexplode("names").alias("i", "name"))
    twice = _kept(alone.groupBy("k", "name").agg(F.count("*").alias("times")).where("times > 1").drop("times"), f"{folder}/twice")
    return repeated.unionByName(alone.join(twice, ["k", "name"]).select("shard", (F.col("g") + F.col("i")).alias("g"), F.lit(1).cast("long").alias("n")))


def _cut(length: int, id_type: pa.DataType):
    def rows(shard: int, found: pa.Table, ids: pa.Array, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        """(id, text, n_bytes, spans, kept) of a shard's documents; found: runs of windows to cut."""
        sizes = np.array([len(t) for t in texts])
        data = np.frombuffer(b"".join(texts), np.uint8)
        g, n = found.column("g").to_numpy(), found.column("n").to_numpy()
        g, n = g[n > 0], n[n > 0]
        cover = np.zeros(len(data) + 1, np.int64)
        np.add.at(cover, g, 1)
        np.add.at(cover, g + n + length - 1, -1)
        gone = np.cumsum(cover)[:-1] > 0
        end = np.cumsum(sizes)
        kept, spans = [], []
        for a, b, whole in zip((end - sizes).tolist(), end.tolist(), texts):
            cut = gone[a:b]
            if cut.any():
                edge = np.flatnonzero(np.diff(np.r_[False, cut, False].astype(np.int8)))
                spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                kept.append(data[a:b][~cut].tobytes())
            else:
                spans.append([])
                kept.append(whole)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])

    return rows


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, crowd: int = CROWD) -> DataFrame:
    """One row for each row of df: id, n_bytes, spans and kept.

    spans: the maximal removed runs (start, end) in bytes of the text's UTF-8; kept: the bytes that stay (a cut may part a
    character). A byte goes if a string of `length` bytes over it also starts elsewhere, in this or another row; strings
    are judged on the input. Null and empty texts have no bytes; null and repeated ids are rows like any other; other
    columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/suffix-{uuid4()}"
    shards = f"{folder}/shards"
    _make(shards)
    found = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_Shards(shards, length), "shard long, k long, c long, d long, g long, n long, times long")
    found = _kept(found, f"{folder}/stretches")
    # counts are written before they are joined, so that a join can split a hash with very many rows
    often = _kept(found.where("times > 0").groupBy("k").agg(F.sum("times").alias("all")).where("all > 1").select("k"), f"{folder}/often")
    shared = _kept(found.where("times > 0").join(often, "k"), f"{folder}/shared")
    classes = shared.groupBy("k", "c", "d").agg(F.sum("times").alias("times"), F.count("*").alias("shards"), F.min(F.struct("shard", "g", "n")).alias("one"))
    classes = _kept(classes, f"{folder}/classes")
    several = _kept(classes.groupBy("k").agg(F.count("*").alias("classes")).where("classes > 1"), f"{folder}/several")
    open_ones = classes.join(several, "k").select("one.shard", "one.g", "one.n", "k", (F.col("classes") > crowd).alias("crowded"))
    named = _by_shard(open_ones, shards, _bytes_of(length), "k long, shard long, g long, n long, crowded boolean, bytes binary")
    named = _kept(named, f"{folder}/bytes")
    windows = named.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, min(TASKS, -(-windows // FAMILY_WINDOWS)))
    columns = ["k", "shard", "g", "n", "bytes"]
    compared = named.where("not crowded").select(*columns).repartition(tasks, "k").sortWithinPartitions("k").mapInArrow(_Compare(length), "shard long, g long, n long")
    counted = _crowded(named.where("crowded").select(*columns), length, folder)
    whole = shared.join(classes.where("shards > 1").select("k", "c", "d"), ["k", "c", "d"]).select("shard", "g", "n")
    every = found.where("times = 0").select("shard", "g", "n")
    schema = T.StructType([field(df, id_col, "id"), *T.StructType.fromDDL("n_bytes long, spans array<struct<start: long, end: long>>, kept binary").fields])
    cut = _by_shard(every.unionByName(whole).unionByName(compared).unionByName(counted), shards, _cut(length, None), schema)
    return cut.withColumnRenamed("id", id_col)


def _by_shard(rows: DataFrame, shards: str, fn, schema) -> DataFrame:
    return rows.select("shard", *[c for c in rows.columns if c != "shard"]).repartition("shard").sortWithinPartitions("shard").mapInArrow(_ByShard(shards, fn), schema)


def _make(folder: str) -> None:
    files, path = file_system(folder)
    files.create_dir(path, recursive=True)


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df, written to the shared folder and read again: its rows name shards that one attempt of each task wrote."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def digest_columns(cut: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns, from remove_repeats()'s result."""
    removed = F.col("n_bytes") - F.octet_length("kept")
    return cut.select(id_col, "n_bytes", removed.cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by a dictionary of all windows; for tests."""
    raw = [(t or "").encode() for t in texts]
    seen: dict[bytes, int] = {}
    for r in raw:
        for i in range(len(r) - length + 1):
            seen[r[i : i + length]] = seen.get(r[i : i + length], 0) + 1
    out = []
    for r in raw:
        gone = bytearray(len(r))
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, x in zip(r, gone) if not x)
        out.append((len(r), sum(gone), sum(1 for i, x in enumerate(gone) if x and not (i and gone[i - 1])), sha256(kept).hexdigest()))
    return out
