"""Document fingerprints by content-defined chunking.

A gear hash of the last 32 bytes runs over a text's UTF-8. A chunk ends where the hash's leading bits are zero: more bits
are asked for before the normal size and fewer behind it (normalised chunking), and no chunk is shorter than the least or
longer than the greatest size. Cuts depend on the bytes around them alone, so an insertion moves no cut elsewhere. A
fingerprint is the set of the chunks' digests, each weighted by its chunk's length; what two fingerprints share, by
weight, measures how far one text is contained in the other.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, per_block

#: Bytes of a chunk, and leading zero bits that end one before and from the normal size on. LEAST is the hash's window.
LEAST, NORMAL, GREATEST, STRICT, LOOSE = 32, 64, 512, 7, 5


def _gears() -> np.ndarray:
    """256 values from a mixing rule (splitmix64's finisher)."""
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(32)).astype(np.uint32)


GEARS = _gears()


def gear_hash(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEARS[data[i - k]] << k for k below 32, modulo 2 ** 32, by doubling the window five times."""
    h = GEARS[data]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)
    return h


def chunk_sets(texts: list[str]) -> list[dict[int, int]]:
    """The fingerprint of each text: the length of each chunk by its digest (XXH64)."""
    raw = [t.encode() for t in texts]
    buffer = b"".join(raw)
    if not buffer:
        return [{} for _ in raw]
    h = gear_hash(np.frombuffer(buffer, np.uint8))
    loose = np.flatnonzero(h < np.uint32(1 << (32 - LOOSE)))
    strict = (loose[h[loose] < np.uint32(1 << (32 - STRICT))] + 1).tolist()
    loose = (loose + 1).tolist()
    out, start, digest = [], 0, xxhash.xxh64_intdigest
    end_strict, end_loose = len(strict), len(loose)
    for r in raw:
        end, chunks, at = start + len(r), {}, start
        while at < end:
            if end - at <= LEAST:
                cut = end
            else:
                i = bisect_left(strict, at + LEAST)
                if i < end_strict and strict[i] < at + NORMAL:
                    cut = strict[i]
                else:
                    i = bisect_left(loose, at + NORMAL)
                    cut = loose[i] if i < end_loose and loose[i] < at + GREATEST else at + GREATEST
                if cut > end:
                    cut = end
            chunks[digest(buffer[at:cut])] = cut - at
            at = cut
        out.append(chunks)
        start = end
    return out


def written(chunks: dict[int, int]) -> str:
    """A fingerprint as text: 16 hexadecimal digits of the digest and 3 of the length for each chunk, sorted."""
    return "".join([f"{d:016x}{n:03x}" for d, n in sorted(chunks.items())])


def read(fingerprint: str) -> dict[int, int]:
    return {int(fingerprint[i : i + 16], 16): int(fingerprint[i + 16 : i + 19], 16) for i in range(0, len(fingerprint), 19)}


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """The share of a's weight that b has too; 1 if a is empty."""
    return sum([n for d, n in a.items() if d in b]) / sum(a.values()) if a else 1.0


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """The lesser of both containments: 1 for equal sets only, 0 if one alone is empty."""
    if not a or not b:
        return float(not a and not b)
    return sum([n for d, n in a.items() if d in b]) / max(sum(a.values()), sum(b.values()))


def fingerprint(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fingerprint of each row, as written(). Null and empty texts have an empty one; other columns are ignored."""

    def block(columns):
        return [columns[0], [written(c) for c in chunk_sets([t or "" for t in columns[1]])]]

    return per_block(df, {"id": f"`{id_col}`", "text": f"`{text_col}`"}, block, T.StructType([field(df, id_col), T.StructField("fingerprint", T.StringType())]))


def edit(text: str, other: str) -> str:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of other."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def edited_neighbours(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's text against its edited text and the next row's text, by descending id; the first follows the last.

    Rows of equal ids are in the order of their texts; null ids come last; null texts count as empty; a single row follows
    itself. id must be numeric; rows of one id, and rows without one, are one range, which isn't split. Rows are dealt by ranges of ids whose bounds come from quantiles, sorted there and read as a
    stream; the first text of each range is sent along to the range before it. So texts are shuffled once, memory is bounded
    by a batch, and the driver sees a few numbers for each range.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = rows.select(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10_000)).first()[0]
    bounds = np.array(sorted(set(found or [])))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        """0 for the highest ids; null ids are behind all others."""
        at = pd.Series(len(bounds) - np.searchsorted(bounds, ids.fillna(0).to_numpy(), side="left"))
        return at.where(ids.notna().to_numpy(), len(bounds) + 1).astype("int32")

    rows = rows.withColumn("range", place("id"))
    heads = sorted((r["range"], r["top"]) for r in rows.groupBy("range").agg(F.max("id").alias("top")).collect())
    if not heads:
        return spark.createDataFrame([], _PAIRS_DDL(df, id_col))
    before = {r: heads[i - 1][0] for i, (r, _) in enumerate(heads)}
    tops = [top for _, top in heads if top is not None]
    first = rows.where(F.col("id").isin(tops) | F.col("id").isNull() if tops else F.col("id").isNull()).groupBy("range").agg(F.min("text").alias("text"))
    earlier = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range"))
    first = first.select(F.lit(None).cast(rows.schema["id"].dataType).alias("id"), "text", earlier.alias("range"), F.lit(1).alias("sent"))
    dealt = rows.withColumn("sent", F.lit(0)).unionByName(first).repartition("range").sortWithinPartitions("range", "sent", F.desc_nulls_last("id"), "text")
    schema = _PAIRS_DDL(df, id_col)
    return dealt.select("range", "sent", "id", "text").mapInArrow(_Neighbours(schema), schema)


def _PAIRS_DDL(df: DataFrame, id_col: str) -> T.StructType:  # noqa: N802
    text, number = T.StringType(), T.DoubleType()
    more = [("n_chars", T.LongType()), ("edited_sha256", text), ("fingerprint", text), ("edited_fingerprint", text), ("near_edited", number), ("near_next", number)]
    return T.StructType([field(df, id_col), *[T.StructField(n, t) for n, t in more]])


class _Neighbours:
    """Reads (range, sent, id, text), sorted; the row before each one has it as its next."""

    ROWS = 256

    def __init__(self, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema = to_arrow_schema(schema)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if len(held) > self.ROWS or len(held) > 1 and size > 4_000_000:
                    yield from self.done(held)
                    held, size = held[-1:], len(row[3])
        yield from self.done(held)

    def done(self, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        """The rows but for the last one, whose next isn't known (it is a sent one at the end)."""
        pairs = [(i, i + 1) for i in range(len(rows) - 1) if not rows[i][1] and rows[i + 1][0] == rows[i][0]]
        if not pairs:
            return
        own = chunk_sets([r[3] for r in rows])
        edited = [edit(rows[i][3], rows[j][3]) for i, j in pairs]
        new = chunk_sets(edited)
        columns = [
            [rows[i][2] for i, _ in pairs],
            [len(rows[i][3]) for i, _ in pairs],
            [sha256(t.encode()).hexdigest() for t in edited],
            [written(own[i]) for i, _ in pairs],
            [written(c) for c in new],
            [likeness(own[i], c) for (i, _), c in zip(pairs, new)],
            [likeness(own[i], own[j]) for i, j in pairs],
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
