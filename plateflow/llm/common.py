"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A block of rows that is handled at once holds at most so many characters (or one row).
BLOCK_CHARS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset a local session gets one in its warehouse; on a cluster, where that may be a local disk, it is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.sparkContext.setCheckpointDir(path)
    return path


def file_system(uri: str):
    """pyarrow's file system and path of a URI; Hadoop's names of object stores are taken for those that pyarrow knows."""
    from pyarrow.fs import FileSystem

    scheme, colon, rest = uri.partition("://")
    return FileSystem.from_uri({"s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}.get(scheme, scheme) + colon + rest)


def cut_lineage(df: DataFrame) -> DataFrame:
    """The rows of df from a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """In this block, what an action has shuffled is deleted as it ends, and not when the driver happens to collect garbage.

    That holds for DataFrames that are made here; such that are returned should be made after it, as whoever gets them may
    run them again.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


@contextmanager
def releasing(spark: SparkSession) -> Iterator[None]:
    """In this block, what an action has shuffled is deleted as it ends, and not when the driver happens to collect garbage.

    That holds for DataFrames that are made here; what is returned to others, who may run it again, is made after the block.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def per_block(
    df: DataFrame,
    columns: dict[str, str],
    fn: Callable[[list[list]], list[list]],
    schema: T.StructType | str,
) -> DataFrame:
    """Applies fn to blocks of rows, in Arrow batches, without a shuffle.

    columns: expressions by name; fn gets their values as lists (the last one text, or null) and returns a list for
    each column of schema, which may have another number of rows. A block has BLOCK_CHARS characters or one row, so
    memory does not depend on the size of a partition.
    """
    source = df.select(*[F.expr(e).alias(n) for n, e in columns.items()])
    schema = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return source.mapInArrow(_Blocks(fn, schema), schema)


def edit_rows(df: DataFrame, text_col: str, fn: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: T.StructType | None = None) -> DataFrame:
    """Applies fn(rows, texts) to blocks of df's rows with all their columns; it returns rows of schema (df's own without one)."""
    schema = schema or df.schema
    return df.mapInArrow(_Rows(fn, df.schema.names.index(text_col), schema), schema)


def sliced(batches: Iterator[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the texts at a place make BLOCK_CHARS bytes."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False)
        first = total = 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > BLOCK_CHARS:
                yield batch.slice(first, i - first)
                first, total = i, 0
            total += n
        if len(sizes) > first:
            yield batch.slice(first)


class _Blocks:
    def __init__(self, fn: Callable, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.fn, self.schema, self.owner = fn, to_arrow_schema(schema), fn.__module__

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(self.owner)
        for batch in batches:
            for block in sliced([batch], batch.num_columns - 1):
                yield self.run(block)
        release(self.owner)

    def run(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        out = self.fn([c.to_pylist() for c in batch.columns])
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, self.schema)], schema=self.schema)


class _Rows:
    def __init__(self, fn: Callable, place: int, schema: T.StructType):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.fn, self.place, self.schema, self.owner = fn, place, to_arrow_schema(schema), fn.__module__

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release(self.owner)
        for block in sliced(batches, self.place):
            out = self.fn(block, block.column(self.place).to_pylist())
            yield pa.RecordBatch.from_arrays(out.columns, schema=self.schema)
        release(self.owner)


# What a worker remembers

_REMEMBERED: dict[str, dict] = {}


def remembered(owner: str) -> dict:
    """A worker's memory of one operator (its module), which lasts until another one begins there."""
    return _REMEMBERED.setdefault(owner, {})


def release(owner: str) -> None:
    """Forgets what other operators remember, and hands free memory back to the system."""
    for other in [x for x in _REMEMBERED if x != owner]:
        del _REMEMBERED[other]
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """The field of df's column, nullable, by another name."""
    return T.StructField(name or column, df.schema[column].dataType, True)


# Polynomial hashes of stretches of bytes, modulo 2 ** 64

#: The base (odd, so that it has an inverse), and a random odd value for each byte.
ODD = 0x9E3779B97F4A7C15
BYTE_CODES = np.random.default_rng(7).integers(1, 1 << 63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """ODD ** i, or its inverse, modulo 2 ** 64, for i below n."""
    if len(_POWERS.get(inverse, ())) < n:
        _POWERS[inverse] = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(max(n, 1 << 16), pow(ODD, -1 if inverse else 1, 1 << 64), np.uint64)])
    return _POWERS[inverse][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """s, so that (s[b] - s[a]) * ODD ** -a is a hash of data[a:b] that doesn't depend on a."""
    return np.r_[np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * powers(len(data)))]


def mixed(codes: np.ndarray) -> np.ndarray:
    """Spreads a hash's bits (splitmix64's finisher)."""
    codes = (codes ^ (codes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    codes = (codes ^ (codes >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return codes ^ (codes >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The little-endian integer that begins at each byte (zeros follow the last one)."""
    return np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))


#: Bytes up to which a stretch is named or compared eight at a time; longer ones are few.
SHORT_BYTES = 64
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(8)] + [(1 << 64) - 1], np.uint64)


def names(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each stretch of data. It is no polynomial: every eight bytes are mixed in, and long ones take XXH3."""
    eights, sizes = _eights(data), ends - starts
    code = mixed(sizes.astype(np.uint64) + np.uint64(ODD))
    live, at = np.flatnonzero(sizes <= SHORT_BYTES), 0
    while live.size:
        left = sizes[live] - at
        code[live] = mixed(code[live] * np.uint64(ODD) ^ mixed((eights[starts[live] + at] & _KEEP[np.minimum(left, 8)]) + np.uint64(at + 1)))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(sizes > SHORT_BYTES).tolist():
        code[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), 42)
    return code


def equal_stretches(a: np.ndarray, starts_a: np.ndarray, b: np.ndarray, starts_b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether so many bytes of a and of b are the same, byte for byte."""
    same, eights_a, eights_b = np.ones(len(sizes), bool), _eights(a), _eights(b)
    live, at = np.flatnonzero(sizes <= SHORT_BYTES), 0
    while live.size:
        left = sizes[live] - at
        same[live] &= ((eights_a[starts_a[live] + at] ^ eights_b[starts_b[live] + at]) & _KEEP[np.minimum(left, 8)]) == 0
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(sizes > SHORT_BYTES).tolist():
        same[i] = np.array_equal(a[starts_a[i] : starts_a[i] + sizes[i]], b[starts_b[i] : starts_b[i] + sizes[i]])
    return same


def stretches(data: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the stretches of data between gaps (booleans; the last must be one)."""
    edge = np.flatnonzero(np.diff(np.r_[True, gap].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    return starts, ends, names(data, starts, ends)
