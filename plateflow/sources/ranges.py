"""Bytes of files by ranges, for files that are too large to be held whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes that are read at once; larger reads go past the window.
WINDOW = 1 << 20


class RangeFile:
    """A file with a size, read by ranges: the last window that was read is kept, and parts of it are read from there."""

    def __init__(self, uri: str):
        from pyarrow.fs import FileSystem

        scheme, colon, rest = uri.partition(":")
        files, path = FileSystem.from_uri(uri if rest.startswith("//") else f"{scheme}://{rest}" if colon else uri)
        self.file = files.open_input_file(path)
        self.size = self.file.size()
        self.at, self.held = 0, b""

    def read(self, offset: int, length: int) -> bytes:
        """Fewer bytes at the end; an offset beyond the file is an error."""
        if not 0 <= offset <= self.size or length < 0:
            raise ValueError(f"an offset of {offset} in a file of {self.size} bytes")
        length = min(length, self.size - offset)
        if length > WINDOW:
            return self.file.read_at(length, offset)
        if not self.at <= offset <= offset + length <= self.at + len(self.held):
            self.at, self.held = offset, self.file.read_at(min(WINDOW, self.size - offset), offset)
        return self.held[offset - self.at : offset - self.at + length]

    def slice(self, offset: int, length: int) -> RangeSlice:
        return RangeSlice(self, offset, min(length, max(0, self.size - offset)))

    def close(self) -> None:
        self.file.close()


class RangeSlice:
    """A part of a file, as a file."""

    def __init__(self, file: RangeFile, start: int, size: int):
        self.file, self.start, self.size = file, start, size

    def read(self, offset: int, length: int) -> bytes:
        if not 0 <= offset <= self.size:
            raise ValueError(f"an offset of {offset} in {self.size} bytes")
        return self.file.read(self.start + offset, min(length, self.size - offset))


def listed(source: DataFrame) -> DataFrame:
    """(path, length) of binaryFile rows; the column of contents is pruned, so no file is read."""
    return source.select("path", "length")


def byte_ranges(ranges: DataFrame) -> DataFrame:
    """ranges (path, offset, length) with their content, or an error: no more of a file is read than its ranges and a window.

    A negative offset counts from the file's end.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, path, file = [], None, None
            for name, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    if name != path:
                        if file:
                            file.close()
                        path, file = name, RangeFile(name)
                    rows.append((name, offset, length, file.read(offset if offset >= 0 else max(0, file.size + offset), length), None))
                except (OSError, ValueError) as e:
                    rows.append((name, offset, length, None, f"{type(e).__name__}: {e}"))
            if file:
                file.close()
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=["path", "offset", "length", "content", "error"])

    return ranges.select("path", F.col("offset").cast("long"), F.col("length").cast("long")).mapInArrow(read, "path string, offset long, length long, content binary, error string")
