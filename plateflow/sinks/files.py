"""Outputs to a folder: each row's content as a file of its own."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def save(outputs: DataFrame, folder: str) -> None:
    """Writes (filename, content) rows below a folder that all executors reach; a file appears whole or not at all.

    Names that leave the folder are refused. Tasks that run twice write the same files again. The names that were written are
    counted, and if several rows had one, of which one file is left, that is an error.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from pyarrow.fs import FileSystem

        from ..sources.containers import safe_name

        files, base = FileSystem.from_uri(folder)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not safe_name(name):
                    raise ValueError(f"a name outside of the folder: {name}")
                path = f"{base.rstrip('/')}/{name}"
                files.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid4().hex}.part"
                with files.open_output_stream(part) as f:
                    f.write(content.as_py())
                files.move(part, path)
            yield batch.select([0])

    written = outputs.select("filename", "content").where("content IS NOT NULL").mapInArrow(put, "filename string")
    twice = written.groupBy("filename").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"several outputs are named {twice[0]['filename']}")
