"""Containers: ZIP archives, SQLite databases, OLE2 files."""

from __future__ import annotations

import io
import sqlite3
import struct
import zipfile

from .model import Damaged

#: Bytes that an entry may say it has.
ENTRY_BYTES = 512 << 20


def safe_name(name: str) -> bool:
    """A name that stays within its archive."""
    return not name.startswith(("/", "\\")) and ".." not in name.replace("\\", "/").split("/") and ":" not in name.split("/")[0]


class Archive:
    """A ZIP archive's entries, stored or deflated; entries that leave the archive or are too large raise Damaged."""

    def __init__(self, data: bytes):
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, ValueError, struct.error, OSError) as e:
            raise Damaged(f"no ZIP archive: {e}") from e
        self.infos = {i.filename: i for i in self.zip.infolist()}
        for name in self.infos:
            if not safe_name(name):
                raise Damaged(f"an entry outside of its archive: {name}")

    def __contains__(self, name: str) -> bool:
        return name in self.infos

    def names(self) -> list[str]:
        return list(self.infos)

    def read(self, name: str) -> bytes:
        info = self.infos.get(name)
        if info is None:
            raise Damaged(f"no entry {name}")
        if info.file_size > ENTRY_BYTES:
            raise Damaged(f"{name} says it has {info.file_size} bytes")
        try:
            with self.zip.open(info) as f:
                out = f.read(ENTRY_BYTES + 1)
        except Exception as e:
            raise Damaged(f"{name}: {e}") from e
        if len(out) > ENTRY_BYTES:
            raise Damaged(f"{name} has more bytes than it says")
        return out

    def text(self, name: str) -> str:
        return self.read(name).decode("utf-8-sig", "replace")


def sqlite_tables(data: bytes) -> dict[str, tuple[list[str], list[tuple]]]:
    """Columns and rows of a database's tables, by name."""
    if data[:16] != b"SQLite format 3\0":
        raise Damaged("no SQLite signature")
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(data)
        out = {}
        for (name,) in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' ORDER BY name").fetchall():
            quoted = name.replace('"', '""')
            rows = db.execute(f'SELECT * FROM "{quoted}"')
            out[name] = ([c[0] for c in rows.description], rows.fetchall())
        return out
    except sqlite3.Error as e:
        raise Damaged(str(e)) from e
    finally:
        db.close()


#: Office kinds by the names of their streams.
STREAMS = {"WordDocument": "doc", "Workbook": "xls", "Book": "xls", "PowerPoint Document": "ppt", "VisioDocument": "vsd", "Quill": "pub"}


def ole2_names(data: bytes) -> list[str]:
    """Names in an OLE2 file's first directory sector."""
    if data[:8] != bytes.fromhex("D0CF11E0A1B11AE1") or len(data) < 512:
        raise Damaged("no OLE2 signature")
    size = 1 << struct.unpack_from("<H", data, 30)[0]
    first = struct.unpack_from("<I", data, 48)[0]
    at, names = 512 + first * size, []
    while at + 128 <= min(len(data), 512 + (first + 1) * size):
        n = struct.unpack_from("<H", data, at + 64)[0]
        if 2 <= n <= 64:
            names.append(data[at : at + n - 2].decode("utf-16-le", "replace"))
        at += 128
    return names


def ole2_kind(data: bytes) -> str:
    return next((STREAMS[n] for n in ole2_names(data) if n in STREAMS), "ole2")
