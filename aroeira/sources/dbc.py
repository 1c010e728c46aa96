"""DBC files: a DBF header, a checksum, and the compressed records.

No real file was at hand to validate against: tests rest on round trips and on the
published vector of the compression.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyarrow import fs

from . import dbf
from .implode import explode, implode

BATCH = 2000


class InitializationError(RuntimeError):
    pass


class FlushError(RuntimeError):
    """Carries the records that could not be written."""

    def __init__(self, message: str, records: list[dict]) -> None:
        super().__init__(message)
        self.records = records


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, HDFS, object stores) and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def read_bytes(path: str, count: int | None = None) -> bytes:
    system, inner = located(path)
    with system.open_input_stream(inner) as f:
        return f.read(count) if count else f.read()


def to_dbf(data: bytes) -> bytes:
    """The DBF file inside a DBC file; DBF bytes pass through."""
    h = dbf.read_header(data)
    body = data[h.header_size :]
    if body[4:5] in (b"\0", b"\1") and len(body) > 6 and 4 <= body[5] <= 6:
        return data[: h.header_size] + explode(body[4:])
    return data


def from_dbf(data: bytes) -> bytes:
    h = dbf.read_header(data)
    body = data[h.header_size :]
    return data[: h.header_size] + struct.pack("<I", zlib.crc32(data[: h.header_size])) + implode(body)


class DbcReader:
    """Header and records of one file, in memory; nothing temporary is left behind."""

    def __init__(self, path: str, encoding: str = "latin-1") -> None:
        self.path, self.encoding = path, encoding
        self._data = to_dbf(read_bytes(path))
        self._header = dbf.read_header(self._data)
        self._rows: Iterator[dict] | None = None

    @property
    def fields(self) -> tuple[dbf.Field, ...]:
        return self._header.fields

    @property
    def size(self) -> int:
        return self._header.records

    def batches(self, columns: Sequence[str] | None = None) -> Iterable[pa.RecordBatch]:
        return dbf.read_batches(self._data, columns, self.encoding)

    def __iter__(self) -> Iterator[dict]:
        for b in self.batches():
            yield from b.to_pylist()

    def read_batch(self, count: int | None = None) -> list[dict]:
        """The next ``count`` records; absent or 0 means all that are left."""
        if self._rows is None:
            self._rows = iter(self)
        if not count:
            return list(self._rows)
        return [r for _, r in zip(range(count), self._rows)]


class DbcWriter:
    """Writes one file: records collect in batches, ``close`` compresses them."""

    def __init__(self, path: str, fields: Sequence[dbf.Field], on_init_error: Callable | None = None, on_flush_error: Callable | None = None, encoding: str = "latin-1") -> None:
        self.path, self.fields, self.encoding, self._on_flush = path, list(fields), encoding, on_flush_error
        self._buffer: list[dict] = []
        self._written: list[dict] = []
        self.fallback = None
        try:
            dbf.write_table(self.fields, [], encoding)
        except dbf.SchemaError as e:
            error = InitializationError(str(e))
            if on_init_error is None:
                raise error from e
            self.fallback = on_init_error(error)

    def write(self, records: dict | Iterable[dict]) -> None:
        self._buffer += [records] if isinstance(records, dict) else list(records)
        while len(self._buffer) >= BATCH:
            self._flush(BATCH)

    def _flush(self, n: int) -> None:
        chunk, self._buffer = self._buffer[:n], self._buffer[n:]
        try:
            dbf.write_table(self.fields, chunk, self.encoding)
        except Exception as e:
            error = FlushError(str(e), chunk)
            if self._on_flush is None:
                raise error from e
            self._on_flush(error, chunk)
        else:
            self._written += chunk

    def close(self) -> None:
        if self._buffer:
            self._flush(len(self._buffer))
        table = dbf.write_table(self.fields, self._written, self.encoding)
        Path(self.path).write_bytes(from_dbf(table) if str(self.path).lower().endswith(".dbc") else table)
