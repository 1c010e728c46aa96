"""DBF tables: header, records to Arrow, rows to bytes.

Types: C text (trailing blanks cut), N and F whole numbers or doubles, D date,
L boolean, I 32-bit whole number, B double.  Blank fields and fields that do not read
as their type are null; deleted records are left out.  A value that does not fit its
field, or a character that the encoding lacks, is an error when written: nothing is cut.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from datetime import date

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T

TYPES = "CNFDLIB"


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    size: int
    decimals: int = 0

    def checked(self) -> Field:
        if not 1 <= len(self.name.encode("latin-1", "replace")) <= 10:
            raise SchemaError(f"field name {self.name!r} must have 1 to 10 characters")
        if self.type not in TYPES or len(self.type) != 1:
            raise SchemaError(f"field type {self.type!r} is unknown")
        if not 1 <= self.size <= 254:
            raise SchemaError(f"size {self.size} of field {self.name!r} is out of range")
        return self

    @property
    def spark_type(self) -> T.DataType:
        if self.type in "NF":
            return T.DoubleType() if self.decimals else T.IntegerType() if self.size < 10 else T.LongType() if self.size < 19 else T.DoubleType()
        return {"C": T.StringType(), "D": T.DateType(), "L": T.BooleanType(), "I": T.IntegerType(), "B": T.DoubleType()}[self.type]


@dataclass(frozen=True)
class Header:
    records: int
    header_size: int
    record_size: int
    fields: tuple[Field, ...]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, f.spark_type) for f in self.fields])


def read_header(data: bytes) -> Header:
    if len(data) < 33:
        raise SchemaError("no DBF header")
    records, header_size, record_size = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at + 32 <= min(header_size, len(data)) and data[at] != 0x0D:
        name = data[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append(Field(name, chr(data[at + 11]), data[at + 16], data[at + 17]))
        at += 32
    if not fields or record_size != 1 + sum(f.size for f in fields):
        raise SchemaError("the header's fields and record size disagree")
    return Header(records, header_size, record_size, tuple(fields))


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _texts(raw: np.ndarray, encoding: str) -> pa.Array:
    """Trailing blanks and zero bytes cut, empty as null; one pass over the column's bytes if they are ASCII."""
    width = raw.dtype.itemsize
    data = np.ascontiguousarray(raw).view(np.uint8).reshape(len(raw), width)
    if (data < 128).all():
        offsets = pa.py_buffer(np.arange(0, (len(raw) + 1) * width, width, dtype=np.int32).tobytes())
        whole = pa.Array.from_buffers(pa.string(), len(raw), [None, offsets, pa.py_buffer(data.tobytes())])
        text = pc.utf8_rtrim(whole, " \0")
    else:
        text = pa.array([bytes(r).decode(encoding, "replace").rstrip(" \0") for r in data], pa.string())
    return pc.if_else(pc.equal(text, ""), pa.scalar(None, pa.string()), text)


def _column(f: Field, raw: np.ndarray, encoding: str) -> pa.Array:
    if f.type in "IB":
        return pa.array(np.ascontiguousarray(raw).view("<i4" if f.type == "I" else "<f8"))
    text = _texts(raw, encoding)
    if f.type == "C":
        return text
    text, none = pc.utf8_trim(text, " "), pa.scalar(None, pa.string())
    fits = lambda pattern: pc.if_else(pc.match_substring_regex(text, pattern), text, none)
    if f.type == "D":
        day = pc.strptime(fits("^[0-9]{8}$"), format="%Y%m%d", unit="s", error_is_null=True)
        real = pc.equal(pc.strftime(day, format="%Y%m%d"), text)  # the 30th of February is read as a day of March
        return pc.if_else(real, day, pa.scalar(None, day.type)).cast(pa.date32())
    if f.type == "L":
        upper = pc.utf8_upper(text)
        true, false = (pc.is_in(upper, pa.array(x)) for x in (["T", "Y"], ["F", "N"]))
        return pc.if_else(true, True, pc.if_else(false, False, pa.scalar(None, pa.bool_())))
    number = pc.utf8_ltrim(fits(_NUMBER), "+")
    if isinstance(f.spark_type, T.DoubleType):
        return number.cast(pa.float64())
    whole = pc.match_substring_regex(number, "^-?[0-9]+$")
    exact = pc.if_else(whole, number, none).cast(pa.int64())
    cut = pc.trunc(pc.if_else(whole, none, number).cast(pa.float64())).cast(pa.int64(), safe=False)
    return pc.coalesce(exact, cut).cast(pa.int32() if isinstance(f.spark_type, T.IntegerType) else pa.int64())


def read_batches(data: bytes, columns: Sequence[str] | None = None, encoding: str = "latin-1", rows: int = 65536) -> Iterable[pa.RecordBatch]:
    """Record batches of the chosen columns (all by default), decoded column by column."""
    h = read_header(data)
    count = min(h.records, (len(data) - h.header_size) // h.record_size)
    wanted, at = [], 1
    for f in h.fields:
        if columns is None or f.name in columns:
            wanted.append((f, at))
        at += f.size
    layout = np.dtype({"names": ["deleted", *(str(i) for i in range(len(wanted)))], "formats": ["S1", *(f"V{f.size}" for f, _ in wanted)], "offsets": [0, *(o for _, o in wanted)], "itemsize": h.record_size})
    body = np.frombuffer(data, layout, count, h.header_size)
    for start in range(0, count, rows):
        part = body[start : start + rows]
        part = part[part["deleted"] != b"*"]
        yield pa.RecordBatch.from_arrays([_column(f, part[str(i)], encoding) for i, (f, _) in enumerate(wanted)], names=[f.name for f, _ in wanted])


def _written(f: Field, v, encoding: str) -> bytes:
    if f.type == "I":
        return struct.pack("<i", v or 0)
    if f.type == "B":
        return struct.pack("<d", v if v is not None else float("nan"))
    if v is None:
        text = ""
    elif f.type == "D":
        text = v.strftime("%Y%m%d") if isinstance(v, date) else str(v).replace("-", "")
    elif f.type == "L":
        text = "T" if v else "F"
    elif f.type in "NF":
        text = f"{v:.{f.decimals}f}" if f.decimals else str(int(v))
        if len(text) > f.size:
            raise SchemaError(f"{v} does not fit field {f.name}")
        return text.rjust(f.size).encode("ascii")
    else:
        text = str(v)
    raw = text.encode(encoding)
    if len(raw) > f.size:
        raise SchemaError(f"a text of {len(raw)} bytes does not fit field {f.name} of {f.size}")
    return raw.ljust(f.size)


def write_table(fields: Sequence[Field], rows: Iterable[dict], encoding: str = "latin-1") -> bytes:
    """A DBF file; fields absent from a row are blank."""
    checked = [f.checked() for f in fields]
    body = [b" " + b"".join(_written(f, r.get(f.name), encoding) for f in checked) for r in rows]
    size = 32 + 32 * len(checked) + 1
    today = date.today()
    head = struct.pack("<BBBBIHH20x", 3, today.year - 1900, today.month, today.day, len(body), size, 1 + sum(f.size for f in checked))
    head += b"".join(struct.pack("<11sc4xBB14x", f.name.encode("latin-1"), f.type.encode(), f.size, f.decimals) for f in checked)
    return head + b"\r" + b"".join(body) + b"\x1a"


def fields_of(schema: T.StructType, sizes: dict[str, int] | None = None) -> list[Field]:
    """Fields that hold a Spark schema; text is 254 wide, the most a field can hold, unless a size is given."""
    out = []
    for s in schema.fields:
        n = (sizes or {}).get(s.name)
        if isinstance(s.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            f = Field(s.name, "N", n or 9)
        elif isinstance(s.dataType, T.LongType):
            f = Field(s.name, "N", n or 18)
        elif isinstance(s.dataType, (T.FloatType, T.DoubleType)):
            f = Field(s.name, "B", 8)
        elif isinstance(s.dataType, T.DateType):
            f = Field(s.name, "D", 8)
        elif isinstance(s.dataType, T.BooleanType):
            f = Field(s.name, "L", 1)
        else:
            f = Field(s.name, "C", n or 254)
        out.append(f.checked())
    return out
