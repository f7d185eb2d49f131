"""The packed tuple format: a NULL bitmap, most significant bit first, then the values that are not NULL.

INT and REAL take 4 bytes, little-endian; VARCHAR a 4-byte length and its UTF-8 bytes. It serves programs that exchange
packed tuples; the engine itself never stores them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame

from quillbase.types import Attribute, AttrType, schema


def nulls_size(n_fields: int) -> int:
    return (n_fields + 7) // 8


def pack(values: Sequence[Any], attrs: Sequence[Attribute]) -> bytes:
    bitmap, out = bytearray(nulls_size(len(attrs))), []
    for i, (v, a) in enumerate(zip(values, attrs, strict=True)):
        if v is None:
            bitmap[i // 8] |= 128 >> i % 8
        elif a.type is AttrType.VARCHAR:
            data = v.encode()
            out.append(struct.pack("<i", len(data)) + data)
        else:
            out.append(struct.pack("<i" if a.type is AttrType.INT else "<f", v))
    return bytes(bitmap) + b"".join(out)


def unpack(data: bytes, attrs: Sequence[Attribute]) -> list[Any]:
    at, out = nulls_size(len(attrs)), []
    for i, a in enumerate(attrs):
        if data[i // 8] & 128 >> i % 8:
            out.append(None)
        elif a.type is AttrType.VARCHAR:
            n = struct.unpack_from("<i", data, at)[0]
            out.append(data[at + 4 : at + 4 + n].decode())
            at += 4 + n
        else:
            out.append(struct.unpack_from("<i" if a.type is AttrType.INT else "<f", data, at)[0])
            at += 4
    return out


def tuple_length(data: bytes, attrs: Sequence[Attribute]) -> int:
    """Bytes of the tuple that `data` begins with."""
    return len(pack(unpack(data, attrs), attrs))


def tuple_max_size(attrs: Sequence[Attribute]) -> int:
    return nulls_size(len(attrs)) + sum(4 + (a.length if a.type is AttrType.VARCHAR else 0) for a in attrs)


def pack_rows(df: DataFrame, attrs: Sequence[Attribute], name: str = "tuple") -> DataFrame:
    """One binary column of packed rows."""
    names = [a.name for a in attrs]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*(b.column(i).to_pylist() for i in range(len(names))), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([pack(r, attrs) for r in rows], pa.binary())], names=[name])

    return df.select(*[f"`{n}`" for n in names]).mapInArrow(run, f"{name} binary")


def unpack_rows(df: DataFrame, attrs: Sequence[Attribute], name: str = "tuple") -> DataFrame:
    """The rows of a column of packed tuples."""
    kinds = {AttrType.INT: pa.int32(), AttrType.REAL: pa.float32(), AttrType.VARCHAR: pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [unpack(t, attrs) for t in b.column(0).to_pylist()]
            columns = [pa.array([r[i] for r in rows], kinds[a.type]) for i, a in enumerate(attrs)]
            yield pa.RecordBatch.from_arrays(columns, names=[a.name for a in attrs])

    return df.select(name).mapInArrow(run, schema(list(attrs)))
