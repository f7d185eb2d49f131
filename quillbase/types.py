"""Attributes, values and conditions, and their Spark counterparts."""

from __future__ import annotations

import enum
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

from quillbase.errors import TypeMismatch


class AttrType(enum.IntEnum):
    INT = 0
    REAL = 1
    VARCHAR = 2
    #: Spark types beyond the three; they pass through scans, projections and joins.
    OTHER = 3


class CompOp(enum.Enum):
    EQ = "="
    LT = "<"
    LE = "<="
    GT = ">"
    GE = ">="
    NE = "<>"
    NO_OP = ""


class AggregateOp(enum.IntEnum):
    MIN = 0
    MAX = 1
    COUNT = 2
    SUM = 3
    AVG = 4


@dataclass(frozen=True)
class Attribute:
    name: str
    type: AttrType
    length: int = 4

    def spark_type(self) -> T.DataType:
        return {AttrType.INT: T.IntegerType(), AttrType.REAL: T.FloatType(), AttrType.VARCHAR: T.StringType(), AttrType.OTHER: T.BinaryType()}[self.type]


@dataclass(frozen=True)
class Value:
    """A typed literal; data None is NULL."""

    type: AttrType
    data: Any

    @staticmethod
    def of(data: Any) -> Value:
        if isinstance(data, bool) or not isinstance(data, (int, float, str)):
            raise TypeMismatch(f"no attribute type for {data!r}")
        return Value(AttrType.INT if isinstance(data, int) else AttrType.REAL if isinstance(data, float) else AttrType.VARCHAR, data)


@dataclass(frozen=True)
class Condition:
    """lhs op rhs, where rhs is an attribute's name or a literal."""

    lhs: str
    op: CompOp
    rhs_attr: str | None = None
    rhs: Value | None = None


def attr_type(kind: T.DataType) -> AttrType:
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return AttrType.INT
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return AttrType.REAL
    return AttrType.VARCHAR if isinstance(kind, (T.StringType, T.VarcharType, T.CharType)) else AttrType.OTHER


def attributes(schema: T.StructType) -> list[Attribute]:
    """A DataFrame's columns as attributes; a string's declared length comes from the field's metadata."""
    return [Attribute(f.name, attr_type(f.dataType), int(f.metadata.get("length", 8 if isinstance(f.dataType, (T.LongType, T.DoubleType)) else 4))) for f in schema.fields]


def schema(attrs: list[Attribute]) -> T.StructType:
    return T.StructType([T.StructField(a.name, a.spark_type(), True, {"length": a.length}) for a in attrs])
