"""Conditions as Columns. Catalyst pushes what reaches a scan down to Parquet."""

from __future__ import annotations

import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbase.errors import TypeMismatch
from quillbase.types import AttrType, CompOp, Value

_COMPARE = {CompOp.EQ: operator.eq, CompOp.LT: operator.lt, CompOp.LE: operator.le, CompOp.GT: operator.gt, CompOp.GE: operator.ge, CompOp.NE: operator.ne}


def compare(left: Column, op: CompOp, right: Column) -> Column:
    """NO_OP holds for every row; with any other operator a NULL on either side drops the row, as a filter does."""
    return F.lit(True) if op is CompOp.NO_OP else _COMPARE[op](left, right)


def check_types(left: AttrType, right: AttrType) -> None:
    if left != right:
        raise TypeMismatch(f"{left.name} compared with {right.name}")


def literal(value: Value) -> Column:
    kinds = {AttrType.INT: "bigint" if isinstance(value.data, int) and abs(value.data) >= 2**31 else "int", AttrType.REAL: "double", AttrType.VARCHAR: "string"}
    return F.lit(value.data).cast(kinds[value.type])
