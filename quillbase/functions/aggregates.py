"""Aggregate functions: partial aggregation, spill and merging are Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillbase.errors import TypeMismatch
from quillbase.types import AggregateOp, AttrType


def aggregate_column(op: AggregateOp, column: Column, kind: AttrType) -> Column:
    """NULLs are skipped; COUNT counts values; sums are kept in 64 bits."""
    if kind not in (AttrType.INT, AttrType.REAL) and op is not AggregateOp.COUNT:
        raise TypeMismatch(f"{op.name} of {kind.name}")
    wide = column.cast("double") if kind is AttrType.REAL and op in (AggregateOp.SUM, AggregateOp.AVG) else column
    return {AggregateOp.MIN: F.min, AggregateOp.MAX: F.max, AggregateOp.COUNT: F.count, AggregateOp.SUM: F.sum, AggregateOp.AVG: F.avg}[op](wide)
