"""Scalar and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillbase.functions.aggregates import aggregate_column
from quillbase.plans.relation import Relation
from quillbase.types import AggregateOp, Attribute, AttrType, attr_type


def aggregate(rel: Relation, attr: str, op: AggregateOp, group: str | None = None, *, drop_null_groups: bool = False, skip_empty: bool = False, as_float: bool = False) -> Relation:
    """One attribute OP(relation.attribute), after the grouping attribute if there is one.

    NULL keys form a group, and an aggregate without groups of no rows gives one row, as in SQL; the flags give the
    other customs: no group for NULL, no row for no rows, and results as 4-byte floats.
    """
    source = rel.attribute(attr)
    value = aggregate_column(op, rel.column(attr), source.type)
    value = (value.cast("float") if as_float else value).alias("value")
    name = f"{op.name}({source.name})"
    if group is None:
        df = rel.df.agg(value, F.count(F.lit(1)).alias("n"))
        df = (df.where("n > 0") if skip_empty else df).select("value")
        columns, attrs = ["value"], []
    else:
        key = rel.column(group)
        df = (rel.df.where(key.isNotNull()) if drop_null_groups else rel.df).groupBy(key.alias("key")).agg(value)
        columns, attrs = ["key", "value"], [rel.attribute(group)]
    kind = attr_type(df.schema["value"].dataType)
    out = Relation.of(df.select(*columns), "x")
    return Relation(out.df, (*attrs, Attribute(name, AttrType.REAL if as_float else kind, 4)), out.columns)
