"""Filter and projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column

from quillbase.errors import TypeMismatch
from quillbase.functions.predicates import check_types, compare, literal
from quillbase.plans.relation import Relation
from quillbase.types import Condition, CompOp


def condition_column(rel: Relation, cond: Condition) -> Column:
    """A condition on one relation; types must agree, as nothing is coerced."""
    if cond.op is CompOp.NO_OP:
        return compare(None, cond.op, None)  # type: ignore[arg-type]
    left = rel.attribute(cond.lhs)
    if cond.rhs_attr is not None:
        check_types(left.type, rel.attribute(cond.rhs_attr).type)
        return compare(rel.column(cond.lhs), cond.op, rel.column(cond.rhs_attr))
    if cond.rhs is None:
        raise TypeMismatch("a condition needs a right-hand side")
    check_types(left.type, cond.rhs.type)
    return compare(rel.column(cond.lhs), cond.op, literal(cond.rhs))


def filter_(rel: Relation, cond: Condition) -> Relation:
    """Rows where the condition holds; stacked filters are a conjunction, which Catalyst merges."""
    return Relation(rel.df.where(condition_column(rel, cond)), rel.attrs, rel.columns, rel.table)


def project(rel: Relation, names: Sequence[str]) -> Relation:
    """The named attributes in the given order, duplicates of rows kept."""
    at = [rel.position(n) for n in names]
    return Relation(rel.df.select(*[rel.columns[i] for i in at]), tuple(rel.attrs[i] for i in at), tuple(rel.columns[i] for i in at), rel.table)
