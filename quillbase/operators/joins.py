"""Inner joins: the three strategies differ in plan, never in rows.

All output the left attributes, then the right ones. NULL keys match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from quillbase.errors import TypeMismatch
from quillbase.functions.predicates import check_types, compare
from quillbase.plans.relation import Relation
from quillbase.types import Condition, CompOp

PAGE = 4096


def _apart(left: Relation, right: Relation) -> Relation:
    """The right side under column names of its own, for a relation joined with itself."""
    if not set(left.columns) & set(right.columns):
        return right
    fresh = Relation.of(right.to_df(*[f"x{i}" for i in range(len(right.columns))]), "x")
    return Relation(fresh.df, right.attrs, fresh.columns, right.table)


def _key(left: Relation, right: Relation, cond: Condition) -> tuple[Column, Column]:
    if cond.rhs_attr is None:
        raise TypeMismatch("a join compares two attributes")
    check_types(left.attribute(cond.lhs).type, right.attribute(cond.rhs_attr).type)
    return left.column(cond.lhs), right.column(cond.rhs_attr)


def _joined(left: Relation, right: Relation, on: Column, l: DataFrame, r: DataFrame) -> Relation:  # noqa: E741
    columns = (*left.columns, *right.columns)
    return Relation(l.join(r, on, "inner").select(*columns), (*left.attrs, *right.attrs), columns)


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a plan's output."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def bnl_join(left: Relation, right: Relation, cond: Condition, num_pages: int = 2560) -> Relation:
    """The right side is broadcast if its estimated size fits into `num_pages` pages; else Spark chooses.

    Any operator of a condition may join; NO_OP gives all pairs.
    """
    right = _apart(left, right)
    a, b = (None, None) if cond.op is CompOp.NO_OP else _key(left, right, cond)
    small = estimated_bytes(right.df) <= num_pages * PAGE
    return _joined(left, right, compare(a, cond.op, b), left.df, right.df.hint("broadcast") if small else right.df)  # type: ignore[arg-type]


def _equi(left: Relation, right: Relation, cond: Condition) -> tuple[Relation, Column, Column]:
    if cond.op is not CompOp.EQ:
        raise TypeMismatch("this strategy joins on equality only")
    right = _apart(left, right)
    return right, *_key(left, right, cond)


def inl_join(left: Relation, right: Relation, cond: Condition) -> Relation:
    """Both sides in key order: a sort-merge join, which spills and which AQE splits where keys are skewed."""
    right, a, b = _equi(left, right, cond)
    return _joined(left, right, a == b, left.df, right.df.hint("merge"))


def gh_join(left: Relation, right: Relation, cond: Condition, num_partitions: int | None = None) -> Relation:
    """Both sides are hash-partitioned on the key, and each pair of partitions is joined by a hash table.

    Spark plans the shuffles itself, so that AQE sizes the partitions and splits those of skewed keys; a number of
    partitions is accepted for the sake of callers and doesn't change the rows.
    """
    right, a, b = _equi(left, right, cond)
    if num_partitions is not None and num_partitions < 1:
        raise TypeMismatch("a number of partitions is positive")
    return _joined(left, right, a == b, left.df, right.df.hint("shuffle_hash"))
