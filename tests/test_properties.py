"""Operators against plain Python on random small relations."""

import operator

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillbase import AggregateOp, AttrType, CompOp, Condition, Relation, Value, aggregate, bnl_join, filter_, gh_join, inl_join

OPS = {CompOp.EQ: operator.eq, CompOp.LT: operator.lt, CompOp.LE: operator.le, CompOp.GT: operator.gt, CompOp.GE: operator.ge, CompOp.NE: operator.ne}
few = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
numbers = st.one_of(st.none(), st.integers(-3, 3))
table = st.lists(st.tuples(numbers, st.one_of(st.none(), st.sampled_from(["", "a", "ab", "Z", "é"]))), max_size=12)


def relation(spark, rows, name):
    return Relation.of(spark.createDataFrame(rows, "x int, s string"), name)


def bag(rel):
    return sorted(map(str, map(tuple, rel.to_df().collect())))


@few
@given(rows=table, op=st.sampled_from(sorted(OPS, key=str)), value=st.integers(-3, 3))
def test_filter(spark, rows, op, value):
    got = filter_(relation(spark, rows, "t"), Condition("t.x", op, rhs=Value(AttrType.INT, value)))
    assert bag(got) == sorted(str(r) for r in rows if r[0] is not None and OPS[op](r[0], value))


@few
@given(left=table, right=table, key=st.sampled_from(["x", "s"]), n=st.integers(1, 4))
def test_joins(spark, left, right, key, n):
    i = "xs".index(key)
    want = sorted(str((*a, *b)) for a in left for b in right if a[i] is not None and a[i] == b[i])
    a, b, on = relation(spark, left, "a"), relation(spark, right, "b"), Condition(f"a.{key}", CompOp.EQ, rhs_attr=f"b.{key}")
    for got in (bnl_join(a, b, on), bnl_join(a, b, on, 0), inl_join(a, b, on), gh_join(a, b, on, n)):
        assert bag(got) == want


@few
@given(left=table, right=table, op=st.sampled_from(sorted(OPS, key=str)))
def test_theta_join(spark, left, right, op):
    want = sorted(str((*a, *b)) for a in left for b in right if None not in (a[0], b[0]) and OPS[op](a[0], b[0]))
    assert bag(bnl_join(relation(spark, left, "a"), relation(spark, right, "b"), Condition("a.x", op, rhs_attr="b.x"))) == want


@few
@given(rows=table)
def test_grouped_aggregates(spark, rows):
    rel = relation(spark, rows, "t")
    groups = {}
    for x, s in rows:
        groups.setdefault(s, []).extend([] if x is None else [x])
    of = {AggregateOp.COUNT: len, AggregateOp.SUM: lambda v: sum(v) if v else None, AggregateOp.MIN: lambda v: min(v, default=None), AggregateOp.MAX: lambda v: max(v, default=None), AggregateOp.AVG: lambda v: sum(v) / len(v) if v else None}
    for op, f in of.items():
        assert bag(aggregate(rel, "t.x", op, "t.s")) == sorted(str((s, f(v))) for s, v in groups.items())
