"""Golden results of the query operators, on fixtures rebuilt from FIXTURES.md."""

import pytest

from quillbase import AggregateOp, Attribute, AttrType, CompOp, Condition, Relation, Value, aggregate, bnl_join, filter_, gh_join, inl_join, project
from quillbase.errors import NoSuchAttribute, TypeMismatch

INT, REAL, VARCHAR = AttrType.INT, AttrType.REAL, AttrType.VARCHAR


def left(spark, name="left", n=100):
    return Relation.of(spark.range(n).selectExpr("int(id) A", "int(id + 10) B", "float(id + 50) C"), name)


def right(spark, name="right", n=100):
    return Relation.of(spark.range(n).selectExpr("int(id + 20) B", "float(id + 25) C", "int(id) D"), name)


def leftvarchar(spark):
    return Relation.of(spark.range(1000).selectExpr("int(id + 20) A", "repeat(char(96 + int(id % 26) + 1), int(id % 26) + 1) B"), "leftvarchar")


def rightvarchar(spark):
    return Relation.of(spark.range(1000).selectExpr("repeat(char(96 + int(id % 26) + 1), int(id % 26) + 1) B", "float(id + 10) C"), "rightvarchar")


def group(spark):
    return Relation.of(spark.range(100).selectExpr("int(id % 5 + 1) A", "int(id % 5 + 1) B", "float(id + 50) C"), "group")


def eq(a, b):
    return Condition(a, CompOp.EQ, rhs_attr=b)


def bag(rel):
    return sorted(tuple(r) for r in rel.to_df().collect())


def test_filter_le(spark):
    assert len(bag(filter_(left(spark), Condition("left.B", CompOp.LE, rhs=Value(INT, 30))))) == 21


def test_filter_varchar(spark):
    assert len(bag(filter_(leftvarchar(spark), Condition("leftvarchar.B", CompOp.EQ, rhs=Value(VARCHAR, "l" * 12))))) == 39


def test_project(spark):
    rows = bag(project(right(spark), ["right.C", "right.D"]))
    assert len(rows) == 100 and {d for _, d in rows} == set(range(100))


def test_bnl_join_and_filter(spark):
    joined = bnl_join(left(spark), right(spark), eq("left.B", "right.B"))
    rows = bag(joined)
    assert len(rows) == 90 and {r[1] for r in rows} == set(range(20, 110))
    assert [a.name for a in joined.get_attributes()] == ["left.A", "left.B", "left.C", "right.B", "right.C", "right.D"]
    assert len(bag(filter_(joined, Condition("right.B", CompOp.GE, rhs=Value(INT, 100))))) == 10


def test_inl_join(spark):
    assert len(bag(inl_join(left(spark), right(spark), eq("left.C", "right.C")))) == 75


def test_filter_project_inl_join(spark):
    few = project(filter_(left(spark), Condition("left.B", CompOp.LT, rhs=Value(INT, 75))), ["left.A", "left.C"])
    assert len(bag(inl_join(few, right(spark), eq("left.C", "right.C")))) == 65


def test_gh_join(spark):
    rel = gh_join(left(spark, "largeleft", 50_000), right(spark, "largeright", 50_000), eq("largeleft.C", "largeright.C"), 10)
    assert rel.df.count() == 49_975
    rows = rel.rows()
    assert [len(next(rows)) for _ in range(5)] == [6] * 5  # stopping early is safe


def test_all_strategies_agree(spark):
    for a, b, on in ((left(spark), right(spark), eq("left.B", "right.B")), (leftvarchar(spark), rightvarchar(spark), eq("leftvarchar.B", "rightvarchar.B"))):
        results = [bag(f) for f in (bnl_join(a, b, on), bnl_join(a, b, on, 0), inl_join(a, b, on), gh_join(a, b, on, 3), gh_join(a, b, on, 1))]
        assert results[0] and all(r == results[0] for r in results)


def test_theta_and_self_join(spark):
    a, b = left(spark, "a", 10), left(spark, "b", 10)
    for op, n in ((CompOp.LT, 45), (CompOp.LE, 55), (CompOp.GT, 45), (CompOp.GE, 55), (CompOp.NE, 90), (CompOp.NO_OP, 100)):
        assert bnl_join(a, b, Condition("a.A", op, rhs_attr="b.A")).df.count() == n
    same = left(spark, "a", 10)
    assert len(bag(inl_join(same, Relation(same.df, tuple(Attribute(x.name.replace("a.", "z."), x.type) for x in same.attrs), same.columns), eq("a.A", "z.A")))) == 10


def test_null_keys_never_match(spark):
    a = Relation.of(spark.createDataFrame([(1, "x"), (None, ""), (2, None)], "k int, s string"), "a")
    b = Relation.of(spark.createDataFrame([(1, ""), (None, None), (None, "x")], "k int, s string"), "b")
    for key, n in (("k", 1), ("s", 2)):
        on = eq(f"a.{key}", f"b.{key}")
        assert {len(x.df.collect()) for x in (bnl_join(a, b, on), bnl_join(a, b, on, 0), inl_join(a, b, on), gh_join(a, b, on, 2))} == {n}


def test_null_rule_of_comparisons(spark):
    rel = Relation.of(spark.createDataFrame([(1, 1), (2, None), (None, None), (3, 4)], "x int, y int"), "t")
    count = {op: filter_(rel, Condition("t.x", op, rhs=Value(INT, 2))).df.count() for op in CompOp}
    assert count == {CompOp.EQ: 1, CompOp.LT: 1, CompOp.LE: 2, CompOp.GT: 1, CompOp.GE: 2, CompOp.NE: 2, CompOp.NO_OP: 4}
    assert filter_(rel, Condition("t.x", CompOp.LT, rhs_attr="t.y")).df.count() == 1
    assert filter_(rel, Condition("t.x", CompOp.NE, rhs=Value(INT, None))).df.count() == 0


def test_varchar_order_is_bytes(spark):
    rel = Relation.of(spark.createDataFrame([("ab",), ("abc",), ("Z",), ("é",)], "s string"), "t")
    got = filter_(rel, Condition("t.s", CompOp.LT, rhs=Value(VARCHAR, "abc"))).to_df("s").collect()
    assert {r.s for r in got} == {"Z", "ab"}


def test_aggregates(spark):
    assert bag(aggregate(left(spark), "left.B", AggregateOp.MAX, as_float=True)) == [(109.0,)]
    assert bag(aggregate(right(spark), "right.B", AggregateOp.AVG)) == [(69.5,)]
    low = aggregate(group(spark), "group.A", AggregateOp.MIN, "group.B")
    assert bag(low) == [(i, i) for i in range(1, 6)]
    assert [a.name for a in low.get_attributes()] == ["group.B", "MIN(group.A)"]
    assert bag(aggregate(group(spark), "group.A", AggregateOp.SUM, "group.B")) == [(i, 20 * i) for i in range(1, 6)]
    assert aggregate(left(spark), "left.B", AggregateOp.MAX).get_attributes()[0].name == "MAX(left.B)"
    assert bag(filter_(low, Condition("MIN(group.A)", CompOp.GE, rhs=Value(INT, 4)))) == [(4, 4), (5, 5)]


def test_aggregates_of_nulls(spark):
    rel = Relation.of(spark.createDataFrame([(None, 5), (1, None), (1, 7), (2, None)], "g int, x int"), "t")
    by = lambda op, **k: sorted((tuple(r) for r in aggregate(rel, "t.x", op, "t.g", **k).to_df().collect()), key=str)
    assert by(AggregateOp.COUNT) == [(1, 1), (2, 0), (None, 1)]
    assert by(AggregateOp.COUNT, drop_null_groups=True) == [(1, 1), (2, 0)]
    assert by(AggregateOp.AVG) == [(1, 7.0), (2, None), (None, 5.0)]
    assert bag(aggregate(rel, "t.x", AggregateOp.MIN)) == [(5,)]
    none = filter_(rel, Condition("t.g", CompOp.GT, rhs=Value(INT, 9)))
    assert bag(aggregate(none, "t.x", AggregateOp.COUNT)) == [(0,)] and aggregate(none, "t.x", AggregateOp.MAX).to_df().collect() == [(None,)]
    assert bag(aggregate(none, "t.x", AggregateOp.COUNT, skip_empty=True)) == []


def test_sums_keep_integers(spark):
    rel = Relation.of(spark.createDataFrame([(2**24,), (1,), (1,)], "x int"), "t")
    assert bag(aggregate(rel, "t.x", AggregateOp.SUM)) == [(2**24 + 2,)]


def test_errors(spark):
    with pytest.raises(TypeMismatch):
        filter_(left(spark), Condition("left.B", CompOp.EQ, rhs=Value(REAL, 1.0)))
    with pytest.raises(TypeMismatch):
        aggregate(leftvarchar(spark), "leftvarchar.B", AggregateOp.SUM)
    with pytest.raises(TypeMismatch):
        inl_join(left(spark), right(spark), Condition("left.B", CompOp.LT, rhs_attr="right.B"))
    with pytest.raises(TypeMismatch):
        bnl_join(left(spark), right(spark), eq("left.B", "right.C"))
    with pytest.raises(NoSuchAttribute):
        project(left(spark), ["left.X"])
    with pytest.raises(NoSuchAttribute):
        bnl_join(left(spark), right(spark), eq("left.B", "right.B")).column("B")


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_plans(spark, tmp_path):
    a, b, on = left(spark), right(spark), eq("left.B", "right.B")
    assert "BroadcastHashJoin" in _plan(bnl_join(a, b, on).df)
    assert "ShuffledHashJoin" in _plan(gh_join(a, b, on, 3).df) and _plan(gh_join(a, b, on, 3).df).split("== Physical Plan ==")[1].count("Exchange hash") == 2
    assert "SortMergeJoin" in _plan(inl_join(a, b, on).df)
    left(spark).to_df("A", "B", "C").write.parquet(f"{tmp_path}/left")
    scan = Relation.of(spark.read.parquet(f"{tmp_path}/left"), "left")
    plan = _plan(project(filter_(scan, Condition("left.B", CompOp.LE, rhs=Value(INT, 30))), ["left.A"]).df)
    assert "LessThanOrEqual(B,30)" in plan and "ReadSchema: struct<A:int,B:int>" in plan
