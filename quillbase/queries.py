"""Queries over the driver's tables, one or more for each operator, and their SQL."""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.operators import aggregate, bnl_join, filter_, gh_join, inl_join, project
from quillbase.plans.relation import Relation
from quillbase.session import Engine
from quillbase.errors import NoSuchIndex, NoSuchRid, NoSuchTable
from quillbase.functions import codec
from quillbase.sources.index import IndexFile
from quillbase.sources.storage import PageFile
from quillbase.types import AggregateOp, Attribute, AttrType, CompOp, Condition, Value, attributes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _table(spark: SparkSession, sf_dir: str, name: str, alias: str | None = None) -> Relation:
    return Relation.of(spark.read.parquet(f"{sf_dir}/{name}.parquet"), alias or name)


def _plain(rel: Relation) -> DataFrame:
    """Under bare attribute names."""
    return rel.to_df(*[a.name.rpartition(".")[2] for a in rel.attrs])


def _int(n: int) -> Value:
    return Value(AttrType.INT, n)


def _real(x: float) -> Value:
    return Value(AttrType.REAL, x)


def _text(s: str) -> Value:
    return Value(AttrType.VARCHAR, s)


def _filtered(name: str, table: str, attr: str, op: CompOp, value: Value, where: str) -> None:
    @_register(name, f"SELECT * FROM {table} WHERE {where}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _plain(filter_(_table(spark, sf_dir, table), Condition(f"{table}.{attr}", op, rhs=value)))


_filtered("filter_int_le", "part", "p_size", CompOp.LE, _int(30), "p_size <= 30")
_filtered("filter_varchar_eq", "orders", "o_orderstatus", CompOp.EQ, _text("F"), "o_orderstatus = 'F'")
_filtered("filter_ne", "customer", "c_mktsegment", CompOp.NE, _text("BUILDING"), "c_mktsegment <> 'BUILDING'")
_filtered("filter_lt", "lineitem", "l_quantity", CompOp.LT, _real(10.0), "l_quantity < 10")
_filtered("filter_gt", "lineitem", "l_quantity", CompOp.GT, _real(45.0), "l_quantity > 45")
_filtered("filter_ge", "orders", "o_totalprice", CompOp.GE, _real(200000.0), "o_totalprice >= 200000")


@_register("filter_col_col", "SELECT * FROM lineitem WHERE l_discount > l_tax")
def filter_col_col(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filter_(_table(spark, sf_dir, "lineitem"), Condition("l_discount", CompOp.GT, rhs_attr="l_tax")))


@_register("filter_null_dropped", "SELECT p_partkey, nullif(p_size, 30) AS size FROM part WHERE nullif(p_size, 30) <> 10")
def filter_null_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _table(spark, sf_dir, "part").pipe(lambda d: d.select("p_partkey", F.nullif("p_size", F.lit(30)).alias("size")), "p")
    return _plain(filter_(rel, Condition("p.size", CompOp.NE, rhs=_int(10))))


@_register("filter_conjunction", "SELECT * FROM part WHERE p_size > 10 AND p_brand = 'Brand#13'")
def filter_conjunction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = filter_(_table(spark, sf_dir, "part"), Condition("p_size", CompOp.GT, rhs=_int(10)))
    return _plain(filter_(rel, Condition("p_brand", CompOp.EQ, rhs=_text("Brand#13"))))


@_register("no_op_scan", "SELECT * FROM nation")
def no_op_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(filter_(_table(spark, sf_dir, "nation"), Condition("n_name", CompOp.NO_OP)))


@_register("project_reorder", "SELECT o_totalprice, o_orderkey FROM orders")
def project_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain(project(_table(spark, sf_dir, "orders"), ["orders.o_totalprice", "orders.o_orderkey"]))


@_register("bnl_join_eq", "SELECT l_orderkey, l_linenumber, o_custkey, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def bnl_join_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = bnl_join(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, "orders"), Condition("l_orderkey", CompOp.EQ, rhs_attr="o_orderkey"))
    return _plain(project(rel, ["l_orderkey", "l_linenumber", "o_custkey", "o_totalprice"]))


@_register("bnl_join_filter", "SELECT customer.*, nation.* FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal >= 5000")
def bnl_join_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = bnl_join(_table(spark, sf_dir, "customer"), _table(spark, sf_dir, "nation"), Condition("c_nationkey", CompOp.EQ, rhs_attr="n_nationkey"))
    return _plain(filter_(rel, Condition("c_acctbal", CompOp.GE, rhs=_real(5000.0))))


@_register("inl_join", "SELECT o_orderkey, o_totalprice, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def inl_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = inl_join(_table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer"), Condition("o_custkey", CompOp.EQ, rhs_attr="c_custkey"))
    return _plain(project(rel, ["o_orderkey", "o_totalprice", "c_custkey", "c_name"]))


def _grace(name: str, table: str, left: str, right: str, kept: list[str]) -> None:
    @_register(name, f"SELECT {', '.join(kept)} FROM lineitem JOIN {table} ON {left} = {right}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rel = gh_join(_table(spark, sf_dir, "lineitem"), _table(spark, sf_dir, table), Condition(left, CompOp.EQ, rhs_attr=right), n)
        return _plain(project(rel, kept))


_grace("gh_join", "part", "l_partkey", "p_partkey", ["l_orderkey", "l_linenumber", "p_partkey", "p_brand", "p_size"])
_grace("gh_join_supplier", "supplier", "l_suppkey", "s_suppkey", ["l_orderkey", "l_linenumber", "s_suppkey", "s_name"])


@_register("join_theta_lt", "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM supplier a JOIN supplier b ON a.s_acctbal < b.s_acctbal")
def join_theta_lt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = bnl_join(_table(spark, sf_dir, "supplier", "a"), _table(spark, sf_dir, "supplier", "b"), Condition("a.s_acctbal", CompOp.LT, rhs_attr="b.s_acctbal"))
    return project(rel, ["a.s_suppkey", "b.s_suppkey"]).to_df("a_key", "b_key")


@_register("join_self_alias", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def join_self_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = inl_join(_table(spark, sf_dir, "nation", "a"), _table(spark, sf_dir, "nation", "b"), Condition("a.n_regionkey", CompOp.EQ, rhs_attr="b.n_regionkey"))
    return project(rel, ["a.n_name", "b.n_name"]).to_df("a_name", "b_name")


@_register("join_null_keys", "SELECT c_custkey, n_name FROM (SELECT c_custkey, nullif(c_nationkey, 0) AS k FROM customer) c JOIN nation ON k = n_nationkey")
def join_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _table(spark, sf_dir, "customer").pipe(lambda d: d.select("c_custkey", F.nullif("c_nationkey", F.lit(0)).alias("k")), "c")
    return _plain(project(bnl_join(left, _table(spark, sf_dir, "nation"), Condition("c.k", CompOp.EQ, rhs_attr="n_nationkey")), ["c_custkey", "n_name"]))


@_register("join_varchar_key", "SELECT a.n_nationkey AS a_key, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_name = b.n_name")
def join_varchar_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = gh_join(_table(spark, sf_dir, "nation", "a"), _table(spark, sf_dir, "nation", "b"), Condition("a.n_name", CompOp.EQ, rhs_attr="b.n_name"), 4)
    return project(rel, ["a.n_nationkey", "b.n_name"]).to_df("a_key", "b_name")


def _aggregated(name: str, table: str, attr: str, op: AggregateOp, group: str | None = None) -> None:
    sql = f"{op.name.lower()}({attr}) AS value FROM {table}"

    @_register(name, f"SELECT {group} AS grp, {sql} GROUP BY {group}" if group else f"SELECT {sql}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return aggregate(_table(spark, sf_dir, table), attr, op, group).to_df(*(["grp", "value"] if group else ["value"]))


_aggregated("agg_min", "part", "p_size", AggregateOp.MIN)
_aggregated("agg_max", "lineitem", "l_extendedprice", AggregateOp.MAX)
_aggregated("agg_sum", "lineitem", "l_quantity", AggregateOp.SUM)
_aggregated("agg_avg", "lineitem", "l_quantity", AggregateOp.AVG)
_aggregated("agg_count", "part", "p_size", AggregateOp.COUNT)
_aggregated("agg_count_varchar", "part", "p_brand", AggregateOp.COUNT)
_aggregated("agg_group_sum", "lineitem", "l_quantity", AggregateOp.SUM, "l_returnflag")
_aggregated("agg_group_count", "lineitem", "l_orderkey", AggregateOp.COUNT, "l_discount")
_aggregated("agg_group_avg", "orders", "o_totalprice", AggregateOp.AVG, "o_custkey")
_aggregated("agg_group_varchar_key", "customer", "c_acctbal", AggregateOp.MAX, "c_mktsegment")
_aggregated("agg_group_min_varchar_key", "part", "p_size", AggregateOp.MIN, "p_brand")


@_register("agg_group_null", "SELECT nullif(p_size, 30) AS grp, count(p_partkey) AS value FROM part GROUP BY nullif(p_size, 30)")
def agg_group_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _table(spark, sf_dir, "part").pipe(lambda d: d.select("p_partkey", F.nullif("p_size", F.lit(30)).alias("size")), "p")
    return aggregate(rel, "p.p_partkey", AggregateOp.COUNT, "p.size").to_df("grp", "value")


@_register("agg_empty", "SELECT max(p_size) AS value FROM part WHERE p_size < 0")
def agg_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate(filter_(_table(spark, sf_dir, "part"), Condition("p_size", CompOp.LT, rhs=_int(0))), "p_size", AggregateOp.MAX).to_df("value")


@_register(
    "plan_filter_project_join_agg",
    "SELECT c_mktsegment, sum(l_quantity) AS quantity FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F') o "
    "JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_mktsegment",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter, project, two joins, grouped sum."""
    finished = filter_(_table(spark, sf_dir, "orders"), Condition("o_orderstatus", CompOp.EQ, rhs=_text("F")))
    orders = project(finished, ["o_orderkey", "o_custkey"])
    owned = bnl_join(orders, project(_table(spark, sf_dir, "customer"), ["c_custkey", "c_mktsegment"]), Condition("o_custkey", CompOp.EQ, rhs_attr="c_custkey"))
    whole = bnl_join(project(_table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_quantity"]), owned, Condition("l_orderkey", CompOp.EQ, rhs_attr="o_orderkey"))
    return aggregate(whole, "l_quantity", AggregateOp.SUM, "c_mktsegment").to_df("c_mktsegment", "quantity")


def _engine(spark: SparkSession) -> Engine:
    """An engine in a fresh folder: in the shared folder that the session names; a local session may do without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{tempfile.mkdtemp(prefix='quillbase-')}"
    engine = Engine(spark, f"{shared.rstrip('/')}/warehouse-{uuid.uuid4().hex}")
    engine.create_catalog()
    atexit.register(_drop, engine)
    return engine


def _drop(engine: Engine) -> None:
    try:
        engine.store.delete(engine.warehouse)
    except Exception:  # noqa: BLE001 - the session may be gone at exit
        return


_PART = [Attribute("p_partkey", AttrType.INT), Attribute("p_brand", AttrType.VARCHAR, 30), Attribute("p_size", AttrType.INT)]
_PART_KINDS = ["bigint", "string", "int"]


def _parts(spark: SparkSession, sf_dir: str) -> tuple[Engine, DataFrame]:
    engine = _engine(spark)
    engine.create_table("part", _PART, _PART_KINDS)
    engine.insert_tuples("part", spark.read.parquet(f"{sf_dir}/part.parquet"))
    return engine, engine.scan("part", None, CompOp.NO_OP, None, ["p_partkey", "p_brand", "p_size"])


@_register(
    "storage_crud",
    "SELECT p_partkey, p_brand, CASE WHEN p_size < 10 THEN p_size + 1000 ELSE p_size END AS p_size FROM part WHERE p_size <= 40",
)
def storage_crud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert, update by identifier, delete by identifier, scan."""
    engine, rows = _parts(spark, sf_dir)
    engine.update_tuples("part", rows.where("p_size < 10").withColumn("p_size", F.col("p_size") + 1000))
    engine.delete_tuples("part", rows.where("p_size > 40").select("_rid"))
    return engine.scan("part", None, CompOp.NO_OP, None, ["p_partkey", "p_brand", "p_size"]).drop("_rid")


@_register("storage_scan_condition", "SELECT p_size, p_partkey FROM part WHERE p_brand = 'Brand#13'")
def storage_scan_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _parts(spark, sf_dir)
    return engine.scan("part", "p_brand", CompOp.EQ, _text("Brand#13"), ["p_size", "p_partkey"]).drop("_rid")


@_register("index_scan_maintained", "SELECT p_partkey, p_size + 5 AS p_size FROM part WHERE p_size + 5 >= 20 AND p_size + 5 < 30 AND p_size <> 17")
def index_scan_maintained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index made before its rows were updated and deleted."""
    engine, rows = _parts(spark, sf_dir)
    engine.create_index("part", "p_size")
    engine.delete_tuples("part", rows.where("p_size = 17").select("_rid"))
    left = engine.scan("part", None, CompOp.NO_OP, None, ["p_partkey", "p_brand", "p_size"])
    engine.update_tuples("part", left.withColumn("p_size", F.col("p_size") + 5))
    rel = engine.index_scan("part", "p_size", 20, 30, high_inclusive=False, through_index=True)
    return _plain(project(rel, ["p_partkey", "p_size"]))


@_register("index_entries", "SELECT p_size AS key, count(*) AS n FROM part WHERE p_size > 10 AND p_size <= 20 GROUP BY p_size")
def index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a stand-alone index, by key."""
    engine, rows = _parts(spark, sf_dir)
    index = IndexFile.create(spark, f"{engine.warehouse}/sizes", _PART[2])
    index.insert_entries(rows.select(F.col("p_size").alias("key"), "_rid"))
    return index.scan(10, 20, low_inclusive=False).groupBy("key").agg(F.count("*").alias("n"))


@_register("attribute_added_dropped", "SELECT p_partkey, p_size, CAST(NULL AS VARCHAR) AS note FROM part")
def attribute_added_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine, _ = _parts(spark, sf_dir)
    engine.add_attribute("part", Attribute("note", AttrType.VARCHAR, 20))
    engine.drop_attribute("part", "p_brand")
    return _plain(engine.table_scan("part"))


@_register(
    "catalog_columns",
    "SELECT * FROM (VALUES (1, 'table-id', 0, 4, 1), (1, 'table-name', 2, 50, 2), (1, 'file-name', 2, 50, 3), (1, 'authority', 0, 4, 4), (2, 'table-id', 0, 4, 1), (2, 'column-name', 2, 50, 2), "
    "(2, 'column-type', 0, 4, 3), (2, 'column-length', 0, 4, 4), (2, 'column-position', 0, 4, 5)) t(table_id, column_name, column_type, column_length, column_position)",
)
def catalog_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _engine(spark).table_scan("Columns").to_df("table_id", "column_name", "column_type", "column_length", "column_position")


def _loaded(spark: SparkSession, sf_dir: str, table: str) -> Engine:
    """An engine with one of the driver's tables, loaded in two commits, so that it has several segments."""
    engine, df = _engine(spark), spark.read.parquet(f"{sf_dir}/{table}.parquet")
    engine.create_table(table, attributes(df.schema), [f.dataType.simpleString() for f in df.schema.fields])
    key = df.columns[0]
    for part in range(2):
        engine.insert_tuples(table, df.where(F.pmod(F.col(key), F.lit(2)) == part))
    return engine


def _ranged(name: str, table: str, attr: str, where: str, **bounds) -> None:
    @_register(name, f"SELECT * FROM {table} WHERE {where}")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        engine = _loaded(spark, sf_dir, table)
        engine.create_index(table, attr)
        return _plain(engine.index_scan(table, attr, **bounds))


_ranged("index_scan_range", "orders", "o_custkey", "o_custkey >= 10 AND o_custkey < 75", low=10, high=75, high_inclusive=False)
_ranged("index_scan_open_low", "part", "p_size", "p_size < 25", high=25, high_inclusive=False)
_ranged("index_scan_varchar", "part", "p_brand", "p_brand >= 'Brand#2' AND p_brand < 'Brand#4'", low="Brand#2", high="Brand#4", high_inclusive=False)
_ranged("index_scan_point", "customer", "c_custkey", "c_custkey = 77", low=77, high=77)
_ranged("index_scan_unordered", "customer", "c_nationkey", "c_nationkey > 20", low=20, low_inclusive=False, ordered=False)


@_register("scan_rewound", "SELECT * FROM region")
def scan_rewound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relation is read to its end, and then again from the start."""
    rel = _loaded(spark, sf_dir, "region").table_scan("region")
    for _ in rel.rows():
        pass
    return _plain(rel)


@_register("index_scan_rids", "SELECT c_custkey, c_nationkey AS key FROM customer WHERE c_nationkey >= 5 AND c_nationkey <= 7")
def index_scan_rids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(identifier, key) of an index, and the rows that the identifiers name."""
    engine = _loaded(spark, sf_dir, "customer")
    engine.create_index("customer", "c_nationkey")
    rids = engine.index_scan_rids("customer", "c_nationkey", 5, 7)
    return engine.scan("customer", None, CompOp.NO_OP, None, ["c_custkey"]).join(rids, "_rid").select("c_custkey", "key")


@_register("index_scan_order", "SELECT row_number() OVER (ORDER BY s_acctbal, s_suppkey) - 1 AS n, s_acctbal AS key FROM supplier WHERE s_acctbal < 2000")
def index_scan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys in the order in which an index gives its entries, numbered as they come."""
    engine = _loaded(spark, sf_dir, "supplier")
    engine.create_index("supplier", "s_acctbal")
    keys = [r["key"] for r in engine.index_scan_rids("supplier", "s_acctbal", None, 2000.0, high_inclusive=False).toLocalIterator()]
    return spark.createDataFrame(list(enumerate(keys)), "n long, key double")


@_register("index_destroyed", "SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def index_destroyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without its index an index scan fails, and a scan with a condition gives the rows."""
    engine = _loaded(spark, sf_dir, "customer")
    engine.create_index("customer", "c_nationkey")
    engine.destroy_index("customer", "c_nationkey")
    try:
        engine.index_scan("customer", "c_nationkey", 3, 3)
    except NoSuchIndex:
        return engine.scan("customer", "c_nationkey", CompOp.EQ, _int(3), ["c_custkey"]).drop("_rid")
    raise AssertionError("an index that was destroyed is still there")


def _sizes(engine: Engine, rows: DataFrame, spark: SparkSession, key: str = "p_size") -> IndexFile:
    index = IndexFile.create(spark, f"{engine.warehouse}/sizes", _PART[2])
    index.insert_entries(rows.selectExpr(f"{key} AS key", "_rid"))
    return index


@_register("index_entries_deleted", "SELECT p_size AS key, count(*) AS n FROM part WHERE p_size <= 20 AND p_partkey % 3 <> 0 GROUP BY p_size")
def index_entries_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries deleted by key and identifier."""
    engine, rows = _parts(spark, sf_dir)
    index = _sizes(engine, rows, spark)
    index.delete_entries(rows.where("p_partkey % 3 = 0").selectExpr("p_size AS key", "_rid"))
    return index.scan(None, 20).groupBy("key").agg(F.count("*").alias("n"))


@_register("index_deleted_while_scanned", "SELECT p_size AS key, p_size <= 10 AS before, count(*) AS n FROM part WHERE p_size <= 20 GROUP BY p_size UNION ALL SELECT p_size, NULL, count(*) FROM part WHERE p_size > 10 AND p_size <= 20 GROUP BY p_size")
def index_deleted_while_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan that began before a deletion gives all entries, one that begins after it those that are left."""
    engine, rows = _parts(spark, sf_dir)
    index = _sizes(engine, rows, spark)
    before = index.scan(None, 20)
    index.delete_entries(before.where("key <= 10").select("key", "_rid"))
    count = lambda df, mark: df.groupBy("key").agg(F.count("*").alias("n")).select("key", mark.alias("before"), "n")
    return count(before, F.col("key") <= 10).unionByName(count(index.scan(None, 20), F.lit(None).cast("boolean")))


@_register("index_null_keys", "SELECT p_size AS key, count(*) AS n FROM part WHERE p_size > 25 AND p_size <> 30 GROUP BY p_size")
def index_null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NULL keys are not indexed."""
    engine, rows = _parts(spark, sf_dir)
    return _sizes(engine, rows, spark, "nullif(p_size, 30)").scan(25, None, low_inclusive=False).groupBy("key").agg(F.count("*").alias("n"))


@_register("print_btree", "SELECT 0 AS level, n_nationkey AS key FROM nation UNION ALL SELECT 1, n_nationkey FROM nation WHERE n_nationkey % 4 = 0 AND n_nationkey % 20 <> 0 UNION ALL SELECT 2, 20")
def print_btree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys by level of the printed tree, four to a node; leaves are level 0."""
    engine = _loaded(spark, sf_dir, "nation")
    engine.create_index("nation", "n_nationkey")
    out: list[tuple[int, int]] = []

    def walk(node: dict) -> int:
        level = max((walk(c) for c in node.get("children", ())), default=-1) + 1
        out.extend((level, int(k.split(":")[0])) for k in node["keys"])
        return level

    walk(json.loads(engine.print_btree("nation", "n_nationkey", 4)))
    return spark.createDataFrame(out, "level int, key int")


@_register("catalog_deleted", "SELECT 'catalog' AS what, false AS there UNION ALL SELECT 'table', false")
def catalog_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of a table that was deleted, and of a catalog."""
    engine, out = _loaded(spark, sf_dir, "region"), []
    for what, gone in (("table", lambda: engine.delete_table("region")), ("catalog", engine.delete_catalog)):
        gone()
        try:
            engine.get_attributes("region" if what == "table" else "Tables")
            out.append((what, True))
        except NoSuchTable:
            out.append((what, False))
    return spark.createDataFrame(out, "what string, there boolean")


@_register("print_tables", "SELECT * FROM (VALUES ('Tables', 0), ('Columns', 0), ('region', 1)) t(name, authority)")
def print_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed catalog, read back."""
    rows = [dict(x.split(" = ") for x in line.split("  ")) for line in _loaded(spark, sf_dir, "region").print_tables().splitlines()]
    return spark.createDataFrame([(r["table-name"], int(r["authority"])) for r in rows], "name string, authority int")


@_register("tuple_reads", "SELECT n_nationkey, n_name, n_regionkey, n_name AS one, n_regionkey AS two, concat('n_nationkey = ', n_nationkey, '  n_name = ', n_name, '  n_regionkey = ', n_regionkey) AS printed FROM nation WHERE n_nationkey < 6")
def tuple_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole tuples, one attribute and several, by identifier, and a tuple as it is printed."""
    engine, out = _loaded(spark, sf_dir, "nation"), []
    for r in engine.scan("nation", "n_nationkey", CompOp.LT, _int(6), ["n_nationkey"]).collect():
        rid = tuple(r["_rid"])
        whole = engine.read_tuple("nation", rid)
        out.append((*whole, engine.read_attribute("nation", rid, "n_name"), engine.read_attributes("nation", rid, ["n_regionkey", "n_name"])[0], engine.print_tuple(whole)))
    return spark.createDataFrame(out, "n_nationkey int, n_name string, n_regionkey int, one string, two int, printed string")


@_register("tuple_life", "SELECT 0 AS step, 'made' AS name UNION ALL SELECT 1, 'changed' UNION ALL SELECT 2, NULL")
def tuple_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tuple inserted, updated and deleted, read after each step."""
    engine, out = _loaded(spark, sf_dir, "region"), []
    rid = engine.insert_tuple("region", (99, "made"))
    steps = (lambda: None, lambda: engine.update_tuple("region", rid, (99, "changed")), lambda: engine.delete_tuple("region", rid))
    for i, step in enumerate(steps):
        step()
        try:
            out.append((i, engine.read_attribute("region", rid, "r_name")))
        except NoSuchRid:
            out.append((i, None))
    return spark.createDataFrame(out, "step int, name string")


@_register("codec_round_trip", "SELECT c_nationkey, nullif(c_mktsegment, 'BUILDING') AS c_mktsegment, CAST(c_acctbal AS REAL) AS c_acctbal FROM customer")
def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows through the packed tuple format and back; one attribute of the packed tuple is read in place."""
    attrs = [Attribute("c_nationkey", AttrType.INT), Attribute("c_mktsegment", AttrType.VARCHAR, 30), Attribute("c_acctbal", AttrType.REAL)]
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_nationkey", "nullif(c_mktsegment, 'BUILDING') AS c_mktsegment", "CAST(c_acctbal AS FLOAT) AS c_acctbal")
    return codec.unpack_rows(codec.pack_rows(rows, attrs), attrs)


@_register("agg_attribute_name", 'SELECT l_linestatus AS "lineitem.l_linestatus", sum(l_quantity) AS "SUM(lineitem.l_quantity)" FROM lineitem GROUP BY l_linestatus')
def agg_attribute_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grouping attribute and OP(relation.attribute), as the operator names them."""
    return aggregate(_table(spark, sf_dir, "lineitem"), "l_quantity", AggregateOp.SUM, "l_linestatus").to_df()


@_register("agg_null_inputs", "SELECT p_brand AS grp, count(nullif(p_size, 30)) AS n, avg(nullif(p_size, 30)) AS mean FROM part GROUP BY p_brand")
def agg_null_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = _table(spark, sf_dir, "part").pipe(lambda d: d.select("p_brand", F.nullif("p_size", F.lit(30)).alias("size")), "p")
    both = [aggregate(rel, "p.size", op, "p.p_brand").to_df("grp", name) for op, name in ((AggregateOp.COUNT, "n"), (AggregateOp.AVG, "mean"))]
    return both[0].join(both[1], "grp")


@_register("page_file", "SELECT * FROM (VALUES (0, 'a', 3, 1, 3, 4), (1, 'z', 3, 1, 3, 4), (2, 'c', 3, 1, 3, 4)) t(page, first, reads, writes, appends, pages)")
def page_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages appended, written and read, the handle's counters, and the number of pages after one more."""
    engine = _engine(spark)
    pages = PageFile.create(spark, f"{engine.warehouse}/pages")
    for c in "abc":
        pages.append_page(c.encode() * PageFile.PAGE)
    pages.write_page(1, b"z" * PageFile.PAGE)
    firsts = [pages.read_page(i)[:1].decode() for i in range(3)]
    counters = pages.collect_counter_values()
    PageFile.open(spark, f"{engine.warehouse}/pages").append_page(b"d" * PageFile.PAGE)
    return spark.createDataFrame([(i, f, *counters, pages.number_of_pages()) for i, f in enumerate(firsts)], "page int, first string, reads int, writes int, appends int, pages int")
