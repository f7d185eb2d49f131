"""Catalog, records, indexes, page files, packed tuples, streams."""

import json
import random

import pytest

from quillbase import Attribute, AttrType, CompOp, Engine, Value
from quillbase.errors import CommitConflict, FileError, IndexExists, NoSuchAttribute, NoSuchEntry, NoSuchIndex, NoSuchRid, NoSuchTable, SystemCatalogError, TableExists, TypeMismatch
from quillbase.functions import codec
from quillbase.sources.files import Manifest, Store
from quillbase.sources.index import IndexFile
from quillbase.sources.storage import SLOTS, PageFile, RecordFile, print_record
from quillbase.streaming import append_stream

INT, REAL, VARCHAR = AttrType.INT, AttrType.REAL, AttrType.VARCHAR
EMPLOYEE = [Attribute("EmpName", VARCHAR, 30), Attribute("Age", INT), Attribute("Height", REAL), Attribute("Salary", INT)]
ANT = ("Anteater", 27, 6.199999809265137, 10000)


def test_catalog(engine):
    with pytest.raises(TableExists):
        engine.create_catalog()
    engine.create_table("emp", EMPLOYEE)
    with pytest.raises(TableExists):
        engine.create_table("emp", EMPLOYEE)
    assert engine.get_attributes("emp") == EMPLOYEE
    tables = [tuple(r) for r in engine.table_scan("Tables").to_df().collect()]
    assert [(t[0], t[1], t[3]) for t in tables] == [(1, "Tables", 0), (2, "Columns", 0), (3, "emp", 1)]
    assert engine.table_scan("Columns").to_df().count() == 13
    assert [a.name for a in engine.table_scan("Tables").attrs] == ["Tables.table-id", "Tables.table-name", "Tables.file-name", "Tables.authority"]
    assert "table-name = emp" in engine.print_tables()
    got = engine.scan("Columns", "column-name", CompOp.EQ, Value(VARCHAR, "Age"), ["column-position"]).collect()
    assert [r["column-position"] for r in got] == [2]


def test_system_tables_are_read_only(engine, spark):
    rows = spark.createDataFrame([(9, "x", "x", 1)], "`table-id` int, `table-name` string, `file-name` string, authority int")
    for call in (lambda: engine.insert_tuples("Tables", rows), lambda: engine.delete_table("Columns"), lambda: engine.delete_tuple("Tables", (0, 0)), lambda: engine.create_index("Tables", "authority")):
        with pytest.raises(SystemCatalogError):
            call()


def test_tuples(engine):
    engine.create_table("emp", EMPLOYEE)
    rid = engine.insert_tuple("emp", ANT)
    assert tuple(engine.read_tuple("emp", rid)) == ANT
    assert engine.read_attribute("emp", rid, "Salary") == 10000 and tuple(engine.read_attributes("emp", rid, ["Height", "EmpName"])) == (ANT[2], "Anteater")
    engine.update_tuple("emp", rid, ("Barney", None, 6.5, 12000))
    assert tuple(engine.read_tuple("emp", rid)) == ("Barney", None, 6.5, 12000)
    assert engine.print_tuple(engine.read_tuple("emp", rid)) == "EmpName = Barney  Age = NULL  Height = 6.5  Salary = 12000"
    engine.delete_tuple("emp", rid)
    for call in (lambda: engine.read_tuple("emp", rid), lambda: engine.delete_tuple("emp", rid), lambda: engine.update_tuple("emp", rid, ANT), lambda: engine.read_tuple("emp", (7, 7))):
        with pytest.raises(NoSuchRid):
            call()
    assert engine.insert_tuple("emp", ANT) != rid  # never used again
    with pytest.raises(NoSuchAttribute):
        engine.read_attribute("emp", rid, "Nope")


def test_dropped_table(engine):
    engine.create_table("emp", EMPLOYEE)
    rid = engine.insert_tuple("emp", ANT)
    engine.create_index("emp", "Age")
    engine.delete_table("emp")
    for call in (lambda: engine.read_tuple("emp", rid), lambda: engine.insert_tuple("emp", ANT), lambda: engine.delete_table("emp"), lambda: engine.index_scan("emp", "Age")):
        with pytest.raises(NoSuchTable):
            call()
    engine.create_table("emp", EMPLOYEE)
    with pytest.raises(NoSuchIndex):
        engine.index_scan("emp", "Age")
    assert engine.table_scan("Tables").df.count() == 3


def test_null_and_empty_differ(engine):
    engine.create_table("emp", EMPLOYEE)
    a, b = (engine.insert_tuple("emp", (name, 1, None, 2)) for name in (None, ""))
    assert engine.read_attribute("emp", a, "EmpName") is None and engine.read_attribute("emp", b, "EmpName") == ""


def tweets(spark, n=10_000, nulls=False):
    null = lambda c: f"IF(id % 50 = 0, NULL, {c})" if nulls else c
    return spark.range(n).selectExpr("int(id) tweetid", f"{null('int(id + id % 100)')} userid", f"{null('format_string(\"Msg%05d\", id)')} message_text")


TWEET = [Attribute("tweetid", INT), Attribute("userid", INT), Attribute("message_text", VARCHAR, 100)]


@pytest.mark.parametrize(("nulls", "n"), [(False, 99), (True, 97)])
def test_scan_condition(engine, spark, nulls, n):
    rows = engine.load("tweets", TWEET, tweets(spark, nulls=nulls))
    assert rows.count() == 10_000
    hits = engine.scan("tweets", "message_text", CompOp.LT, Value(VARCHAR, "Msg00099"), ["message_text", "tweetid"])
    assert hits.columns == ["_rid", "message_text", "tweetid"] and hits.count() == n
    r = hits.orderBy("tweetid").first()
    assert engine.read_attribute("tweets", tuple(r["_rid"]), "tweetid") == r["tweetid"]


def test_identifiers_are_dense_and_last(engine, spark):
    rows = engine.load("tweets", TWEET, tweets(spark).repartition(5))
    before = {tuple(r["_rid"]): r["tweetid"] for r in rows.collect()}
    assert sorted(p * SLOTS + s for p, s in before) == list(range(10_000))
    engine.update_tuples("tweets", rows.where("tweetid % 100 = 0").selectExpr("_rid", "tweetid", "tweetid + tweetid % 500 userid", "repeat('x', 500) message_text"))
    engine.delete_tuples("tweets", rows.where("tweetid % 10 = 3").select("_rid"))
    engine.insert_tuples("tweets", tweets(spark, 10))
    after = engine.scan("tweets", None, CompOp.NO_OP, None, ["tweetid", "message_text"])
    old = {tuple(r["_rid"]): r["tweetid"] for r in after.collect() if tuple(r["_rid"]) in before}
    assert len(old) == 9000 and all(before[k] == v for k, v in old.items()) and after.count() == 9010
    rows = sorted(map(str, after.collect()))
    file = engine.file("tweets")
    assert file.needs_compaction() is False
    file.compact()
    file.vacuum()
    again = engine.scan("tweets", None, CompOp.NO_OP, None, ["tweetid", "message_text"])
    assert sorted(map(str, again.collect())) == rows
    assert engine.metrics("tweets")["changed"] == 0


def test_null_age_condition(engine, spark):
    random.seed(1)
    rows = [("x", None if i % 10 == 0 else random.randint(15, 34), 1.0, 2) for i in range(500)]
    engine.load("emp", EMPLOYEE, rows)
    for op in CompOp:
        n = engine.scan("emp", "Age", op, Value(INT, 25), ["Age"]).count()
        keep = {CompOp.EQ: lambda a: a == 25, CompOp.LT: lambda a: a < 25, CompOp.LE: lambda a: a <= 25, CompOp.GT: lambda a: a > 25, CompOp.GE: lambda a: a >= 25, CompOp.NE: lambda a: a != 25}
        assert n == (500 if op is CompOp.NO_OP else sum(r[1] is not None and keep[op](r[1]) for r in rows))


def test_attributes_added_and_dropped(engine):
    engine.create_table("emp", EMPLOYEE)
    rid = engine.insert_tuple("emp", ANT)
    engine.add_attribute("emp", Attribute("SSN", INT))
    new = engine.insert_tuple("emp", (*ANT, 123))
    assert engine.read_attribute("emp", rid, "SSN") is None and engine.read_attribute("emp", new, "SSN") == 123
    engine.create_index("emp", "Salary")
    engine.drop_attribute("emp", "Salary")
    assert [a.name for a in engine.get_attributes("emp")] == ["EmpName", "Age", "Height", "SSN"] and tuple(engine.read_tuple("emp", rid)) == (*ANT[:3], None)
    engine.add_attribute("emp", Attribute("Salary", INT))
    assert engine.read_attribute("emp", rid, "Salary") is None
    with pytest.raises(NoSuchAttribute):
        engine.drop_attribute("emp", "Nope")


def test_index_before_and_after_load(engine, spark):
    left = [Attribute("A", INT), Attribute("B", INT), Attribute("C", REAL)]
    engine.create_table("left", left)
    engine.create_index("left", "B")
    engine.insert_tuples("left", spark.range(100).selectExpr("int(id) A", "int(id + 10) B", "float(id + 50) C"))
    engine.create_index("left", "C")
    with pytest.raises(IndexExists):
        engine.create_index("left", "C")
    for through in (False, True):
        assert engine.index_scan("left", "C", 110.0, through_index=through).df.count() == 40
        got = [r["left.B"] for r in engine.index_scan("left", "B", 20, 30, True, False, through_index=through).to_df().collect()]
        assert got == list(range(20, 30))
    assert engine.index_scan_rids("left", "B", 15, 12).count() == 0


def test_index_follows_changes(engine, spark):
    engine.create_table("emp", EMPLOYEE)
    model, rng = {}, random.Random(3)
    engine.create_index("emp", "Age")
    for step in range(3):
        rows = [(f"n{step}{i}", rng.choice([None, *range(20)]), 1.0, i) for i in range(30)]
        kind = "EmpName string, Age int, Height float, Salary int"
        for r in engine.insert_tuples("emp", spark.createDataFrame(rows, kind)).collect():
            model[tuple(r["_rid"])] = r["Age"]
        gone, moved = rng.sample(sorted(model), 5), rng.sample(sorted(model), 8)
        moved = [m for m in moved if m not in gone]
        engine.delete_tuples("emp", engine.file("emp").rids(gone))
        for g in gone:
            del model[g]
        engine.update_tuples("emp", spark.createDataFrame([(m, "u", rng.randint(0, 19), 2.0, 1) for m in moved], f"_rid struct<page_num:int,slot_num:int>, {kind}"))
        for r in engine.scan("emp", None, CompOp.NO_OP, None, ["Age"]).collect():
            model[tuple(r["_rid"])] = r["Age"]
        if step == 1:
            engine.rebuild_index("emp", "Age")
        want = sorted((a, rid) for rid, a in model.items() if a is not None and 5 <= a < 15)
        got = [(r["key"], tuple(r["_rid"])) for r in engine.index_scan_rids("emp", "Age", 5, 15, True, False).collect()]
        assert got == want
        for through in (False, True):
            assert [r["emp.Age"] for r in engine.index_scan("emp", "Age", 5, 15, True, False, through_index=through).to_df().collect()] == [a for a, _ in want]
    keys = [k.split(":")[0] for k in json.loads(engine.print_btree("emp", "Age"))["keys"]]
    assert keys == sorted(set(keys), key=int)
    engine.file("emp").compact()
    assert [r["key"] for r in engine.index_scan_rids("emp", "Age").collect()] == sorted(a for a in model.values() if a is not None)
    engine.destroy_index("emp", "Age")
    with pytest.raises(NoSuchIndex):
        engine.destroy_index("emp", "Age")


def entries(spark, sql, n=1, start=0, step=1, kind="int"):
    return spark.range(start, n, step).selectExpr(f"CAST({sql} AS {kind}) key", "struct(int(id) page_num, int(id % 7) slot_num) _rid")


def test_index_file(spark, tmp_path):
    index = IndexFile.create(spark, f"file://{tmp_path}/i", Attribute("a", INT))
    with pytest.raises(FileError):
        IndexFile.create(spark, f"file://{tmp_path}/i", Attribute("a", INT))
    assert index.scan().count() == 0
    index.insert_entries(entries(spark, "id", 301, 1).unionByName(entries(spark, "id", 5101, 5001)))
    assert index.scan(5001).count() == 100
    assert [r["key"] for r in index.scan(299, 5002).collect()] == [299, 300, 5001, 5002]
    one = index.scan(300, 300)
    for r in one.collect():  # deleting what a scan returned
        index.delete_entry(r["key"], tuple(r["_rid"]))
    assert index.scan(300, 300).count() == 0
    with pytest.raises(NoSuchEntry):
        index.delete_entry(300, (300, 300 % 7))
    with pytest.raises(TypeMismatch):
        index.insert_entry("x", (0, 0))
    index.insert_entry(300, (300, 300 % 7))
    index.insert_entry(None, (1, 1))
    assert index.scan().count() == 400
    index.compact()
    assert index.scan(high=10, high_inclusive=False).count() == 9
    index.destroy()
    with pytest.raises(FileError):
        IndexFile.open(spark, f"file://{tmp_path}/i")


def test_index_file_keys(spark, tmp_path):
    real = IndexFile.create(spark, f"file://{tmp_path}/r", Attribute("a", REAL))
    real.insert_entries(entries(spark, "id + 76.5", 2001, 1, kind="float").unionByName(entries(spark, "id + 76.5", 8001, 6000, kind="float")))
    assert real.scan(high=6500.0, high_inclusive=False).count() == 2424
    same = IndexFile.create(spark, f"file://{tmp_path}/d", Attribute("a", INT))
    same.insert_entries(entries(spark, "7", 2000).unionByName(entries(spark, "8", 2010, 2000)))
    assert same.scan(7, 7).count() == 2000
    text = IndexFile.create(spark, f"file://{tmp_path}/v", Attribute("a", VARCHAR, 26))
    text.insert_entries(entries(spark, "repeat(char(97 + int((id - 1) % 26)), int((id - 1) % 26) + 1)", 1001, 1, kind="string"))
    assert text.scan("t" * 20, "t" * 20).count() == 38
    assert json.loads(same.printed())["keys"][1].startswith("8:[(2000,")


def test_record_file_and_pages(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    RecordFile.create(spark, path, EMPLOYEE)
    with pytest.raises(FileError):
        RecordFile.create(spark, path, EMPLOYEE)
    RecordFile.open(spark, path).destroy()
    with pytest.raises(FileError):
        RecordFile.open(spark, path)
    pages = PageFile.create(spark, f"file://{tmp_path}/p")
    for i in range(3):
        pages.append_page(bytes([i]) * 4096)
    pages.write_page(1, b"z" * 4096)
    assert [pages.read_page(i)[:1] for i in range(3)] == [b"\0", b"z", b"\2"] and pages.number_of_pages() == 3
    assert pages.collect_counter_values() == (3, 1, 3)
    with pytest.raises(NoSuchRid):
        pages.read_page(3)
    with pytest.raises(FileError):
        pages.append_page(b"short")


def test_commit_conflict(spark, tmp_path):
    m = Manifest(Store(spark), f"file://{tmp_path}/m")
    assert m.version() == 0 and m.commit(0, {"a": 1}) == 1
    with pytest.raises(CommitConflict):
        m.commit(0, {"a": 2})
    assert m.load() == {"a": 1}


def test_exclusive_commits(spark, tmp_path):
    """Of many writers of one version one wins, and its document is whole; the rename for other stores doesn't replace either."""
    from concurrent.futures import ThreadPoolExecutor

    store = Store(spark)

    def commit(i):
        try:
            return Manifest(store, f"file://{tmp_path}/m").commit(0, {"writer": i})
        except CommitConflict:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(commit, range(16))) == [0] * 15 + [1]
    assert Manifest(store, f"file://{tmp_path}/m").load()["writer"] in range(16) and store.names(f"file://{tmp_path}/m") == ["v000000000001.json"]
    for name in "ab":
        (tmp_path / name).write_text(name)
    fs, a = store._at(f"file://{tmp_path}/a")
    with pytest.raises(Exception, match="FileAlreadyExists"):
        store._rename(fs, a, store._at(f"file://{tmp_path}/b")[1])
    store._rename(fs, a, store._at(f"file://{tmp_path}/c")[1])
    assert (tmp_path / "b").read_text() == "b" and (tmp_path / "c").read_text() == "a"


def test_index_scan_opens_matching_segments_only(engine, spark):
    attrs = [Attribute("k", INT), Attribute("v", INT)]
    engine.create_table("t", attrs)
    for part in range(5):
        engine.insert_tuples("t", spark.range(part * 1000, part * 1000 + 1000).selectExpr("int(id) k", "int(id % 7) v").repartition(2))
    engine.create_index("t", "k")
    rel = engine.index_scan("t", "k", 2100, 2200, high_inclusive=False)
    assert [r["t.k"] for r in rel.to_df().collect()] == list(range(2100, 2200))
    opened = {f.split("/")[-2] for f in rel.df.inputFiles() if "/segment-" in f}
    assert opened == {engine.file("t")._state()[1]["segments"][2]["path"].rpartition("/")[2]}
    engine.delete_tuples("t", engine.scan("t", "k", CompOp.EQ, Value(INT, 2150), ["k"]).select("_rid"))
    engine.update_tuples("t", engine.scan("t", "k", CompOp.EQ, Value(INT, 4999), ["k", "v"]).selectExpr("_rid", "2150 k", "v"))
    assert [r["t.k"] for r in engine.index_scan("t", "k", 2149, 2151).to_df().collect()] == [2149, 2150, 2151]
    engine.create_index("t", "v")
    assert engine.index_scan("t", "k", 9000).df.count() == 0 and engine.index_scan("t", "v", ordered=False).df.count() == 4999


def test_ranges_of_an_index_scan(spark, monkeypatch):
    from quillbase import session

    monkeypatch.setattr(session, "RANGES", 3)
    chosen = spark.createDataFrame([(i,) for i in (1, 2, 3, 50, 52, 90, 200, 400)], "_wanted long")
    ranges = Engine._where(chosen, 500)
    assert len(ranges) == 3 and all(any(a <= i < b for a, b in ranges) for i in (1, 2, 3, 50, 52, 90, 200, 400)) and not any(a <= 300 < b for a, b in ranges)
    assert Engine._where(chosen.limit(0), 500) == []


def test_deletions_are_known_after_compaction(engine, spark):
    engine.create_table("emp", EMPLOYEE)
    rids = [engine.insert_tuple("emp", ANT) for _ in range(3)]
    engine.delete_tuple("emp", rids[1])
    for _ in range(2):
        engine.file("emp").compact()
        engine.file("emp").vacuum()
        for call in (lambda: engine.delete_tuple("emp", rids[1]), lambda: engine.update_tuple("emp", rids[1], ANT), lambda: engine.update_tuple("emp", (0, 63), ANT)):
            with pytest.raises(NoSuchRid):
                call()
    engine.update_tuple("emp", rids[2], ("x", 1, 1.0, 1))
    assert engine.read_attribute("emp", rids[2], "EmpName") == "x" and engine.table_scan("emp").df.count() == 2


def test_identifiers_beyond_32_bits(spark):
    from quillbase.sources.storage import ordinal_of, rid_column

    far = 2**31 * SLOTS * 5 + 17
    row = spark.range(1).selectExpr(f"{far}L AS _ord").select(rid_column().alias("r"), "_ord")
    assert tuple(row.first().r) == (far // SLOTS, far % SLOTS) and row.select(ordinal_of(row["r"]).alias("o")).first().o == far


def test_printed_tree(spark, tmp_path):
    index = IndexFile.create(spark, f"file://{tmp_path}/i", Attribute("a", INT))
    assert json.loads(index.printed()) == {"keys": []}
    index.insert_entries(entries(spark, "id", 40))
    found = []

    def walk(node, depth=0):
        assert len(node["keys"]) <= 3
        for i, child in enumerate(node.get("children", ())):
            first = walk(child, depth + 1)
            assert i == 0 or node["keys"][i - 1] == first
        if "children" not in node:
            found.append((depth, [int(k.split(":")[0]) for k in node["keys"]]))
            return node["keys"][0].split(":")[0]
        return walk_first(node)

    def walk_first(node):
        while "children" in node:
            node = node["children"][0]
        return node["keys"][0].split(":")[0]

    walk(json.loads(index.printed(3)))
    assert [k for _, keys in found for k in keys] == list(range(40)) and max(d for d, _ in found) >= 2


def test_engine_persists(engine, spark):
    engine.create_table("emp", EMPLOYEE)
    rid = engine.insert_tuple("emp", ANT)
    assert tuple(Engine(spark, engine.warehouse).read_tuple("emp", rid)) == ANT
    engine.register_views()
    assert spark.sql("SELECT sum(Salary) s FROM emp").first().s == 10000
    engine.delete_catalog()
    with pytest.raises(NoSuchTable):
        engine.get_attributes("emp")


def test_codec(spark):
    rows = [ANT, ("", None, 1.5, -1), (None, None, None, None)]
    packed = [codec.pack(r, EMPLOYEE) for r in rows]
    assert [tuple(codec.unpack(p, EMPLOYEE)) for p in packed] == rows
    assert packed[2] == b"\xf0" and packed[1][0] == 0x40 and codec.tuple_length(packed[0] + b"more", EMPLOYEE) == len(packed[0])
    assert codec.tuple_max_size(EMPLOYEE) == 1 + 34 + 12 and codec.nulls_size(9) == 2
    df = spark.createDataFrame(rows, "EmpName string, Age int, Height float, Salary int")
    assert sorted(map(str, codec.unpack_rows(codec.pack_rows(df, EMPLOYEE), EMPLOYEE).collect())) == sorted(map(str, df.collect()))
    assert print_record(df.first()).startswith("EmpName = Anteater  Age = 27")


def test_stream(engine, spark, tmp_path):
    engine.create_table("tweets", TWEET)
    tweets(spark, 100).coalesce(1).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        rows = spark.readStream.schema("tweetid int, userid int, message_text string").parquet(f"{tmp_path}/in")
        append_stream(engine, "tweets", rows, f"{tmp_path}/state", once=True).awaitTermination(120)
    file = engine.file("tweets")
    file.insert(tweets(spark, 5), (f"{tmp_path}/state", 0))  # a batch that was committed before
    assert engine.table_scan("tweets").df.count() == 100
