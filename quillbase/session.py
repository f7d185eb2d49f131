"""The engine: catalog, tables, records, indexes and scans of one warehouse folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from quillbase.errors import EngineError, IndexExists, NoSuchAttribute, NoSuchIndex, NoSuchTable, SystemCatalogError, TableExists
from quillbase.operators.basic import filter_, project
from quillbase.plans.relation import Relation
from quillbase.sources.files import Manifest, Store
from quillbase.sources.index import in_range, print_entries
from quillbase.sources.storage import RecordFile, Rid, print_record, rid_column
from quillbase.types import Attribute, AttrType, Condition, CompOp, Value

TABLES, COLUMNS = "Tables", "Columns"
SYSTEM, USER = 0, 1
#: Cells into which a table's ordinals are counted for an index scan, and ranges of ordinals that it puts into its scan.
CELLS, RANGES = 1 << 16, 48
_TABLES = (Attribute("table-id", AttrType.INT), Attribute("table-name", AttrType.VARCHAR, 50), Attribute("file-name", AttrType.VARCHAR, 50), Attribute("authority", AttrType.INT))
_COLUMNS = (
    Attribute("table-id", AttrType.INT), Attribute("column-name", AttrType.VARCHAR, 50), Attribute("column-type", AttrType.INT), Attribute("column-length", AttrType.INT), Attribute("column-position", AttrType.INT),
)


class Engine:
    """One writer at a time; a commit that finds another's raises CommitConflict."""

    def __init__(self, spark: SparkSession, warehouse: str):
        self.spark, self.warehouse = spark, warehouse.rstrip("/")
        self.store = Store(spark)
        self.manifest = Manifest(self.store, f"{self.warehouse}/_catalog")

    # -- catalog

    def create_catalog(self) -> None:
        if self.manifest.version():
            raise TableExists("the catalog is there already")
        system = {TABLES: {"id": 1, "file": TABLES, "authority": SYSTEM}, COLUMNS: {"id": 2, "file": COLUMNS, "authority": SYSTEM}}
        self.manifest.commit(0, {"tables": system, "next": 3, "indexes": {}})

    def delete_catalog(self) -> None:
        """Catalog, tables and indexes."""
        self._catalog()
        self.store.delete(self.warehouse)

    def _catalog(self) -> tuple[int, dict]:
        version = self.manifest.version()
        if not version:
            raise NoSuchTable("there is no catalog")
        return version, self.manifest.load(version)

    def _entry(self, table: str, writing: bool = False) -> dict:
        catalog = self._catalog()[1]
        if table not in catalog["tables"]:
            raise NoSuchTable(table)
        entry = catalog["tables"][table]
        if writing and entry["authority"] == SYSTEM:
            raise SystemCatalogError(table)
        return entry

    def file(self, table: str, writing: bool = False) -> RecordFile:
        return RecordFile.open(self.spark, f"{self.warehouse}/{self._entry(table, writing)['file']}")

    def create_table(self, table: str, attrs: Sequence[Attribute], kinds: Sequence[str] | None = None) -> None:
        version, catalog = self._catalog()
        if table in catalog["tables"]:
            raise TableExists(table)
        if len({a.name for a in attrs}) != len(attrs) or not attrs:
            raise NoSuchAttribute("a table needs attributes, of different names")
        name = f"t{catalog['next']}-{uuid.uuid4().hex[:8]}"
        RecordFile.create(self.spark, f"{self.warehouse}/{name}", attrs, kinds)
        catalog["tables"][table] = {"id": catalog["next"], "file": name, "authority": USER}
        catalog["next"] += 1
        self.manifest.commit(version, catalog)

    def delete_table(self, table: str) -> None:
        """The table and its indexes."""
        version, catalog = self._catalog()
        file = self.file(table, writing=True)
        gone = [k for k, i in catalog["indexes"].items() if i["table"] == table]
        paths = [catalog["indexes"].pop(k)["path"] for k in gone]
        del catalog["tables"][table]
        self.manifest.commit(version, catalog)
        file.destroy()
        for p in paths:
            self.store.delete(p)

    def get_attributes(self, table: str) -> list[Attribute]:
        self._entry(table)
        return list({TABLES: _TABLES, COLUMNS: _COLUMNS}[table]) if table in (TABLES, COLUMNS) else self.file(table).attributes()

    def add_attribute(self, table: str, attr: Attribute) -> None:
        self.file(table, writing=True).add_attribute(attr)

    def drop_attribute(self, table: str, name: str) -> None:
        file = self.file(table, writing=True)
        if self._index_key(table, name) in self._catalog()[1]["indexes"]:
            self.destroy_index(table, name)
        file.drop_attribute(name)

    def _system(self, table: str) -> DataFrame:
        """A system table's rows, from the catalog's version."""
        catalog = self._catalog()[1]
        if table == TABLES:
            rows = [(t["id"], name, t["file"], t["authority"]) for name, t in catalog["tables"].items()]
            frame = self.spark.createDataFrame(rows, "`table-id` int, `table-name` string, `file-name` string, authority int")
        else:
            rows = [(t["id"], a.name, int(a.type), a.length, i) for name, t in catalog["tables"].items() for i, a in enumerate(self.get_attributes(name), 1)]
            frame = self.spark.createDataFrame(rows, "`table-id` int, `column-name` string, `column-type` int, `column-length` int, `column-position` int")
        order = F.expr("row_number() OVER (ORDER BY `table-id`" + (", `column-position`)" if table == COLUMNS else ")"))
        return frame.withColumn("_ord", (order - 1).cast("long"))

    def print_tables(self) -> str:
        rows = self._system(TABLES).drop("_ord").orderBy("`table-id`").collect()
        return "\n".join(print_record(r) for r in rows)

    # -- records

    def _rows(self, table: str) -> DataFrame:
        """`_ord` and the attributes."""
        return self._system(table) if table in (TABLES, COLUMNS) else self.file(table).view()

    def insert_tuples(self, table: str, rows: DataFrame) -> DataFrame:
        """`_rid` and attributes of the new rows; indexes see them at once, as they read the table's log."""
        return self.file(table, writing=True).insert(rows)

    def insert_tuple(self, table: str, values: Sequence[Any]) -> Rid:
        file = self.file(table, writing=True)
        state = file._state()[1]
        kind = ", ".join(f"`{c['name']}` {c['kind']}" for c in state["columns"])
        rid = file.insert(self.spark.createDataFrame([tuple(values)], kind)).first()["_rid"]
        return rid["page_num"], rid["slot_num"]

    def read_tuple(self, table: str, rid: Rid) -> Row:
        return self.read_attributes(table, rid, [a.name for a in self.get_attributes(table)])

    def read_attributes(self, table: str, rid: Rid, names: Sequence[str]) -> Row:
        return self.file(table).read(rid, names)

    def read_attribute(self, table: str, rid: Rid, name: str) -> Any:
        return self.read_attributes(table, rid, [name])[0]

    def update_tuples(self, table: str, rows: DataFrame) -> None:
        """Whole rows with their `_rid`."""
        self.file(table, writing=True).update(rows)

    def update_tuple(self, table: str, rid: Rid, values: Sequence[Any]) -> None:
        file = self.file(table, writing=True)
        kind = ", ".join(f"`{c['name']}` {c['kind']}" for c in file._state()[1]["columns"])
        file.update(self.spark.createDataFrame([(tuple(rid), *values)], f"_rid struct<page_num:bigint,slot_num:int>, {kind}"))

    def delete_tuples(self, table: str, rids: DataFrame) -> None:
        self.file(table, writing=True).delete(rids)

    def delete_tuple(self, table: str, rid: Rid) -> None:
        file = self.file(table, writing=True)
        file.delete(file.rids([rid]))

    @staticmethod
    def print_tuple(row: Row) -> str:
        return print_record(row)

    # -- scans

    def table_scan(self, table: str, alias: str | None = None) -> Relation:
        """All rows and attributes; an alias is the relation's name in attributes, the table stays the table."""
        rel = Relation.of(self._rows(table), alias or table)
        return Relation(rel.df, rel.attrs, rel.columns, table)

    def scan(self, table: str, cond_attr: str | None, op: CompOp, value: Value | None, names: Sequence[str]) -> DataFrame:
        """`_rid` and the named attributes, in that order, of rows where the condition holds."""
        if not names:
            raise NoSuchAttribute("a scan needs attributes")
        rows = self._rows(table)
        rel = Relation.of(rows.withColumnRenamed("_ord", "ord"), table)
        if op is not CompOp.NO_OP:
            rel = filter_(rel, Condition(f"{table}.{cond_attr}", op, rhs=value))
        out = project(rel, [f"{table}.ord", *[f"{table}.{n}" for n in names]])
        return out.to_df("_ord", *names).select(rid_column().alias("_rid"), *[F.col(f"`{n}`") for n in names])

    # -- indexes

    @staticmethod
    def _index_key(table: str, attr: str) -> str:
        return f"{table}\0{attr}"

    def create_index(self, table: str, attr: str) -> None:
        """A sorted copy of (key, ordinal) of the rows that are there; later changes are read from the table's log."""
        version, catalog = self._catalog()
        file = self.file(table, writing=True)
        if attr not in [a.name for a in file.attributes()]:
            raise NoSuchAttribute(attr)
        key = self._index_key(table, attr)
        if key in catalog["indexes"]:
            raise IndexExists(f"{table}.{attr}")
        catalog["indexes"][key] = {"table": table, "attr": attr, **self._build(file, attr)}
        self.manifest.commit(version, catalog)

    def _build(self, file: RecordFile, attr: str) -> dict[str, Any]:
        path = f"{self.warehouse}/_indexes/{uuid.uuid4().hex}"
        base, state = file._state()
        rows = file.view(state).where(F.col(f"`{attr}`").isNotNull()).select(F.col(f"`{attr}`").alias("key"), "_ord")
        rows.repartitionByRange("key", "_ord").sortWithinPartitions("key", "_ord").write.parquet(path)
        return {"path": path, "version": base, "segments": [s["path"] for s in state["segments"]], "changes": [c["path"] for c in state["changes"]]}

    def destroy_index(self, table: str, attr: str) -> None:
        version, catalog = self._catalog()
        entry = catalog["indexes"].pop(self._index_key(table, attr), None)
        if entry is None:
            raise NoSuchIndex(f"{table}.{attr}")
        self.manifest.commit(version, catalog)
        self.store.delete(entry["path"])

    def rebuild_index(self, table: str, attr: str) -> None:
        """Fold what has changed since into a new sorted copy."""
        self._index(table, attr)
        version, catalog = self._catalog()
        entry = catalog["indexes"][self._index_key(table, attr)]
        old = entry["path"]
        entry.update(self._build(self.file(table), attr))
        self.manifest.commit(version, catalog)
        self.store.delete(old)

    def _index(self, table: str, attr: str) -> dict:
        self._entry(table)
        entry = self._catalog()[1]["indexes"].get(self._index_key(table, attr))
        if entry is None:
            raise NoSuchIndex(f"{table}.{attr}")
        return entry

    def _entries(self, table: str, attr: str, **bounds: Any) -> DataFrame:
        """(key, _ord) within the bounds, as the table is now: the sorted copy, without what changed since, and that."""
        entry, file = self._index(table, attr), self.file(table)
        state = file._state()[1]
        kind = next(c["kind"] for c in state["columns"] if c["name"] == attr)
        stored = in_range(self.spark.read.schema(f"key {kind}, _ord long").parquet(entry["path"]), "key", **bounds)
        known = set(entry["segments"])
        if not known <= {s["path"] for s in state["segments"]}:  # compacted since
            return in_range(file.view(state).select(F.col(f"`{attr}`").alias("key"), "_ord"), "key", **bounds)
        fresh = [s for s in state["segments"] if s["path"] not in known]
        if fresh:
            new = file.view(state | {"segments": fresh, "changes": []}).select(F.col(f"`{attr}`").alias("key"), "_ord")
            stored = stored.unionByName(in_range(new, "key", **bounds))
        if [c["path"] for c in state["changes"]] != entry["changes"]:
            last = file._changes(state)
            column = next(f"c{c['id']}" for c in state["columns"] if c["name"] == attr)
            now = in_range(last.where("NOT _gone").select(F.col(column).alias("key"), "_ord"), "key", **bounds)
            stored = stored.join(last.select("_ord"), "_ord", "left_anti").select("key", "_ord").unionByName(now)
        return stored

    def index_scan_rids(self, table: str, attr: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
        """(_rid, key) in ascending order of key."""
        rows = self._entries(table, attr, low=low, high=high, low_inclusive=low_inclusive, high_inclusive=high_inclusive)
        return rows.orderBy("key", "_ord").select(rid_column().alias("_rid"), "key")

    def index_scan(
        self, table: str, attr: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True, alias: str | None = None, through_index: bool = True, ordered: bool = True
    ) -> Relation:
        """Whole rows within the bounds, in ascending order of key unless that isn't asked for.

        The sorted copy gives the ordinals; where they lie (at most CELLS numbers reach the driver) chooses the segments
        that are opened and the row groups that are read, and a semi-join on the ordinal takes the rows. Without
        `through_index` the bounds go into the table's own scan instead. Both give the same rows.
        """
        self._index(table, attr)
        bounds = {"low": low, "high": high, "low_inclusive": low_inclusive, "high_inclusive": high_inclusive}
        if through_index:
            chosen = self._entries(table, attr, **bounds).select(F.col("_ord").alias("_wanted"))
            file = self.file(table)
            state = file._state()[1]
            rows = file.view(state, self._where(chosen, state["next"])).join(chosen, F.col("_ord") == F.col("_wanted"), "left_semi")
        else:
            rows = in_range(self._rows(table), f"`{attr}`", **bounds)
        rel = Relation.of(rows.orderBy(f"`{attr}`", "_ord") if ordered else rows, alias or table)
        return Relation(rel.df, rel.attrs, rel.columns, table)

    @staticmethod
    def _where(chosen: DataFrame, total: int) -> list[tuple[int, int]]:
        """At most RANGES ranges of ordinals that hold all `_wanted` ones."""
        size = -(-total // CELLS) or 1
        cells = sorted(r[0] for r in chosen.select(F.floor(F.col("_wanted") / size)).distinct().collect())
        ranges: list[tuple[int, int]] = []
        for c in cells:
            if ranges and ranges[-1][1] == c * size:
                ranges[-1] = (ranges[-1][0], (c + 1) * size)
            else:
                ranges.append((c * size, (c + 1) * size))
        while len(ranges) > RANGES:  # the closest neighbours become one
            gaps = sorted(range(len(ranges) - 1), key=lambda i: ranges[i + 1][0] - ranges[i][1])
            joined = set(gaps[: len(ranges) - RANGES])
            merged = [ranges[0]]
            for i, r in enumerate(ranges[1:]):
                if i in joined:
                    merged[-1] = (merged[-1][0], r[1])
                else:
                    merged.append(r)
            ranges = merged
        return ranges

    def print_btree(self, table: str, attr: str, order: int = 64) -> str:
        """The index as a tree of nodes of up to `order` keys."""
        return print_entries(self.index_scan_rids(table, attr), order)

    # -- the rest

    def register_views(self) -> None:
        """Every table as a temporary view, for spark.sql."""
        for name in self._catalog()[1]["tables"]:
            self._rows(name).drop("_ord").createOrReplaceTempView(name)

    def metrics(self, table: str) -> dict[str, int]:
        """Stored rows, changed rows, versions and bytes of a table."""
        file = self.file(table)
        version, state = file._state()
        return {"rows": sum(s["rows"] for s in state["segments"]), "changed": sum(c["rows"] for c in state["changes"]), "versions": version, "bytes": self.store.size(file.path)}

    def load(self, table: str, attrs: Sequence[Attribute], rows: Iterable[Sequence[Any]] | DataFrame) -> DataFrame:
        """A new table with these rows."""
        self.create_table(table, attrs)
        kind = ", ".join(f"`{a.name}` {a.spark_type().simpleString()}" for a in attrs)
        return self.insert_tuples(table, rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([tuple(r) for r in rows], kind))


__all__ = ["COLUMNS", "TABLES", "Engine", "EngineError"]
