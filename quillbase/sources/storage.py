"""Record files: Parquet segments under a versioned manifest, with row identifiers that last.

An inserted row gets the next ordinal, which is its identifier for good: page = ordinal // SLOTS, slot = ordinal % SLOTS,
never used again. Inserts append segments. Updates and deletes append to a change log; reading takes the segments
without the changed ordinals, and the last change of each. Segments carry the range of their ordinals, so reading by
identifier opens only files that can hold it, and a file that was never updated is a plain, prunable Parquet scan.
Ordinals are dense, so an identifier is live if it was given out and not deleted, which the change log and a list of
compacted deletions tell; no update or delete looks at the table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillbase.errors import FileError, NoSuchAttribute, NoSuchRid
from quillbase.sources.files import Manifest, Store
from quillbase.types import Attribute, AttrType

#: Slots of a page: what turns an ordinal into (page, slot).
SLOTS = 64
#: Changed rows per stored row beyond which a read should be preceded by compact().
COMPACT_AT = 0.2

Rid = tuple[int, int]


def rid_column(ordinal: str = "_ord") -> Column:
    o = F.col(ordinal)
    return F.struct((F.floor(o / SLOTS)).cast("long").alias("page_num"), (o % SLOTS).cast("int").alias("slot_num"))


def ordinal_of(rid: Column) -> Column:
    return rid["page_num"].cast("long") * SLOTS + rid["slot_num"]


def in_ranges(column: Column, ranges: Sequence[tuple[int, int]]) -> Column:
    """Whether a column lies in one of the ranges [a, b)."""
    out = F.lit(False)
    for a, b in ranges:
        out = out | ((column >= a) & (column < b))
    return out


def ordinal(rid: Rid) -> int:
    return rid[0] * SLOTS + rid[1]


class RecordFile:
    """A file of records with an ordered list of attributes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.store = Store(spark)
        self.manifest = Manifest(self.store, f"{self.path}/_versions")
        #: Stored parts (segments and change files) read, changed and appended since this handle was opened.
        self.counters = {"read": 0, "write": 0, "append": 0}

    # -- life cycle

    @classmethod
    def create(cls, spark: SparkSession, path: str, attrs: Sequence[Attribute], kinds: Sequence[str] | None = None) -> RecordFile:
        """A new, empty file; kinds: Spark types where they are wider than the attributes' own."""
        file = cls(spark, path)
        if file.manifest.version():
            raise FileError(f"{path} is there already")
        kinds = kinds or [a.spark_type().simpleString() for a in attrs]
        columns = [{"id": i, "name": a.name, "type": int(a.type), "length": a.length, "kind": k} for i, (a, k) in enumerate(zip(attrs, kinds, strict=True))]
        file.manifest.commit(0, {"columns": columns, "next_column": len(columns), "next": 0, "seq": 0, "segments": [], "changes": []})
        return file

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> RecordFile:
        file = cls(spark, path)
        if not file.manifest.version():
            raise FileError(f"{path} is not there")
        return file

    def destroy(self) -> None:
        if not self.manifest.version():
            raise FileError(f"{self.path} is not there")
        self.store.delete(self.path)

    # -- schema

    def attributes(self, state: dict | None = None) -> list[Attribute]:
        state = state or self.manifest.load()
        return [Attribute(c["name"], AttrType(c["type"]), c["length"]) for c in state["columns"]]

    def add_attribute(self, attr: Attribute) -> None:
        """Rows that are there read NULL for it; no data is written."""
        base, state = self._state()
        if any(c["name"] == attr.name for c in state["columns"]):
            raise NoSuchAttribute(f"{attr.name!r} is there already")
        state["columns"].append({"id": state["next_column"], "name": attr.name, "type": int(attr.type), "length": attr.length, "kind": attr.spark_type().simpleString()})
        state["next_column"] += 1
        self.manifest.commit(base, state)

    def drop_attribute(self, name: str) -> None:
        """Gone from the schema; stored values stay until compaction, and an attribute added later doesn't see them."""
        base, state = self._state()
        left = [c for c in state["columns"] if c["name"] != name]
        if len(left) == len(state["columns"]):
            raise NoSuchAttribute(name)
        self.manifest.commit(base, state | {"columns": left})

    # -- reading

    def _state(self) -> tuple[int, dict[str, Any]]:
        base = self.manifest.version()
        if not base:
            raise FileError(f"{self.path} is not there")
        return base, self.manifest.load(base)

    def _stored(self, state: dict) -> T.StructType:
        fields = [T.StructField("_ord", T.LongType())]
        return T.StructType(fields + [T.StructField(f"c{c['id']}", T._parse_datatype_string(c["kind"])) for c in state["columns"]])

    def _segments(self, state: dict, ranges: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        wanted = [s for s in state["segments"] if ranges is None or any(s["first"] < b and a < s["first"] + s["rows"] for a, b in ranges)]
        self.counters["read"] += len(wanted)
        kind = self._stored(state)
        return self.spark.read.schema(kind).parquet(*[s["path"] for s in wanted]) if wanted else self.spark.createDataFrame([], kind)

    def _changes(self, state: dict) -> DataFrame:
        """The last change of each changed ordinal."""
        kind = self._stored(state).add("_seq", T.LongType()).add("_gone", T.BooleanType())
        log = self.spark.read.schema(kind).parquet(*[c["path"] for c in state["changes"]])
        value = F.struct("_gone", *[c.name for c in self._stored(state).fields[1:]])
        return log.groupBy("_ord").agg(F.max_by(value, "_seq").alias("v")).select("_ord", "v.*")

    def view(self, state: dict | None = None, ranges: Sequence[tuple[int, int]] | None = None) -> DataFrame:
        """`_ord` and the attributes of every live record of one version, or of those whose ordinal is in one of the ranges [a, b).

        Ranges choose the segments that are opened, and go into their scans, where Parquet's statistics prune row groups.
        """
        state = state or self._state()[1]
        columns = [f"c{c['id']}" for c in state["columns"]]
        rows = self._segments(state, ranges).select("_ord", *columns)
        inside = in_ranges(F.col("_ord"), ranges) if ranges is not None else F.lit(True)
        rows = rows.where(inside)
        if state["changes"]:
            self.counters["read"] += len(state["changes"])
            last = self._changes(state).where(inside)
            rows = rows.join(last.select("_ord"), "_ord", "left_anti").unionByName(last.where(~F.col("_gone")).select("_ord", *columns))
        named = [F.col(f"c{c['id']}").alias(c["name"], metadata={"length": c["length"]}) for c in state["columns"]]
        return rows.select("_ord", *named)

    def scan(self) -> DataFrame:
        """`_rid` and the attributes."""
        rows = self.view()
        return rows.select(rid_column().alias("_rid"), *[f"`{c}`" for c in rows.columns[1:]])

    def read(self, rid: Rid, names: Sequence[str] | None = None) -> Row:
        """One record, or some of its attributes in the given order."""
        state = self._state()[1]
        own = [a.name for a in self.attributes(state)]
        if missing := set(names or ()) - set(own):
            raise NoSuchAttribute(str(sorted(missing)))
        at = ordinal(rid)
        found = self.view(state, [(at, at + 1)]).where(F.col("_ord") == at).select(*[f"`{n}`" for n in names or own]).take(1)
        if not found:
            raise NoSuchRid(str(rid))
        return found[0]

    # -- writing

    def _cast(self, df: DataFrame, state: dict) -> list[Column]:
        if missing := [c["name"] for c in state["columns"] if c["name"] not in df.columns]:
            raise NoSuchAttribute(f"the rows lack {missing}")
        return [F.col(f"`{c['name']}`").cast(c["kind"]).alias(f"c{c['id']}") for c in state["columns"]]

    def _path(self, kind: str) -> str:
        return f"{self.path}/{kind}-{uuid.uuid4().hex}"

    def insert(self, df: DataFrame, batch: tuple[str, int] | None = None) -> DataFrame:
        """Append rows; gives their `_rid` and attributes. A stream's batch is committed once, by its number.

        Rows are numbered by the partition that first wrote them and their place in it, so no row is moved or ordered;
        the counts that reach the driver are one a partition.
        """
        base, state = self._state()
        done = state.setdefault("batches", {})
        if batch and done.get(batch[0], -1) >= batch[1]:
            return self.scan().limit(0)
        if batch:
            done[batch[0]] = batch[1]
        draft, final = self._path("draft"), self._path("segment")
        place = F.monotonically_increasing_id()
        df.select(*self._cast(df, state), place.alias("_place")).write.parquet(draft)
        written = self.spark.read.schema(T.StructType([*self._stored(state).fields[1:], T.StructField("_place", T.LongType())])).parquet(draft)
        counts = written.groupBy(F.shiftright("_place", 33).alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
        total, starts = 0, []
        for r in counts:
            starts.append((r["_part"], state["next"] + total))
            total += r["n"]
        if total:
            offsets = self.spark.createDataFrame(starts, "_part long, _start long")
            numbered = written.withColumn("_part", F.shiftright("_place", 33)).join(F.broadcast(offsets), "_part")
            numbered = numbered.withColumn("_ord", F.col("_start") + F.col("_place").bitwiseAND((1 << 33) - 1))
            numbered.select("_ord", *[f"c{c['id']}" for c in state["columns"]]).write.parquet(final)
            state["segments"].append({"path": final, "first": state["next"], "rows": total})
        state["next"] += total
        self.manifest.commit(base, state)
        self.store.delete(draft)
        self.counters["append"] += 1
        new = self.view(state | {"segments": state["segments"][-1:] if total else [], "changes": []})
        return new.select(rid_column().alias("_rid"), *[f"`{c}`" for c in new.columns[1:]])

    def _change(self, rows: DataFrame, gone: bool) -> None:
        """Log new values, or deletions, for rows with `_ord`; every ordinal must be live."""
        base, state = self._state()
        path = self._path("changes")
        columns = [F.lit(None).cast(c["kind"]).alias(f"c{c['id']}") for c in state["columns"]] if gone else self._cast(rows, state)
        rows.select("_ord", *columns, F.lit(state["seq"] + 1).cast("long").alias("_seq"), F.lit(gone).alias("_gone")).write.parquet(path)
        logged = self.spark.read.schema("_ord long").parquet(path)
        n, distinct = logged.agg(F.count("*"), F.countDistinct("_ord")).first()
        inside = (F.col("_ord") >= 0) & (F.col("_ord") < state["next"])
        dead = logged.where(~F.coalesce(inside, F.lit(False))).take(1) or logged.join(self._gone(state), "_ord", "left_semi").take(1)
        if dead or n != distinct:
            self.store.delete(path)
            if dead:
                raise NoSuchRid(str(divmod(dead[0]["_ord"], SLOTS) if dead[0]["_ord"] is not None else None))
            raise FileError("an identifier comes twice in one change")
        state["seq"] += 1
        state["changes"].append({"path": path, "rows": n})
        self.manifest.commit(base, state)
        self.counters["write"] += 1

    def _gone(self, state: dict) -> DataFrame:
        """`_ord` of all deleted records."""
        gone = self.spark.read.schema("_ord long").parquet(*state["gone"]) if state.get("gone") else self.spark.createDataFrame([], "_ord long")
        return gone.unionByName(self._changes(state).where("_gone").select("_ord")) if state["changes"] else gone

    def update(self, df: DataFrame) -> None:
        """Replace whole records: `_rid` and every attribute. Identifiers stay."""
        self._change(df.withColumn("_ord", ordinal_of(F.col("_rid"))), False)

    def delete(self, rids: DataFrame) -> None:
        """Delete the records of a column `_rid`; deleting one twice fails."""
        self._change(rids.select(ordinal_of(F.col("_rid")).alias("_ord")), True)

    def rids(self, some: Iterable[Rid]) -> DataFrame:
        return self.spark.createDataFrame([((p, s),) for p, s in some], "_rid struct<page_num:bigint,slot_num:int>")

    def needs_compaction(self) -> bool:
        state = self._state()[1]
        return sum(c["rows"] for c in state["changes"]) > COMPACT_AT * max(1, sum(s["rows"] for s in state["segments"]))

    def compact(self) -> None:
        """Fold the change log into one new segment; identifiers stay, open readers keep their version's files."""
        base, state = self._state()
        path, gone = self._path("segment"), self._path("gone")
        rows = self.view(state)
        rows.select("_ord", *[F.col(f"`{c['name']}`").alias(f"c{c['id']}") for c in state["columns"]]).write.parquet(path)
        self._gone(state).write.parquet(gone)
        self.manifest.commit(base, state | {"segments": [{"path": path, "first": 0, "rows": state["next"]}], "changes": [], "gone": [gone]})

    def vacuum(self) -> None:
        """Delete files that the last version doesn't name; only when no older reader is left."""
        state = self._state()[1]
        live = {s["path"].rpartition("/")[2] for s in state["segments"] + state["changes"]} | {p.rpartition("/")[2] for p in state.get("gone", [])} | {"_versions"}
        for name in self.store.names(self.path):
            if name not in live:
                self.store.delete(f"{self.path}/{name}")


def print_record(row: Row) -> str:
    """`name = value` for each attribute, NULL for nulls."""
    return "  ".join(f"{k} = {'NULL' if v is None else v}" for k, v in row.asDict().items())


class PageFile:
    """Numbered pages of bytes: create, append, read, write, count."""

    PAGE = 4096
    _attrs = (Attribute("data", AttrType.OTHER, PAGE),)

    def __init__(self, file: RecordFile):
        self.file = file
        #: Pages read, written and appended through this handle.
        self.pages = [0, 0, 0]

    @classmethod
    def create(cls, spark: SparkSession, path: str) -> PageFile:
        return cls(RecordFile.create(spark, path, cls._attrs))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> PageFile:
        return cls(RecordFile.open(spark, path))

    def destroy(self) -> None:
        self.file.destroy()

    def _frame(self, data: bytes, schema: str, *before: Any) -> DataFrame:
        if len(data) != self.PAGE:
            raise FileError(f"a page has {self.PAGE} bytes")
        return self.file.spark.createDataFrame([(*before, bytearray(data))], schema)

    def append_page(self, data: bytes) -> None:
        self.file.insert(self._frame(data, "data binary"))
        self.pages[2] += 1

    def write_page(self, n: int, data: bytes) -> None:
        self.file.update(self._frame(data, "_rid struct<page_num:bigint,slot_num:int>, data binary", divmod(n, SLOTS)))
        self.pages[1] += 1

    def read_page(self, n: int) -> bytes:
        page = bytes(self.file.read(divmod(n, SLOTS))["data"])
        self.pages[0] += 1
        return page

    def number_of_pages(self) -> int:
        return int(self.file._state()[1]["next"])

    def collect_counter_values(self) -> tuple[int, int, int]:
        """Pages read, written, appended."""
        return tuple(self.pages)  # type: ignore[return-value]
