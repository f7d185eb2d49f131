"""Ordered indexes: (key, rid) entries in range-partitioned, sorted Parquet.

Range predicates reach the files' minima and maxima, so a range scan opens few of them. Inserted and deleted entries go to a
log; a scan takes the entries whose last change is not a deletion. NULL keys are not indexed. Any number of entries may
share a key.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbase.errors import FileError, NoSuchEntry, TypeMismatch
from quillbase.sources.files import Manifest, Store
from quillbase.sources.storage import SLOTS, Rid, ordinal
from quillbase.types import Attribute, AttrType


def in_range(df: DataFrame, column: str, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
    """Rows within the bounds; a bound of None is open. NULL keys are in no index and in no range."""
    c = df[column]
    out = df.where(c.isNotNull())
    if low is not None:
        out = out.where(c >= F.lit(low) if low_inclusive else c > F.lit(low))
    if high is not None:
        out = out.where(c <= F.lit(high) if high_inclusive else c < F.lit(high))
    return out


class IndexFile:
    """An index that is kept by its own entries."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark)
        self.manifest = Manifest(self.store, f"{self.path}/_versions")

    @classmethod
    def create(cls, spark: SparkSession, path: str, attr: Attribute, kind: str | None = None) -> IndexFile:
        index = cls(spark, path)
        if index.manifest.version():
            raise FileError(f"{path} is there already")
        index.manifest.commit(0, {"kind": kind or attr.spark_type().simpleString(), "type": int(attr.type), "seq": 0, "parts": [], "deletes": False})
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> IndexFile:
        index = cls(spark, path)
        if not index.manifest.version():
            raise FileError(f"{path} is not there")
        return index

    def destroy(self) -> None:
        if not self.manifest.version():
            raise FileError(f"{self.path} is not there")
        self.store.delete(self.path)

    def _read(self, state: dict) -> DataFrame:
        kind = f"key {state['kind']}, _ord long, _seq long, _gone boolean"
        return self.spark.read.schema(kind).parquet(*state["parts"]) if state["parts"] else self.spark.createDataFrame([], kind)

    def _entries(self, state: dict, **bounds: Any) -> DataFrame:
        rows = in_range(self._read(state), "key", **bounds)
        if not state["deletes"]:
            return rows.select("key", "_ord")
        last = rows.groupBy("key", "_ord").agg(F.max_by("_gone", "_seq").alias("gone"))
        return last.where("NOT gone").select("key", "_ord")

    def _log(self, entries: DataFrame, gone: bool) -> None:
        base, state = self.manifest.version(), self.manifest.load()
        path = f"{self.path}/part-{uuid.uuid4().hex}"
        rows = entries.where("key IS NOT NULL").select(F.col("key").cast(state["kind"]).alias("key"), "_ord", F.lit(state["seq"] + 1).cast("long").alias("_seq"), F.lit(gone).alias("_gone"))
        rows.repartitionByRange("key", "_ord").sortWithinPartitions("key", "_ord").write.parquet(path)
        state = state | {"seq": state["seq"] + 1, "parts": [*state["parts"], path], "deletes": state["deletes"] or gone}
        self.manifest.commit(base, state)

    def insert_entries(self, entries: DataFrame) -> None:
        """Rows (key, _rid)."""
        self._log(entries.select("key", (F.col("_rid.page_num").cast("long") * SLOTS + F.col("_rid.slot_num")).alias("_ord")), False)

    def delete_entries(self, entries: DataFrame) -> None:
        """Rows (key, _rid), each of which must be there."""
        state = self.manifest.load()
        gone = entries.select(F.col("key").cast(state["kind"]).alias("key"), (F.col("_rid.page_num").cast("long") * SLOTS + F.col("_rid.slot_num")).alias("_ord"))
        if gone.join(self._entries(state), ["key", "_ord"], "left_anti").take(1):
            raise NoSuchEntry("an entry to delete is not there")
        self._log(gone, True)

    def _one(self, key: Any, rid: Rid) -> DataFrame:
        state = self.manifest.load()
        wanted = {AttrType.INT: int, AttrType.REAL: (float, int), AttrType.VARCHAR: str}[AttrType(state["type"])]
        if key is not None and not isinstance(key, wanted):
            raise TypeMismatch(f"{key!r} is no key of this index")
        return self.spark.createDataFrame([(key, tuple(rid))], f"key {state['kind']}, _rid struct<page_num:bigint,slot_num:int>")

    def insert_entry(self, key: Any, rid: Rid) -> None:
        self.insert_entries(self._one(key, rid))

    def delete_entry(self, key: Any, rid: Rid) -> None:
        self.delete_entries(self._one(key, rid))

    def scan(self, low: Any = None, high: Any = None, low_inclusive: bool = True, high_inclusive: bool = True) -> DataFrame:
        """(_rid, key) in ascending order of key; what is deleted meanwhile stays in a scan that has begun."""
        rows = self._entries(self.manifest.load(), low=low, high=high, low_inclusive=low_inclusive, high_inclusive=high_inclusive)
        rid = F.struct((F.floor(F.col("_ord") / SLOTS)).cast("long").alias("page_num"), (F.col("_ord") % SLOTS).cast("int").alias("slot_num"))
        return rows.select(rid.alias("_rid"), "key", "_ord").orderBy("key", "_ord").drop("_ord")

    def compact(self) -> None:
        """One sorted, range-partitioned part without deleted entries."""
        base, state = self.manifest.version(), self.manifest.load()
        path = f"{self.path}/part-{uuid.uuid4().hex}"
        rows = self._entries(state).select("key", "_ord", F.lit(state["seq"]).cast("long").alias("_seq"), F.lit(False).alias("_gone"))
        rows.repartitionByRange("key", "_ord").sortWithinPartitions("key", "_ord").write.parquet(path)
        self.manifest.commit(base, state | {"parts": [path], "deletes": False})

    def printed(self, order: int = 64) -> str:
        """The entries as a tree, keys ascending."""
        return print_entries(self.scan(), order)


def print_entries(entries: DataFrame, order: int = 64) -> str:
    """A tree of nodes of up to `order` keys: {"keys": ["key:[(page,slot),...]", ...]} for a leaf, and above the leaves
    {"keys": [first key of each child but the first], "children": [...]}. The keys come to the driver one partition at a time.
    """
    rows = entries.groupBy("key").agg(F.sort_array(F.collect_list("_rid")).alias("r")).orderBy("key").toLocalIterator()
    held: list[tuple[str, str]] = [(str(r["key"]), f"{r['key']}:[{','.join(f'({x[0]},{x[1]})' for x in r['r'])}]") for r in rows]
    level = [(part[0][0], {"keys": [text for _, text in part]}) for part in (held[i : i + order] for i in range(0, len(held), order))] or [("", {"keys": []})]
    while len(level) > 1:
        groups = [level[i : i + order + 1] for i in range(0, len(level), order + 1)]
        level = [(g[0][0], {"keys": [first for first, _ in g[1:]], "children": [node for _, node in g]}) if len(g) > 1 else g[0] for g in groups]
    return json.dumps(level[0][1], ensure_ascii=False)


__all__ = ["IndexFile", "in_range", "ordinal", "print_entries"]
