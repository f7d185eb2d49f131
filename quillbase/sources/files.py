"""Small files and folders through Hadoop's file system API, so a warehouse may lie in any store.

A manifest is a numbered JSON file; a commit creates the next number, exclusively, and fails if another writer made it
first. Readers hold the version they began with, as nothing is written in place.
"""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from quillbase.errors import CommitConflict


class Store:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return bool(fs.exists(p))

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        with_ = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(with_))
        finally:
            with_.close()

    def create(self, path: str, data: bytes) -> None:
        """A new file, whole or not at all; CommitConflict if it is there.

        The draft takes its name in one exclusive step: a hard link in a local folder, elsewhere a rename that does not
        replace, which is atomic on HDFS; a store without such a rename needs one writer at a time.
        """
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        draft = self._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(data))
        out.close()
        try:
            if fs.getUri().getScheme() == "file":
                os.link(draft.toUri().getPath(), p.toUri().getPath())
            else:
                self._rename(fs, draft, p)
        except FileExistsError:
            raise CommitConflict(path) from None
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in str(e.java_exception):
                raise CommitConflict(path) from None
            raise
        finally:
            fs.delete(draft, False)


    def _rename(self, fs, draft, p) -> None:
        """Raises FileAlreadyExistsException if `p` is there."""
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(draft, p, options)


class Manifest:
    """The numbered versions of a JSON document in a folder."""

    def __init__(self, store: Store, folder: str):
        self.store, self.folder = store, folder.rstrip("/")

    def version(self) -> int:
        """0 if there is none."""
        found = [n for n in self.store.names(self.folder) if n.startswith("v") and n.endswith(".json")]
        return int(found[-1][1:-5]) if found else 0

    def load(self, version: int | None = None) -> dict[str, Any]:
        """A version's document, the last one's if none is named."""
        return json.loads(self.store.read(f"{self.folder}/v{version or self.version():012d}.json"))

    def commit(self, base: int, document: dict[str, Any]) -> int:
        """Version base + 1; CommitConflict if another writer was first."""
        self.store.create(f"{self.folder}/v{base + 1:012d}.json", json.dumps(document).encode())
        return base + 1
