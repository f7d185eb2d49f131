"""A relation: a lazy DataFrame whose attributes are named relation.attribute.

Inside, columns have unique names, so joins may repeat a relation's attribute names and a relation may be joined with
itself under an alias; outside names are put on by to_df().
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quillbase.errors import NoSuchAttribute
from quillbase.types import Attribute, attributes

_number = itertools.count()


@dataclass(frozen=True)
class Relation:
    df: DataFrame
    attrs: tuple[Attribute, ...]
    columns: tuple[str, ...]
    #: For base tables: their name, and the alias for show.
    table: str | None = field(default=None)

    @staticmethod
    def of(df: DataFrame, name: str) -> Relation:
        """A DataFrame under a relation's name; hidden columns (leading underscore) stay out."""
        own = [a for a in attributes(df.schema) if not a.name.startswith("_")]
        inner = [f"c{next(_number)}" for _ in own]
        renamed = df.select(*[F.col(f"`{a.name}`").alias(c) for a, c in zip(own, inner, strict=True)])
        return Relation(renamed, tuple(Attribute(f"{name}.{a.name}", a.type, a.length) for a in own), tuple(inner), name)

    def get_attributes(self) -> list[Attribute]:
        return list(self.attrs)

    def position(self, name: str) -> int:
        """Of relation.attribute, or of a bare attribute name that only one relation has."""
        full = [i for i, a in enumerate(self.attrs) if a.name == name]
        found = full or [i for i, a in enumerate(self.attrs) if a.name.rpartition(".")[2] == name]
        if len(found) != 1:
            raise NoSuchAttribute(f"{name!r} names {len(found)} attributes of {[a.name for a in self.attrs]}")
        return found[0]

    def attribute(self, name: str) -> Attribute:
        return self.attrs[self.position(name)]

    def column(self, name: str) -> Column:
        return self.df[self.columns[self.position(name)]]

    def to_df(self, *names: str) -> DataFrame:
        """With attributes named relation.attribute, or as given."""
        out = names or [a.name for a in self.attrs]
        return self.df.select(*[F.col(c).alias(n) for c, n in zip(self.columns, out, strict=True)])

    def rows(self) -> Iterator[Row]:
        """Rows one after another; partitions come to the driver one at a time."""
        return self.to_df().toLocalIterator()

    def pipe(self, fn: Callable[[DataFrame], DataFrame], name: str) -> Relation:
        """Any transformation of the named DataFrame, as a relation again."""
        return Relation.of(fn(self.to_df(*[a.name.rpartition(".")[2] for a in self.attrs])), name)
