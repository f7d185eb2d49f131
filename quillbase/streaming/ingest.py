"""A stream of rows into a table, each micro-batch one commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillbase.session import Engine


def append_stream(engine: Engine, table: str, rows: DataFrame, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Insert every micro-batch; its number is part of the commit, so a batch that is run again changes nothing."""
    file = engine.file(table, writing=True)
    stream = checkpoint.rstrip("/")

    def insert(batch: DataFrame, number: int) -> None:
        file.insert(batch, (stream, number))

    writer = rows.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
