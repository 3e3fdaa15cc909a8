"""Structured Streaming in and out of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keytide.operators.readview import newest
from keytide.sources.table import KVTable


def into_table(stream: DataFrame, table: KVTable, checkpoint: str) -> StreamingQuery:
    """Append a stream of (key, value[, op]): each micro-batch is one commit, which also records the batch's
    number, so a micro-batch that runs again after a failure is skipped if its commit was made."""

    def sink(batch: DataFrame, n: int) -> None:
        if table.applied.get(checkpoint, -1) < n and not batch.isEmpty():
            table.write_frame(batch, mark=(checkpoint, n))

    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).start()


def latest_state(stream: DataFrame) -> DataFrame:
    """The newest version of each key of a streamed changelog, for the update or complete output mode; what
    arrives late counts by its sequence number, so the order of arrival doesn't matter."""
    return newest(stream)
