"""Feeds a mutation log from Structured Streaming into a table, one commit a micro-batch."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyloom.sources.database import Database


def ingest(stream: DataFrame, database: Database, table: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """stream(seq, op, key columns, record columns) -> the table. A micro-batch that was committed before a failure is
    recognised by its stream, as its checkpoint names it, and its number, kept in the same commit, and not applied again.
    Several streams may feed one table, each with its own checkpoint."""

    def apply(batch: DataFrame, number: int) -> None:
        stream_id = json.loads(database._read_file(f"{checkpoint.rstrip('/')}/metadata"))["id"]
        done = database._catalog[table].get("batches", {})
        if done.get(stream_id, -1) >= number:
            return
        batch = batch.persist()
        try:
            database.apply(table, batch)
            database._catalog[table]["batches"] = done | {stream_id: number}
            database.commit()
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
