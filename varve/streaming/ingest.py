"""A stream as a change log: each micro-batch is one atomic write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from varve.store import Store


def ingest(stream: DataFrame, store: Store, checkpoint: str, pos: str = "pos") -> StreamingQuery:
    """Write a stream of (pos, vtype, user_key, value) into a store until it is stopped.

    Sequence numbers follow pos inside a micro-batch and the batches' order across them. A micro-batch that
    the store has taken already, which happens when a query starts again, is left out: its number is kept.
    """

    def take(batch: DataFrame, number: int) -> None:
        if store.streamed < number:  # the number and the rows are there by one manifest edit
            store.write_frame(batch.withColumnRenamed(pos, "pos"), number)

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
