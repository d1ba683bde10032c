"""Feeding a collection from a stream: each micro-batch is one write with its own version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import InvalidArgument
from ..store.collection import Collection


def write_batch(collection: Collection, batch: DataFrame, mode: str, order_col: str, progress: dict[str, int] | None = None) -> None:
    """Rows with _pk and the collection's fields; in update mode only the batch's own fields change."""
    rows = batch.withColumnRenamed(order_col, "_pos") if order_col != "_pos" else batch
    if mode == "insert":
        collection.insert_frame(rows, progress)
    elif mode in ("upsert", "update"):
        collection.merge_frame(rows, create=mode == "upsert", progress=progress)
    elif mode == "delete":
        collection.delete_frame(rows.select("_pos", "_pk"), progress)
    else:
        raise InvalidArgument(f"mode {mode!r}", "ingest")


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, mode: str = "upsert", order_col: str = "_pos", **trigger) -> StreamingQuery:
    """Start a query that writes the stream's rows in the order of order_col.

    A batch that was written before a restart is not written again: the collection keeps the
    last batch's number of each checkpoint, in the same manifest as the batch itself.
    """
    if "_pk" not in stream.columns or order_col not in stream.columns:
        raise InvalidArgument(f"the stream needs _pk and {order_col}", "ingest")

    def each(batch: DataFrame, number: int) -> None:
        if collection.progress(checkpoint) >= number:
            return
        cached = batch.withColumn(order_col, F.col(order_col).cast("long")).persist()
        try:
            write_batch(collection, cached, mode, order_col, {checkpoint: number})
            if collection.progress(checkpoint) < number:  # nothing was written
                collection.set_progress(checkpoint, number)
        finally:
            cached.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
