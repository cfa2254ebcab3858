"""Scan ingestion as a stream: every landed micro-batch is one scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodgetrail.plans.scan import TrackingStore


def merge_batches(store: TrackingStore, to_batch: Callable[[DataFrame], DataFrame], time_column: str,
                  complete: bool = False, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """foreachBatch function: one merge per micro-batch, replays skipped by stream and batch id.

    Only with ``complete`` does a micro-batch count as a whole scan, whose
    missing listings are missed; a trigger may come while pages still land.

    Miss counters live in the state table, so removals follow from the same
    merge and nothing is kept in the state store.
    """

    def merge_one(landed: DataFrame, batch_id: int) -> None:
        newest = landed.agg(F.date_format(F.max(time_column), "yyyy-MM-dd HH:mm:ss").alias("t")).first().t
        if newest is not None:
            store.apply_scan(to_batch(landed), newest, complete=complete, batch_key=f"{stream}-{batch_id}")

    return merge_one


def start_ingestion(
    landed: DataFrame, store: TrackingStore, to_batch: Callable[[DataFrame], DataFrame],
    time_column: str, checkpoint: str, available_now: bool = True, every: str = "30 minutes", complete: bool = False,
) -> StreamingQuery:
    """Start the ingestion. Batch ids start anew with a checkpoint folder, so its path names the stream."""
    merges = merge_batches(store, to_batch, time_column, complete, stream=checkpoint)
    writer = landed.writeStream.foreachBatch(merges).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()
