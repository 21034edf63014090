"""Documents that arrive over time: each micro-batch goes through a batch pipeline and is appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def segment_stream(docs: DataFrame, out: str, checkpoint: str, pipeline: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Start a query that writes ``pipeline(batch)`` of every micro-batch below ``out``, one folder for each batch.

    A batch that is repeated after a failure overwrites its own folder, so results are written once.
    """

    def write(batch: DataFrame, number: int) -> None:
        pipeline(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
