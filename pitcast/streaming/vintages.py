"""Continuous vintage intake: the batch append-and-materialize step driven by a file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from pitcast.sources.store import append_and_materialize


def start_intake(spark: SparkSession, landing: str, schema: T.StructType, vintage_root: str, latest_root: str,
                 checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append every landed micro-batch to the vintages and refresh the latest table.

    Late rows need no watermark: a late row is a new vintage, and the as-of operators decide which
    origins may see it. A replayed batch replaces its own
    folder, and the latest table is keyed.
    """

    def handle(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            append_and_materialize(batch, vintage_root, latest_root, epoch)

    writer = (
        spark.readStream.schema(schema).parquet(landing).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()
