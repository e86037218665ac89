"""Validation of a stream of addresses, an extension: each micro-batch goes through the batch resolver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postmark.operators import resolve


def validate_stream(stream: DataFrame, entities: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Starts a query that writes each micro-batch of (id, text) with its results to ``out``; a batch that runs again overwrites its own folder only."""

    def run(batch: DataFrame, number: int) -> None:
        resolve.validate(batch.select("id", "text"), entities, **options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
