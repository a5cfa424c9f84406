"""Streams of new records: matched batch by batch, each batch written once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from postalloom.config import EngineConfig
from postalloom.operators import incremental
from postalloom.sources import sinks


def match_stream(records: DataFrame, representatives: Callable[[], DataFrame], threshold: float, output: str, checkpoint: str, config: EngineConfig | None = None, at: str | None = "create_time", trigger: dict | None = None) -> StreamingQuery:
    """Matches each micro-batch to the representatives as they are then, and writes it under its batch id.

    A batch that is repeated after a failure overwrites its own folder, so rows are written exactly once. Records that
    come again within the watermark are dropped.
    """
    settings = config or EngineConfig()
    source = records.withWatermark(at, settings.watermark).dropDuplicatesWithinWatermark(["id"]) if at else records

    def write(batch: DataFrame, number: int) -> None:
        matches = incremental.match(batch, representatives(), threshold, settings)
        sinks.incremental_rows(matches, str(number), settings).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def process_stream(records: DataFrame, run: Callable[[DataFrame], DataFrame], output: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Any function of frames over micro-batches, whose size the source's options set (maxFilesPerTrigger)."""

    def write(batch: DataFrame, number: int) -> None:
        run(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
