"""Incremental builds: a stream of raw documents keeps a table of records current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def changed_documents(stream: DataFrame, within: str = "7 days", time: str = "fetched_at") -> DataFrame:
    """Documents whose URL and content hash were not seen within the watermark; state is bounded by it."""
    hashed = stream.withColumn("sha256", F.sha2("body", 256)).withWatermark(time, within)
    return hashed.dropDuplicatesWithinWatermark(["url", "sha256"])


def keep_records(stream: DataFrame, extract: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that extracts each micro-batch's records and writes them under its number; a batch that runs again replaces
    its own files, so every record is there once."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def rolling_counts(stream: DataFrame, late: str = "1 hour", width: str = "1 day", time: str = "fetched_at") -> DataFrame:
    """Fetched documents by source and window, with late data up to the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "source_id").agg(F.count("*").alias("documents"))
