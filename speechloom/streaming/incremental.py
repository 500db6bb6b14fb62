"""Stop and resume as a stream: what has been processed stands in a checkpoint, not in a process's memory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def incremental(spark: SparkSession, source: str, schema: str, transform: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Processes the files of a folder that no earlier run has finished, appends the rows as JSON lines, and ends. A run that was
    stopped goes on with the batch it was in; a batch is written once."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    writer = transform(rows).writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(target)


def running_counts(spark: SparkSession, source: str, schema: str, checkpoint: str, name: str) -> StreamingQuery:
    """Counts by status of what a run has written so far, kept up to date in a table in memory."""
    rows = spark.readStream.schema(schema).json(source)
    counts = rows.groupBy("pipeline", "status").count()
    return counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
