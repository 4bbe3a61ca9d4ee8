"""Structured Streaming forms of the operators that work row by row or append once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sortament.operators.persist import append_once
from sortament.operators.reject_rows import load_lines


def stream_table(spark: SparkSession, folder: str, like: DataFrame, *, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder, with the columns of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str) -> StreamingQuery:
    """Write each key once, whatever repeats within or across batches or after a restart."""

    def write(batch: DataFrame, _: int) -> None:
        append_once(batch.sparkSession, path, batch, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_line_stream(stream: DataFrame, key: str, text: str, loaded: str, rejected: str, checkpoint: str) -> StreamingQuery:
    """Lines as they arrive into two tables: loaded rows and rejects with their reason."""

    def write(batch: DataFrame, _: int) -> None:
        result = load_lines(batch, key, text)
        append_once(batch.sparkSession, loaded, result.loaded, key)
        append_once(batch.sparkSession, rejected, result.rejected, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """Each key once within the lateness the watermark allows; state is kept no longer."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, group: str, *, width: str, slide: str, late: str) -> DataFrame:
    """Counts by sliding window and group; rows later than ``late`` are left out, which
    the reference has no counterpart for."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, width, slide), group).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(F.col("window.start").alias("window_start"), group, "rows")
