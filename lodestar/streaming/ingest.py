"""Structured Streaming: idempotent ingest, sliding windows, late rows, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """New Parquet files of a folder as a stream, a bounded number at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def chunk_of_file() -> Column:
    """The chunk of a row of a file stream: its file, which always comes whole."""
    return F.sha1("_metadata.file_path")


def ingest(stream: DataFrame, folder: str, checkpoint: str, key: str, chunk: str = "chunk") -> None:
    """Drains the stream into ``folder``. A chunk, which must come whole in one batch, is a
    partition that its rows overwrite: if it comes again, from a new checkpoint, in other
    batches or after an attempt that broke off, it replaces itself and nothing else.
    Repeated keys within a chunk are one row."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates([chunk, key])
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(chunk).parquet(folder)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def drain(stream: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """Everything that a stream appends, as a table."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(folder)


def sliding(stream: DataFrame, time: str, size: str, slide: str, late: str, by: list[str], value: str) -> DataFrame:
    """Counts and sums in sliding windows; rows later than ``late`` are dropped."""
    counted = stream.withWatermark(time, late).groupBy(F.window(time, size, slide), *by)
    return counted.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("t_start"), F.col("window.end").alias("t_end"), *by, "n", "total")


def deduplicated(stream: DataFrame, time: str, late: str, key: list[str]) -> DataFrame:
    """First row of each key, remembered for as long as late rows may come."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def sessions(stream: DataFrame, time: str, gap: str, late: str, by: list[str]) -> DataFrame:
    """Sessions that end after a gap without rows."""
    counted = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by)
    return counted.agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("t_start"), F.col("session_window.end").alias("t_end"), *by, "n")
