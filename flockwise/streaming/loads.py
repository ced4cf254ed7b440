"""Continuous loading: the batch merges applied to micro-batches, and decayed signals over event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_table(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 8) -> DataFrame:
    """A directory of Parquet files as a stream, with the columns of `like`."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def merge_stream(stream: DataFrame, target: str, empty: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Folds every micro-batch into a table by a merge function.

    Each batch writes a version named by its number, so a batch that is repeated after a failure overwrites its own
    version and starts from the one before: the result is the same as if it had run once. Runs until the input is used up.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = spark.read.schema(empty.schema).parquet(f"{target}/v={number - 1}") if number else empty
        merge(old, batch).write.mode("overwrite").parquet(f"{target}/v={number}")

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, at: str, keys: list[str], window: str, late: str) -> DataFrame:
    """Events per window and keys; rows later than `late` are dropped by the watermark."""
    when = F.col(at).cast("timestamp")
    rows = stream.withColumn("_at", when).withWatermark("_at", late)
    per = rows.groupBy(F.window("_at", window), *keys).agg(F.count("*").alias("n"))
    return per.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *keys, "n")
