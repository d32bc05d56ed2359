"""Incremental forms: listings seen once, incidents rolled up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files: int = 8) -> DataFrame:
    """A folder of Parquet files as a stream. Times without a zone are taken in the session's, as watermarks need one."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
    plain = [f.name for f in schema if isinstance(f.dataType, T.TimestampNTZType)]
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in plain}) if plain else raw


def first_seen_stream(stream: DataFrame, key: str, time: str, delay: str = "7 days") -> DataFrame:
    """Rows whose key hasn't been seen within the watermark's delay; the checkpoint is the state of what was done."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def daily_counts(rows: DataFrame, time: str, keys: list[str], **flags: Column) -> DataFrame:
    """Counts per day and key of a batch, or of one trigger's rows: those of several add up, see ``monthly``."""
    return rows.groupBy(F.date_trunc("DAY", time).alias("day"), *keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def add_available(stream: DataFrame, path: str, checkpoint: str, count: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """count(rows) of each trigger, for everything that is there now; all triggers' counts are returned.

    Each trigger has its own folder, which a repeated one overwrites, so nothing counts twice. There is no state and no
    watermark: rows count however late they come.
    """
    spark = stream.sparkSession
    count(spark.createDataFrame([], stream.schema)).write.mode("overwrite").parquet(f"{path}/trigger=-1")

    def add(batch: DataFrame, k: int) -> None:
        count(batch).write.mode("overwrite").parquet(f"{path}/trigger={k}")

    stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).drop("trigger")


def monthly(days: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    return days.groupBy(*keys, F.date_trunc("MONTH", "day").alias("month")).agg(*[F.sum(m).alias(m) for m in measures])


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, to Parquet; a later call goes on where this one ended."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
