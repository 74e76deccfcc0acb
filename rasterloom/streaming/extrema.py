"""The history of a metric as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def extrema(log: DataFrame, group: str, value: str) -> DataFrame:
    """group, lowest, highest and n of a stream of measurements; state holds one row a group."""
    return log.groupBy(group).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count("*").alias("n"))


def by_window(log: DataFrame, time: str, late: str, width: str, group: str, value: str) -> DataFrame:
    """The same by event time; windows are given once the watermark has passed them, and then leave the state."""
    return log.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.min(value).alias("lowest"), F.max(value).alias("highest"), F.count("*").alias("n"))


def run_once(stream: DataFrame, folder: str, mode: str = "complete") -> DataFrame:
    """Process all that is there, and return what the query has put out so far; state and output are in a folder that all executors share.

    Each batch is a part of its own, which a batch that is repeated after a failure replaces; in complete mode the last one counts.
    """
    spark, out = stream.sparkSession, f"{folder}/out"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    put(spark.createDataFrame([], stream.schema), -1)
    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(StructType([*stream.schema, StructField("batch", LongType())])).parquet(out)
    if mode == "complete":
        found = found.where(F.col("batch") == found.agg(F.max("batch")).first()[0])
    return found.drop("batch")
