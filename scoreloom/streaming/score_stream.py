"""Incremental scores: a stream of score rows keeps windowed aggregates, and appends to the log exactly once a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.cases import SCORE
from ..sources.folders import folder


def scores(spark: SparkSession, path: str) -> DataFrame:
    """Score rows as their files come in."""
    return spark.readStream.schema(SCORE).json(path)


def by_window(stream: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Mean and count of each system and metric by window of the time of scoring; rows later than ``late`` are left out."""
    return stream.withWatermark("scored_at", late).groupBy(F.window("scored_at", width), "system", "metric").agg(F.avg("value").alias("average"), F.count(F.lit(1)).alias("n"))


def append_log(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Appends new rows to a log of Parquet, one folder a batch: a batch that runs again replaces its own folder alone."""

    def put(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["system", "document", "metric", "pass", "seq"]).write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windows_of(stream: DataFrame, time: str, group: str, value: str, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """group, start, n, average by window of an event's own time."""
    t = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("average"))
    return t.select(group, F.col("w.start").alias("start"), "n", "average")


def settled(windows: DataFrame, spark: SparkSession) -> DataFrame:
    """What windows hold once all that has come in is read, as a table; each batch rewrites it as a whole."""
    at = folder(spark, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table")

    windows.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(windows.schema).parquet(f"{at}/table")
