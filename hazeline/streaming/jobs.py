"""The hourly loop as streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hazeline.plans.ingest import refresh
from hazeline.sources.store import FeatureStore


def unique_observations(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Drops repeated (station, hour) observations that arrive within ``lateness`` of each other."""
    timed = stream.withColumn("event_time", F.col("datetime").cast("timestamp"))
    return (
        timed.withWatermark("event_time", lateness)
        .dropDuplicatesWithinWatermark(["city", "datetime"])
        .drop("event_time")
    )


def start_refresh(
    stream: DataFrame, store: FeatureStore, checkpoint: str, *, block_seconds: int | None = None
) -> StreamingQuery:
    """Runs the batch refresh on each micro-batch, for all input there is now.

    The upsert gives the same table when a batch is replayed.
    """

    def upsert(batch: DataFrame, _batch_id: int) -> None:
        refresh(store, batch, block_seconds=block_seconds)

    return (
        stream.writeStream.foreachBatch(upsert)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_live(forecasts: DataFrame, actuals: DataFrame, lateness: str = "3 days") -> DataFrame:
    """Joins a stream of forecasts with the stream of actual values: day and error of each pair.

    Both sides are bounded by their watermark, so neither state grows without end.
    """
    left = (
        forecasts.withColumn("target_time", F.col("target_datetime").cast("timestamp"))
        .withWatermark("target_time", lateness)
        .select("city", "target_time", "predicted_aqi")
        .alias("f")
    )
    right = (
        actuals.withColumn("event_time", F.col("datetime").cast("timestamp"))
        .withWatermark("event_time", lateness)
        .select("city", "event_time", F.col("aqi").alias("actual_aqi"))
        .alias("a")
    )
    joined = left.join(
        right,
        (F.col("f.city") == F.col("a.city")) & (F.col("f.target_time") == F.col("a.event_time")),
    )
    return joined.select("target_time", (F.col("predicted_aqi") - F.col("actual_aqi")).alias("error"))


def start_scoring(scored: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Adds up the errors per day in partial sums, a folder per micro-batch below ``path``.

    A pair is counted in the batch that completes it, so the newest days are there at once
    and no day is left waiting for a watermark. A replayed batch overwrites its own folder.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        parts = batch.groupBy(F.to_date("target_time").alias("day")).agg(
            F.count(F.lit(1)).alias("scored"), F.sum(F.abs("error")).alias("absolute_error")
        )
        parts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        scored.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def daily_scores(spark: SparkSession, path: str) -> DataFrame:
    """Number and mean absolute error of the forecasts of each day so far."""
    parts = spark.read.schema("day date, scored long, absolute_error double, batch long").parquet(path)
    total = F.sum("scored")
    return parts.groupBy("day").agg(total.alias("scored"), (F.sum("absolute_error") / total).alias("mae"))
