"""Forecast log and its error once the actual values arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline import schemas
from hazeline.operators.dedupe import keep_last

LOG_KEY = ["generated_at", "city", "target_datetime"]
TOP_MISSES = 5


def flatten_documents(documents: DataFrame) -> DataFrame:
    """Forecast documents (one per station, nested hours) -> log rows."""
    hours = documents.select("generated_at", "city", F.inline("hourly"))
    return hours.select(
        "generated_at",
        "city",
        F.col("datetime").cast("timestamp_ntz").alias("target_datetime"),
        F.col("aqi").cast("int").alias("predicted_aqi"),
    )


def append_log(rows: DataFrame, path: str, batch: int) -> None:
    """Adds one run. Runs are appended as they come; ``read_log`` settles repeated keys."""
    rows.select(*LOG_KEY, "predicted_aqi").withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(path)


def latest_log(rows: DataFrame) -> DataFrame:
    return keep_last(rows, LOG_KEY, ["batch", "predicted_aqi"]).drop("batch")


def read_log(spark, path: str) -> DataFrame:
    return latest_log(spark.read.schema(schemas.FORECAST_LOG).parquet(path))


def score_forecasts(log: DataFrame, features: DataFrame) -> DataFrame:
    """Logged forecasts that have an actual value, with their error."""
    actual = features.select(
        "city", F.col("datetime").alias("target_datetime"), F.col("aqi").alias("actual_aqi")
    )
    joined = log.join(actual, ["city", "target_datetime"])
    return joined.withColumn("error", F.col("predicted_aqi") - F.col("actual_aqi"))


def biggest_misses(scored: DataFrame, k: int = TOP_MISSES) -> DataFrame:
    """Largest absolute errors; values are cut to whole numbers, not rounded."""
    ranked = scored.where(F.col("error").isNotNull()).orderBy(
        F.desc(F.abs("error")), "city", "target_datetime", "generated_at"
    )
    return ranked.limit(k).select(
        "city",
        F.col("target_datetime").alias("when"),
        F.col("predicted_aqi").cast("int").alias("predicted"),
        F.col("actual_aqi").cast("int").alias("actual"),
        F.col("error").cast("int").alias("error"),
    )


def error_report(log: DataFrame, features: DataFrame) -> DataFrame:
    """One row: status, scored points, errors and the biggest misses."""
    scored = score_forecasts(log, features)
    error = F.col("error")
    report = scored.agg(
        F.count(F.lit(1)).alias("scored_points"),
        F.bround(F.avg(F.abs(error)), 2).alias("mae"),
        F.bround(F.sqrt(F.avg(error * error)), 2).alias("rmse"),
    )
    misses = biggest_misses(scored).agg(
        F.sort_array(
            F.collect_list(F.struct(F.abs("error").alias("size"), "city", "when", "predicted", "actual", "error")),
            asc=False,
        )
    )
    status = F.when(F.col("scored_points") > 0, "ok").otherwise("waiting for actuals")
    return report.select(status.alias("status"), "*", misses.scalar().alias("biggest_misses"))
