"""Read side: what a client asks of the stored tables, each answer a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.functions.index import category_name
from hazeline.functions.text import same_name
from hazeline.operators.drift import drift_report
from hazeline.operators.explore import history_summary
from hazeline.operators.scoring import error_report
from hazeline.session import literal_table


def list_cities(dim: DataFrame) -> DataFrame:
    return dim.select("name", "province", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))


def _requested(spark, names) -> DataFrame:
    return literal_table(spark, [(n,) for n in names], T.StructType([T.StructField("city", T.StringType())]))


def peak_summary(documents: DataFrame) -> DataFrame:
    """Per station: current state, daily forecast, peak of the next days (current if there are no hours)."""
    highest = F.array_max(F.transform("hourly", lambda h: h["aqi"]))
    peak = F.coalesce(highest, F.col("current.aqi"))
    return documents.select(
        "city",
        "province",
        F.col("current.aqi").alias("current_aqi"),
        F.col("current.category").alias("current_category"),
        F.col("daily").alias("daily_forecast"),
        peak.alias("peak_aqi_next_3_days"),
        category_name(peak).alias("peak_category"),
        "alert",
    )


def get_forecast(documents: DataFrame, names: list[str]) -> DataFrame:
    """Forecast summaries of the named stations; an unknown name gets an ``error``."""
    asked = _requested(documents.sparkSession, names)
    found = asked.join(peak_summary(documents), "city", "left")
    missing = F.when(F.col("current_category").isNull(), F.concat(F.lit("No forecast for "), "city"))
    return found.withColumn("error", missing)


def get_explanation(documents: DataFrame, names: list[str]) -> DataFrame:
    asked = _requested(documents.sparkSession, names)
    found = asked.join(documents.select("city", "explanation"), "city", "left")
    missing = F.when(F.col("explanation").isNull(), F.lit("No explanation available"))
    return found.select(
        "city",
        F.col("explanation.text").alias("explanation"),
        F.col("explanation.contributors").alias("top_drivers"),
        F.col("explanation.for_time").alias("for_time"),
        missing.alias("error"),
    )


def get_history(features: DataFrame, names: list[str]) -> DataFrame:
    """History of the named stations; the filter reaches the scan."""
    wanted = features.where(F.col("city").isin(names))
    found = _requested(features.sparkSession, names).join(history_summary(wanted), "city", "left")
    return found.withColumn("error", F.when(F.col("hours_of_data").isNull(), F.concat(F.lit("No history for "), "city")))


def predictions_for(documents: DataFrame, name: str) -> DataFrame:
    """The whole document of one station, by case-insensitive name."""
    return documents.where(same_name(F.col("city"), F.lit(name)))


def monitoring(features: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    return {"drift": drift_report(features), "forecast_error": error_report(log, features)}
