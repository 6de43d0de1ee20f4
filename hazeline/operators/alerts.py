"""Hazard alerts over hourly forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.clock import epoch_micros
from hazeline.functions.index import category_advice, category_name

# Alert limits; both are inclusive.
WARNING_FROM = 150
DANGER_FROM = 200


def severity(peak: Column) -> Column:
    return F.when(peak >= DANGER_FROM, "danger").when(peak >= WARNING_FROM, "warning").otherwise("none")


def forecast_alerts(hourly: DataFrame) -> DataFrame:
    """One alert per station: peak, when it first comes, severity, advice, first exceedance."""
    aqi, time = F.col("aqi"), F.col("datetime")
    earliest_peak = F.max_by(time, F.when(aqi.isNotNull(), F.struct(aqi, (-epoch_micros(time)).alias("t"))))
    peaks = hourly.groupBy("city").agg(
        F.max(aqi).alias("_peak"),
        earliest_peak.alias("peak_time"),
        F.min(F.when(aqi >= WARNING_FROM, time)).alias("first_exceed_time"),
    )
    peak = F.col("_peak")
    return peaks.where(peak.isNotNull()).select(
        "city",
        severity(peak).alias("severity"),
        F.bround(peak, 0).cast("int").alias("peak_aqi"),
        "peak_time",
        category_name(peak).alias("category"),
        category_advice(peak).alias("advice"),
        "first_exceed_time",
    )
