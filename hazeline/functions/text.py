"""Names, labels and sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model feature -> reader-facing label.
FEATURE_LABELS = {
    "aqi_anchor": "current AQI",
    "pm2_5_anchor": "current PM2.5",
    "pm10_anchor": "current PM10",
    "aqi_roll_mean_24h_anchor": "24h AQI trend",
    "aqi_roll_mean_6h_anchor": "6h AQI trend",
    "aqi_roll_std_24h_anchor": "recent AQI volatility",
    "hour_sin": "time of day",
    "hour_cos": "time of day",
    "month_sin": "season",
    "month_cos": "season",
    "dow_sin": "day of week",
    "dow_cos": "day of week",
    "is_weekend": "weekend",
    "wind_u": "wind (E–W)",
    "wind_v": "wind (N–S)",
    "wind_speed_10m": "wind speed",
    "wind_gusts_10m": "wind gusts",
    "temperature_2m": "temperature",
    "relative_humidity_2m": "humidity",
    "dew_point_2m": "dew point",
    "apparent_temperature": "feels-like temp",
    "precipitation": "rain",
    "surface_pressure": "air pressure",
    "cloud_cover": "cloud cover",
    "latitude": "location (lat)",
    "longitude": "location (lon)",
    "horizon": "lead time",
}


def slug(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def same_name(left: Column, right: Column) -> Column:
    return F.lower(left) == F.lower(right)


def feature_label(feature: Column) -> Column:
    pairs = [F.lit(x) for item in FEATURE_LABELS.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[feature], F.replace(feature, F.lit("_"), F.lit(" ")))


def signed_part(label: Column, impact: Column) -> Column:
    """``label +3.1`` or ``label −3.1``."""
    sign = F.when(impact >= 0, F.lit("+")).otherwise(F.lit("−"))
    return F.concat(label, F.lit(" "), sign, F.abs(impact).cast("string"))


def driver_sentence(prediction: Column, base: Column, contributors: Column) -> Column:
    """Sentence over an array of ``struct<label, impact>``."""
    parts = F.transform(contributors, lambda c: signed_part(c["label"], c["impact"]))
    return F.concat(
        F.lit("Forecast AQI ≈ "),
        F.bround(prediction, 0).cast("long").cast("string"),
        F.lit(" (baseline "),
        F.bround(base, 0).cast("long").cast("string"),
        F.lit("). Main drivers: "),
        F.array_join(parts, ", "),
        F.lit("."),
    )


def relative_impact(impact: Column, largest: Column) -> Column:
    """Bar length of an impact against the largest one, never scaled up."""
    return F.abs(impact) / F.greatest(largest, F.lit(1.0))
