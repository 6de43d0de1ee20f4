"""Declared schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = "city"
TIME = "datetime"

# Vendor variable names, in request order.
AIR_QUALITY_VARS = (
    "pm2_5",
    "pm10",
    "carbon_monoxide",
    "nitrogen_dioxide",
    "sulphur_dioxide",
    "ozone",
    "us_aqi",
)
WEATHER_VARS = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "apparent_temperature",
    "precipitation",
    "surface_pressure",
    "cloud_cover",
    "wind_speed_10m",
    "wind_direction_10m",
    "wind_gusts_10m",
)

PRIMARY_KEY = ("city", "timestamp")


def _doubles(names):
    return [T.StructField(n, T.DoubleType()) for n in names]


RAW_HOURLY = T.StructType(
    [T.StructField("datetime", T.TimestampNTZType()), T.StructField("city", T.StringType())]
    + _doubles(AIR_QUALITY_VARS)
    + _doubles(WEATHER_VARS)
    + _doubles(("latitude", "longitude"))
)

CITY_DIM = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("latitude", T.DoubleType(), False),
        T.StructField("longitude", T.DoubleType(), False),
        T.StructField("province", T.StringType(), False),
        T.StructField("timezone", T.StringType(), False),
    ]
)

CATEGORY_DIM = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("lo", T.IntegerType(), False),
        T.StructField("hi", T.IntegerType(), False),
        T.StructField("emoji", T.StringType(), False),
        T.StructField("color", T.StringType(), False),
        T.StructField("advice", T.StringType(), False),
    ]
)

BREAKPOINT_DIM = T.StructType(
    [
        T.StructField("pollutant", T.StringType(), False),
        T.StructField("c_lo", T.DoubleType(), False),
        T.StructField("c_hi", T.DoubleType(), False),
        T.StructField("i_lo", T.DoubleType(), False),
        T.StructField("i_hi", T.DoubleType(), False),
    ]
)


def payload_schema(variables) -> T.StructType:
    """One landed vendor document: parallel hourly arrays, routing tags and the order of loading."""
    hourly = T.StructType(
        [T.StructField("time", T.ArrayType(T.StringType()))]
        + [T.StructField(v, T.ArrayType(T.DoubleType())) for v in variables]
    )
    return T.StructType(
        [
            T.StructField("city", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("seq", T.LongType()),
            T.StructField("hourly", hourly),
        ]
    )


FORECAST_LOG = T.StructType(
    [
        T.StructField("generated_at", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("target_datetime", T.TimestampNTZType()),
        T.StructField("predicted_aqi", T.IntegerType()),
        T.StructField("batch", T.LongType()),
    ]
)

METRICS = T.StructType(_doubles(("rmse", "mae", "r2")))

LEADERBOARD = T.StructType(
    [
        T.StructField("version", T.IntegerType()),
        T.StructField("trained_at", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("rmse", T.DoubleType()),
        T.StructField("mae", T.DoubleType()),
        T.StructField("r2", T.DoubleType()),
        T.StructField("n_train", T.LongType()),
        T.StructField("n_valid", T.LongType()),
        T.StructField("candidates", T.MapType(T.StringType(), METRICS)),
        T.StructField("promoted", T.BooleanType()),
        T.StructField("prev_champion_rmse", T.DoubleType()),
    ]
)

SCENARIO = T.StructType(
    [
        T.StructField("scenario_id", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("horizon", T.IntegerType()),
    ]
    + _doubles(("pm2_5", "aqi_now", "wind_speed", "humidity", "temperature"))
)
