"""Station panels derived from the given ``events`` table.

``readings``: one row per event. Five stations hold all rows, so every series is a
hot key and grows with the table. ``hourly``: the events of each station and hour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.functions.text import slug
from hazeline.operators.blocks import suggest_block_seconds
from hazeline.session import literal_table, materialize
from hazeline.sources.dims import attach_location

# name, latitude, longitude, province
STATIONS = (
    ("click", 31.5, 74.4, "Punjab"),
    ("error", 33.6, 73.0, "Punjab"),
    ("purchase", 24.9, 67.0, "Sindh"),
    ("signup", 34.0, 71.5, "Khyber Pakhtunkhwa"),
    ("view", 30.2, 67.0, "Balochistan"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def station_dim(spark: SparkSession) -> DataFrame:
    schema = T.StructType(
        [T.StructField(n, t()) for n, t in zip(("name", "latitude", "longitude", "province"), (T.StringType, T.DoubleType, T.DoubleType, T.StringType))]
    )
    return literal_table(spark, STATIONS, schema).withColumn("slug", slug(F.col("name")))


def derive_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select(
        "event_type", "ts", "value", "user_id", F.get_json_object("props", "$.k").cast("long").alias("k")
    )
    k, u = F.col("k"), F.col("user_id")
    rows = events.select(
        F.col("event_type").alias("city"),
        F.col("ts").alias("datetime"),
        F.when(k % 37 == 0, None).when(k % 41 == 0, -1.0).otherwise(F.col("value")).alias("pm2_5"),
        F.when(k % 43 == 0, None).otherwise(F.col("value") * F.lit(1.6)).alias("pm10"),
        (F.col("value") * F.lit(10.0)).alias("carbon_monoxide"),
        (k % 7 + 40).cast("double").alias("nitrogen_dioxide"),
        (u % 3 + 10).cast("double").alias("sulphur_dioxide"),
        (k % 11 + 60).cast("double").alias("ozone"),
        F.when(u % 4 == 0, None)
        .otherwise(F.least(F.lit(500.0), F.floor("value").cast("double") + 20.0))
        .alias("us_aqi"),
        (k % 30 + 10).cast("double").alias("temperature_2m"),
        (u % 80 + 20).cast("double").alias("relative_humidity_2m"),
        (k % 15).cast("double").alias("dew_point_2m"),
        (k % 30 + 9).cast("double").alias("apparent_temperature"),
        (u % 3).cast("double").alias("precipitation"),
        (u % 30 + 990).cast("double").alias("surface_pressure"),
        (k % 101).cast("double").alias("cloud_cover"),
        (k % 20).cast("double").alias("wind_speed_10m"),
        ((k * 7 + u) % 360).cast("double").alias("wind_direction_10m"),
        (k % 25).cast("double").alias("wind_gusts_10m"),
    )
    return _spread(attach_location(rows, station_dim(spark)))


def derive_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    hours = (
        events.groupBy(
            F.col("event_type").alias("city"),
            F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("datetime"),
        )
        .agg(
            F.min("value").alias("pm2_5"),
            F.max("value").alias("pm10"),
            F.count(F.lit(1)).alias("n"),
            F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"),
            F.sum("user_id").alias("u"),
        )
    )
    n, k, u = F.col("n"), F.col("k"), F.col("u")
    rows = hours.select(
        "city",
        "datetime",
        "pm2_5",
        "pm10",
        (F.col("pm10") * 10.0).alias("carbon_monoxide"),
        (k % 7 + 40).cast("double").alias("nitrogen_dioxide"),
        (u % 3 + 10).cast("double").alias("sulphur_dioxide"),
        (k % 11 + 60).cast("double").alias("ozone"),
        F.when(n % 4 == 0, None)
        .otherwise(F.least(F.lit(500.0), F.floor("pm10").cast("double") + 20.0))
        .alias("us_aqi"),
        (k % 30 + 10).cast("double").alias("temperature_2m"),
        (u % 80 + 20).cast("double").alias("relative_humidity_2m"),
        (k % 15).cast("double").alias("dew_point_2m"),
        (k % 30 + 9).cast("double").alias("apparent_temperature"),
        (n % 3).cast("double").alias("precipitation"),
        (u % 30 + 990).cast("double").alias("surface_pressure"),
        (k % 101).cast("double").alias("cloud_cover"),
        (n + k % 20).cast("double").alias("wind_speed_10m"),
        ((k * 7) % 360).cast("double").alias("wind_direction_10m"),
        (n + k % 25).cast("double").alias("wind_gusts_10m"),
    )
    return _spread(attach_location(rows, station_dim(spark)))


# Rows of one file of a stored panel.
FILE_ROWS = 500_000
_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored_once(spark: SparkSession, sf_dir: str, derive) -> DataFrame:
    """``derive(spark, sf_dir)`` as a stored table, written once per session, in files of bounded rows."""
    at = (spark.sparkContext.applicationId, sf_dir, derive.__name__)
    if at not in _stored:
        _stored[at] = materialize(derive(spark, sf_dir), derive.__name__, FILE_ROWS)
    return _stored[at]


def _spread(panel: DataFrame) -> DataFrame:
    """A single small input file is spread, so that scans of the stored panel run in parallel."""
    cores = panel.sparkSession.sparkContext.defaultParallelism
    return panel.repartition(cores) if panel.rdd.getNumPartitions() < cores else panel


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_once(spark, sf_dir, derive_readings)


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_once(spark, sf_dir, derive_hourly)


def untargeted(hour: str = "datetime"):
    """Hours without any index: every 9th by day and hour."""
    return (F.dayofmonth(hour) * 5 + F.hour(hour)) % 9 == 0


def hourly_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``hourly`` where the vendor index and both particle readings are missing at times."""
    none = {c: F.when(~untargeted(), F.col(c)) for c in ("us_aqi", "pm2_5", "pm10")}
    return hourly(spark, sf_dir).withColumns(none)


_block_cache: dict[tuple[str, str], int] = {}


def block_seconds(spark: SparkSession, sf_dir: str) -> int:
    """Block length for ``readings``, from the density of the events table (one small job per table)."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _block_cache:
        events = table(spark, sf_dir, "events").select("event_type", "ts")
        _block_cache[at] = suggest_block_seconds(events, "event_type", "ts")
    return _block_cache[at]
