"""Batch forecast: latest state, future hours, intervals, daily rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.clock import date_text, lead_hours
from hazeline.functions.index import category_name
from hazeline.operators.supervised import ANCHOR_STATE, FEATURE_COLUMNS, TARGET_TIME_FEATURES

# Forecast length, days of the rollup, index range.
HORIZON_HOURS = 72
DAYS = 3
INDEX_RANGE = (0.0, 500.0)


def as_time(as_of) -> Column:
    """``as_of`` (text, or a column such as a scalar subquery) as a naive hour."""
    time = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")
    return F.date_trunc("hour", time).cast("timestamp_ntz")


def anchors(features: DataFrame, as_of, columns=ANCHOR_STATE) -> DataFrame:
    """Per station the latest row up to ``as_of``; its first row when all lie later.

    A plain aggregate, so a long series is reduced before the shuffle.
    """
    time, now = F.col("datetime"), as_time(as_of)
    row = F.struct("datetime", *columns)
    latest = F.max_by(row, F.when(time <= now, time))
    picked = features.groupBy("city").agg(latest.alias("_latest"), F.min_by(row, time).alias("_first"))
    return picked.select("city", F.coalesce("_latest", "_first").alias("_row")).select(
        "city",
        F.col("_row.datetime").alias("anchor_datetime"),
        *[F.col(f"_row.{c}").alias(f"{c}_anchor") for c in columns],
    )


def next_rows(features: DataFrame, as_of, n: int = HORIZON_HOURS) -> DataFrame:
    """The first ``n`` rows after ``as_of`` of every station, numbered in ``step``.

    The rank limit is applied before the shuffle as well, so at most ``n`` rows of a
    station leave each task.
    """
    w = Window.partitionBy("city").orderBy("datetime")
    future = features.where(F.col("datetime") > as_time(as_of))
    return future.withColumn("step", F.row_number().over(w)).where(F.col("step") <= n)


def forecast_inputs(features: DataFrame, as_of, n: int = HORIZON_HOURS) -> DataFrame:
    """Model input for every future hour: its own conditions plus the station's latest state."""
    state = anchors(features, as_of)
    future = next_rows(features, as_of, n).select("city", "datetime", *TARGET_TIME_FEATURES)
    joined = future.join(state, "city")
    horizon = lead_hours(F.col("datetime"), as_time(as_of))
    return joined.withColumn("horizon", horizon).select("city", "datetime", *FEATURE_COLUMNS)


def stations_without_future(features: DataFrame, as_of) -> DataFrame:
    """Stations the forecast has to skip."""
    newest = features.groupBy("city").agg(F.max("datetime").alias("newest"))
    return newest.where(F.col("newest") <= as_time(as_of))


def nearest(horizon: Column, trained: Column) -> Column:
    """Closest value of an array; the smaller of two equally close ones."""
    by_distance = F.transform(
        trained, lambda t: F.struct(F.abs(t - horizon).alias("d"), t.alias("horizon"))
    )
    return F.array_min(by_distance)["horizon"]


def attach_intervals(scored: DataFrame, intervals: DataFrame) -> DataFrame:
    """Adds the residual bounds (``low``, ``high``) of the nearest trained lead time.

    ``intervals`` has one row per trained lead time.
    """
    trained = intervals.agg(F.sort_array(F.collect_set("horizon"))).scalar()
    bounds = intervals.select(F.col("horizon").alias("_nearest"), "low", "high")
    matched = scored.withColumn("_trained", trained).withColumn(
        "_nearest", nearest(F.col("horizon"), F.col("_trained"))
    )
    return matched.join(bounds, "_nearest").drop("_nearest", "_trained")


def interval_bounds(prediction: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """Lower end held at 0 and upper end at 500; the other sides stay as they are."""
    return F.greatest(F.lit(INDEX_RANGE[0]), prediction + low), F.least(F.lit(INDEX_RANGE[1]), prediction + high)


def hourly_forecast(scored: DataFrame, intervals: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Whole-number forecast with interval; the category is that of the unrounded value."""
    p = F.col(prediction)
    lower, upper = interval_bounds(p, F.col("low"), F.col("high"))
    return attach_intervals(scored, intervals).select(
        "city",
        "datetime",
        F.bround(p, 0).cast("int").alias("aqi"),
        F.bround(lower, 0).cast("int").alias("lower"),
        F.bround(upper, 0).cast("int").alias("upper"),
        category_name(p).alias("category"),
    )


def daily_rollup(hourly: DataFrame, days: int = DAYS) -> DataFrame:
    """Means of the rounded hourly values for the first calendar days of every station."""
    per_day = hourly.groupBy("city", date_text(F.col("datetime")).alias("date")).agg(
        F.avg("aqi").alias("_mean"), F.avg("lower").alias("_lower"), F.avg("upper").alias("_upper")
    )
    order = Window.partitionBy("city").orderBy("date")
    return (
        per_day.withColumn("_day", F.row_number().over(order))
        .where(F.col("_day") <= days)
        .select(
            "city",
            "date",
            F.bround("_mean", 0).cast("int").alias("aqi"),
            F.bround("_lower", 0).cast("int").alias("lower"),
            F.bround("_upper", 0).cast("int").alias("upper"),
            category_name(F.col("_mean")).alias("category"),
        )
    )


def current_index(inputs: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Current index per station: the latest state, else the first predicted hour."""
    first = F.min_by(F.struct("aqi_anchor", prediction), "datetime")
    value = F.coalesce("_row.aqi_anchor", f"_row.{prediction}")
    return (
        inputs.groupBy("city")
        .agg(first.alias("_row"))
        .select(
            "city",
            F.bround(value, 0).cast("int").alias("current_aqi"),
            category_name(value).alias("current_category"),
        )
    )
