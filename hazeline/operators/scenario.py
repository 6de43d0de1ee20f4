"""Scenario scoring: change some inputs, predict again, compare."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.functions.index import category_name
from hazeline.operators.forecast import anchors, next_rows
from hazeline.operators.supervised import FEATURE_COLUMNS, TARGET_TIME_FEATURES

# Fixed value: gusts implied by a wind speed.
GUST_FACTOR = 1.4


def base_vectors(features: DataFrame, requests: DataFrame, as_of) -> DataFrame:
    """Model input for each requested ``(city, horizon)``.

    The target is the horizon-th future row, or the last one when the future is shorter.
    """
    furthest = requests.agg(F.max("horizon")).first()[0] or 1
    future = next_rows(features, as_of, furthest).select("city", "step", *TARGET_TIME_FEATURES)
    lengths = future.groupBy("city").agg(F.max("step").alias("_steps"))
    wanted = requests.select("city", "horizon").distinct().join(lengths, "city")
    wanted = wanted.select("city", "horizon", F.least(F.col("horizon"), F.col("_steps")).alias("step"))
    rows = wanted.join(future, ["city", "step"]).join(anchors(features, as_of), "city")
    return rows.select("city", *FEATURE_COLUMNS)


def overridden(feature: str) -> Column:
    """A model input after the scenario's settings; settings left null change nothing."""
    value = F.col(feature)
    speed = F.hypot("wind_u", "wind_v")
    scale = F.col("wind_speed") / F.when(speed == 0, F.lit(1.0)).otherwise(speed)
    setting = {
        "pm2_5_anchor": F.col("pm2_5"),
        "aqi_anchor": F.col("aqi_now"),
        "aqi_roll_mean_6h_anchor": F.col("aqi_now"),
        "aqi_roll_mean_24h_anchor": F.col("aqi_now"),
        "relative_humidity_2m": F.col("humidity"),
        "temperature_2m": F.col("temperature"),
        "apparent_temperature": F.col("temperature"),
        "wind_u": value * scale,
        "wind_v": value * scale,
        "wind_speed_10m": F.col("wind_speed"),
        "wind_gusts_10m": F.col("wind_speed") * GUST_FACTOR,
    }.get(feature)
    return value if setting is None else F.coalesce(setting, value)


def scenario_inputs(base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Each scenario's model input, next to its station and horizon."""
    joined = base.join(scenarios, ["city", "horizon"])
    return joined.select(
        "scenario_id", "city", *[overridden(c).alias(c) for c in FEATURE_COLUMNS]
    )


def simulate(base: DataFrame, scenarios: DataFrame, predict: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Baseline and scenario forecast and their difference.

    ``predict`` adds a ``prediction`` column (a fitted model's ``transform``).
    """
    baseline = predict(base).select("city", "horizon", F.col("prediction").alias("_base"))
    changed = predict(scenario_inputs(base, scenarios)).select(
        "scenario_id", "city", "horizon", F.col("prediction").alias("_scenario")
    )
    both = changed.join(baseline, ["city", "horizon"])

    def whole(x):
        return F.bround(x, 0).cast("int")

    return both.select(
        "scenario_id",
        "city",
        F.col("horizon").alias("horizon_h"),
        whole(F.col("_base")).alias("baseline_aqi"),
        category_name(F.col("_base")).alias("baseline_category"),
        whole(F.col("_scenario")).alias("scenario_aqi"),
        category_name(F.col("_scenario")).alias("scenario_category"),
        whole(F.col("_scenario") - F.col("_base")).alias("delta"),
    )


def setting_defaults(base: DataFrame) -> DataFrame:
    """The settings as they are now, to start a scenario from."""
    return base.select(
        "city",
        "horizon",
        F.bround("pm2_5_anchor", 1).alias("pm2_5"),
        F.bround("aqi_anchor", 0).alias("aqi_now"),
        F.bround(F.hypot("wind_u", "wind_v"), 1).alias("wind_speed"),
        F.bround("relative_humidity_2m", 0).alias("humidity"),
        F.bround("temperature_2m", 1).alias("temperature"),
    )
