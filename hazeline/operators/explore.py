"""Descriptive tables over the feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.clock import date_text, month_name

# Weather variables compared with the index.
CORRELATES = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "precipitation",
    "surface_pressure",
    "cloud_cover",
    "wind_speed_10m",
)
HISTOGRAM_BINS = 60


def mean_by(features: DataFrame, group, name: str) -> DataFrame:
    return features.groupBy(group.alias(name)).agg(F.avg("aqi").alias("mean_aqi"))


def city_ranking(features: DataFrame) -> DataFrame:
    """Mean index per station, worst first; stations with equal means by name."""
    return mean_by(features, F.col("city"), "city").orderBy(F.desc("mean_aqi"), "city")


def monthly_profile(features: DataFrame) -> DataFrame:
    return mean_by(features, F.month("datetime"), "month").orderBy("month")


def diurnal_profile(features: DataFrame) -> DataFrame:
    return mean_by(features, F.hour("datetime"), "hour").orderBy("hour")


def dataset_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct("city").alias("n_cities"),
        date_text(F.min("datetime")).alias("date_min"),
        date_text(F.max("datetime")).alias("date_max"),
    )


def weather_correlation(features: DataFrame) -> DataFrame:
    """Pearson r of the index with each weather variable, over rows that have both."""
    columns = [c for c in CORRELATES if c in features.columns]
    wide = features.agg(*[F.corr("aqi", c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in columns])
    return wide.select(F.inline(pairs))


def strongest_correlate(features: DataFrame) -> DataFrame:
    return weather_correlation(features).where(F.col("r").isNotNull()).orderBy(F.desc(F.abs("r")), "feature").limit(1)


def findings(features: DataFrame) -> DataFrame:
    """One row: size, worst and cleanest station, worst month, strongest weather driver.

    Stations and months are averaged first; the picks are aggregates over those rows.
    """
    cities = mean_by(features, F.col("city"), "city").where(F.col("mean_aqi").isNotNull())
    months = mean_by(features, F.month("datetime"), "month").where(F.col("mean_aqi").isNotNull())
    # equal means: the ranking is by name, so the last name counts as the cleanest
    picks = cities.agg(
        F.bround(F.max("mean_aqi"), 1).alias("worst_city_mean"),
        F.max(F.struct(-F.col("mean_aqi"), "city"))["city"].alias("cleanest_city"),
        F.bround(F.min("mean_aqi"), 1).alias("cleanest_city_mean"),
        F.min(F.struct(-F.col("mean_aqi"), "city"))["city"].alias("worst_city"),
    )
    month = months.agg(F.min(F.struct(-F.col("mean_aqi"), "month"))["month"].alias("worst_month"))
    driver = strongest_correlate(features).select(
        F.col("feature").alias("strongest_feature"), F.bround("r", 2).alias("strongest_r")
    )
    out = dataset_summary(features)
    # each part has exactly one row: read them as scalar subqueries
    for part in (picks, month, driver):
        out = out.withColumns({c: part.select(c).scalar() for c in part.columns})
    return out


def aqi_histogram(features: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bin counts between the smallest and the largest value; empty bins count 0."""
    values = features.select("aqi").where(F.col("aqi").isNotNull())
    low, high = values.agg(F.min("aqi"), F.max("aqi")).first()
    if low is None:
        low = high = 0.0
    if low == high:
        # a single value still gets a unit-wide range around it
        low, high = low - 0.5, high + 0.5
    lo, width = F.lit(float(low)), F.lit((high - low) / bins)
    x = F.col("aqi")
    guess = F.floor((x - lo) / width)
    # division may land one bin off at an edge: the edges decide
    at = guess - (x < lo + guess * width).cast("int") + (x >= lo + (guess + 1) * width).cast("int")
    filled = values.groupBy(F.least(F.lit(bins), at + 1).cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("hours")
    )
    every = features.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(filled, "bin", "left").select(
        "bin",
        (lo + (F.col("bin") - 1) * width).alias("bin_low"),
        F.coalesce("hours", F.lit(0)).alias("hours"),
    )


def history_summary(features: DataFrame) -> DataFrame:
    """Per station: mean, record, worst and cleanest month, hours of data.

    Months are summed first, so a station reaches the second step as at most 12 rows.
    """
    monthly = features.groupBy("city", F.month("datetime").alias("month")).agg(
        F.sum("aqi").alias("_sum"),
        F.count("aqi").alias("_n"),
        F.max("aqi").alias("_max"),
        F.count(F.lit(1)).alias("_hours"),
        F.avg("aqi").alias("_mean"),
    )
    has_mean = F.col("_mean").isNotNull()
    # equal means: the earlier month
    worst = F.max_by("month", F.when(has_mean, F.struct("_mean", (-F.col("month")).alias("m"))))
    clean = F.min_by("month", F.when(has_mean, F.struct("_mean", "month")))
    return monthly.groupBy("city").agg(
        F.bround(F.sum("_sum") / F.sum("_n"), 1).alias("mean_aqi"),
        F.bround(F.max("_max"), 0).cast("int").alias("max_aqi_on_record"),
        month_name(worst).alias("worst_month"),
        month_name(clean).alias("cleanest_month"),
        F.sum("_hours").alias("hours_of_data"),
    )
