"""Daily forecast of every station, as one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.functions.clock import iso_text
from hazeline.operators.alerts import forecast_alerts
from hazeline.operators.blocks import suggest_block_seconds
from hazeline.operators.attribution import explain, linear_attribution, tree_attribution
from hazeline.operators.boosting import Boosted
from hazeline.operators.features import build_features
from hazeline.operators.forecast import (
    HORIZON_HOURS,
    current_index,
    daily_rollup,
    forecast_inputs,
    hourly_forecast,
)
from hazeline.operators.forests import Forest
from hazeline.operators.scoring import append_log, flatten_documents
from hazeline.session import literal_table, materialize
from hazeline.sources.bundle import ModelBundle


def score_hours(features: DataFrame, bundle: ModelBundle, as_of, hours: int = HORIZON_HOURS) -> DataFrame:
    """Model input and prediction for the next hours of every station.

    ``features`` holds observed rows and rows with forecast weather; a place that is
    not a known station is one more value of ``city``.
    """
    return bundle.predict(forecast_inputs(features, as_of, hours))


def attribute(rows: DataFrame, bundle: ModelBundle) -> DataFrame:
    if isinstance(bundle.model, Boosted | Forest) or hasattr(bundle.model.stages[-1], "trees"):
        return tree_attribution(rows, bundle.model, bundle.feature_columns)
    return linear_attribution(rows, bundle.model, bundle.feature_columns)


def peak_hours(scored: DataFrame) -> DataFrame:
    """The hour with the highest prediction of every station; the first of equal ones."""
    w = Window.partitionBy("city").orderBy(F.desc("prediction"), "datetime")
    return scored.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def explanations(scored: DataFrame, bundle: ModelBundle) -> DataFrame:
    """Why each station's peak is as high as it is."""
    explained = explain(attribute(peak_hours(scored), bundle), bundle.feature_columns)
    return explained.select(
        "city",
        F.struct(
            F.bround("explained", 0).cast("int").alias("prediction"),
            F.bround("base", 1).alias("base_value"),
            "contributors",
            "text",
            iso_text(F.col("datetime")).alias("for_time"),
        ).alias("explanation"),
    )


def forecast_documents(
    scored: DataFrame, intervals: DataFrame, dim: DataFrame, generated_at: str, explained: DataFrame | None = None
) -> DataFrame:
    """One nested row per station: place, current index, hours, days, alert, explanation.

    A station has at most 72 hours here, so collecting them is bounded.
    """
    hourly = hourly_forecast(scored, intervals)
    hours = hourly.groupBy("city").agg(
        F.sort_array(F.collect_list(F.struct("datetime", "aqi", "lower", "upper", "category"))).alias("hourly")
    )
    days = daily_rollup(hourly).groupBy("city").agg(
        F.sort_array(F.collect_list(F.struct("date", "aqi", "lower", "upper", "category"))).alias("daily")
    )
    current = current_index(scored).select(
        "city", F.struct(F.col("current_aqi").alias("aqi"), F.col("current_category").alias("category")).alias("current")
    )
    alerts = forecast_alerts(hourly)
    alert = alerts.select("city", F.struct(*alerts.columns).alias("alert"))
    place = dim.select(F.col("name").alias("city"), "province", F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    out = hours.join(days, "city").join(current, "city").join(alert, "city").join(place, "city", "left")
    if explained is not None:
        out = out.join(explained, "city", "left")
    return out.withColumn("generated_at", F.lit(generated_at))


def place_features(rows: DataFrame, name: str, latitude: float, longitude: float, block_seconds: int | None = None) -> DataFrame:
    """Features of hourly rows of any place, under its own name and coordinates.

    ``rows`` are hours of one place (columns of the raw hourly schema; the last hours may
    hold forecast weather alone). The place need not be a known station.
    """
    placed = rows.withColumns({"city": F.lit(name), "latitude": F.lit(float(latitude)), "longitude": F.lit(float(longitude))})
    return build_features(placed, dropna_target=False, block_seconds=block_seconds or suggest_block_seconds(placed))


def forecast_place(
    rows: DataFrame, name: str, latitude: float, longitude: float, predict: Callable[[DataFrame], DataFrame], intervals: DataFrame, *, as_of, generated_at: str
) -> DataFrame:
    """The forecast document of any place; ``predict`` adds a ``prediction`` (a bundle's ``predict``)."""
    features = place_features(rows, name, latitude, longitude)
    scored = materialize(predict(forecast_inputs(features, as_of, HORIZON_HOURS)), "scored")
    place = literal_table(
        rows.sparkSession,
        [(name, float(latitude), float(longitude), None)],
        T.StructType([T.StructField("name", T.StringType()), T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()), T.StructField("province", T.StringType())]),
    )
    return forecast_documents(scored, intervals, place, generated_at)


def run_inference(
    features: DataFrame, bundle: ModelBundle, dim: DataFrame, *, as_of, generated_at: str, path: str, log_path: str, batch: int
) -> DataFrame:
    """Writes the forecast documents and logs their hours. Returns the stored documents."""
    scored = materialize(score_hours(features, bundle, as_of), "scored")
    documents = forecast_documents(scored, bundle.intervals, dim, generated_at, explanations(scored, bundle))
    documents.write.mode("overwrite").parquet(path)
    stored = features.sparkSession.read.parquet(path)
    append_log(flatten_documents(stored), log_path, batch)
    return stored


def write_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)
