"""Forecast error measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.operators.quantiles import quantiles


def rmse(actual: Column, predicted: Column) -> Column:
    error = actual - predicted
    return F.sqrt(F.avg(error * error))


def mae(actual: Column, predicted: Column) -> Column:
    return F.avg(F.abs(actual - predicted))


def r2(actual: Column, predicted: Column) -> Column:
    """1 - residual / total sum of squares; 1 or 0 when the target is constant."""
    error = actual - predicted
    residual, total = F.sum(error * error), F.var_pop(actual) * F.count(actual)
    return F.when(total > 0, 1 - residual / total).otherwise(F.when(residual == 0, 1.0).otherwise(0.0))


def error_columns(actual: str, predicted: str) -> list[Column]:
    a, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    return [rmse(a, p).alias("rmse"), mae(a, p).alias("mae"), r2(a, p).alias("r2")]


def error_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*error_columns(actual, predicted))


def horizon_metrics(scored: DataFrame, actual: str = "y_aqi", predicted: str = "prediction") -> DataFrame:
    """Model and persistence error for every lead time."""
    baseline = rmse(F.col(actual), F.col("aqi_anchor")).alias("baseline_rmse")
    return (
        scored.groupBy(F.col("horizon").alias("horizon_h"))
        .agg(*error_columns(actual, predicted), baseline)
        .orderBy("horizon_h")
    )


# Residual quantiles that bound a forecast interval.
INTERVAL_FRACTIONS = (0.1, 0.9)


def residual_intervals(scored: DataFrame, actual: str = "y_aqi", predicted: str = "prediction") -> DataFrame:
    """Low and high residual quantile for every lead time."""
    residual = F.col(actual) - F.col(predicted)
    return quantiles(scored, ["horizon"], residual, INTERVAL_FRACTIONS).select(
        "horizon", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")
    )


def fold_summary(folds: DataFrame) -> DataFrame:
    """Mean and sample deviation of the fold errors."""
    return folds.agg(F.avg("rmse").alias("mean_rmse"), F.stddev_samp("rmse").alias("sd_rmse"))
