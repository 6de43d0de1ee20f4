"""Error by lead time and the expanding backtest."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.operators import boosting, models
from hazeline.operators.blocks import suggest_block_seconds
from hazeline.operators.folds import assign_folds, fold_report
from hazeline.operators.metrics import fold_summary, horizon_metrics
from hazeline.operators.normal import expanding_ridge
from hazeline.operators.sampling import exact_samples_before
from hazeline.operators.supervised import FEATURE_COLUMNS, HORIZONS, make_supervised, time_split
from hazeline.plans.training import FIT_ROWS, fitting_rows, use_checkpoints
from hazeline.session import materialize
from hazeline.sources.bundle import ModelBundle

N_SPLITS = 5
# What a fold report reads besides the prediction.
REPORTED = ["fold", "datetime", "y_aqi"]


def backtest_model(_train: DataFrame) -> boosting.HistogramBoosting:
    return boosting.HistogramBoosting(rounds=models.BACKTEST_ROUNDS)


def walk_forward(
    rows: DataFrame, n_splits: int = N_SPLITS, pipeline: Callable[[DataFrame], Pipeline] = backtest_model, fit_rows: int | None = FIT_ROWS
) -> DataFrame:
    """One model per fold, trained on earlier rows only. ``rows`` should be a stored table.

    ``pipeline`` builds the model from a fold's training rows, so nothing it takes from them
    can come from the future. ``fit_rows`` bounds the rows of a fit; all test rows are scored.
    """
    use_checkpoints(rows.sparkSession)
    folded = assign_folds(rows, n_splits)
    columns = ["fold", "datetime", "y_aqi", "prediction"]
    scored = [folded.where(F.col("fold") == 0).withColumn("prediction", F.lit(None).cast("double")).select(*columns)]
    for i in range(1, n_splits + 1):
        train = fitting_rows(folded.where(F.col("fold") < i), fit_rows)
        fitted = models.fit_candidates(train, {"fold": pipeline(train)})["fold"]
        scored.append(fitted.predict(folded.where(F.col("fold") == i)).select(*columns))
    return fold_report(reduce(DataFrame.unionByName, scored), n_splits)


def walk_forward_boosted(
    rows: DataFrame, n_splits: int = N_SPLITS, fit_rows: int | None = None, features=FEATURE_COLUMNS, settings: boosting.Settings | None = None
) -> DataFrame:
    """The expanding backtest of a boosted ensemble: the folds are fitted side by side on all their rows (at most ``fit_rows`` if given), all test rows scored in one scan."""
    settings = settings or boosting.Settings(rounds=models.BACKTEST_ROUNDS)
    folded = assign_folds(rows, n_splits)
    samples = exact_samples_before(folded, "fold", n_splits, fit_rows, ["city", "datetime", "horizon"])
    fitted = boosting.fit_groups(samples, "_fit", n_splits, features, settings=settings)
    return fold_report(boosting.predict_groups(folded, "fold", fitted, REPORTED), n_splits)


def walk_forward_ridge(rows: DataFrame, n_splits: int = N_SPLITS, features=FEATURE_COLUMNS, alpha: float = models.RIDGE_ALPHA) -> DataFrame:
    """The expanding backtest of a ridge: all folds are fitted on all their rows from one scan."""
    folded = assign_folds(rows, n_splits)
    return fold_report(expanding_ridge(folded, n_splits, features, alpha=alpha, keep=REPORTED), n_splits)


def evaluate(
    features: DataFrame,
    bundle: ModelBundle,
    *,
    n_splits: int = N_SPLITS,
    pipeline: Callable[[DataFrame], Pipeline] | None = None,
    block_seconds: int | None = None,
) -> dict[str, DataFrame]:
    """Tables of the evaluation report over all rows: ``per_horizon``, ``walk_forward``, ``summary``.

    The backtest is that of the boosted ensemble, or of ``pipeline``.
    """
    seconds = block_seconds or suggest_block_seconds(features)
    rows = materialize(make_supervised(features, horizons=HORIZONS, block_seconds=seconds), "evaluation")
    _, valid = time_split(rows)
    folds = materialize(walk_forward(rows, n_splits, pipeline) if pipeline else walk_forward_boosted(rows, n_splits), "folds")
    return {
        "per_horizon": horizon_metrics(bundle.predict(valid)),
        "walk_forward": folds.orderBy("fold"),
        "summary": fold_summary(folds),
    }


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").json(f"{path}/{name}")
