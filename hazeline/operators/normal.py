"""Ridge by additive normal equations: one scan of the rows, however many fits.

Counts, sums and cross products add up over tasks, groups and time, so one table of them
per group gives every model whose training rows are a union of groups, such as the
expanding folds of a backtest.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.operators.boosting import scored
from hazeline.operators.supervised import FEATURE_COLUMNS, TARGET


def cross_sums(rows: DataFrame, features=FEATURE_COLUMNS, label: str = TARGET, group: Column | None = None) -> dict[int, np.ndarray]:
    """Per group (0 without one) the sums of all products of two of: inputs, their presence, the label and 1.

    A missing input counts as 0 with presence 0; rows without a label are left out. Each
    task adds up its rows and sends one vector a group; vectors are added on the way.
    """
    names = list(features)
    inputs = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in names]
    picked = rows.where(F.col(label).isNotNull()).select((F.lit(0) if group is None else group).cast("int").alias("_group"), *inputs, F.col(label).cast("double").alias("_label"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            groups = batch.column("_group").to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names]).astype(float)
            there = ~np.isnan(x)
            y = batch.column("_label").to_numpy(zero_copy_only=False)
            z = np.column_stack([np.where(there, x, 0.0), there, y, np.ones(len(y))])
            for g in np.unique(groups).tolist():
                own = z[groups == g]
                sums[g] = sums.get(g, 0.0) + own.T @ own
        upper = np.triu_indices(2 * len(names) + 2)
        yield pa.RecordBatch.from_pydict({"g": pa.array(list(sums), pa.int32()), "v": pa.array([m[upper].tolist() for m in sums.values()], pa.list_(pa.float64()))})

    parts = picked.mapInArrow(add, "g int, v array<double>")
    added = parts.groupBy("g").agg(Summarizer.sum(array_to_vector("v")).alias("v")).collect()
    size = 2 * len(names) + 2
    out = {}
    for row in added:
        whole = np.zeros((size, size))
        whole[np.triu_indices(size)] = row["v"].toArray()
        out[row["g"]] = whole + np.triu(whole, 1).T
    return out


@dataclass(frozen=True)
class LinearFit:
    """Prediction = intercept + sum of weight times distance from the mean; a missing input adds nothing."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def predict(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("prediction", choose_prediction([self], F.lit(0)))


def solve_ridge(sums: np.ndarray, features=FEATURE_COLUMNS, alpha: float = 1.0) -> LinearFit:
    """Ridge with a penalty of ``alpha * |w|²`` on the summed squared error, from ``cross_sums``.

    Missing inputs are filled with the mean of the others and inputs scaled by their population
    deviation; an input that does not vary gets weight 0.
    """
    d = len(features)
    values, there = slice(0, d), slice(d, 2 * d)
    y, one = 2 * d, 2 * d + 1
    n = sums[one, one]
    counts = sums[there, one]
    means = np.divide(sums[values, one], counts, out=np.zeros(d), where=counts > 0)
    middle = sums[y, one] / n
    centred = sums[values, values] - sums[values, there] * means - means[:, None] * sums[there, values] + np.outer(means, means) * sums[there, there]
    toward = sums[values, y] - means * sums[there, y]
    scale = np.sqrt(np.maximum(np.diag(centred), 0) / n)
    # what cancellation leaves of a constant input is no deviation
    live = scale > 1e-7 * np.maximum(np.abs(means), 1e-300)
    weights = np.zeros(d)
    if live.any():
        s = scale[live]
        weights[live] = np.linalg.solve(centred[np.ix_(live, live)] / np.outer(s, s) + alpha * np.eye(len(s)), toward[live] / s) / s
    return LinearFit(tuple(features), tuple(means.tolist()), tuple(weights.tolist()), float(middle))


def choose_prediction(fits: list[LinearFit], which: Column) -> Column:
    """The prediction of fit number ``which`` (0, 1, ...) as one expression; null beyond the fits."""

    def of(values: list[float]) -> Column:
        return F.get(F.array(*[F.lit(float(v)) for v in values]), which)

    total = of([f.intercept for f in fits])
    for i, name in enumerate(fits[0].features):
        value = F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))
        total = total + F.coalesce((value - of([f.means[i] for f in fits])) * of([f.weights[i] for f in fits]), F.lit(0.0))
    return total


def fit_ridge(train: DataFrame, features=FEATURE_COLUMNS, label: str = TARGET, alpha: float = 1.0) -> LinearFit:
    """Ridge on all training rows."""
    return solve_ridge(cross_sums(train, features, label)[0], features, alpha)


def expanding_ridge(folded: DataFrame, n_splits: int, features=FEATURE_COLUMNS, label: str = TARGET, alpha: float = 1.0, keep: list[str] | None = None) -> DataFrame:
    """Adds ``prediction`` to the rows, or to their columns ``keep``: rows of fold i by the ridge of all rows with a smaller ``fold``; null in fold 0."""
    sums = cross_sums(folded.where(F.col("fold") < n_splits), features, label, F.col("fold"))
    so_far, fits = 0.0, []
    for i in range(n_splits):
        so_far = so_far + sums.get(i, 0.0)
        fits.append(solve_ridge(so_far, features, alpha))
    place = (keep or folded.columns).index("fold")
    means, weights = np.array([f.means for f in fits]), np.array([f.weights for f in fits])
    middle = np.array([f.intercept for f in fits])

    def score(batch: pa.RecordBatch, x: np.ndarray) -> pa.Array:
        fold = batch.column(place).to_numpy(zero_copy_only=False)
        out = np.zeros(len(x))
        for i in np.unique(fold[fold > 0]).tolist():
            own = fold == i
            total = np.full(np.count_nonzero(own), middle[i - 1])
            for value, mean, weight in zip(x[own].T, means[i - 1], weights[i - 1], strict=True):
                total += np.where(np.isnan(value), 0.0, (value - mean) * weight)
            out[own] = total
        return pa.array(out, mask=fold <= 0)

    return scored(folded, tuple(features), score, keep)
