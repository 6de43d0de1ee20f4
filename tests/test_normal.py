import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hazeline.operators import normal

NAMES = ("a", "b", "c", "flat", "gone")


def panel(seed, n=600):
    rng = np.random.default_rng(seed)
    x = pd.DataFrame({"a": rng.normal(1000, 8, n), "b": rng.gamma(2, 3, n), "c": rng.integers(0, 5, n).astype(float), "flat": 7.3, "gone": np.nan})
    x.loc[rng.random(n) < 0.2, "b"] = np.nan
    x["y_aqi"] = 0.4 * x.a - 3 * x.b.fillna(4) + rng.normal(0, 2, n)
    x["fold"] = np.sort(rng.integers(0, 4, n))
    return x


def plain_ridge(train, test, alpha):
    """Fill, scale and solve as one would by hand."""
    means = train[list(NAMES)].mean()
    z, t = ((df[list(NAMES)].fillna(means).fillna(0) - means.fillna(0)).to_numpy() for df in (train, test))
    sd = z.std(axis=0)
    use = sd > 1e-9
    z, t = z[:, use] / sd[use], t[:, use] / sd[use]
    w = np.linalg.solve(z.T @ z + alpha * np.eye(use.sum()), z.T @ (train.y_aqi - train.y_aqi.mean()))
    return train.y_aqi.mean() + t @ w


@pytest.mark.parametrize("alpha", [1.0, 250.0])
def test_equals_ridge_by_hand(spark, alpha):
    x = panel(1)
    rows = spark.createDataFrame(x).withColumn("id", F.monotonically_increasing_id()).repartition(5)
    fit = normal.fit_ridge(rows, NAMES, alpha=alpha)
    got = fit.predict(rows).orderBy("id").toPandas()
    # createDataFrame may keep NaN or null; both are missing
    assert np.allclose(got.prediction, plain_ridge(x, x, alpha), rtol=1e-9)


def test_folds_equal_separate_fits(spark):
    x = panel(2)
    rows = spark.createDataFrame(x).withColumn("id", F.monotonically_increasing_id()).repartition(6)
    got = normal.expanding_ridge(rows, 3, NAMES).orderBy("id").toPandas()
    assert got[got.fold == 0].prediction.isna().all()
    for i in (1, 2, 3):
        assert np.allclose(got[got.fold == i].prediction, plain_ridge(x[x.fold < i], x[x.fold == i], 1.0), rtol=1e-9)


def test_one_scan_fits_all_folds(spark):
    rows = spark.createDataFrame(panel(3))
    group = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one-scan", "")
    normal.cross_sums(rows, NAMES, group=F.col("fold"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [group.getStageInfo(s) for j in group.getJobIdsForGroup("one-scan") for s in group.getJobInfo(j).stageIds]
    assert sum(s is not None and s.numCompletedTasks > 0 for s in stages) <= 2


def test_rows_without_label_and_empty_tasks(spark):
    x = panel(4, 40)
    x.loc[::3, "y_aqi"] = None
    rows = spark.createDataFrame(x).repartition(64)
    known = x[x.y_aqi.notna()]
    fit = normal.fit_ridge(rows.withColumn("y_aqi", F.nanvl("y_aqi", F.lit(None).cast("double"))), NAMES)
    assert fit.intercept == pytest.approx(known.y_aqi.mean(), rel=1e-12)
