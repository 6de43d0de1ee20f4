"""Steps that must not grow faster than their input."""

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from checks import panels, queries
from hazeline.operators import models, normal, quantiles, sequences
from hazeline.operators.folds import assign_folds
from hazeline.operators.sampling import exact_sample, exact_samples_before
from hazeline.session import materialize

KEYS = ["city", "datetime", "horizon"]
INPUTS = ("aqi_anchor", "temperature_2m", "wind_u")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    step = F.col("id")
    events = spark.range(600).select(
        step.alias("event_id"), F.timestamp_seconds(step * 600 + 1_704_067_200).alias("ts"), (step % 37).alias("user_id"),
        F.element_at(F.array(*[F.lit(s) for s in ("view", "click")]), (step % 2 + 1).cast("int")).alias("event_type"),
        (step * 17 % 90 + 0.5).alias("value"), F.concat(F.lit('{"k": '), (step * 7 % 100).cast("string"), F.lit("}")).alias("props"),
    )
    at = str(tmp_path_factory.mktemp("tables"))
    events.write.parquet(f"{at}/events.parquet")
    return at


def test_forest_reads_parts_of_bounded_rows(spark, tables, monkeypatch):
    rows = materialize(queries.supervised_table(spark, tables).coalesce(1), "one-part", 200)
    parts, plain = [], Pipeline._fit

    def fit(self, dataset):
        parts.append(max(dataset.rdd.glom().map(len).collect()))
        return plain(self, dataset)

    monkeypatch.setattr(Pipeline, "_fit", fit)
    monkeypatch.setattr(models, "TREE_PART_ROWS", 200)
    models.fit_candidates(rows, {"f": models.forest(INPUTS, numTrees=2, maxDepth=2)})
    assert rows.count() > 4000 and parts[0] <= 400
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_ranks_store_every_value_once(spark, monkeypatch):
    stored, write = [], quantiles.materialize

    def record(df, name):
        out = write(df, name)
        stored.append((name, out.count()))
        return out

    monkeypatch.setattr(quantiles, "materialize", record)
    df = spark.range(5000).select((F.col("id") % 50).alias("t"))
    assert quantiles.values_at_ranks(df, "t", [0, 99, 100, 4999], 5000) == [(0.0, 0), (0.0, 0), (1.0, 100), (49.0, 4900)]
    assert quantiles.quantile_scalar(df, "t", 0.5) == pytest.approx(np.quantile(np.arange(5000) % 50, 0.5))
    assert max(n for name, n in stored if name == "ordered-values") == 50


def test_backtest_scores_reported_columns_only(spark, tables):
    folded = assign_folds(queries.supervised_table(spark, tables), 3)
    got = normal.expanding_ridge(folded, 3, INPUTS, keep=[*KEYS, "fold"])
    assert got.columns == [*KEYS, "fold", "prediction"]
    found = got.toPandas().sort_values(KEYS).prediction.to_numpy()
    sums = normal.cross_sums(folded, INPUTS, group=F.col("fold"))
    fits = [normal.solve_ridge(sum(sums[g] for g in range(i)), INPUTS) for i in (1, 2, 3)]
    want = folded.withColumn("prediction", F.when(F.col("fold") > 0, normal.choose_prediction(fits, F.col("fold") - 1)))
    np.testing.assert_allclose(found, want.toPandas().sort_values(KEYS).prediction.to_numpy(), rtol=1e-10)


@pytest.mark.parametrize("n", [40, 700, 10**6])
def test_samples_of_all_folds_equal_one_at_a_time(spark, n):
    # repeated keys too
    df = spark.range(1500).select(
        (F.col("id") % 4).cast("int").alias("fold"), F.concat(F.lit("c"), F.col("id") % 3).alias("city"),
        F.timestamp_seconds(F.col("id") % 900).alias("datetime"), F.lit(1).alias("horizon"), "id",
    )
    got = exact_samples_before(df, "fold", 3, n, KEYS)
    for i in (1, 2, 3):
        want = {r["id"] for r in exact_sample(df.where(F.col("fold") < i), n, KEYS).collect()}
        assert sorted(r["id"] for r in got.where(F.col("_fit") == i).collect()) == sorted(want)


def test_sequences_compute_only_what_they_hold(spark, tables):
    rows = queries.sequence_inputs(spark, tables)
    assert rows.columns == ["city", "datetime", *sequences.SEQUENCE_FEATURES]
    assert "Window [" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_residual_intervals_store_no_wide_rows(spark, tables, monkeypatch):
    monkeypatch.setattr(panels, "_stored", {})
    assert queries.QUERIES["residual_intervals"](spark, tables).count() == 10
    assert {name for _, _, name in panels._stored} == {"derive_readings"}
