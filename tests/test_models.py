import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import panel, station_series
from hazeline.operators import attribution, forecast, models, scenario
from hazeline.operators.features import build_features
from hazeline.operators.supervised import FEATURE_COLUMNS, make_supervised, time_split
from hazeline.plans import evaluation, inference, reports, training
from hazeline.sources import dims
from hazeline.sources.bundle import load_bundle

QUICK = {"maxIter": 8, "maxDepth": 4, "stepSize": 0.3}


@pytest.fixture(scope="module")
def features(spark):
    """Two seasonal stations with some noise, so that there is something to learn."""
    rng = np.random.default_rng(9)
    frames = []
    for i, city in enumerate(("Lahore", "Karachi")):
        f = station_series(900, city, 31.5 - i, 74.3 - i)
        f["us_aqi"] = (150 + 60 * np.sin(2 * np.pi * np.arange(900) / 24) + rng.normal(0, 6, 900) + 20 * i).clip(0)
        frames.append(f)
    return build_features(panel(spark, *frames)).cache()


@pytest.fixture(scope="module")
def rows(features):
    return make_supervised(features, horizons=(1, 6, 24)).cache()


def test_ridge_equals_the_closed_form(rows):
    alpha = 50.0
    got = models.fit_candidates(rows, {"r": models.ridge(rows, alpha=alpha)})["r"].predict(rows)
    frame = got.select(*FEATURE_COLUMNS, "y_aqi", "prediction").toPandas()
    x, y = frame[list(FEATURE_COLUMNS)].to_numpy(float), frame["y_aqi"].to_numpy()
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd > 1e-12, sd, 1.0)
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean()))
    np.testing.assert_allclose(frame["prediction"], y.mean() + z @ w, rtol=1e-6)


def test_linear_attribution_adds_up(rows):
    fitted = models.fit_candidates(rows, {"r": models.ridge(rows)})["r"]
    out = attribution.explain(attribution.linear_attribution(fitted.predict(rows), fitted.model))
    worst = out.agg(F.max(F.abs(F.col("explained") - F.col("prediction")))).first()[0]
    assert worst < 1e-6
    text = out.first()["text"]
    assert text.startswith("Forecast AQI ≈ ") and "Main drivers: " in text


def brute_force(leaves, x, n_features):
    """Shapley values by summing over all coalitions."""

    def value(known):
        total = 0.0
        for leaf in leaves:
            part = leaf.value
            for j, f in enumerate(leaf.features):
                inside = leaf.low[j] < x[f] <= leaf.high[j]
                part *= float(inside) if f in known else leaf.share[j]
            total += part
        return total

    phi = np.zeros(n_features)
    for i in range(n_features):
        others = [j for j in range(n_features) if j != i]
        for size in range(n_features):
            weight = math.factorial(size) * math.factorial(n_features - size - 1) / math.factorial(n_features)
            for known in itertools.combinations(others, size):
                phi[i] += weight * (value({*known, i}) - value({*known}))
    return phi


@pytest.mark.parametrize("family", ["forest", "boosted"])
def test_tree_attribution_equals_brute_force(spark, rows, family):
    names = ["aqi_anchor", "hour_sin", "horizon", "temperature_2m", "pm10_anchor"]
    build = models.forest if family == "forest" else models.boosted
    settings = {"numTrees": 5, "maxDepth": 5} if family == "forest" else {"maxIter": 4, "maxDepth": 4}
    typed = models.numeric_inputs(rows)
    fitted = build(features=names, **settings).fit(typed)
    some = typed.limit(40).drop("features")
    scored = fitted.transform(some).drop("features")
    got = attribution.tree_attribution(scored, fitted, names).toPandas()
    leaves, base = attribution.tree_leaves(fitted)
    for _, row in got.iterrows():
        want = brute_force(leaves, row[names].to_numpy(float), len(names))
        np.testing.assert_allclose(row["phi"], want, atol=1e-8)
        assert row["base"] + sum(row["phi"]) == pytest.approx(row["prediction"], abs=1e-6)
    ranked = attribution.global_importance(attribution.tree_attribution(scored, fitted, names), names, k=3).collect()
    assert len(ranked) == 3 and ranked[0]["mean_abs"] >= ranked[1]["mean_abs"]


def test_contributors(spark):
    row = spark.range(1).select(F.array(*[F.lit(x) for x in (1.0, -7.26, 0.2, 3.0)]).alias("phi"))
    got = row.select(attribution.contributors(F.col("phi"), ["aqi_anchor", "wind_u", "x_y", "horizon"], 3).alias("c")).first()["c"]
    assert [(c["label"], c["impact"]) for c in got] == [("wind (E–W)", -7.3), ("lead time", 3.0), ("current AQI", 1.0)]


def test_boosted_beats_persistence_on_a_seasonal_series(rows):
    train, valid = time_split(rows)
    fitted = models.fit_candidates(train, {"b": models.boosted(**QUICK)})
    result = {r["model"]: r["rmse"] for r in models.compare(valid.where("horizon = 6"), fitted).collect()}
    assert result["b"] < result[models.BASELINE]


def test_train_save_forecast_explain(spark, features, tmp_path):
    def quick(train):
        return {"Ridge": models.ridge(train), "GradientBoosting": models.boosted(**QUICK)}

    path, board = str(tmp_path / "model"), str(tmp_path / "board")
    run = training.train(features, horizons=(1, 6, 24, 72), pipelines=quick, model_path=path, leaderboard_path=board, trained_at="t1")
    assert run.decision["promoted"] and run.results.count() == 3
    again = training.train(features, horizons=(1, 6), pipelines=lambda t: {"Ridge": models.ridge(t, alpha=1e9)}, model_path=path, leaderboard_path=board, trained_at="t2")
    assert not again.decision["promoted"]
    bundle = load_bundle(spark, path)
    assert bundle.trained_at == "t1" and bundle.intervals.count() == 4

    now = "2024-02-04 11:20:00"
    documents = inference.run_inference(
        features, bundle, dims.cities(spark), as_of=now, generated_at="g1", path=str(tmp_path / "docs"), log_path=str(tmp_path / "log"), batch=1
    )
    got = {r["city"]: r for r in documents.collect()}
    assert set(got) == {"Lahore", "Karachi"}
    doc = got["Lahore"]
    assert doc["province"] == "Punjab" and len(doc["hourly"]) == 72 and len(doc["daily"]) == 3
    assert doc["hourly"][0]["datetime"] == pd.Timestamp("2024-02-04 12:00")
    assert all(h["lower"] <= h["aqi"] <= h["upper"] for h in doc["hourly"])
    assert doc["alert"]["peak_aqi"] == max(h["aqi"] for h in doc["hourly"])
    assert len(doc["explanation"]["contributors"]) == 5
    assert spark.read.parquet(str(tmp_path / "log")).count() == 144
    assert reports.get_forecast(documents, ["Lahore", "Nowhere"]).where("error IS NOT NULL").count() == 1
    assert reports.predictions_for(documents, "lahore").count() == 1
    why = {r["city"]: r for r in reports.get_explanation(documents, ["Lahore", "Nowhere"]).collect()}
    assert why["Lahore"]["explanation"] and why["Nowhere"]["error"]


def test_walk_forward_and_report(features, rows, tmp_path):
    folds = evaluation.walk_forward(rows, 3, models.ridge).orderBy("fold").collect()
    n = rows.count()
    assert [f["test_rows"] for f in folds] == [n // 4] * 3
    assert folds[0]["train_rows"] == n - 3 * (n // 4)
    assert all(f["rmse"] > 0 for f in folds)


def test_nearest_horizon_and_clamps(spark):
    intervals = spark.createDataFrame([(h, -20.0, 40.0) for h in (1, 2, 3, 6, 12, 24, 36, 48, 60, 72)], "horizon int, low double, high double")
    asked = spark.createDataFrame([(h, 490.0) for h in (1, 4, 9, 18, 30, 54, 66, 72)] + [(5, 5.0)], "horizon int, prediction double")
    trained = intervals.agg(F.sort_array(F.collect_list("horizon"))).first()[0]
    near = asked.select(forecast.nearest(F.col("horizon"), F.array(*[F.lit(t) for t in trained])).alias("n"))
    assert [r["n"] for r in near.collect()][:8] == [1, 3, 6, 12, 24, 48, 60, 72]
    joined = forecast.attach_intervals(asked, intervals)
    lo, hi = forecast.interval_bounds(F.col("prediction"), F.col("low"), F.col("high"))
    got = {(r[0], r[1]) for r in joined.select(lo, hi).collect()}
    assert got == {(470.0, 500.0), (0.0, 45.0)}


def test_anchor_falls_back_to_the_first_row(features):
    early = forecast.anchors(features, "2020-01-01 00:00:00").first()
    assert early["anchor_datetime"] == pd.Timestamp("2024-01-01")
    assert forecast.stations_without_future(features, "2030-01-01").count() == 2
    assert forecast.forecast_inputs(features, "2030-01-01").count() == 0


def test_scenarios(spark, features):
    asked = spark.createDataFrame(
        [("none", "Lahore", 24, None, None), ("wind", "Lahore", 24, 10.0, None), ("far", "Lahore", 60, None, 90.0)],
        "scenario_id string, city string, horizon int, wind_speed double, aqi_now double",
    ).selectExpr("scenario_id", "city", "horizon", "CAST(NULL AS double) AS pm2_5", "aqi_now", "wind_speed", "CAST(NULL AS double) AS humidity", "CAST(NULL AS double) AS temperature")
    base = scenario.base_vectors(features, asked, "2024-02-06 12:00:00")
    got = {r["scenario_id"]: r for r in scenario.scenario_inputs(base, asked).collect()}
    plain = {r["horizon"]: r for r in base.collect()}
    assert all(got["none"][c] == plain[24][c] for c in FEATURE_COLUMNS)
    assert math.hypot(got["wind"]["wind_u"], got["wind"]["wind_v"]) == pytest.approx(10.0)
    assert got["wind"]["wind_gusts_10m"] == 14.0
    assert got["far"]["aqi_roll_mean_24h_anchor"] == 90.0
    # 2024-02-07 11:00 is the last hour: 23 steps ahead, so horizon 60 uses it
    last = features.where("city = 'Lahore'").orderBy(F.desc("datetime")).first()
    assert got["far"]["temperature_2m"] == last["temperature_2m"]
    calm = base.withColumn("wind_u", F.lit(0.0)).withColumn("wind_v", F.lit(0.0))
    still = {r["scenario_id"]: r for r in scenario.scenario_inputs(calm, asked).collect()}["wind"]
    assert (still["wind_u"], still["wind_speed_10m"]) == (0.0, 10.0)
    scores = scenario.simulate(base, asked, lambda d: d.withColumn("prediction", F.col("aqi_anchor") - F.col("wind_speed_10m")))
    assert {r["scenario_id"]: r["delta"] for r in scores.collect()}["none"] == 0
    assert scenario.setting_defaults(base).count() == 2
