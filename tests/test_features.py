import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import gappy, panel, station_series
from hazeline.operators import blocks
from hazeline.operators.features import build_features
from hazeline.operators.sequences import build_sequences
from hazeline.operators.supervised import FEATURE_COLUMNS, HORIZONS, make_supervised, supervised_from_raw

DAY = 86400


def by_key(df, *columns):
    return df.select("city", "datetime", *columns).toPandas().sort_values(["city", "datetime"]).reset_index(drop=True)


def expected_windows(features):
    """The same windows with pandas, on rows with or without a target."""
    out = features.copy()
    g = out.groupby("city")
    for c in ("aqi", "pm2_5", "pm10"):
        for n in (1, 24):
            out[f"{c}_lag_{n}h"] = g[c].shift(n)
        for n in (6, 24):
            roll = g[c].transform(lambda s, n=n: s.shift(1).rolling(n, min_periods=max(2, n // 2)).mean())
            out[f"{c}_roll_mean_{n}h"] = roll
            out[f"{c}_roll_std_{n}h"] = g[c].transform(
                lambda s, n=n: s.shift(1).rolling(n, min_periods=max(2, n // 2)).std()
            )
    return out


def test_columns_and_key(spark):
    got = build_features(panel(spark, station_series()))
    assert len(got.columns) == 74
    times = [r[0] for r in got.select("timestamp").orderBy("datetime").collect()]
    assert times == sorted(set(times)) and len(times) == 240


def test_stations_do_not_mix(spark):
    raw = panel(spark, station_series(city="Lahore"), station_series(city="Karachi", lat=24.8, lon=67.0))
    nulls = build_features(raw).where(F.col("aqi_lag_24h").isNull()).groupBy("city").count().collect()
    assert {r["city"]: r["count"] for r in nulls} == {"Lahore": 24, "Karachi": 24}


@pytest.mark.parametrize("seconds", [6 * 3600, 2 * DAY, 400 * DAY])
def test_blocks_equal_whole_series(spark, seconds):
    """Gaps longer than several blocks, missing values, blocks shorter than the look-back."""
    raw = panel(spark, gappy(1, city="A"), gappy(2, city="B", drop=0.8), station_series(30, "C"))
    whole = by_key(build_features(raw, dropna_target=False, block_seconds=400 * DAY), "aqi", "pm2_5", "pm10")
    want = expected_windows(whole)
    columns = [c for c in want.columns if "_lag_" in c or "_roll_" in c]
    got = by_key(build_features(raw, dropna_target=False, block_seconds=seconds), *columns)
    pd.testing.assert_frame_equal(got[columns], want[columns], rtol=1e-9)


@pytest.mark.parametrize("limit", [0, 50_000])
def test_stored_ranges_give_the_same_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(blocks, "MAX_BROADCAST_RANGES", limit)
    raw = panel(spark, gappy(1, city="A"), gappy(2, city="B", drop=0.8))
    got = by_key(build_features(raw, block_seconds=DAY), "aqi_lag_24h", "pm10_roll_std_24h")
    want = by_key(build_features(raw, block_seconds=400 * DAY), "aqi_lag_24h", "pm10_roll_std_24h")
    pd.testing.assert_frame_equal(got, want)


def test_input_order_and_partitions_do_not_matter(spark):
    raw = panel(spark, gappy(3, city="A"), gappy(4, city="B"))
    a = by_key(build_features(raw, block_seconds=DAY), "aqi_change_rate", "aqi_roll_max_6h")
    b = by_key(build_features(raw.orderBy(F.rand(7)).repartition(5), block_seconds=DAY), "aqi_change_rate", "aqi_roll_max_6h")
    pd.testing.assert_frame_equal(a, b)


def test_no_value_of_the_row_itself_leaks_into_its_windows(spark):
    frame = station_series(60)
    bumped = frame.copy()
    bumped.loc[40, ["us_aqi", "pm2_5", "pm10"]] = 499.0
    cols = [c for c in build_features(panel(spark, frame)).columns if "_lag_" in c or "_roll_" in c]
    a, b = (by_key(build_features(panel(spark, f)), *cols).loc[40, cols] for f in (frame, bumped))
    pd.testing.assert_series_equal(a, b)


def test_change_rate_and_min_periods(spark):
    frame = station_series(5)
    frame["us_aqi"] = [0.0, 5.0, 10.0, 20.0, 40.0]
    got = by_key(build_features(panel(spark, frame)), "aqi_change_rate", "aqi_roll_mean_6h")
    assert np.isnan(got.aqi_change_rate[:2]).all() and got.aqi_change_rate[2] == 1.0
    assert list(got.aqi_roll_mean_6h.isna()) == [True, True, True, False, False]


def test_clock_mode_leaves_missing_hours_empty(spark):
    frame = station_series(100).drop(index=[50]).reset_index(drop=True)
    for seconds in (5 * 3600, 2 * DAY, 30 * DAY):
        got = by_key(build_features(panel(spark, frame), mode="time", block_seconds=seconds), "aqi", "aqi_lag_1h", "aqi_lag_24h")
        at = got.set_index("datetime")
        hour = pd.Timestamp("2024-01-03 03:00")
        assert pd.isna(at.loc[hour, "aqi_lag_1h"])
        assert at.loc[hour, "aqi_lag_24h"] == at.loc[hour - pd.Timedelta("24h"), "aqi"]
        assert pd.isna(at.loc[hour + pd.Timedelta("23h"), "aqi_lag_24h"])


def test_supervised_anchor_is_the_state_h_rows_before(spark):
    raw = panel(spark, gappy(5, 900, city="A", drop=0.1, missing=0.05), station_series(360, "B"))
    features = build_features(raw).cache()
    want = by_key(features, "aqi", "aqi_roll_mean_24h")
    one_pass = supervised_from_raw(raw, block_seconds=3 * DAY)
    stored = make_supervised(features, block_seconds=3 * DAY)
    assert set(FEATURE_COLUMNS) <= set(stored.columns)
    assert one_pass.count() == stored.count() > 0
    for h in (1, 24, 72):
        got = by_key(stored.where(F.col("horizon") == h), "y_aqi", "aqi_anchor", "aqi_roll_mean_24h_anchor")
        again = by_key(one_pass.where(F.col("horizon") == h), "y_aqi", "aqi_anchor", "aqi_roll_mean_24h_anchor")
        pd.testing.assert_frame_equal(got, again)
        shifted = want.assign(
            y_aqi=want.aqi, aqi_anchor=want.groupby("city").aqi.shift(h),
            aqi_roll_mean_24h_anchor=want.groupby("city").aqi_roll_mean_24h.shift(h),
        )
        merged = got.merge(shifted, on=["city", "datetime"], suffixes=("", "_w"))
        assert len(merged) == len(got)
        for c in ("y_aqi", "aqi_anchor", "aqi_roll_mean_24h_anchor"):
            np.testing.assert_allclose(merged[c], merged[f"{c}_w"])


def test_supervised_horizons(spark):
    rows = make_supervised(build_features(panel(spark, station_series(360))), horizons=(1, 24))
    assert {r[0] for r in rows.select("horizon").distinct().collect()} == {1, 24}
    assert HORIZONS[-1] == 72


def test_sequences_equal_a_loop(spark):
    raw = panel(spark, gappy(6, 700, city="A", drop=0.05, missing=0.002), station_series(200, "B"))
    features = build_features(raw).cache()
    got = build_sequences(features, block_seconds=2 * DAY).select("city", "end", "target", "datetime", F.element_at("window", 1)["pm10"].alias("first")).toPandas()
    want = []
    columns = ["aqi", "pm2_5", "pm10"]
    for city, g in by_key(features, *columns).groupby("city"):
        g = g.reset_index(drop=True)
        for end in range(48, len(g) - 24, 6):
            if not g.loc[end - 48 : end - 1, columns].isna().any().any():
                want.append((city, end, g.aqi[end + 23], g.datetime[end], g.pm10[end - 48]))
    want = pd.DataFrame(want, columns=["city", "end", "target", "datetime", "first"])
    key = ["city", "end"]
    a, b = got.sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
    assert len(a) == len(b) > 30
    assert (a[key] == b[key]).all().all() and (a.datetime == b.datetime).all()
    np.testing.assert_allclose(a[["target", "first"]], b[["target", "first"]], rtol=1e-6)
