import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from frames import panel, station_series
from hazeline import schemas
from hazeline.operators.features import build_features
from hazeline.operators.scoring import append_log, biggest_misses, error_report, read_log
from hazeline.plans.ingest import backfill, load_raw, refresh
from hazeline.sources import dims, payload
from hazeline.sources.store import FeatureStore, merge_batches


def sorted_frame(df):
    columns = sorted(df.columns)
    return df.select(*columns).toPandas().sort_values(["city", "datetime"]).reset_index(drop=True)


@pytest.fixture()
def store(spark, tmp_path):
    return FeatureStore(spark, str(tmp_path / "store"))


def test_missing_store(store):
    with pytest.raises(FileNotFoundError):
        store.read()
    assert store.cities().count() == 0


def test_upsert_keeps_the_last_row(spark, store):
    features = build_features(panel(spark, station_series(100, "Lahore")))
    store.upsert(features)
    store.upsert(features.where(F.col("timestamp") % 7200 == 0).withColumn("aqi", F.lit(1.0)))
    got = store.read()
    assert got.count() == 100
    assert got.where("aqi = 1").count() == 50
    assert dict(got.dtypes)["hour"] == "double" and dict(got.dtypes)["timestamp"] == "bigint"
    assert [r[0] for r in store.cities().collect()] == ["Lahore"]
    assert store.between("2024-01-02", "2024-01-02").count() == 24
    assert spark.table(store.register_view()).count() == 100
    first = store.ordered().first()
    assert first["timestamp"] == got.agg(F.min("timestamp")).first()[0]


def test_two_upserts_equal_one(spark, tmp_path):
    features = build_features(panel(spark, station_series(100)))
    one, two = (FeatureStore(spark, str(tmp_path / n)) for n in ("one", "two"))
    one.upsert(features)
    two.upsert(features.where("hour < 12"))
    two.upsert(features.where("hour >= 12"))
    pd.testing.assert_frame_equal(sorted_frame(one.read()), sorted_frame(two.read()))


def test_staged_upsert_is_finished_by_recover(spark, store):
    features = build_features(panel(spark, station_series(50)))
    store.upsert(features.where("hour < 12"))
    # an upsert that died after staging its merged days, before swapping them in
    merged = merge_batches(None, features.withColumn("day", F.to_date("datetime")))
    merged.write.partitionBy("day").parquet(f"{store.pending}/half-way")
    store.recover()
    assert store.read().count() == 50
    store.recover()
    assert store.read().count() == 50


def test_highest_sequence_wins_within_a_batch(spark):
    rows = spark.createDataFrame([("A", 1, 1.0, 1), ("A", 1, 2.0, 2), ("B", 1, 5.0, 1)], "city string, timestamp long, aqi double, _seq int")
    assert {(r.city, r.aqi) for r in merge_batches(None, rows).collect()} == {("A", 2.0), ("B", 5.0)}


@pytest.mark.parametrize("gap_days", [0, 60])
def test_refresh_keeps_lags_whole(spark, store, gap_days):
    """Two loads give the table one load gives, also when the history lies far back."""
    frame = pd.concat([station_series(300, "Lahore"), station_series(300, "Karachi", 24.8, 67.0)])
    late = frame["datetime"] >= "2024-01-09"
    frame.loc[late, "datetime"] += pd.Timedelta(days=gap_days)
    raw = panel(spark, frame)
    cut = F.lit("2024-01-09").cast("timestamp_ntz")
    dim = dims.cities(spark)
    backfill(store, raw.where(F.col("datetime") < cut).unionByName(raw.where(F.hour("datetime") == 3).where(F.col("datetime") < cut)), dim)
    refresh(store, raw.where(F.col("datetime") >= cut))
    want = build_features(raw)
    columns = ["city", "datetime", "aqi", "aqi_lag_24h", "aqi_roll_std_24h", "aqi_change_rate"]
    pd.testing.assert_frame_equal(
        sorted_frame(store.read().select(*columns)), sorted_frame(want.select(*columns)), check_exact=False
    )


WINDOWS = ["city", "datetime", "aqi", "aqi_lag_1h", "aqi_lag_24h", "aqi_roll_mean_24h", "aqi_change_rate"]


def assert_as_built_at_once(store, raw):
    got, want = (sorted_frame(df.select(*WINDOWS)) for df in (store.read(), build_features(raw)))
    pd.testing.assert_frame_equal(got, want, check_exact=False)


def hours(raw, *spans):
    hour = ((F.unix_timestamp(F.col("datetime").cast("timestamp")) - 1704067200) / 3600).cast("int")
    found = F.lit(False)
    for a, b in spans:
        found = found | hour.between(a, b)
    return raw.where(found)


@pytest.mark.parametrize(
    "batches",
    [
        [[(0, 99)], [(110, 199)], [(100, 109)]],  # late hours
        [[(0, 119), (121, 198)], [(120, 120), (199, 199)]],  # a correction far before the newest hour
        [[(150, 199)], [(0, 149)]],  # history after the present
    ],
)
def test_refresh_in_any_order_equals_a_rebuild(spark, store, batches):
    frame = station_series(200, "Lahore")
    frame.loc[[20, 88, 89, 90, 91, 92, 93, 94, 95, 96, 97, 98], ["us_aqi", "pm2_5", "pm10"]] = float("nan")  # no target
    raw = panel(spark, frame)
    for spans in batches:
        refresh(store, hours(raw, *spans))
    assert_as_built_at_once(store, raw)
    assert store.read_all().count() == 200 and store.read().count() == 188
    assert sum(r.known for r in store.day_counts().collect()) == 188
    counts = {(r.city, str(r.day)): r.n for r in store.day_counts().collect()}
    assert counts[("Lahore", "2024-01-02")] == 24 and sum(counts.values()) == 200


def test_repeated_hours_count_once_and_the_last_wins(spark, store):
    raw = panel(spark, station_series(120, "Lahore"))
    refresh(store, hours(raw, (0, 59)))
    late = hours(raw, (60, 119))
    old = late.withColumn("us_aqi", F.lit(1.0)).withColumn("_seq", F.lit(1))
    refresh(store, late.withColumn("_seq", F.lit(2)).unionByName(old).unionByName(old))
    assert_as_built_at_once(store, raw)


def test_around_reads_few_days(spark, store):
    store.upsert(build_features(panel(spark, station_series(240, "Lahore"), station_series(60, "Karachi")), dropna_target=False))
    got = {(r.city, r.d) for r in store.around("2024-01-06 05:00:00", 30).select("city", F.to_date("datetime").cast("string").alias("d")).collect()}
    assert got == {("Lahore", f"2024-01-0{d}") for d in (5, 6, 7, 8)} | {("Karachi", "2024-01-03")}


def test_backfill_keeps_the_first_copy(spark, store):
    raw = panel(spark, station_series(60, "Lahore")).withColumn("_seq", F.lit(1))
    again = raw.withColumn("us_aqi", F.lit(1.0)).withColumn("_seq", F.lit(2))
    backfill(store, again.unionByName(raw), dims.cities(spark))
    assert_as_built_at_once(store, raw.drop("_seq"))


def test_broken_documents_stop_no_other_station(spark, tmp_path):
    def document(city, times, seq, value, n=None):
        values = {v: [value] * (len(times) if n is None else n) for v in schemas.AIR_QUALITY_VARS}
        return {"city": city, "source": "air_quality", "seq": seq, "hourly": {"time": times, **values}}

    air = [
        document("Lahore", ["2024-01-01T00:00", "soon", "2024-01-01T01:00"], 2, 2.0),
        document("Lahore", ["2024-01-01T01:00"], 1, 1.0),
        document("Multan", ["2024-01-01T00:00"], 1, 5.0, n=2),
        document("Nowhere", ["2024-01-01T00:00"], 1, 7.0),
    ]
    wx = [
        {"city": c, "source": "forecast", "hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], **{v: [1.0, 1.0] for v in schemas.WEATHER_VARS}}}
        for c in ("Lahore", "Multan", "Nowhere")
    ]
    for name, docs in (("air", air), ("wx", wx)):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(d) for d in docs))
    args = (spark, str(tmp_path / "air.json"), str(tmp_path / "wx.json"), dims.cities(spark))
    for keep, value in (("first", 1.0), ("last", 2.0)):
        rows, rejected = load_raw(*args, dated=False, keep=keep)
        got = sorted((r.city, r.datetime.hour, r.pm10, r.latitude) for r in rows.collect())
        assert got == [("Lahore", 0, 2.0, 31.5204), ("Lahore", 1, value, 31.5204), ("Nowhere", 0, 7.0, None)]
    reasons = {(r.city, r.reason) for r in rejected.collect()}
    assert reasons == {("Lahore", "not a time: soon"), ("Multan", "arrays of unequal length"), ("Nowhere", "unknown station")}


def test_backfill_resumes(spark, store):
    raw = panel(spark, station_series(60, "Lahore"), station_series(60, "Karachi"))
    dim = dims.cities(spark)
    backfill(store, raw.where("city = 'Lahore'"), dim)
    changed = raw.withColumn("us_aqi", F.lit(7.0))
    backfill(store, changed, dim)
    got = {r["city"]: r["m"] for r in store.read().groupBy("city").agg(F.max("aqi").alias("m")).collect()}
    assert got["Karachi"] == 7.0 and got["Lahore"] > 100


def test_landed_documents(spark, tmp_path):
    def document(source, variables, hours, **extra):
        return {"city": "Lahore", "source": source, "hourly": {"time": [f"2024-01-01T{h:02d}:00" for h in hours], **{v: [float(h) for h in hours] for v in variables}}, **extra}

    air = [document("air_quality", schemas.AIR_QUALITY_VARS, [2, 0, 1]), {"city": "Karachi", "source": "air_quality", "hourly": {"pm10": [1.0]}}, {"city": "Multan", "source": "air_quality"}]
    wx = [document("forecast", schemas.WEATHER_VARS, [0, 1]), document("archive", schemas.WEATHER_VARS, [1, 2])]
    for name, docs in (("air", air), ("wx", wx)):
        (tmp_path / f"{name}.json").write_text("\n".join(json.dumps(d) for d in docs))
    args = (spark, str(tmp_path / "air.json"), str(tmp_path / "wx.json"), dims.cities(spark))
    rows, rejected = load_raw(*args, dated=False)
    assert rows.columns == schemas.RAW_HOURLY.names
    assert [(r.datetime.hour, r.pm10, r.latitude) for r in rows.orderBy("datetime").collect()] == [(0, 0.0, 31.5204), (1, 1.0, 31.5204)]
    assert {r.city for r in rejected.collect()} == {"Karachi", "Multan"}
    dated, _ = load_raw(*args, dated=True)
    assert [r.datetime.hour for r in dated.orderBy("datetime").collect()] == [1, 2]


@pytest.mark.parametrize(
    "start, stop, inclusive, want",
    [
        ("2024-01-01", "2024-04-01", False, [("2024-01-01", "2024-03-31")]),
        ("2024-01-01", "2024-04-01", True, [("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-04-01")]),
        ("2024-01-01", "2024-01-01", False, []),
        ("2024-01-01", "2024-05-01", False, [("2024-01-01", "2024-03-31"), ("2024-04-01", "2024-05-01")]),
    ],
)
def test_date_chunks(spark, start, stop, inclusive, want):
    ranges = spark.createDataFrame([("c", start, stop)], "city string, a string, b string").select("city", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    got = payload.date_chunks(ranges, "a", "b", inclusive=inclusive).orderBy("chunk_start").collect()
    assert [(r.chunk_start, r.chunk_end) for r in got] == want


def test_forecast_log_and_errors(spark, tmp_path):
    path = str(tmp_path / "log")
    features = build_features(panel(spark, station_series(100)))

    def rows(shift):
        return features.select(F.lit("g").alias("generated_at"), "city", F.col("datetime").alias("target_datetime"), (F.floor("aqi") + shift).cast("int").alias("predicted_aqi"))

    append_log(rows(9), path, 1)
    append_log(rows(3).where("predicted_aqi > 120"), path, 2)
    log = read_log(spark, path)
    assert log.count() == 100
    report = error_report(log, features).first()
    assert report["status"] == "ok" and report["scored_points"] == 100
    top = biggest_misses(log.join(features.select("city", F.col("datetime").alias("target_datetime"), F.col("aqi").alias("actual_aqi")), ["city", "target_datetime"]).withColumn("error", F.col("predicted_aqi") - F.col("actual_aqi"))).collect()
    assert len(top) == 5 and len(report["biggest_misses"]) == 5
    waiting = error_report(log.withColumn("target_datetime", F.col("target_datetime") + F.expr("interval 1 year")), features).first()
    assert waiting["status"] == "waiting for actuals" and waiting["scored_points"] == 0
