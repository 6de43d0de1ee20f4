import pytest
from pyspark.sql import functions as F

from hazeline.functions import index
from hazeline.operators.alerts import forecast_alerts
from hazeline.sources import dims


def values(spark, name, data, *columns):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(data)], f"i int, {name} double")
    return [r[1] for r in rows.select("i", *columns).orderBy("i").collect()]


def test_sub_index_ends_gaps_and_bad_values(spark):
    pm = index.sub_index(F.col("c"), "pm2_5")
    assert values(spark, "c", [0.0, 9.0, 9.1, 35.4, 55.5, 500.4], pm) == [0, 50, 51, 100, 151, 500]
    assert values(spark, "c", [9.05, None, -1.0, 600.0, float("nan")], pm) == [500, None, None, 500, None]
    assert values(spark, "c", [54.5], index.sub_index(F.col("c"), "pm10")) == [500]


def test_truncation_closes_the_gaps(spark):
    cut = index.sub_index(F.col("c"), "pm2_5", truncate=True)
    assert values(spark, "c", [9.05, 35.4, 35.49], cut) == [50, 100, 100]
    assert values(spark, "c", [54.5], index.sub_index(F.col("c"), "pm10", truncate=True)) == [50]


def test_sub_index_rises(spark):
    got = values(spark, "c", [1.0, 5.0, 10.0, 20.0, 40.0, 60.0], index.sub_index(F.col("c"), "pm2_5"))
    assert got == sorted(got)


def test_overall_uses_particles_only_and_skips_nulls(spark):
    rows = spark.createDataFrame(
        [(1, 9.0, 10.0, 3000.0), (2, None, 54.0, 1.0), (3, None, None, 1.0)],
        "i int, pm2_5 double, pm10 double, carbon_monoxide double",
    )
    got = [r[0] for r in rows.select("i", index.overall_index(rows).alias("a")).orderBy("i").select("a").collect()]
    assert got == [50, 50, None]
    one = rows.select("i", "pm10")
    assert [r[0] for r in one.select("i", index.overall_index(one).alias("a")).orderBy("i").select("a").collect()] == [9, 50, None]


def test_vendor_index_wins_unrounded(spark):
    rows = spark.createDataFrame([(71.4, 9.0, 1.0), (None, 9.0, 1.0)], "us_aqi double, pm2_5 double, pm10 double")
    assert {r[0] for r in rows.select(index.target_index(rows)).collect()} == {71.4, 50.0}


def test_categories(spark):
    data = [None, 50.0, 50.4, 51.0, 150.0, 301.0, 900.0]
    assert values(spark, "v", data, index.category_name(F.col("v"))) == [
        "Good", "Good", "Moderate", "Moderate", "Unhealthy for Sensitive Groups", "Hazardous", "Hazardous",
    ]
    for a, b in zip(index.CATEGORIES, index.CATEGORIES[1:]):
        assert b[1] == a[2] + 1


def test_hazard_is_strict_and_null_is_safe(spark):
    assert values(spark, "v", [250.0, 200.0, 150.0, None], index.is_hazardous(F.col("v"))) == [True, False, False, False]


@pytest.mark.parametrize(
    "series, severity, first, peak",
    [([149, 150, 150], "warning", 1, 1), ([100, 200, 250, 250], "danger", 1, 2), ([10], "none", None, 0)],
)
def test_alerts(spark, series, severity, first, peak):
    rows = spark.createDataFrame(
        [("A", f"2024-01-01 {i:02d}:00:00", float(v)) for i, v in enumerate(series)], "city string, t string, aqi double"
    ).select("city", F.col("t").cast("timestamp_ntz").alias("datetime"), "aqi")
    got = forecast_alerts(rows).first()
    assert (got.severity, got.peak_time.hour) == (severity, peak)
    assert (got.first_exceed_time and got.first_exceed_time.hour) == first


def test_dimensions(spark):
    assert dims.cities(spark).count() == 22
    assert dims.find_city(dims.cities(spark), "lAHORE").first()["slug"] == "lahore"
    assert dims.find_city(dims.cities(spark), "Atlantis").count() == 0
    assert dims.breakpoints(spark).count() == 12
    punjab = dims.cities_by_province(dims.cities(spark)).where("province = 'Punjab'").first()["cities"]
    assert punjab == sorted(punjab) and len(punjab) == 8
