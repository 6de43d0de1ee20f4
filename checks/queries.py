"""One query per operator, each over whole given tables."""

from __future__ import annotations

from datetime import timedelta
from functools import wraps

from pyspark.ml import Pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks.panels import block_seconds, hourly, hourly_with_gaps, readings, station_dim, stored_once, table
from hazeline import schemas
from hazeline.functions import clock, index, text
from hazeline.operators import (
    alerts,
    attribution,
    boosting,
    dedupe,
    drift,
    explore,
    features,
    folds,
    forecast,
    leaderboard,
    metrics,
    models,
    normal,
    scenario,
    scoring,
    sequences,
    supervised,
)
from hazeline.operators.sampling import exact_sample
from hazeline.plans import evaluation, inference, ingest, reports, training
from hazeline.session import materialize, pin_utc, scratch_path
from hazeline.sources import dims, payload, store
from hazeline.sources.bundle import ModelBundle, load_bundle, save_bundle
from hazeline.streaming import jobs

QUERIES: dict = {}
DIGITS = 6
KEY = ("city", "datetime")


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(fn(pin_utc(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return run


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that engines may add in different orders."""
    return df.selectExpr(
        *[
            f"round(`{f.name}`, {DIGITS}) + 0D AS `{f.name}`"
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def reading_features(spark, sf_dir) -> DataFrame:
    return features.build_features(readings(spark, sf_dir), block_seconds=block_seconds(spark, sf_dir))


def hourly_features(spark, sf_dir) -> DataFrame:
    return features.build_features(hourly(spark, sf_dir))


def derive_supervised(spark, sf_dir) -> DataFrame:
    return supervised.supervised_from_raw(readings(spark, sf_dir), block_seconds=block_seconds(spark, sf_dir))


def supervised_table(spark, sf_dir) -> DataFrame:
    """Written once: the queries on top read it several times."""
    return stored_once(spark, sf_dir, derive_supervised)


def stored_hourly_features(spark, sf_dir) -> DataFrame:
    return stored_once(spark, sf_dir, hourly_features)


def hourly_supervised(spark, sf_dir) -> DataFrame:
    return supervised.make_supervised(stored_hourly_features(spark, sf_dir))


def target_rows(spark, sf_dir) -> DataFrame:
    """Readings with their index; enough for queries that use no windows."""
    return features.add_target(readings(spark, sf_dir)).where(F.col("aqi").isNotNull())


# --- index ---------------------------------------------------------------------------


@query
def sub_indices(spark, sf_dir):
    raw = readings(spark, sf_dir)
    cut = {f"{k}_truncated": v for k, v in index.sub_indices(raw, truncate=True).items()}
    columns = index.sub_indices(raw) | cut
    return raw.select(*KEY, *[c.alias(n) for n, c in columns.items()])


@query
def overall_aqi(spark, sf_dir):
    raw = readings(spark, sf_dir)
    return raw.select(*KEY, index.overall_index(raw).alias("aqi"))


@query
def aqi_category(spark, sf_dir):
    raw = readings(spark, sf_dir)
    aqi = F.col("pm2_5")
    return raw.select(
        *KEY,
        index.category_name(aqi).alias("category"),
        index.category_color(aqi).alias("color"),
        index.category_advice(aqi).alias("advice"),
        index.is_hazardous(aqi).alias("hazardous"),
    )


@query
def category_lookup(spark, sf_dir):
    counts = target_rows(spark, sf_dir).groupBy(F.col("aqi_category").alias("name")).agg(
        F.count(F.lit(1)).alias("hours")
    )
    return counts.join(dims.categories(spark), "name").select("name", "lo", "hi", "color", "hours")


@query
def breakpoint_bins(spark, sf_dir):
    """Readings per concentration bin (range join with the 12-row breakpoint table)."""
    long = readings(spark, sf_dir).select(
        F.inline(
            F.array(
                *[F.struct(F.lit(p).alias("pollutant"), F.col(p).alias("c")) for p in index.INDEX_POLLUTANTS]
            )
        )
    )
    bins = dims.breakpoints(spark)
    joined = long.join(
        F.broadcast(bins),
        (long.pollutant == bins.pollutant) & long.c.between(bins.c_lo, bins.c_hi),
    )
    return joined.groupBy(bins.pollutant, "c_lo", "i_lo").agg(F.count(F.lit(1)).alias("n_readings"))


@query
def target_derivation(spark, sf_dir):
    return target_rows(spark, sf_dir).select(*KEY, "aqi", "aqi_category")


# --- row features --------------------------------------------------------------------


@query
def calendar_features(spark, sf_dir):
    raw = readings(spark, sf_dir)
    columns = clock.calendar_columns(F.col("datetime")) | clock.cyclical_columns(F.col("datetime"))
    return raw.select(*KEY, *[c.alias(n) for n, c in columns.items()])


@query
def wind_vectors(spark, sf_dir):
    raw = readings(spark, sf_dir)
    return raw.select(*KEY, *[F.col(c) for c in ("wind_speed_10m", "wind_direction_10m")], *[
        c.alias(n) for n, c in features.wind_columns(F.col("wind_speed_10m"), F.col("wind_direction_10m")).items()
    ])


@query
def epoch_key(spark, sf_dir):
    return readings(spark, sf_dir).select(*KEY, clock.epoch_seconds(F.col("datetime")).alias("timestamp"))


@query
def station_location(spark, sf_dir):
    return readings(spark, sf_dir).select(*KEY, "latitude", "longitude")


@query
def type_normalizer(spark, sf_dir):
    rows = readings(spark, sf_dir).select(
        *KEY, F.hour("datetime").alias("hour"), (F.col("pm2_5") > 50).alias("dirty"),
        clock.epoch_seconds(F.col("datetime")).alias("timestamp"),
    )
    return store.normalize_types(rows)


@query
def city_slug(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    shouted = F.upper(F.concat("c_name", F.lit(" "), "c_mktsegment"))
    return customers.select(
        "c_custkey",
        text.slug(shouted).alias("slug"),
        text.same_name(shouted, F.concat("c_name", F.lit(" building"))).alias("is_building"),
    )


@query
def time_text(spark, sf_dir):
    return readings(spark, sf_dir).select(
        *KEY,
        clock.iso_text(F.col("datetime")).alias("iso"),
        clock.date_text(F.col("datetime")).alias("date"),
        clock.month_name(F.month("datetime")).alias("month_name"),
    )


# --- windows -------------------------------------------------------------------------


@query
def lag_features(spark, sf_dir):
    rows = reading_features(spark, sf_dir)
    return rows.select(*KEY, *[f"{c}_lag_{n}h" for c in features.SERIES for n in features.LAGS])


@query
def change_rates(spark, sf_dir):
    return reading_features(spark, sf_dir).select(*KEY, "aqi_change_1h", "aqi_change_24h", "aqi_change_rate")


@query
def rolling_features(spark, sf_dir):
    rows = reading_features(spark, sf_dir)
    return rows.select(*KEY, *[c for c in rows.columns if "_roll_" in c])


@query
def feature_table(spark, sf_dir):
    return reading_features(spark, sf_dir)


@query
def feature_table_hourly(spark, sf_dir):
    return hourly_features(spark, sf_dir)


@query
def feature_table_clock(spark, sf_dir):
    """Offsets in elapsed hours, over the panel with missing hours."""
    rows = features.build_features(hourly(spark, sf_dir), mode="time")
    return rows.select(*KEY, *[c for c in rows.columns if "_lag_" in c or "_roll_" in c or "_change_" in c])


# --- supervised ----------------------------------------------------------------------


@query
def supervised_rows(spark, sf_dir):
    return supervised.supervised_from_raw(readings(spark, sf_dir), block_seconds=block_seconds(spark, sf_dir))


@query
def supervised_clock(spark, sf_dir):
    """State exactly h hours before the target hour."""
    stored = stored_hourly_features(spark, sf_dir)
    return supervised.make_supervised(stored, mode="time").select(
        *KEY, "horizon", "y_aqi", *supervised.ANCHOR_COLUMNS
    )


@query
def supervised_sample(spark, sf_dir):
    rows = supervised_table(spark, sf_dir)
    return supervised.exact_sample(rows, 5000, ["city", "datetime", "horizon"], portable=True)


@query
def sample_size(spark, sf_dir):
    rows = supervised_table(spark, sf_dir)
    sample = supervised.exact_sample(rows, 5000, ["city", "datetime", "horizon"])
    return sample.agg(F.count(F.lit(1)).alias("n_rows"))


@query
def time_split_counts(spark, sf_dir):
    rows = supervised_table(spark, sf_dir)
    cutoff = supervised.split_cutoff(rows)
    part = F.when(F.col("datetime") <= cutoff, "train").otherwise("valid")
    return rows.groupBy(part.alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min("datetime").alias("first"), F.max("datetime").alias("last")
    )


def _persistence(rows: DataFrame) -> DataFrame:
    return rows.withColumn("prediction", F.col("aqi_anchor"))


@query
def persistence_by_horizon(spark, sf_dir):
    return metrics.horizon_metrics(_persistence(supervised_table(spark, sf_dir)))


@query
def residual_intervals(spark, sf_dir):
    # read once and three columns of it only, so nothing wide is stored
    return metrics.residual_intervals(_persistence(derive_supervised(spark, sf_dir)))


@query
def walk_forward_folds(spark, sf_dir):
    folded = folds.assign_folds(supervised_table(spark, sf_dir))
    return folds.fold_report(_persistence(folded), 5)


@query
def fold_summary(spark, sf_dir):
    folded = folds.assign_folds(supervised_table(spark, sf_dir))
    return metrics.fold_summary(folds.fold_report(_persistence(folded), 5))


# --- exploration ---------------------------------------------------------------------


@query
def city_ranking(spark, sf_dir):
    return explore.city_ranking(target_rows(spark, sf_dir))


@query
def monthly_profile(spark, sf_dir):
    return explore.monthly_profile(target_rows(spark, sf_dir))


@query
def diurnal_profile(spark, sf_dir):
    return explore.diurnal_profile(target_rows(spark, sf_dir))


@query
def dataset_summary(spark, sf_dir):
    return explore.dataset_summary(target_rows(spark, sf_dir))


@query
def dataset_findings(spark, sf_dir):
    return explore.findings(target_rows(spark, sf_dir))


@query
def weather_correlation(spark, sf_dir):
    return explore.weather_correlation(target_rows(spark, sf_dir))


@query
def aqi_histogram(spark, sf_dir):
    return explore.aqi_histogram(target_rows(spark, sf_dir))


@query
def history_summary(spark, sf_dir):
    return explore.history_summary(target_rows(spark, sf_dir))


# --- monitoring ----------------------------------------------------------------------


@query
def psi_by_feature(spark, sf_dir):
    return drift.drift_by_feature(target_rows(spark, sf_dir)).select("feature", "psi", "status")


@query
def drift_report(spark, sf_dir):
    return drift.drift_report(target_rows(spark, sf_dir)).drop("features")


def forecast_log(spark, sf_dir) -> DataFrame:
    """Each hour's index as the forecast for the row 24 rows later, logged twice."""
    rows = stored_hourly_features(spark, sf_dir).where(F.col("aqi_lag_24h").isNotNull())
    runs = F.array(*[F.struct(F.lit(b).cast("long").alias("batch"), F.lit(b * 3).alias("shift")) for b in (1, 2)])
    return rows.select("*", F.inline(runs)).select(
        F.date_format((F.col("datetime") - F.expr("interval 24 hours")).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"),
        "city",
        F.col("datetime").alias("target_datetime"),
        (F.col("aqi_lag_24h") + F.col("shift")).cast("int").alias("predicted_aqi"),
        "batch",
    )


@query
def forecast_log_latest(spark, sf_dir):
    return scoring.latest_log(forecast_log(spark, sf_dir))


@query
def forecast_scores(spark, sf_dir):
    return scoring.score_forecasts(scoring.latest_log(forecast_log(spark, sf_dir)), stored_hourly_features(spark, sf_dir))


@query
def forecast_error(spark, sf_dir):
    log = scoring.latest_log(forecast_log(spark, sf_dir))
    return scoring.error_report(log, stored_hourly_features(spark, sf_dir)).drop("biggest_misses")


@query
def monitoring_answers(spark, sf_dir):
    """Drift and forecast error as one client asks for them."""
    rows = stored_hourly_features(spark, sf_dir)
    found = reports.monitoring(rows, scoring.latest_log(forecast_log(spark, sf_dir)))
    drifted = found["drift"].select("recent_days", "reference_rows", "recent_rows", "overall_status", "worst_feature")
    return drifted.join(F.broadcast(found["forecast_error"].select("scored_points", "mae", "rmse")))


@query
def biggest_misses(spark, sf_dir):
    log = scoring.latest_log(forecast_log(spark, sf_dir))
    return scoring.biggest_misses(scoring.score_forecasts(log, stored_hourly_features(spark, sf_dir)))


# --- store and ingest ----------------------------------------------------------------


@query
def payload_scan(spark, sf_dir):
    docs = payload_documents(hourly(spark, sf_dir))
    return payload.raw_hourly(payload.air_quality(docs[0]), payload.weather(docs[1]), station_dim(spark))


@query
def payload_rejects(spark, sf_dir):
    air, _ = payload_documents(hourly(spark, sf_dir))
    return payload.split_payloads(air)[1].groupBy("city", "source").agg(F.count(F.lit(1)).alias("documents"))


def payload_documents(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vendor-shaped documents per station and day (24 hours at most).

    Day 13 of every station comes without times; the weather feed misses every 7th hour.
    """

    def documents(rows, variables, source):
        step = F.struct(F.date_format(F.col("datetime").cast("timestamp"), "yyyy-MM-dd'T'HH:mm").alias("time"), *variables)
        day = rows.groupBy("city", F.to_date("datetime").alias("day")).agg(F.sort_array(F.collect_list(step)).alias("h"))
        times = F.when(F.dayofmonth("day") != 13, F.col("h.time"))
        return day.select(
            "city",
            F.lit(source).alias("source"),
            F.struct(times.alias("time"), *[F.col(f"h.{v}").alias(v) for v in variables]).alias("hourly"),
        )

    seen = raw.where(F.hour("datetime") % 7 != 0)
    return (
        documents(raw, schemas.AIR_QUALITY_VARS, payload.AIR_QUALITY),
        documents(seen, schemas.WEATHER_VARS, payload.FORECAST),
    )


@query
def feature_upsert(spark, sf_dir):
    rows = features.add_target(hourly(spark, sf_dir)).withColumn("timestamp", clock.epoch_seconds(F.col("datetime")))
    rows = rows.select("city", "timestamp", "aqi", "pm10")
    stored = rows.where(F.hour(F.timestamp_seconds("timestamp")) % 3 != 0)
    changed = rows.where(F.hour(F.timestamp_seconds("timestamp")) % 2 == 0)
    first = changed.withColumn("aqi", F.col("aqi") + 1).withColumn("_seq", F.lit(1))
    second = changed.where(F.col("pm10") > 50).withColumn("aqi", F.col("aqi") + 2).withColumn("_seq", F.lit(2))
    return store.merge_batches(stored, first.unionByName(second))


@query
def keep_first_copy(spark, sf_dir):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *order)
    return dedupe.keep_first(items, ["l_orderkey", "l_linenumber"], order)


@query
def keep_last_copy(spark, sf_dir):
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *order)
    return dedupe.keep_last(items, ["l_orderkey", "l_linenumber"], order)


@query
def resume_missing(spark, sf_dir):
    """Documents without labels, as stations that still have to be loaded."""
    wanted = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("name"), "source")
    stored = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("city")).distinct()
    return store.missing_cities(wanted, stored)


@query
def stored_cities(spark, sf_dir):
    """Users as stations of a stored table, named by the store."""
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("city"), F.col("ts").alias("datetime"), clock.epoch_seconds(F.col("ts")).alias("timestamp"), F.col("value").alias("aqi")
    )
    target = store.FeatureStore(spark, scratch_path(spark, "store"))
    target.upsert(rows)
    return target.cities()


def _order_ranges(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(
        F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("stop")
    )


@query
def range_chunks(spark, sf_dir):
    return payload.date_chunks(_order_ranges(spark, sf_dir), "start", "stop")


@query
def range_chunks_inclusive(spark, sf_dir):
    return payload.date_chunks(_order_ranges(spark, sf_dir), "start", "stop", inclusive=True)


@query
def refreshed_store(spark, sf_dir):
    """Load the past, refresh the last days, read the table back."""
    raw = hourly(spark, sf_dir)
    split = raw.agg(F.max("datetime")).first()[0].replace(minute=0)
    cut = F.lit(str(split)).cast("timestamp_ntz") - F.expr("interval 7 days")
    target = store.FeatureStore(spark, scratch_path(spark, "store"))
    ingest.backfill(target, raw.where(F.col("datetime") < cut), station_dim(spark))
    ingest.refresh(target, raw.where(F.col("datetime") >= cut))
    return target.read().select(*KEY, "timestamp", "aqi", "aqi_lag_24h", "aqi_roll_mean_24h", "aqi_change_rate")


REFRESHED = ("timestamp", "aqi", "aqi_lag_1h", "aqi_lag_24h", "aqi_roll_mean_24h", "aqi_change_rate", "pm10_roll_std_6h")


@query
def refresh_late(spark, sf_dir):
    """A week in the middle arrives after the days that follow it; some hours have no target."""
    raw = hourly_with_gaps(spark, sf_dir)
    day = F.dayofmonth("datetime")
    target = store.FeatureStore(spark, scratch_path(spark, "store"))
    ingest.backfill(target, raw.where(day < 10), station_dim(spark))
    ingest.refresh(target, raw.where(day >= 17))
    ingest.refresh(target, raw.where((day >= 10) & (day < 17)))
    return target.read().select(*KEY, *REFRESHED)


@query
def refresh_sparse_duplicates(spark, sf_dir):
    """Every 11th hour comes again, first wrong and then corrected, all in one batch."""
    raw = hourly_with_gaps(spark, sf_dir)
    sparse = F.hour("datetime") % 11 == 0
    target = store.FeatureStore(spark, scratch_path(spark, "store"))
    ingest.backfill(target, raw.where(~sparse | (F.dayofmonth("datetime") > 12)).withColumn("us_aqi", F.when(~sparse, F.col("us_aqi"))), station_dim(spark))
    right = raw.where(sparse).withColumn("_seq", F.lit(2))
    wrong = right.withColumn("us_aqi", F.lit(499.0)).withColumn("_seq", F.lit(1))
    ingest.refresh(target, right.unionByName(wrong))
    return target.read().select(*KEY, *REFRESHED)


@query
def ingest_rejects(spark, sf_dir):
    """Reasons why documents, or hours of them, give no rows."""
    docs, _ = payload_documents(hourly(spark, sf_dir))
    day = F.dayofmonth(F.element_at("hourly.time", 1).cast("timestamp_ntz"))
    short = F.col("hourly").withField("pm10", F.slice("hourly.pm10", 1, 1))
    broken = F.col("hourly").withField("time", F.transform("hourly.time", lambda t, i: F.when(i == 0, F.lit("soon")).otherwise(t)))
    hours = F.when((day == 5) & (F.size("hourly.time") > 1), short).when(day == 7, broken).otherwise(F.col("hourly"))
    known = station_dim(spark).where("name != 'view'")
    found = payload.payload_rejects(docs.withColumn("hourly", hours), schemas.AIR_QUALITY_VARS, known)
    return found.groupBy("city", "source", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def province_cities(spark, sf_dir):
    """Nations with suppliers, grouped by region."""
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    used = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    grouped = dims.cities_by_province(used.select(F.col("n_name").alias("name"), F.col("r_name").alias("province")))
    return grouped.select("province", F.array_join("cities", ",").alias("cities"))


# --- leaderboard ---------------------------------------------------------------------


def _order_runs(spark, sf_dir):
    """Orders as training runs: one board per priority."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("board"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderstatus").alias("model"),
        (F.col("o_totalprice") / F.lit(7777.0)).alias("rmse"),
    )


@query
def leaderboard_history(spark, sf_dir):
    """One board per priority, versions in key order."""
    runs = _order_runs(spark, sf_dir)
    return leaderboard.gate_history(runs, board="board", order="run_id", block=F.floor(F.col("run_id") / F.lit(4_000)))


@query
def leaderboard_margin(spark, sf_dir):
    """The same boards under a gate that asks for a margin; the errors rise and fall by season, so champions linger."""
    runs = _order_runs(spark, sf_dir).withColumn("rmse", F.col("rmse") + F.lit(25.0) / (F.lit(1.0) + F.floor(F.col("run_id") / F.lit(500))))
    return leaderboard.gate_history(runs, board="board", order="run_id", block=F.floor(F.col("run_id") / F.lit(4_000)), margin=0.75)


@query
def best_candidate(spark, sf_dir):
    """Smallest mean error per ship mode group, the baseline left out."""
    results = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(
        F.avg(F.col("o_totalprice") / F.lit(7777.0)).alias("rmse")
    )
    return leaderboard.best_candidate(results, "5-LOW")


# --- forecast ------------------------------------------------------------------------


def as_of(raw: DataFrame):
    """Three days before the newest hour."""
    newest = raw.agg(F.max("datetime")).scalar()
    return newest - F.expr("interval 72 hours")


def forecast_rows(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(inputs with persistence as prediction, persistence intervals) on the hourly panel."""
    rows = stored_hourly_features(spark, sf_dir)
    inputs = forecast.forecast_inputs(rows, as_of(rows))
    intervals = metrics.residual_intervals(_persistence(stored_once(spark, sf_dir, hourly_supervised)))
    return _persistence(inputs), materialize(intervals, "intervals")


@query
def as_of_anchor(spark, sf_dir):
    rows = stored_hourly_features(spark, sf_dir)
    return forecast.anchors(rows, as_of(hourly(spark, sf_dir)))


@query
def next_hours(spark, sf_dir):
    raw = hourly(spark, sf_dir)
    return forecast.next_rows(raw, raw.agg(F.min("datetime")).scalar() + F.expr("interval 100 hours")).select(*KEY, "step", "pm10")


@query
def forecast_inputs(spark, sf_dir):
    rows = stored_hourly_features(spark, sf_dir)
    return forecast.forecast_inputs(rows, as_of(hourly(spark, sf_dir)))


@query
def forecast_from_store(spark, sf_dir):
    """Model input read from a store, of which only the days around the forecast time are scanned."""
    raw = hourly_with_gaps(spark, sf_dir)
    target = store.FeatureStore(spark, scratch_path(spark, "store"))
    ingest.backfill(target, raw, station_dim(spark))
    now = str(raw.agg(F.max("datetime")).first()[0] - timedelta(hours=72))
    found = forecast.forecast_inputs(target.around(now, forecast.HORIZON_HOURS), now)
    return found.withColumn("is_weekend", F.col("is_weekend").cast("int"))  # stored as a double


@query
def skipped_stations(spark, sf_dir):
    """Users, as stations, that have no reading in the last day."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("city"), F.col("ts").alias("datetime"))
    return forecast.stations_without_future(rows, rows.agg(F.max("datetime")).scalar() - F.expr("interval 1 day"))


@query
def nearest_horizon_interval(spark, sf_dir):
    scored, intervals = forecast_rows(spark, sf_dir)
    rows = forecast.attach_intervals(scored, intervals)
    lower, upper = forecast.interval_bounds(F.col("prediction"), F.col("low"), F.col("high"))
    return rows.select(*KEY, "horizon", "low", "high", lower.alias("lower"), upper.alias("upper"))


@query
def forecast_hours(spark, sf_dir):
    scored, intervals = forecast_rows(spark, sf_dir)
    return forecast.hourly_forecast(scored, intervals)


@query
def daily_rollup(spark, sf_dir):
    scored, intervals = forecast_rows(spark, sf_dir)
    return forecast.daily_rollup(forecast.hourly_forecast(scored, intervals))


@query
def current_index(spark, sf_dir):
    scored, _ = forecast_rows(spark, sf_dir)
    return forecast.current_index(scored)


@query
def hazard_alerts(spark, sf_dir):
    """The whole measured series as the forecast to scan."""
    return alerts.forecast_alerts(target_rows(spark, sf_dir).select(*KEY, "aqi"))


@query
def forecast_alerts(spark, sf_dir):
    scored, intervals = forecast_rows(spark, sf_dir)
    return alerts.forecast_alerts(forecast.hourly_forecast(scored, intervals))


def documents(spark, sf_dir) -> DataFrame:
    scored, intervals = forecast_rows(spark, sf_dir)
    return inference.forecast_documents(scored, intervals, station_dim(spark), "run-1")


@query
def forecast_documents(spark, sf_dir):
    return scoring.flatten_documents(documents(spark, sf_dir))


@query
def json_documents(spark, sf_dir):
    """The documents as written for other programs, read back and flattened."""
    made, path = documents(spark, sf_dir), scratch_path(spark, "json")
    inference.write_json(made, path)
    return scoring.flatten_documents(spark.read.schema(made.schema).json(path))


@query
def listed_cities(spark, sf_dir):
    """Places as a client lists them, with their newest hour."""
    newest = hourly(spark, sf_dir).groupBy(F.col("city").alias("name")).agg(F.max("datetime").alias("newest"))
    return reports.list_cities(station_dim(spark)).join(newest, "name")


@query
def forecast_lookup(spark, sf_dir):
    """Summaries of every station and of one that does not exist."""
    names = [r[0] for r in station_dim(spark).select("name").collect()] + ["nowhere"]
    found = reports.get_forecast(documents(spark, sf_dir), names)
    return found.select(
        "city", "province", "current_aqi", "current_category", "peak_aqi_next_3_days", "peak_category",
        F.size("daily_forecast").alias("days"), F.col("alert.severity").alias("severity"), "error",
    )


@query
def history_lookup(spark, sf_dir):
    return reports.get_history(target_rows(spark, sf_dir), ["view", "nowhere"])


# --- scenarios -----------------------------------------------------------------------


def scenarios(spark, sf_dir) -> DataFrame:
    """One scenario per customer, its settings drawn from the row; some settings are empty."""
    c = F.col("c_custkey")
    names = F.array(*[F.lit(s) for s in ("click", "error", "purchase", "signup", "view")])
    horizons = F.array(*[F.lit(h) for h in supervised.HORIZONS])
    return table(spark, sf_dir, "customer").select(
        c.cast("string").alias("scenario_id"),
        F.get(names, (c % 5).cast("int")).alias("city"),
        F.get(horizons, (c % 10).cast("int")).alias("horizon"),
        F.when(c % 2 == 0, (c % 400).cast("double")).alias("pm2_5"),
        F.when(c % 3 == 0, (c % 500).cast("double")).alias("aqi_now"),
        F.when(c % 4 != 0, (c % 40).cast("double")).alias("wind_speed"),
        F.when(c % 7 == 0, (c % 100).cast("double")).alias("humidity"),
        F.when(c % 11 != 0, (c % 50 - 5).cast("double")).alias("temperature"),
    )


def _scenario_base(spark, sf_dir):
    rows = stored_hourly_features(spark, sf_dir)
    asked = scenarios(spark, sf_dir)
    return scenario.base_vectors(rows, asked, as_of(rows)), asked, rows


@query
def scenario_base(spark, sf_dir):
    return _scenario_base(spark, sf_dir)[0]


@query
def scenario_features(spark, sf_dir):
    base, asked, _ = _scenario_base(spark, sf_dir)
    return scenario.scenario_inputs(base, asked)


@query
def scenario_defaults(spark, sf_dir):
    return scenario.setting_defaults(_scenario_base(spark, sf_dir)[0])


@query
def scenario_deltas(spark, sf_dir):
    """Scenario scores under a fixed linear rule instead of a fitted model."""
    base, asked, _ = _scenario_base(spark, sf_dir)

    def rule(rows):
        value = F.col("aqi_anchor") * 0.6 + F.col("pm2_5_anchor") * 0.3 - F.col("wind_speed_10m") * 0.5
        return rows.withColumn("prediction", value + F.col("temperature_2m") * 0.1)

    return scenario.simulate(base, asked, rule)


@query
def scenario_scores(spark, sf_dir):
    base, asked, rows = _scenario_base(spark, sf_dir)
    train = stored_once(spark, sf_dir, hourly_supervised)
    fitted = models.fit_candidates(train, {"Ridge": models.ridge(train)})["Ridge"]
    return scenario.simulate(base, asked, fitted.predict)


# --- sequences -----------------------------------------------------------------------


def sequence_inputs(spark, sf_dir) -> DataFrame:
    """The feature columns that windows hold; the others are not computed."""
    return reading_features(spark, sf_dir).select(*KEY, *sequences.SEQUENCE_FEATURES)


def _sequences(spark, sf_dir):
    rows = stored_once(spark, sf_dir, sequence_inputs)
    return sequences.build_sequences(rows, block_seconds=block_seconds(spark, sf_dir))


@query
def sequence_windows(spark, sf_dir):
    windows = _sequences(spark, sf_dir)

    def mean(c):
        return F.aggregate("window", F.lit(0.0), lambda s, x: s + x[c].cast("double")) / F.size("window")

    return windows.select(
        "city", "end", "datetime", F.col("target").cast("double").alias("target"), F.size("window").alias("steps"),
        *[F.round(mean(c), 3).alias(f"{c}_mean") for c in sequences.SEQUENCE_FEATURES],
        F.element_at("window", 1)["aqi"].cast("double").alias("oldest_aqi"),
        F.element_at("window", -1)["aqi"].cast("double").alias("newest_aqi"),
    )


@query
def sequence_baseline(spark, sf_dir):
    return sequences.sequence_baseline(stored_once(spark, sf_dir, _sequences))


@query
def sequence_regressor(spark, sf_dir):
    """Ridge on the flattened window against persistence, same task and split."""
    rows = sequences.flatten_windows(stored_once(spark, sf_dir, _sequences))
    return sequences.compare_regressor(rows)


# --- models --------------------------------------------------------------------------


def _split(spark, sf_dir):
    return supervised.time_split(supervised_table(spark, sf_dir))


def _fitted_metrics(spark, sf_dir, name, build):
    train, valid = _split(spark, sf_dir)
    return models.compare(valid, models.fit_candidates(train, {name: build(train)}))


@query
def ridge_metrics(spark, sf_dir):
    train, valid = _split(spark, sf_dir)
    return models.compare(valid, {"Ridge": normal.fit_ridge(train)})


@query
def forest_metrics(spark, sf_dir):
    """120 trees of depth 16 on all older rows, compared on all recent rows."""
    return _fitted_metrics(spark, sf_dir, "RandomForest", lambda _: models.forest())


@query
def boosted_metrics(spark, sf_dir):
    """600 rounds of depth 8 on a sample of ``FIT_ROWS`` rows, compared on all recent rows."""
    train, valid = _split(spark, sf_dir)
    sample = training.fitting_rows(train)
    return models.compare(valid, models.fit_candidates(sample, {"GradientBoosting": boosting.HistogramBoosting()}))


@query
def walk_forward_boosted(spark, sf_dir):
    """The backtest of the boosted ensemble with 400 rounds a fold."""
    return evaluation.walk_forward_boosted(supervised_table(spark, sf_dir))


@query
def walk_forward_ridge(spark, sf_dir):
    return evaluation.walk_forward_ridge(supervised_table(spark, sf_dir))


@query
def walk_forward_two_inputs(spark, sf_dir):
    """The backtest of a ridge on two inputs, whose coefficients have a closed form."""
    return evaluation.walk_forward_ridge(supervised_table(spark, sf_dir), features=("aqi_anchor", "temperature_2m"), alpha=300.0)


ONE_INPUT = ("aqi_anchor",)
ONE_INPUT_ALPHA = 900.0


def _bundle(spark, sf_dir) -> tuple[ModelBundle, DataFrame]:
    """A saved and reloaded model of one input, whose numbers SQL can give, with intervals from the recent rows."""
    rows = stored_hourly_features(spark, sf_dir)
    train, valid = supervised.time_split(stored_once(spark, sf_dir, hourly_supervised))
    fitted = models.fit_candidates(train, {"Ridge": models.ridge(train, ONE_INPUT, alpha=ONE_INPUT_ALPHA)})["Ridge"]
    intervals = metrics.residual_intervals(fitted.predict(valid))
    bundle = ModelBundle("Ridge", fitted.model, intervals, "2024-01-01T00:00:00", feature_columns=ONE_INPUT)
    path = scratch_path(spark, "bundle")
    save_bundle(spark, bundle, path)
    return load_bundle(spark, path), rows


@query
def forecast_72h(spark, sf_dir):
    """Saved and reloaded model, every station: values, bounds and categories of the next hours."""
    bundle, rows = _bundle(spark, sf_dir)
    return forecast.hourly_forecast(inference.score_hours(rows, bundle, as_of(rows)), bundle.intervals)


@query
def explained_forecast(spark, sf_dir):
    bundle, rows = _bundle(spark, sf_dir)
    explained = inference.explanations(inference.score_hours(rows, bundle, as_of(rows)), bundle)
    return explained.select("city", "explanation.*").drop("contributors")


@query
def explanation_lookup(spark, sf_dir):
    """Explanations of every station and of one that does not exist, as a client asks for them."""
    bundle, rows = _bundle(spark, sf_dir)
    scored = materialize(inference.score_hours(rows, bundle, as_of(rows)), "scored")
    made = inference.forecast_documents(scored, bundle.intervals, station_dim(spark), "run-1", inference.explanations(scored, bundle))
    names = [r[0] for r in station_dim(spark).select("name").collect()] + ["nowhere"]
    found = reports.get_explanation(made, names)
    return found.select("city", "explanation", F.get("top_drivers", F.lit(0))["label"].alias("driver"), "for_time", "error")


@query
def trained_run(spark, sf_dir):
    """A training run on one-input models: errors of all families, the promoted one, and what the saved bundle predicts."""
    rows = stored_hourly_features(spark, sf_dir)
    path, board = scratch_path(spark, "model"), scratch_path(spark, "board")

    def families(train):
        return {"Ridge": models.ridge(train, ONE_INPUT, alpha=ONE_INPUT_ALPHA), "Flat": models.ridge(train, ONE_INPUT, alpha=1e9)}

    run = training.train(rows, pipelines=families, model_path=path, leaderboard_path=board, trained_at="run-1")
    champion = leaderboard.load_leaderboard(spark, board).where("is_champion").select(F.col("model").alias("champion"), "n_train", "n_valid", "version")
    scored = load_bundle(spark, path).predict(stored_once(spark, sf_dir, hourly_supervised))
    means = scored.agg(F.avg("prediction").alias("mean_prediction"))
    return run.results.join(F.broadcast(champion)).join(F.broadcast(means))


RULE = {"aqi_anchor": (0.5, 100.0), "pm2_5_anchor": (0.25, 40.0), "wind_u": (-1.5, 0.0), "temperature_2m": (0.75, 20.0), "relative_humidity_2m": (-0.125, 60.0), "surface_pressure": (0.0625, 1000.0), "horizon": (0.25, 24.0)}
RULE_BASE = 90.0


def _by_rule(rows: DataFrame) -> DataFrame:
    """Contributions under a fixed linear rule: weight times distance from a fixed middle."""
    phi = F.array(*[F.lit(w) * (F.col(c).cast("double") - F.lit(m)) for c, (w, m) in RULE.items()])
    return rows.withColumns({"base": F.lit(RULE_BASE), "phi": phi})


@query
def explained_rule(spark, sf_dir):
    """Sentence and top contributors of every future hour under the rule."""
    rows = stored_hourly_features(spark, sf_dir)
    found = attribution.explain(_by_rule(forecast.forecast_inputs(rows, as_of(rows))), tuple(RULE))
    said = F.array_join(F.transform("contributors", lambda c: F.concat_ws(":", c["feature"], c["label"])), ",")
    return found.select(*KEY, "horizon", "explained", "text", said.alias("drivers"), F.get("contributors", F.lit(0))["impact"].alias("largest"))


@query
def impact_bars_rule(spark, sf_dir):
    rows = stored_hourly_features(spark, sf_dir)
    return attribution.impact_bars(attribution.explain(_by_rule(forecast.forecast_inputs(rows, as_of(rows))), tuple(RULE)))


@query
def importance_rule(spark, sf_dir):
    """Mean size of the rule's contributions over all supervised rows, the five largest."""
    return attribution.global_importance(_by_rule(supervised_table(spark, sf_dir)), tuple(RULE), k=5)


@query
def linear_attribution(spark, sf_dir):
    train = supervised_table(spark, sf_dir)
    model = models.fit_candidates(train, {"r": models.ridge(train)})["r"]
    rows = attribution.explain(attribution.linear_attribution(model.predict(train), model.model))
    exact = F.abs(F.col("explained") - F.col("prediction")) < 1e-6
    return rows.select(*KEY, "horizon", exact.alias("exact"), "base")


def _boosted_once(spark, sf_dir):
    """The full-size ensemble of the oldest rows; fitted once for the queries on top of it."""
    if (spark, sf_dir) not in _boosted:
        train, _ = _split(spark, sf_dir)
        _boosted.clear()
        _boosted[spark, sf_dir] = boosting.HistogramBoosting().fit(training.fitting_rows(train))
    return _boosted[spark, sf_dir]


_boosted: dict = {}
EXPLAINED_ROWS = 3_000
# Few rows with much work each are dealt out to so many tasks.
PARTS = 32


@query
def tree_attribution(spark, sf_dir):
    """Exact contributions of the full-size ensemble to the prediction of every row."""
    rows = supervised_table(spark, sf_dir)
    model = _boosted_once(spark, sf_dir)
    # much work a row: even parts, each at most the rows that are explained together
    parts = max(spark.sparkContext.defaultParallelism, -(-rows.count() // attribution.EXPLAINED_TOGETHER))
    asked = model.transform(rows.repartition(parts))
    explained = attribution.explain(attribution.tree_attribution(asked, model))
    exact = F.abs(F.col("explained") - F.col("prediction")) < 1e-6
    return explained.select(*KEY, "horizon", exact.alias("exact"))


@query
def global_importance(spark, sf_dir):
    """Mean size of the contributions over an exact sample, as large as the report's."""
    sample = exact_sample(supervised_table(spark, sf_dir), EXPLAINED_ROWS, ["city", "datetime", "horizon"]).repartition(PARTS)
    return attribution.global_importance(attribution.tree_attribution(sample, _boosted_once(spark, sf_dir)), k=attribution.TOP_FEATURES)


@query
def impact_bars(spark, sf_dir):
    bundle, rows = _bundle(spark, sf_dir)
    scored = inference.peak_hours(inference.score_hours(rows, bundle, as_of(rows)))
    return attribution.impact_bars(attribution.explain(inference.attribute(scored, bundle), bundle.feature_columns))


@query
def feature_labels(spark, sf_dir):
    """Mean of every measured variable under its reader-facing label."""
    rows = target_rows(spark, sf_dir)
    names = [*schemas.AIR_QUALITY_VARS, *schemas.WEATHER_VARS]
    means = rows.agg(*[F.avg(c).alias(c) for c in names])
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("mean")) for c in names])
    return means.select(F.inline(pairs)).withColumn("label", text.feature_label(F.col("feature")))


@query
def scaling_statistics(spark, sf_dir):
    """Mean and deviation of every model input, as the fitted scaler holds them."""
    train, _ = _split(spark, sf_dir)
    fitted = Pipeline(stages=models.scaling()).fit(models.numeric_inputs(train))
    scaler = fitted.stages[-1]
    rows = list(zip(supervised.FEATURE_COLUMNS, scaler.mean.toArray().tolist(), scaler.std.toArray().tolist(), strict=True))
    return spark.createDataFrame(rows, "feature string, mean double, sd double")


@query
def ridge_one_feature(spark, sf_dir):
    """Ridge on one input, whose coefficients have a closed form, on the recent rows."""
    train, valid = _split(spark, sf_dir)
    build = models.ridge(train, features=("aqi_anchor",), alpha=5000.0)
    fitted = models.Fitted("Ridge", build.fit(models.numeric_inputs(train))).predict(valid)
    return fitted.agg(*metrics.error_columns("y_aqi", "prediction"), F.avg("prediction").alias("mean_prediction"))


@query
def evaluation_tables(spark, sf_dir):
    """Folds of the evaluation report, written as JSON and read back: sizes, dates and bounded errors."""
    bundle, rows = _bundle(spark, sf_dir)
    path = scratch_path(spark, "report")
    evaluation.write_report(evaluation.evaluate(rows, bundle, pipeline=models.ridge), path)
    found = spark.read.json(f"{path}/walk_forward")
    return found.select("fold", "train_rows", "test_rows", "test_from", (F.col("rmse") > 0).alias("has_error"))


@query
def recorded_runs(spark, sf_dir):
    """Orders of each year as one training run, recorded in turn and loaded again."""
    years = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(
        (F.avg("o_totalprice") / F.lit(7777.0)).alias("rmse"), F.count(F.lit(1)).alias("n")
    )
    path = scratch_path(spark, "leaderboard")
    for r in years.orderBy("y").collect():
        errors = {"A": {"rmse": r["rmse"], "mae": r["rmse"] / 2, "r2": 0.5}}
        leaderboard.record_run(spark, path, errors, "A", trained_at=str(r["y"]), n_train=r["n"], n_valid=1)
    loaded = leaderboard.load_leaderboard(spark, path)
    return loaded.select("version", "trained_at", "model", "rmse", "n_train", "promoted", "is_champion", "prev_champion_rmse")


@query
def forecast_any_place(spark, sf_dir):
    """Forecast document of a place that is no station, from rows and coordinates alone."""
    raw = hourly(spark, sf_dir).where("city = 'view'")
    _, intervals = forecast_rows(spark, sf_dir)
    document = inference.forecast_place(raw, "Somewhere", 12.5, 45.25, _persistence, intervals, as_of=as_of(hourly(spark, sf_dir)), generated_at="run-1")
    return document.select("city", "lat", "lon", "province", F.inline("hourly"))


# --- streaming -----------------------------------------------------------------------


@query
def stream_refresh(spark, sf_dir):
    """Hourly rows arriving as files, the newest first, refreshed in one batch each, read back."""
    source = scratch_path(spark, "landed")
    raw = hourly_with_gaps(spark, sf_dir)
    third = F.floor((F.dayofmonth("datetime") - 1) / 10)
    for n in (2, 0, 1):
        raw.where(third == n if n < 2 else third >= n).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(raw.schema).option("maxFilesPerTrigger", 1).parquet(source)
    target = store.FeatureStore(spark, scratch_path(spark, "store"))
    jobs.start_refresh(stream, target, scratch_path(spark, "offsets")).awaitTermination()
    return target.read().select(*KEY, "aqi", "aqi_lag_24h", "aqi_roll_std_24h")


@query
def stream_unique(spark, sf_dir):
    """Each hour lands twice; one copy stays."""
    source, out = scratch_path(spark, "landed"), scratch_path(spark, "unique")
    raw = hourly(spark, sf_dir)
    raw.unionByName(raw).write.parquet(source)
    unique = jobs.unique_observations(spark.readStream.schema(raw.schema).parquet(source))
    (
        unique.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", scratch_path(spark, "offsets"))
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.schema(unique.schema).parquet(out).select(*KEY, "pm10")


@query
def stream_scoring(spark, sf_dir):
    """Forecasts and actual values as two streams, and the error of every day."""
    rows = stored_hourly_features(spark, sf_dir)
    logged, actual, out = (scratch_path(spark, n) for n in ("log", "actual", "scores"))
    log = rows.where(F.col("aqi_lag_24h").isNotNull()).select(
        "city", F.col("datetime").alias("target_datetime"), F.col("aqi_lag_24h").alias("predicted_aqi")
    )
    log.write.parquet(logged)
    actual_rows = rows.select("city", "datetime", "aqi")
    actual_rows.write.parquet(actual)
    pairs = jobs.score_live(
        spark.readStream.schema(log.schema).parquet(logged),
        spark.readStream.schema(actual_rows.schema).parquet(actual),
    )
    jobs.start_scoring(pairs, out, scratch_path(spark, "offsets")).awaitTermination()
    return jobs.daily_scores(spark, out).withColumn("day", F.col("day").cast("timestamp_ntz"))
