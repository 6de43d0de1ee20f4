"""Historical load and hourly refresh of the feature store."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.operators.blocks import suggest_block_seconds
from hazeline.operators.dedupe import keep_first, keep_last
from hazeline.operators.features import ROWS_BACK, build_features
from hazeline.schemas import AIR_QUALITY_VARS, WEATHER_VARS
from hazeline.session import materialize
from hazeline.sources.payload import air_quality, payload_rejects, raw_hourly, read_payloads, weather
from hazeline.sources.store import FeatureStore, missing_cities

RAW_COLUMNS = (*AIR_QUALITY_VARS, *WEATHER_VARS, "latitude", "longitude")


def load_raw(
    spark, air_path: str, weather_path: str, dim: DataFrame, *, dated: bool, keep: str = "first"
) -> tuple[DataFrame, DataFrame]:
    """(hourly rows, rejects) from landed files.

    Each feed has one row per station and hour before they are joined: the first copy, or
    with ``keep="last"`` the last, by the documents' ``seq`` and then the place in the
    document. Rejects (city, source, reason) never stop the load of other stations.
    """
    air = read_payloads(spark, air_path, AIR_QUALITY_VARS)
    wx = read_payloads(spark, weather_path, WEATHER_VARS)
    rejected = payload_rejects(air, AIR_QUALITY_VARS, dim).unionByName(payload_rejects(wx, WEATHER_VARS, dim))
    return raw_hourly(air_quality(air), weather(wx, dated=dated), dim, keep=keep), rejected


def _order(rows: DataFrame) -> list[str]:
    """Load order; without ``_seq`` the values decide, which is repeatable but not by time."""
    return [*[c for c in ("_seq",) if c in rows.columns], *[c for c in RAW_COLUMNS if c in rows.columns]]


def backfill(
    store: FeatureStore,
    raw: DataFrame,
    dim: DataFrame,
    *,
    resume: bool = True,
    block_seconds: int | None = None,
) -> None:
    """Loads stations that are not stored yet, all in one job.

    Overlapping requests repeat hours; the copy with the smallest ``_seq`` stays. The block
    length follows the densest station unless it is given.
    """
    todo = missing_cities(dim, store.cities()) if resume else dim
    rows = raw.join(todo.select(F.col("name").alias("city")), "city", "left_semi")
    unique = keep_first(rows, ["city", "datetime"], _order(rows)).drop("_seq")
    seconds = block_seconds or suggest_block_seconds(unique)
    store.upsert(build_features(unique, dropna_target=False, block_seconds=seconds))


def context_days(counts: DataFrame, span: DataFrame, rows: int) -> DataFrame:
    """(city, day) of the stored days that a refresh of ``span`` (city, first, last) has to read.

    All days from the first to the last fresh hour, and as many days before and after them
    as hold ``rows`` rows of the station. ``counts`` has a row per station and day.
    """
    days = counts.join(span.select("city", F.to_date("first").alias("_from"), F.to_date("last").alias("_to")), "city")
    backward = Window.partitionBy("city").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    forward = Window.partitionBy("city").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = days.where("day < _from").withColumn("_between", F.coalesce(F.sum("n").over(backward), F.lit(0)))
    after = days.where("day > _to").withColumn("_between", F.coalesce(F.sum("n").over(forward), F.lit(0)))
    within = days.where("day BETWEEN _from AND _to").withColumn("_between", F.lit(0).cast("long"))
    return before.unionByName(after).unionByName(within).where(F.col("_between") < rows).select("city", "day")


def with_context(store: FeatureStore, fresh: DataFrame, rows: int = ROWS_BACK) -> DataFrame:
    """Fresh hours and the stored hours around them; ``_write`` marks what the refresh changes.

    The windows of a fresh hour look back over stored hours, and those of the stored hours
    after it look back at it, so the latter are rebuilt as well. A fresh hour replaces the
    stored one.
    """
    span = fresh.groupBy("city").agg(F.min("datetime").alias("first"), F.max("datetime").alias("last"))
    columns = ["city", "datetime", *[c for c in RAW_COLUMNS if c in fresh.columns]]
    stored = store.days_of(context_days(store.day_counts(), span, rows)).select(*columns)
    others = stored.join(fresh.select("city", "datetime"), ["city", "datetime"], "left_anti")
    others = others.join(span.select("city", "first"), "city").withColumn("_write", F.col("datetime") >= F.col("first"))
    return fresh.select(*columns, F.lit(True).alias("_write")).unionByName(others.drop("first"))


def refresh(store: FeatureStore, recent: DataFrame, *, block_seconds: int | None = None) -> None:
    """Upserts recently fetched hours; the table is then as if built from all hours at once.

    Hours may be late, sparse or repeated (the highest ``_seq`` counts).
    """
    fresh = materialize(keep_last(recent, ["city", "datetime"], _order(recent)).drop("_seq"), "fresh")
    rows = with_context(store, fresh) if store.exists() else fresh.withColumn("_write", F.lit(True))
    rows = materialize(rows, "refresh")
    features = build_features(rows, dropna_target=False, block_seconds=block_seconds or suggest_block_seconds(rows))
    store.upsert(features.where("_write").drop("_write"))
