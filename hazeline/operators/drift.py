"""Feature drift: population stability index of a recent window against the past."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.operators.quantiles import quantiles
from hazeline.session import literal_table, materialize

# Watched features in report order, and the status limits.
DRIFT_FEATURES = (
    "aqi",
    "pm2_5",
    "pm10",
    "temperature_2m",
    "relative_humidity_2m",
    "wind_speed_10m",
    "surface_pressure",
)
RECENT_DAYS = 14
BINS = 10
MIN_REFERENCE, MIN_RECENT, MIN_EDGES = 50, 20, 3
EPSILON = 1e-6
STABLE_BELOW, MODERATE_BELOW = 0.1, 0.25


def drift_status(psi: Column) -> Column:
    return F.when(psi < STABLE_BELOW, "stable").when(psi < MODERATE_BELOW, "moderate").otherwise("significant")


def _unpivot(df: DataFrame, features) -> DataFrame:
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features]
    )
    return df.select("recent", F.inline(pairs)).where(F.col("value").isNotNull())


def population_stability(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """``rows(feature, value, recent)``, read twice -> PSI per feature, 0 where there is too little to compare.

    Bin edges are the distinct deciles of the reference part, rounded so that equal
    deciles stay equal; the outer bins are open.
    """
    fractions = [i / bins for i in range(bins + 1)]
    reference = rows.where(~F.col("recent"))
    found = quantiles(reference, ["feature"], "value", fractions)
    edges = materialize(
        found.select("feature", F.array_distinct(F.transform("q", lambda x: F.round(x, 9))).alias("edges")), "drift-edges"
    )
    # one row per feature, so the broadcast side is as long as the feature list; inner edges become
    # columns, so that a value is binned by plain comparisons
    inner = [f"_edge{i}" for i in range(1, bins)]
    wide = edges.select(
        "feature", *[F.when(F.size("edges") > i + 1, F.get("edges", F.lit(i))).alias(c) for i, c in enumerate(inner, 1)]
    )
    bin_of = sum((F.coalesce((F.col("value") >= F.col(c)).cast("int"), F.lit(0)) for c in inner), F.lit(0))
    counts = (
        rows.join(F.broadcast(wide), "feature", "left")
        .groupBy("feature", bin_of.alias("bin"))
        .agg(F.count_if(~F.col("recent")).alias("ref"), F.count_if(F.col("recent")).alias("cur"))
        .groupBy("feature")
        .agg(
            F.map_from_entries(F.collect_list(F.struct("bin", F.struct("ref", "cur")))).alias("filled"),
            F.sum("ref").alias("n_ref"),
            F.sum("cur").alias("n_cur"),
        )
        .join(F.broadcast(edges), "feature", "left")
    )

    def term(b):
        found = F.try_element_at("filled", b)
        ref = F.coalesce(found["ref"], F.lit(0)) / F.nullif(F.col("n_ref"), F.lit(0)) + F.lit(EPSILON)
        cur = F.coalesce(found["cur"], F.lit(0)) / F.nullif(F.col("n_cur"), F.lit(0)) + F.lit(EPSILON)
        return (cur - ref) * F.ln(cur / ref)

    every_bin = F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))
    psi = F.aggregate(F.transform(every_bin, term), F.lit(0.0), lambda s, x: s + x)
    comparable = (
        (F.col("n_ref") >= MIN_REFERENCE) & (F.col("n_cur") >= MIN_RECENT) & (F.size("edges") >= MIN_EDGES)
    )
    return counts.select("feature", F.when(comparable, psi).otherwise(F.lit(0.0)).alias("psi"))


def mark_recent(features: DataFrame, recent_days: int = RECENT_DAYS) -> DataFrame:
    """Adds ``recent``: the last days before the newest row, over all stations."""
    newest = features.agg(F.max("datetime")).scalar()
    return features.withColumn("recent", F.col("datetime") >= newest - F.expr(f"interval {recent_days} days"))


def _watched_rows(features: DataFrame, recent_days: int, watched) -> tuple[DataFrame, list[str]]:
    """The watched columns with ``recent``, stored, as every step of a report reads them."""
    present = [f for f in watched if f in features.columns]
    narrow = materialize(features.select("datetime", *present), "drift-rows")
    return mark_recent(narrow, recent_days), present


def _scored(marked: DataFrame, present: list[str], bins: int) -> DataFrame:
    scored = population_stability(_unpivot(marked, present), bins)
    schema = T.StructType([T.StructField("position", T.IntegerType()), T.StructField("feature", T.StringType())])
    listed = literal_table(marked.sparkSession, list(enumerate(present)), schema)
    psi = F.coalesce("psi", F.lit(0.0))
    return listed.join(scored, "feature", "left").select(
        "position", "feature", psi.alias("psi"), drift_status(psi).alias("status")
    )


def drift_by_feature(
    features: DataFrame, *, recent_days: int = RECENT_DAYS, watched=DRIFT_FEATURES, bins: int = BINS
) -> DataFrame:
    """PSI and status of every watched feature; the table is read once, for all features."""
    return _scored(*_watched_rows(features, recent_days, watched), bins)


def drift_report(features: DataFrame, *, recent_days: int = RECENT_DAYS, watched=DRIFT_FEATURES) -> DataFrame:
    """One row: window sizes, overall status, worst feature, and the per-feature list.

    The worst feature is the first in list order among those with the largest rounded PSI.
    """
    marked, present = _watched_rows(features, recent_days, watched)
    per_feature = _scored(marked, present, BINS).select(
        "position", "feature", F.round("psi", 3).alias("psi"), "status"
    )
    first_of_worst = F.max_by(F.struct("feature", "status"), F.struct("psi", (-F.col("position")).alias("p")))
    summary = per_feature.agg(
        first_of_worst.alias("worst"),
        F.sort_array(F.collect_list(F.struct("position", "feature", "psi", "status"))).alias("features"),
    )
    sizes = marked.agg(
        F.count_if(~F.col("recent")).alias("reference_rows"), F.count_if(F.col("recent")).alias("recent_rows")
    )
    return summary.select(
        F.lit(recent_days).alias("recent_days"),
        sizes.select("reference_rows").scalar().alias("reference_rows"),
        sizes.select("recent_rows").scalar().alias("recent_rows"),
        F.col("worst.status").alias("overall_status"),
        F.col("worst.feature").alias("worst_feature"),
        "features",
    )
