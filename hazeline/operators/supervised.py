"""Supervised rows: a target hour, the state some hours before, and the lead time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.clock import epoch_micros, from_epoch_micros
from hazeline.operators.blocks import BLOCK, DEFAULT_BLOCK_SECONDS, OWN, block_window, own_rows, with_halo
from hazeline.operators.features import feature_windows
from hazeline.operators.quantiles import quantile_scalar
from hazeline.operators.sampling import exact_sample

# Model inputs known for the target hour.
TARGET_TIME_FEATURES = (
    "temperature_2m",
    "relative_humidity_2m",
    "dew_point_2m",
    "apparent_temperature",
    "precipitation",
    "surface_pressure",
    "cloud_cover",
    "wind_speed_10m",
    "wind_gusts_10m",
    "wind_u",
    "wind_v",
    "hour_sin",
    "hour_cos",
    "month_sin",
    "month_cos",
    "dow_sin",
    "dow_cos",
    "is_weekend",
    "latitude",
    "longitude",
)
# State observed at forecast time.
ANCHOR_STATE = ("aqi", "aqi_roll_mean_6h", "aqi_roll_mean_24h", "aqi_roll_std_24h", "pm2_5", "pm10")
ANCHOR_COLUMNS = tuple(f"{c}_anchor" for c in ANCHOR_STATE)
FEATURE_COLUMNS = (*TARGET_TIME_FEATURES, *ANCHOR_COLUMNS, "horizon")
TARGET = "y_aqi"
HORIZONS = (1, 2, 3, 6, 12, 24, 36, 48, 60, 72)
SUPERVISED_COLUMNS = (*FEATURE_COLUMNS, TARGET, "city", "datetime")


def _explode_horizons(blocked: DataFrame, horizons) -> DataFrame:
    """Row τ once per horizon, with the state h rows earlier."""
    w = block_window()
    lagged = blocked.select(
        *TARGET_TIME_FEATURES,
        F.col("aqi").alias(TARGET),
        "city",
        "datetime",
        BLOCK,
        OWN,
        F.array(
            *[
                F.struct(
                    *[F.lag(c, h).over(w).alias(f"{c}_anchor") for c in ANCHOR_STATE],
                    F.lit(h).alias("horizon"),
                )
                for h in horizons
            ]
        ).alias("_states"),
    )
    rows = own_rows(lagged).select("*", F.inline("_states")).select(*SUPERVISED_COLUMNS)
    return rows.dropna(subset=[*ANCHOR_COLUMNS, TARGET])


def make_supervised(
    features: DataFrame,
    *,
    horizons=HORIZONS,
    max_rows: int | None = None,
    seed: int = 42,
    mode: str = "rows",
    block_seconds: int = DEFAULT_BLOCK_SECONDS,
) -> DataFrame:
    """Supervised rows from a stored feature table."""
    if mode == "rows":
        blocked = with_halo(features, rows_back=max(horizons), carry=list(ANCHOR_STATE), seconds=block_seconds)
        rows = _explode_horizons(blocked, horizons)
    elif mode == "time":
        rows = _join_states(features, horizons)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return _sampled(rows, max_rows, seed)


def supervised_from_raw(
    raw: DataFrame,
    *,
    horizons=HORIZONS,
    max_rows: int | None = None,
    seed: int = 42,
    block_seconds: int = DEFAULT_BLOCK_SECONDS,
) -> DataFrame:
    """Features and supervised rows in one pass, with one exchange for both windows."""
    features = feature_windows(raw, block_seconds=block_seconds, extra_rows=max(horizons))
    rows = _explode_horizons(features.where(F.col("aqi").isNotNull()), horizons)
    return _sampled(rows, max_rows, seed)


def _join_states(features: DataFrame, horizons) -> DataFrame:
    """Elapsed-time alignment: the state lies exactly h hours before the target."""
    later = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(h).alias("horizon"),
                    (F.col("datetime") + F.expr(f"interval {h} hours")).alias("_target"),
                )
                for h in horizons
            ]
        )
    )
    states = features.select(
        "city", "datetime", *[F.col(c).alias(f"{c}_anchor") for c in ANCHOR_STATE]
    ).select("city", *ANCHOR_COLUMNS, later)
    targets = features.select(*TARGET_TIME_FEATURES, F.col("aqi").alias(TARGET), "city", "datetime")
    joined = targets.join(states.withColumnRenamed("_target", "datetime"), ["city", "datetime"])
    return joined.select(*SUPERVISED_COLUMNS).dropna(subset=[*ANCHOR_COLUMNS, TARGET])


def _sampled(rows: DataFrame, max_rows, seed) -> DataFrame:
    if not max_rows:
        return rows
    return exact_sample(rows, max_rows, ["city", "datetime", "horizon"], seed)


def split_cutoff(rows: DataFrame, valid_fraction: float = 0.2):
    """Row-weighted quantile of the target times, as a naive timestamp literal."""
    micros = quantile_scalar(rows.select(epoch_micros(F.col("datetime")).alias("_t")), "_t", 1 - valid_fraction)
    return from_epoch_micros(F.lit(int(micros)))


def time_split(rows: DataFrame, *, valid_fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Past rows for training, the most recent ones for validation."""
    cutoff = split_cutoff(rows, valid_fraction)
    return rows.where(F.col("datetime") <= cutoff), rows.where(F.col("datetime") > cutoff)
