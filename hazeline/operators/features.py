"""Feature table: target, calendar, wind, change, lag and rolling columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.functions.clock import calendar_columns, cyclical_columns, epoch_seconds
from hazeline.functions.index import category_name, target_index
from hazeline.functions.wind import wind_columns
from hazeline.operators.blocks import (
    BLOCK,
    DEFAULT_BLOCK_SECONDS,
    own_rows,
    with_halo,
    with_time_halo,
)

# The windows of the feature table.
LAGS = (1, 3, 6, 12, 24)
ROLLING = (6, 24)
SERIES = ("aqi", "pm2_5", "pm10")
DAY_OFFSET = 24

ROWS_BACK = max(*LAGS, *ROLLING, DAY_OFFSET)
HOUR = 3600


def add_target(df: DataFrame, truncate: bool = False) -> DataFrame:
    """``aqi`` (vendor index, else own index) and its category."""
    with_aqi = df.withColumn("aqi", target_index(df, truncate))
    return with_aqi.withColumn("aqi_category", category_name(F.col("aqi")))


def row_columns(df: DataFrame) -> dict:
    """Columns that depend on their own row only."""
    time = F.col("datetime")
    out = {**calendar_columns(time), **cyclical_columns(time)}
    if {"wind_speed_10m", "wind_direction_10m"} <= set(df.columns):
        out |= wind_columns(F.col("wind_speed_10m"), F.col("wind_direction_10m"))
    out["timestamp"] = epoch_seconds(time)
    return out


# Window frames over the rows or the clock of one block, as SQL text.
BLOCK_ROWS = f"PARTITION BY city, {BLOCK} ORDER BY datetime"
BLOCK_CLOCK = f"PARTITION BY city, {BLOCK} ORDER BY unix_seconds(CAST(datetime AS timestamp))"


@dataclass(frozen=True)
class Offsets:
    """Window columns, and the feature columns made from them, as SQL text.

    Each window is evaluated once, however many features use it.
    """

    windows: dict[str, str]
    derived: dict[str, str]

    def apply(self, blocked: DataFrame, row: dict) -> DataFrame:
        helpers = [n for n in self.windows if n.startswith("_")]
        windowed = blocked.select("*", *[F.expr(f"{e} AS {n}") for n, e in self.windows.items()])
        derived = [F.expr(f"{e} AS {n}") for n, e in self.derived.items()]
        kept = [c for c in windowed.columns if c not in helpers]
        return windowed.select(*kept, *[e.alias(n) for n, e in row.items()], *derived)


def _offsets(columns, at, frame) -> Offsets:
    """Change, lag and rolling columns; ``at(column, n)`` is the value n hours back."""
    series = [c for c in SERIES if c in columns]
    windows = {f"{c}_lag_{n}h": at(c, n) for c in series for n in LAGS}
    derived = {
        "aqi_change_1h": "aqi - aqi_lag_1h",
        "aqi_change_24h": f"aqi - aqi_lag_{DAY_OFFSET}h",
        "aqi_change_rate": "(aqi - aqi_lag_1h) / nullif(aqi_lag_1h, 0)",
    }
    for c in series:
        for n in ROLLING:
            over = f"OVER ({frame(n)})"
            windows[f"_{c}_n_{n}h"] = f"count({c}) {over}"
            for name, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")):
                windows[f"_{c}_{name}_{n}h"] = f"{fn}({c}) {over}"
                derived[f"{c}_roll_{name}_{n}h"] = f"CASE WHEN _{c}_n_{n}h >= {max(2, n // 2)} THEN _{c}_{name}_{n}h END"
    return Offsets(windows, derived)


def row_offsets(columns) -> Offsets:
    """Offsets count rows: "n hours" means n rows."""
    return _offsets(
        columns,
        lambda c, n: f"lag({c}, {n}) OVER ({BLOCK_ROWS})",
        lambda n: f"{BLOCK_ROWS} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING",
    )


def clock_offsets(columns) -> Offsets:
    """Offsets are elapsed time; a missing hour gives a missing value."""

    def span(first, last):
        return f"{BLOCK_CLOCK} RANGE BETWEEN {first} PRECEDING AND {last} PRECEDING"

    return _offsets(
        columns,
        lambda c, n: f"max({c}) OVER ({span(n * HOUR, n * HOUR)})",
        lambda n: span(n * HOUR, 1),
    )


def feature_windows(
    raw: DataFrame,
    *,
    block_seconds: int = DEFAULT_BLOCK_SECONDS,
    extra_rows: int = 0,
    truncate: bool = False,
) -> DataFrame:
    """Blocked feature rows, halo included.

    ``extra_rows`` is what a later window over the same blocks looks back, counted in
    rows with a target. The later window then needs no exchange of its own.
    """
    rows = add_target(raw, truncate)
    carry = rows.columns if extra_rows else [c for c in SERIES if c in rows.columns]
    blocked = with_halo(
        rows,
        rows_back=ROWS_BACK + extra_rows,
        carry=carry,
        seconds=block_seconds,
        counted=F.col("aqi").isNotNull() if extra_rows else None,
    )
    return row_offsets(rows.columns).apply(blocked, row_columns(rows))


def build_features(
    raw: DataFrame,
    *,
    dropna_target: bool = True,
    mode: str = "rows",
    block_seconds: int = DEFAULT_BLOCK_SECONDS,
    truncate: bool = False,
) -> DataFrame:
    """Feature table of all stations; no value crosses a station.

    ``mode="rows"`` counts offsets in rows, ``mode="time"`` in elapsed hours.
    Rows without a target go only after the windows have used them.
    """
    if mode == "rows":
        blocked = feature_windows(raw, block_seconds=block_seconds, truncate=truncate)
    elif mode == "time":
        rows = with_time_halo(add_target(raw, truncate), seconds_back=ROWS_BACK * HOUR, seconds=block_seconds)
        blocked = clock_offsets(rows.columns).apply(rows, row_columns(rows))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    out = own_rows(blocked)
    return out.where(F.col("aqi").isNotNull()) if dropna_target else out

