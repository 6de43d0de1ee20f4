"""Sliding windows of past hours with the index some hours later."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazeline.operators.blocks import (
    BLOCK,
    DEFAULT_BLOCK_SECONDS,
    OWN,
    block_directory,
    series_positions,
    with_halo,
)
from hazeline.operators.metrics import error_columns
from hazeline.operators.models import ridge_penalty
from hazeline.operators.supervised import split_cutoff

# Window length, lead, step between windows, window columns.
LENGTH = 48
LEAD = 24
STRIDE = 6
SEQUENCE_FEATURES = (
    "aqi",
    "pm2_5",
    "pm10",
    "temperature_2m",
    "relative_humidity_2m",
    "wind_speed_10m",
    "surface_pressure",
    "hour_sin",
    "hour_cos",
    "month_sin",
    "month_cos",
    "latitude",
    "longitude",
)


def build_sequences(
    features: DataFrame,
    *,
    length: int = LENGTH,
    lead: int = LEAD,
    stride: int = STRIDE,
    columns=SEQUENCE_FEATURES,
    block_seconds: int = DEFAULT_BLOCK_SECONDS,
) -> DataFrame:
    """``end`` (row index after the window), ``datetime`` there, ``window`` and ``target``.

    A block and the rows before it are one sorted array; windows are cut out of it at the
    stride's ends alone, ``lead - 1`` rows before their target row, so they only look back.
    Windows with a missing value are left out.
    """
    directory = block_directory(features, key="city", time="datetime", seconds=block_seconds)
    rows_back = length + lead - 1
    blocked = with_halo(
        features.select("city", "datetime", *columns),
        rows_back=rows_back,
        carry=list(columns),
        seconds=block_seconds,
    )
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    step = F.struct(*[F.col(c).cast("float").alias(c) for c in columns])
    row = F.struct("datetime", F.col(OWN).alias("own"), complete.alias("ok"), step.alias("step"), F.col("aqi").cast("float").alias("target"))
    listed = blocked.groupBy("city", BLOCK).agg(F.sort_array(F.collect_list(row)).alias("s"))
    placed = listed.join(series_positions(directory), ["city", BLOCK])
    # the p-th place (from 1) holds the target of the window that ends at series row p + shift
    before = F.size(F.filter("s", lambda r: ~r["own"]))
    shift = F.col("rows_before") - before - lead
    first = F.greatest(before + 1, F.lit(length) - shift).cast("long")
    start = first + F.pmod(F.lit(length) - first - shift, F.lit(stride))
    last = F.least(F.size("s"), F.col("series_rows") - lead - 1 - shift).cast("long")
    targets = F.when(start <= last, F.sequence(start, last, F.lit(stride).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def cut(p: Column) -> Column:
        window = F.slice("s", (p - rows_back).cast("int"), F.lit(length))
        target = F.get("s", (p - 1).cast("int"))
        return F.struct(
            (p + F.col("shift")).alias("end"),
            F.get("s", (p - lead).cast("int"))["datetime"].alias("datetime"),
            F.when(F.size(F.filter(window, lambda r: r["ok"])) == length, window["step"]).alias("window"),
            target["target"].alias("target"),
        )

    cuts = placed.select("city", "s", shift.alias("shift"), targets.alias("targets"))
    # a place with fewer rows before it than the window takes holds no window
    able = F.filter("targets", lambda p: p > rows_back)
    return cuts.select("city", F.inline(F.transform(able, cut))).where("window IS NOT NULL AND target IS NOT NULL").select("city", "end", "datetime", "window", "target")


def sequence_baseline(sequences: DataFrame, *, valid_fraction: float = 0.2) -> DataFrame:
    """Error of "stays as it is" on the most recent sequences."""
    cutoff = split_cutoff(sequences, valid_fraction)
    last = F.element_at("window", -1)["aqi"]
    valid = sequences.where(F.col("datetime") > cutoff).withColumn("persistence", last)
    return valid.agg(*error_columns("target", "persistence"))


def flatten_windows(sequences: DataFrame, columns=SEQUENCE_FEATURES) -> DataFrame:
    """Adds ``flat``: the window as one array of doubles, oldest hour first."""
    steps = F.transform("window", lambda s: F.array(*[s[c].cast("double") for c in columns]))
    return sequences.withColumn("flat", F.flatten(steps))


def compare_regressor(flat: DataFrame, *, valid_fraction: float = 0.2, alpha: float = 1.0) -> DataFrame:
    """Ridge on the flattened window and persistence on the same recent sequences.

    The scaling is fitted on the training part, per window position.
    """
    cutoff = split_cutoff(flat, valid_fraction)
    rows = flat.select(
        "datetime",
        F.col("target").cast("double").alias("target"),
        F.element_at("window", -1)["aqi"].cast("double").alias("persistence"),
        array_to_vector("flat").alias("assembled"),
    )
    train = rows.where(F.col("datetime") <= cutoff)
    valid = rows.where(F.col("datetime") > cutoff)
    n, sd = train.agg(F.count("target"), F.stddev_pop("target")).first()
    scaler = StandardScaler(inputCol="assembled", outputCol="features", withMean=True, withStd=True)
    # several hundred near-collinear inputs: an iterative solver instead of the normal equations
    regression = LinearRegression(labelCol="target", regParam=ridge_penalty(alpha, n, sd), standardization=False, solver="l-bfgs")
    model = Pipeline(stages=[scaler, regression]).fit(train)
    scored = model.transform(valid)
    ridge = scored.agg(*error_columns("target", "prediction")).withColumn("model", F.lit("Ridge on window"))
    base = scored.agg(*error_columns("target", "persistence")).withColumn("model", F.lit("Persistence (baseline)"))
    return ridge.unionByName(base).select("model", "rmse", "mae", "r2")
