"""Air-quality index arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Index bins (lo, hi), shared by all pollutants.
INDEX_BINS = ((0, 50), (51, 100), (101, 150), (151, 200), (201, 300), (301, 500))

# Concentration bins (lo, hi) in µg/m³, aligned to INDEX_BINS.
CONCENTRATION_BINS = {
    "pm2_5": ((0.0, 9.0), (9.1, 35.4), (35.5, 55.4), (55.5, 125.4), (125.5, 225.4), (225.5, 500.4)),
    "pm10": ((0, 54), (55, 154), (155, 254), (255, 354), (355, 424), (425, 604)),
}

# Decimals kept by the published truncation rule.
TRUNCATE_DECIMALS = {"pm2_5": 1, "pm10": 0}

INDEX_POLLUTANTS = tuple(CONCENTRATION_BINS)
INDEX_CAP = 500.0

# Name, lo, hi, emoji, colour, advice.
CATEGORIES = (
    ("Good", 0, 50, "🟢", "#00e400", "Air quality is satisfactory; enjoy the outdoors."),
    ("Moderate", 51, 100, "🟡", "#ffde33", "Unusually sensitive people should limit prolonged outdoor exertion."),
    ("Unhealthy for Sensitive Groups", 101, 150, "🟠", "#ff9933", "Sensitive groups should reduce prolonged outdoor exertion."),
    ("Unhealthy", 151, 200, "🔴", "#ff5050", "Everyone may feel effects; limit outdoor exertion."),
    ("Very Unhealthy", 201, 300, "🟣", "#b25aff", "Health alert: avoid outdoor exertion; wear a mask outside."),
    ("Hazardous", 301, 500, "🟤", "#c81d3f", "Emergency: stay indoors and run air purifiers."),
)

HAZARD_THRESHOLD = 200


def sub_index(concentration: Column, pollutant: str, truncate: bool = False) -> Column:
    """Piecewise-linear sub-index; null for missing or negative input.

    The bins do not touch, and a value between two bins counts as off the scale.
    ``truncate=True`` applies the published rule (drop extra decimals first), which
    closes those gaps.
    """
    c = F.nanvl(concentration.cast("double"), F.lit(None).cast("double"))
    if truncate:
        unit = float(10 ** TRUNCATE_DECIMALS[pollutant])
        # the decimal cast keeps 35.4 at 35.4 where 35.4 * 10 would round below 354
        c = (F.floor(c.cast("decimal(28,9)") * F.lit(int(unit))) / F.lit(unit)).cast("double")
    index = F.when(c < 0, None)
    for (c_lo, c_hi), (i_lo, i_hi) in zip(CONCENTRATION_BINS[pollutant], INDEX_BINS):
        slope = (i_hi - i_lo) / (c_hi - c_lo)
        line = F.lit(slope) * (c - F.lit(float(c_lo))) + F.lit(float(i_lo))
        index = index.when(c.between(float(c_lo), float(c_hi)), line)
    return index.when(c.isNotNull(), F.lit(INDEX_CAP)).cast("double")


def sub_indices(df: DataFrame, pollutants=INDEX_POLLUTANTS, truncate: bool = False) -> dict[str, Column]:
    """``aqi_<pollutant>`` expressions for the pollutants the frame has."""
    return {f"aqi_{p}": sub_index(F.col(p), p, truncate) for p in pollutants if p in df.columns}


def overall_index(df: DataFrame, truncate: bool = False) -> Column:
    """Worst sub-index, rounded half-even; nulls are skipped."""
    parts = list(sub_indices(df, truncate=truncate).values())
    if not parts:
        return F.lit(None).cast("double")
    worst = F.greatest(*parts) if len(parts) > 1 else parts[0]
    return F.bround(worst, 0)


def target_index(df: DataFrame, truncate: bool = False) -> Column:
    """Vendor index where present, own index elsewhere."""
    own = overall_index(df, truncate)
    if "us_aqi" not in df.columns:
        return own
    return F.coalesce(F.nanvl(F.col("us_aqi").cast("double"), F.lit(None).cast("double")), own)


def _by_category(value: Column, position: int) -> Column:
    """Attribute of the first category whose upper bound holds the value; missing counts as the first."""
    out = F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(CATEGORIES[0][position]))
    for category in CATEGORIES[:-1]:
        out = out.when(value <= category[2], F.lit(category[position]))
    return out.otherwise(F.lit(CATEGORIES[-1][position]))


def category_name(value: Column) -> Column:
    return _by_category(value, 0)


def category_color(value: Column) -> Column:
    return _by_category(value, 4)


def category_advice(value: Column) -> Column:
    return _by_category(value, 5)


def is_hazardous(value: Column, threshold: float = HAZARD_THRESHOLD) -> Column:
    clean = F.nanvl(value.cast("double"), F.lit(None).cast("double"))
    return F.coalesce(clean > F.lit(threshold), F.lit(False))
