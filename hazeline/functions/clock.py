"""Calendar, cyclical and epoch expressions over naive timestamps."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names, January first.
MONTH_NAMES = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def epoch_seconds(time: Column) -> Column:
    """Naive wall clock read as UTC (the session zone is pinned to UTC)."""
    return F.unix_seconds(time.cast("timestamp"))


def epoch_micros(time: Column) -> Column:
    return F.unix_micros(time.cast("timestamp"))


def from_epoch_micros(micros: Column) -> Column:
    return F.timestamp_micros(micros.cast("long")).cast("timestamp_ntz")


def calendar_columns(time: Column) -> dict[str, Column]:
    """Hour, day, month, weekday (Monday 0), day of year and weekend flag."""
    weekday = F.weekday(time)
    return {
        "hour": F.hour(time),
        "day": F.dayofmonth(time),
        "month": F.month(time),
        "day_of_week": weekday,
        "day_of_year": F.dayofyear(time),
        "is_weekend": (weekday >= 5).cast("int"),
    }


def cyclical_columns(time: Column) -> dict[str, Column]:
    """Sine and cosine of hour, month and weekday on their circles."""
    out = {}
    for prefix, value, period in (
        ("hour", F.hour(time), 24),
        ("month", F.month(time), 12),
        ("dow", F.weekday(time), 7),
    ):
        angle = F.lit(2 * math.pi) * value / F.lit(float(period))
        out[f"{prefix}_sin"] = F.sin(angle)
        out[f"{prefix}_cos"] = F.cos(angle)
    return out


def month_name(month: Column) -> Column:
    return F.element_at(F.array(*[F.lit(m) for m in MONTH_NAMES]), month.cast("int"))


def lead_hours(target: Column, now: Column) -> Column:
    """Whole hours from ``now`` to ``target``, half-even."""
    return F.bround((epoch_seconds(target) - epoch_seconds(now)) / F.lit(3600.0), 0).cast("int")


def iso_text(time: Column) -> Column:
    return F.date_format(time.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")


def date_text(time: Column) -> Column:
    return F.date_format(time.cast("timestamp"), "yyyy-MM-dd")
