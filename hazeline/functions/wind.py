"""Wind speed and direction as two components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wind_columns(speed: Column, direction: Column) -> dict[str, Column]:
    angle = F.radians(direction)
    return {"wind_u": speed * F.cos(angle), "wind_v": speed * F.sin(angle)}
