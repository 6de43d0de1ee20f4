"""Small hand-made panels."""

import numpy as np
import pandas as pd

from hazeline import schemas


def station_series(hours=240, city="Lahore", lat=31.5, lon=74.3):
    """Hourly readings of one station: a daily saw-tooth plus a bounded random walk."""
    rng = np.random.default_rng(len(city) * 101 + hours)
    start = pd.Timestamp("2024-01-01")
    clock = np.arange(hours)
    saw = np.abs((clock % 24) - 12) / 12.0
    drift = np.clip(np.cumsum(rng.normal(0, 1.5, hours)), -12, 12)
    load = 100 + 55 * saw + drift
    values = {name: np.round(rng.gamma(4.0, 5.0, hours), 2) for name in (*schemas.AIR_QUALITY_VARS, *schemas.WEATHER_VARS)}
    values |= {"us_aqi": np.round(load, 2), "pm2_5": np.round(load * 0.41, 2), "pm10": np.round(load * 0.73 + 4, 2)}
    values["wind_direction_10m"] = np.round(rng.uniform(0, 359.5, hours), 1)
    values["temperature_2m"] = np.round(22 - 9 * saw + rng.normal(0, 0.5, hours), 2)
    frame = pd.DataFrame({"datetime": start + pd.to_timedelta(clock, unit="h"), "city": city, **values, "latitude": lat, "longitude": lon})
    return frame[schemas.RAW_HOURLY.names]


def gappy(seed, hours=600, city="A", drop=0.4, missing=0.15):
    """Random values, missing hours (one long gap) and missing readings."""
    rng = np.random.default_rng(seed)
    frame = station_series(hours, city)
    for c in ("pm2_5", "pm10", "us_aqi"):
        frame[c] = np.round(rng.uniform(0, 400, hours), 1)
        frame.loc[rng.random(hours) < missing, c] = np.nan
    keep = rng.random(hours) > drop
    keep[200:380] = False
    return frame[keep].reset_index(drop=True)


def panel(spark, *frames):
    data = pd.concat(frames, ignore_index=True)
    rows = [tuple(None if pd.isna(v) else v for v in r) for r in data.itertuples(index=False)]
    rows = [(r[0].to_pydatetime(), *r[1:]) for r in rows]
    return spark.createDataFrame(rows, schemas.RAW_HOURLY)
