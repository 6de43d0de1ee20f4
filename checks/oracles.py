"""The same results as ANSI SQL, for a second engine on the same tables."""

from __future__ import annotations

import math

from hazeline.functions.index import CATEGORIES, CONCENTRATION_BINS, INDEX_BINS
from hazeline.functions.clock import MONTH_NAMES
from hazeline.functions.text import FEATURE_LABELS
from hazeline.operators.drift import DRIFT_FEATURES
from hazeline.operators.explore import CORRELATES
from hazeline.operators.features import LAGS, ROLLING, SERIES
from hazeline.operators.sequences import SEQUENCE_FEATURES
from hazeline.operators.supervised import (
    ANCHOR_COLUMNS,
    ANCHOR_STATE,
    FEATURE_COLUMNS,
    HORIZONS,
    TARGET_TIME_FEATURES,
)
from hazeline.schemas import AIR_QUALITY_VARS, RAW_HOURLY, WEATHER_VARS
from checks.panels import STATIONS

RAW = RAW_HOURLY.names


def num(x) -> str:
    """A DOUBLE literal."""
    return f"{float(x)!r}e0"


def r6(expr: str, name: str | None = None) -> str:
    return f"round({expr}, 6) + 0.0e0 AS {name or expr}"


def text_case(value: str, pick) -> str:
    arms = "".join(f" WHEN {value} <= {c[2]} THEN '{pick(c)}'" for c in CATEGORIES[:-1])
    return f"CASE WHEN {value} IS NULL THEN '{pick(CATEGORIES[0])}'{arms} ELSE '{pick(CATEGORIES[-1])}' END"


def category(value: str) -> str:
    return text_case(value, lambda c: c[0])


def advice(value: str) -> str:
    return text_case(value, lambda c: c[5])


def sub_index(c: str, pollutant: str) -> str:
    arms = ""
    for (c_lo, c_hi), (i_lo, i_hi) in zip(CONCENTRATION_BINS[pollutant], INDEX_BINS):
        slope = (i_hi - i_lo) / (c_hi - c_lo)
        arms += f" WHEN {c} BETWEEN {num(c_lo)} AND {num(c_hi)} THEN {num(slope)} * ({c} - {num(c_lo)}) + {num(i_lo)}"
    return f"CASE WHEN {c} IS NULL OR {c} < 0 THEN NULL{arms} ELSE 500.0e0 END"


def truncated(c: str, factor: int) -> str:
    return f"floor(CAST({c} AS DECIMAL(28, 9)) * {factor}) / {num(factor)}"


LATITUDE = "CASE city" + "".join(f" WHEN '{n}' THEN {num(a)}" for n, a, _, _ in STATIONS) + " END"
LONGITUDE = "CASE city" + "".join(f" WHEN '{n}' THEN {num(b)}" for n, _, b, _ in STATIONS) + " END"
PROVINCE = "CASE city" + "".join(f" WHEN '{n}' THEN '{p}'" for n, _, _, p in STATIONS) + " END"

K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"

READINGS = f"""
ev AS (SELECT event_type AS city, ts AS datetime, value, user_id AS u, {K} AS k FROM events),
raw AS (SELECT city, datetime,
  CASE WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN -1.0e0 ELSE value END AS pm2_5,
  CASE WHEN k % 43 = 0 THEN NULL ELSE value * 1.6e0 END AS pm10,
  value * 10.0e0 AS carbon_monoxide,
  CAST(k % 7 + 40 AS DOUBLE) AS nitrogen_dioxide,
  CAST(u % 3 + 10 AS DOUBLE) AS sulphur_dioxide,
  CAST(k % 11 + 60 AS DOUBLE) AS ozone,
  CASE WHEN u % 4 = 0 THEN NULL ELSE least(500.0e0, floor(value) + 20.0e0) END AS us_aqi,
  CAST(k % 30 + 10 AS DOUBLE) AS temperature_2m,
  CAST(u % 80 + 20 AS DOUBLE) AS relative_humidity_2m,
  CAST(k % 15 AS DOUBLE) AS dew_point_2m,
  CAST(k % 30 + 9 AS DOUBLE) AS apparent_temperature,
  CAST(u % 3 AS DOUBLE) AS precipitation,
  CAST(u % 30 + 990 AS DOUBLE) AS surface_pressure,
  CAST(k % 101 AS DOUBLE) AS cloud_cover,
  CAST(k % 20 AS DOUBLE) AS wind_speed_10m,
  CAST((k * 7 + u) % 360 AS DOUBLE) AS wind_direction_10m,
  CAST(k % 25 AS DOUBLE) AS wind_gusts_10m,
  {LATITUDE} AS latitude, {LONGITUDE} AS longitude
  FROM ev)"""

HOURLY = f"""
h AS (SELECT event_type AS city, date_trunc('hour', ts) AS datetime, min(value) AS pm2_5, max(value) AS pm10,
  count(*) AS n, CAST(sum({K}) AS BIGINT) AS k, CAST(sum(user_id) AS BIGINT) AS u
  FROM events GROUP BY 1, 2),
raw AS (SELECT city, CAST(datetime AS TIMESTAMP) AS datetime, pm2_5, pm10,
  pm10 * 10.0e0 AS carbon_monoxide,
  CAST(k % 7 + 40 AS DOUBLE) AS nitrogen_dioxide,
  CAST(u % 3 + 10 AS DOUBLE) AS sulphur_dioxide,
  CAST(k % 11 + 60 AS DOUBLE) AS ozone,
  CASE WHEN n % 4 = 0 THEN NULL ELSE least(500.0e0, floor(pm10) + 20.0e0) END AS us_aqi,
  CAST(k % 30 + 10 AS DOUBLE) AS temperature_2m,
  CAST(u % 80 + 20 AS DOUBLE) AS relative_humidity_2m,
  CAST(k % 15 AS DOUBLE) AS dew_point_2m,
  CAST(k % 30 + 9 AS DOUBLE) AS apparent_temperature,
  CAST(n % 3 AS DOUBLE) AS precipitation,
  CAST(u % 30 + 990 AS DOUBLE) AS surface_pressure,
  CAST(k % 101 AS DOUBLE) AS cloud_cover,
  CAST(n + k % 20 AS DOUBLE) AS wind_speed_10m,
  CAST((k * 7) % 360 AS DOUBLE) AS wind_direction_10m,
  CAST(n + k % 25 AS DOUBLE) AS wind_gusts_10m,
  {LATITUDE} AS latitude, {LONGITUDE} AS longitude
  FROM h)"""

OVERALL = f"round_even(greatest({sub_index('pm2_5', 'pm2_5')}, {sub_index('pm10', 'pm10')}), 0)"
TARGET = f"""
tgt AS (SELECT *, {category('aqi')} AS aqi_category FROM (SELECT *, coalesce(us_aqi, {OVERALL}) AS aqi FROM raw)),
known AS (SELECT * FROM tgt WHERE aqi IS NOT NULL)"""

CALENDAR = {
    "hour": "CAST(hour(datetime) AS INTEGER)",
    "day": "CAST(day(datetime) AS INTEGER)",
    "month": "CAST(month(datetime) AS INTEGER)",
    "day_of_week": "CAST(isodow(datetime) - 1 AS INTEGER)",
    "day_of_year": "CAST(dayofyear(datetime) AS INTEGER)",
    "is_weekend": "CAST(isodow(datetime) >= 6 AS INTEGER)",
}
TWO_PI = num(2 * math.pi)
CYCLES = {}
for _prefix, _value, _period in (("hour", "hour(datetime)", 24), ("month", "month(datetime)", 12), ("dow", "(isodow(datetime) - 1)", 7)):
    for _fn in ("sin", "cos"):
        CYCLES[f"{_prefix}_{_fn}"] = f"{_fn}({TWO_PI} * {_value} / {num(_period)})"
WIND = {
    "wind_u": "wind_speed_10m * cos(radians(wind_direction_10m))",
    "wind_v": "wind_speed_10m * sin(radians(wind_direction_10m))",
}
EPOCH = "CAST(floor(epoch(datetime)) AS BIGINT)"

CHANGES = {
    "aqi_change_1h": "aqi - lag(aqi, 1) OVER w",
    "aqi_change_24h": "aqi - lag(aqi, 24) OVER w",
    "aqi_change_rate": "(aqi - lag(aqi, 1) OVER w) / nullif(lag(aqi, 1) OVER w, 0)",
}
LAG_COLUMNS = {f"{c}_lag_{n}h": f"lag({c}, {n}) OVER w" for c in SERIES for n in LAGS}


def rolling(frame: str = "w{n}") -> dict[str, str]:
    out = {}
    for c in SERIES:
        for n in ROLLING:
            w = frame.format(n=n)
            for stat, fn in (("mean", "avg"), ("std", "stddev_samp"), ("max", "max")):
                out[f"{c}_roll_{stat}_{n}h"] = (
                    f"CASE WHEN count({c}) OVER {w} >= {max(2, n // 2)} THEN {fn}({c}) OVER {w} END"
                )
    return out


ROLL_COLUMNS = rolling()
ROW_WINDOWS = "WINDOW w AS (PARTITION BY city ORDER BY datetime)" + "".join(
    f", w{n} AS (PARTITION BY city ORDER BY datetime ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)" for n in ROLLING
)
ROW_FEATURES = {**CALENDAR, **CYCLES, **WIND, "timestamp": EPOCH}
WINDOW_FEATURES = {**CHANGES, **LAG_COLUMNS, **ROLL_COLUMNS}


def aliased(columns: dict[str, str]) -> str:
    return ", ".join(f"{e} AS {n}" for n, e in columns.items())


FEATURES = f"""
allf AS (SELECT *, {aliased(ROW_FEATURES)}, {aliased(WINDOW_FEATURES)} FROM tgt {ROW_WINDOWS}),
feats AS (SELECT * FROM allf WHERE aqi IS NOT NULL)"""

INTEGERS = {*CALENDAR, "timestamp"}
EXACT = {"city", "datetime", "aqi_category", "horizon", *INTEGERS}


def picked(columns) -> str:
    return ", ".join(c if c in EXACT else r6(c) for c in columns)


FEATURE_TABLE_COLUMNS = [*RAW, "aqi", "aqi_category", *ROW_FEATURES, *WINDOW_FEATURES]

SHIFTED = " UNION ALL ".join(
    f"SELECT {', '.join(TARGET_TIME_FEATURES)}, "
    + ", ".join(f"lag({c}, {h}) OVER w AS {c}_anchor" for c in ANCHOR_STATE)
    + f", {h} AS horizon, aqi AS y_aqi, city, datetime FROM feats WINDOW w AS (PARTITION BY city ORDER BY datetime)"
    for h in HORIZONS
)
SUPERVISED = f"""
shifted AS ({SHIFTED}),
sup AS (SELECT * FROM shifted WHERE y_aqi IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in ANCHOR_COLUMNS)})"""

GAPS = ", ".join(f"CASE WHEN (day(datetime) * 5 + hour(datetime)) % 9 <> 0 THEN {c} END AS {c}" for c in ("us_aqi", "pm2_5", "pm10"))
HOURLY_WITH_GAPS = f"{HOURLY.replace('raw AS (', 'whole AS (')}, raw AS (SELECT * REPLACE ({GAPS}) FROM whole)"
ON_READINGS = f"WITH {READINGS}, {TARGET}"
ON_HOURLY = f"WITH {HOURLY}, {TARGET}"
READING_FEATURES = f"{ON_READINGS}, {FEATURES}"
HOURLY_FEATURES = f"{ON_HOURLY}, {FEATURES}"
GAPPY_FEATURES = f"WITH {HOURLY_WITH_GAPS}, {TARGET}, {FEATURES}"
REFRESHED = ", ".join(r6(c) for c in ("aqi", "aqi_lag_1h", "aqi_lag_24h", "aqi_roll_mean_24h", "aqi_change_rate", "pm10_roll_std_6h"))
READING_SUPERVISED = f"{READING_FEATURES}, {SUPERVISED}"
HOURLY_SUPERVISED = f"{HOURLY_FEATURES}, {SUPERVISED}"


def error_columns(y: str, p: str) -> str:
    return (
        f"{r6(f'sqrt(avg(({y} - {p}) * ({y} - {p})))', 'rmse')}, {r6(f'avg(abs({y} - {p}))', 'mae')}, "
        f"{r6(f'1 - sum(({y} - {p}) * ({y} - {p})) / (var_pop({y}) * count({y}))', 'r2')}"
    )


def clock_features() -> str:
    """Elapsed-time offsets: lags by equality, rolling by range."""

    def at(c, n):
        return f"max({c}) OVER (PARTITION BY city ORDER BY datetime RANGE BETWEEN INTERVAL {n} HOURS PRECEDING AND INTERVAL {n} HOURS PRECEDING)"

    cols = {
        "aqi_change_1h": f"aqi - {at('aqi', 1)}",
        "aqi_change_24h": f"aqi - {at('aqi', 24)}",
        "aqi_change_rate": f"(aqi - {at('aqi', 1)}) / nullif({at('aqi', 1)}, 0)",
    }
    cols |= {f"{c}_lag_{n}h": at(c, n) for c in SERIES for n in LAGS}
    cols |= rolling(
        "(PARTITION BY city ORDER BY datetime RANGE BETWEEN INTERVAL {n} HOURS PRECEDING AND INTERVAL 1 SECOND PRECEDING)"
    )
    return f"{ON_HOURLY} SELECT city, datetime, {', '.join(r6(e, n) for n, e in cols.items())} FROM known"


def folds_sql(tail: str, k: int = 5) -> str:
    return f"""{READING_SUPERVISED},
numbered AS (SELECT *, row_number() OVER (ORDER BY datetime, city, horizon) - 1 AS rn, count(*) OVER () AS n FROM sup),
sized AS (SELECT *, n // {k + 1} AS t FROM numbered),
folded AS (SELECT *, CASE WHEN rn < n - {k} * t THEN 0 ELSE CAST((rn - (n - {k} * t)) // t + 1 AS INTEGER) END AS fold FROM sized),
report AS (SELECT CAST(fold AS INTEGER) AS fold, CAST(min(n - {k} * t + (fold - 1) * t) AS BIGINT) AS train_rows, count(*) AS test_rows,
  strftime(min(datetime), '%Y-%m-%d') AS test_from, {error_columns('y_aqi', 'aqi_anchor')} FROM folded WHERE fold > 0 GROUP BY fold)
{tail}"""


MONTH_LIST = "[" + ", ".join(f"'{m}'" for m in MONTH_NAMES) + "]"

HISTORY = f"""
hm AS (SELECT city, month(datetime) AS m, avg(aqi) AS mean FROM known GROUP BY 1, 2),
hw AS (SELECT city, m, row_number() OVER (PARTITION BY city ORDER BY mean DESC, m) AS worst,
  row_number() OVER (PARTITION BY city ORDER BY mean, m) AS clean FROM hm),
history AS (SELECT city, round_even(avg(aqi), 1) AS mean_aqi, CAST(round_even(max(aqi), 0) AS INTEGER) AS max_aqi_on_record,
  {MONTH_LIST}[(SELECT m FROM hw WHERE hw.city = known.city AND worst = 1)] AS worst_month,
  {MONTH_LIST}[(SELECT m FROM hw WHERE hw.city = known.city AND clean = 1)] AS cleanest_month,
  count(*) AS hours_of_data FROM known GROUP BY city)"""

CORRELATIONS = "corrs AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, corr(aqi, {c}) AS r FROM known" for c in CORRELATES
) + ")"


def psi_ctes() -> str:
    long = " UNION ALL ".join(
        f"SELECT {i} AS position, '{f}' AS feature, {f} AS v, datetime FROM known WHERE {f} IS NOT NULL"
        for i, f in enumerate(DRIFT_FEATURES)
    )
    fractions = "[" + ", ".join(num(i / 10) for i in range(11)) + "]"
    return f"""
edge AS (SELECT max(datetime) - INTERVAL 14 DAYS AS cut FROM known),
long AS ({long}),
marked AS (SELECT long.*, datetime >= cut AS recent FROM long, edge),
q AS (SELECT feature, quantile_cont(v, {fractions}) AS qs FROM marked WHERE NOT recent GROUP BY feature),
e AS (SELECT feature, list_sort(list_distinct([round(x, 9) for x in qs])) AS edges FROM q),
inner_edges AS (SELECT feature, edges, edges[2:len(edges) - 1] AS ie FROM e),
binned AS (SELECT m.feature, m.position, recent, len([x for x in ie if x <= v]) AS bin, len(edges) AS ne FROM marked m JOIN inner_edges USING (feature)),
sizes AS (SELECT feature, position, ne, count(*) FILTER (WHERE NOT recent) AS nr, count(*) FILTER (WHERE recent) AS nc FROM binned GROUP BY ALL),
every AS (SELECT feature, position, ne, nr, nc, unnest(range(0, ne - 1)) AS bin FROM sizes),
filled AS (SELECT feature, bin, count(*) FILTER (WHERE NOT recent) AS r, count(*) FILTER (WHERE recent) AS c FROM binned GROUP BY ALL),
shares AS (SELECT y.*, coalesce(r, 0)::DOUBLE / nr + 1e-6 AS rp, coalesce(c, 0)::DOUBLE / nc + 1e-6 AS cp
  FROM every y LEFT JOIN filled f ON f.feature = y.feature AND f.bin = y.bin),
psis AS (SELECT feature, position, CASE WHEN min(nr) < 50 OR min(nc) < 20 OR min(ne) < 3 THEN 0.0e0 ELSE sum((cp - rp) * ln(cp / rp)) END AS psi
  FROM shares GROUP BY feature, position),
statuses AS (SELECT *, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'significant' END AS status FROM psis)"""


LOG = """
lagged AS (SELECT *, unnest([1, 2]) AS b FROM feats WHERE aqi_lag_24h IS NOT NULL),
log AS (SELECT strftime(datetime - INTERVAL 24 HOURS, '%Y-%m-%dT%H:%M:%S') AS generated_at, city, datetime AS target_datetime,
  CAST(trunc(aqi_lag_24h + b * 3) AS INTEGER) AS predicted_aqi FROM lagged WHERE b = 2),
scored AS (SELECT l.city, l.target_datetime, generated_at, predicted_aqi, aqi AS actual_aqi, predicted_aqi - aqi AS error
  FROM log l JOIN feats f ON f.city = l.city AND f.datetime = l.target_datetime)"""

CUTOFF = "(SELECT make_timestamp(CAST(trunc(quantile_cont(CAST(epoch_us(datetime) AS DOUBLE), 0.8e0)) AS BIGINT)) FROM {0})"
CUTOFF_OF_SUP = CUTOFF.format("sup")
NOW = "(SELECT max(datetime) - INTERVAL 72 HOURS FROM raw)"
ANCHOR_ROWS = f"""
clocked AS (SELECT feats.*, {NOW} AS now FROM feats),
ranked AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime <= now DESC,
  CASE WHEN datetime <= now THEN -epoch_us(datetime) ELSE epoch_us(datetime) END) AS pick FROM clocked),
anchors AS (SELECT city, datetime AS anchor_datetime, {', '.join(f'{c} AS {c}_anchor' for c in ANCHOR_STATE)} FROM ranked WHERE pick = 1),
future AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime) AS step FROM clocked WHERE datetime > now) WHERE step <= 72),
inputs AS (SELECT f.city, f.datetime, {', '.join('f.' + c for c in TARGET_TIME_FEATURES)}, {', '.join(ANCHOR_COLUMNS)},
  CAST(round_even((epoch(f.datetime) - epoch(now)) / 3600.0e0, 0) AS INTEGER) AS horizon FROM future f JOIN anchors USING (city))"""

INTERVALS = """
intervals AS (SELECT horizon, quantile_cont(y_aqi - aqi_anchor, 0.1e0) AS low, quantile_cont(y_aqi - aqi_anchor, 0.9e0) AS high FROM sup GROUP BY horizon)"""
def forecast_ctes(value: str, tables: str = "") -> str:
    """Forecast hours, days and current state from ``value``, a prediction over the columns of the inputs and of ``tables``."""
    return f"""
matched AS (SELECT i.*, n.horizon AS nearest, low, high, {value} AS value, row_number() OVER (PARTITION BY i.city, i.datetime ORDER BY abs(n.horizon - i.horizon), n.horizon) AS pick
  FROM inputs i, intervals n{tables}),
bounded AS (SELECT *, greatest(0.0e0, value + low) AS lower, least(500.0e0, value + high) AS upper FROM matched WHERE pick = 1),
hours AS (SELECT city, datetime, CAST(round_even(value, 0) AS INTEGER) AS aqi, CAST(round_even(lower, 0) AS INTEGER) AS lower,
  CAST(round_even(upper, 0) AS INTEGER) AS upper, {category('value')} AS category FROM bounded),
per_day AS (SELECT city, strftime(datetime, '%Y-%m-%d') AS date, avg(aqi) AS m, avg(lower) AS l, avg(upper) AS u FROM hours GROUP BY 1, 2),
days AS (SELECT city, date, CAST(round_even(m, 0) AS INTEGER) AS aqi, CAST(round_even(l, 0) AS INTEGER) AS lower,
  CAST(round_even(u, 0) AS INTEGER) AS upper, {category('m')} AS category
  FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY date) AS rn FROM per_day) WHERE rn <= 3),
curr AS (SELECT city, CAST(round_even(v, 0) AS INTEGER) AS current_aqi, {category('v')} AS current_category FROM
  (SELECT city, aqi_anchor AS v, row_number() OVER (PARTITION BY city ORDER BY datetime) AS rn FROM inputs) WHERE rn = 1)"""


FORECAST = f"{HOURLY_SUPERVISED}, {ANCHOR_ROWS}, {INTERVALS}, {forecast_ctes('aqi_anchor')}"
RIDGE = "my + w * (aqi_anchor - mx) / sx"
RIDGE_FIT = f"""
train AS (SELECT * FROM sup WHERE datetime <= {CUTOFF_OF_SUP}), valid AS (SELECT * FROM sup WHERE datetime > {CUTOFF_OF_SUP}),
fit AS (SELECT avg(aqi_anchor) AS mx, stddev_pop(aqi_anchor) AS sx, avg(y_aqi) AS my, covar_pop(aqi_anchor, y_aqi) / stddev_pop(aqi_anchor) * count(*) / (count(*) + 900.0e0) AS w FROM train)"""
RIDGE_FORECAST = f"""{HOURLY_SUPERVISED}, {ANCHOR_ROWS}, {RIDGE_FIT},
intervals AS (SELECT horizon, quantile_cont(y_aqi - ({RIDGE}), 0.1e0) AS low, quantile_cont(y_aqi - ({RIDGE}), 0.9e0) AS high FROM valid, fit GROUP BY horizon),
{forecast_ctes(RIDGE, ', fit')},
peaks AS (SELECT * FROM (SELECT i.*, fit.*, {RIDGE} AS value, row_number() OVER (PARTITION BY city ORDER BY {RIDGE} DESC, datetime) AS rn FROM inputs i, fit) WHERE rn = 1),
told AS (SELECT city, CAST(round_even(value, 0) AS INTEGER) AS prediction, round_even(my, 1) AS base_value, strftime(datetime, '%Y-%m-%dT%H:%M:%S') AS for_time,
  'Forecast AQI ≈ ' || CAST(round_even(value, 0) AS BIGINT) || ' (baseline ' || CAST(round_even(my, 0) AS BIGINT) || '). Main drivers: current AQI '
  || CASE WHEN round_even(value - my, 1) >= 0 THEN '+' ELSE '−' END || abs(round_even(value - my, 1)) || '.' AS text FROM peaks)"""


# Weight and middle of each input in the rule of the explained queries.
EXPLAIN_RULE = {"aqi_anchor": (0.5, 100.0), "pm2_5_anchor": (0.25, 40.0), "wind_u": (-1.5, 0.0), "temperature_2m": (0.75, 20.0), "relative_humidity_2m": (-0.125, 60.0), "surface_pressure": (0.0625, 1000.0), "horizon": (0.25, 24.0)}
RULE_BASE = 90.0


def rule_ctes(source: str) -> str:
    """One row for each contribution of a fixed linear rule, by size."""
    parts = " UNION ALL ".join(
        f"SELECT city, datetime, horizon, '{c}' AS feature, {w}e0 * (CAST({c} AS DOUBLE) - {m}e0) AS p FROM {source}" for c, (w, m) in EXPLAIN_RULE.items()
    )
    return f"""
parts AS ({parts}),
sized AS (SELECT *, round_even(p, 1) AS impact, {label_case('feature')} AS label, sum(p) OVER (PARTITION BY city, datetime, horizon) + {RULE_BASE}e0 AS explained,
  row_number() OVER (PARTITION BY city, datetime, horizon ORDER BY abs(p) DESC, feature) AS place FROM parts),
top AS (SELECT *, max(abs(impact)) OVER (PARTITION BY city, datetime, horizon) AS most FROM sized WHERE place <= 5)"""


def alerts_sql(source: str) -> str:
    return f"""
pk AS (SELECT city, aqi, datetime, row_number() OVER (PARTITION BY city ORDER BY aqi DESC, datetime) AS rn,
  min(CASE WHEN aqi >= 150 THEN datetime END) OVER (PARTITION BY city) AS first_exceed_time FROM {source} WHERE aqi IS NOT NULL),
alerts AS (SELECT city, CASE WHEN aqi >= 200 THEN 'danger' WHEN aqi >= 150 THEN 'warning' ELSE 'none' END AS severity,
  CAST(round_even(aqi, 0) AS INTEGER) AS peak_aqi, datetime AS peak_time, {category('aqi')} AS category, {advice('aqi')} AS advice,
  first_exceed_time FROM pk WHERE rn = 1)"""


SCENARIOS = """
scen AS (SELECT CAST(c_custkey AS VARCHAR) AS scenario_id, ['click', 'error', 'purchase', 'signup', 'view'][c_custkey % 5 + 1] AS city,
  [1, 2, 3, 6, 12, 24, 36, 48, 60, 72][c_custkey % 10 + 1] AS horizon,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 400 AS DOUBLE) END AS s_pm2_5,
  CASE WHEN c_custkey % 3 = 0 THEN CAST(c_custkey % 500 AS DOUBLE) END AS s_aqi,
  CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_custkey % 40 AS DOUBLE) END AS s_wind,
  CASE WHEN c_custkey % 7 = 0 THEN CAST(c_custkey % 100 AS DOUBLE) END AS s_humidity,
  CASE WHEN c_custkey % 11 <> 0 THEN CAST(c_custkey % 50 - 5 AS DOUBLE) END AS s_temperature FROM customer)"""
SCENARIO_BASE = f"""{HOURLY_FEATURES}, {ANCHOR_ROWS}, {SCENARIOS},
lens AS (SELECT city, max(step) AS steps FROM future GROUP BY city),
wanted AS (SELECT DISTINCT s.city, s.horizon, least(s.horizon, steps) AS step FROM scen s JOIN lens USING (city)),
base AS (SELECT w.city, w.horizon, {', '.join('f.' + c for c in TARGET_TIME_FEATURES)}, {', '.join(ANCHOR_COLUMNS)}
  FROM wanted w JOIN future f ON f.city = w.city AND f.step = w.step JOIN anchors a ON a.city = w.city)"""
SPEED = "sqrt(wind_u * wind_u + wind_v * wind_v)"
SCALE = f"s_wind / CASE WHEN {SPEED} = 0 THEN 1.0e0 ELSE {SPEED} END"
OVERRIDES = {
    "pm2_5_anchor": "s_pm2_5",
    "aqi_anchor": "s_aqi",
    "aqi_roll_mean_6h_anchor": "s_aqi",
    "aqi_roll_mean_24h_anchor": "s_aqi",
    "relative_humidity_2m": "s_humidity",
    "temperature_2m": "s_temperature",
    "apparent_temperature": "s_temperature",
    "wind_u": f"wind_u * ({SCALE})",
    "wind_v": f"wind_v * ({SCALE})",
    "wind_speed_10m": "s_wind",
    "wind_gusts_10m": "s_wind * 1.4e0",
}
SCENARIO_ROWS = f"""{SCENARIO_BASE},
changed AS (SELECT scenario_id, b.city, b.horizon, {', '.join(
    f"coalesce({OVERRIDES[c]}, {c}) AS {c}" if c in OVERRIDES else f"b.{c}" for c in FEATURE_COLUMNS if c != 'horizon'
)} FROM base b JOIN scen s ON s.city = b.city AND s.horizon = b.horizon)"""
RULE = "aqi_anchor * 0.6e0 + pm2_5_anchor * 0.3e0 - wind_speed_10m * 0.5e0 + temperature_2m * 0.1e0"

SEQ_FRAME = "(PARTITION BY city ORDER BY datetime ROWS BETWEEN 71 PRECEDING AND 24 PRECEDING)"
SEQUENCES = f"""{READING_FEATURES},
seq AS (SELECT city, datetime, aqi, row_number() OVER (PARTITION BY city ORDER BY datetime) - 1 - 23 AS "end",
  count(*) OVER (PARTITION BY city) AS n, lag(datetime, 23) OVER (PARTITION BY city ORDER BY datetime) AS end_time,
  count(*) FILTER (WHERE {' AND '.join(f'{c} IS NOT NULL' for c in SEQUENCE_FEATURES)}) OVER {SEQ_FRAME} AS usable,
  {', '.join(f'avg(CAST({c} AS FLOAT)) OVER {SEQ_FRAME} AS {c}_mean' for c in SEQUENCE_FEATURES)},
  lag(aqi, 71) OVER (PARTITION BY city ORDER BY datetime) AS oldest_aqi, lag(aqi, 24) OVER (PARTITION BY city ORDER BY datetime) AS newest_aqi FROM feats),
windows AS (SELECT city, "end", end_time AS datetime, CAST(CAST(aqi AS FLOAT) AS DOUBLE) AS target, CAST(usable AS INTEGER) AS steps, {', '.join(f'{c}_mean' for c in SEQUENCE_FEATURES)},
  CAST(CAST(oldest_aqi AS FLOAT) AS DOUBLE) AS oldest_aqi, CAST(CAST(newest_aqi AS FLOAT) AS DOUBLE) AS newest_aqi
  FROM seq WHERE "end" >= 48 AND "end" < n - 24 AND ("end" - 48) % 6 = 0 AND usable = 48)"""


PAYLOAD = f"""{ON_HOURLY}
SELECT {', '.join(c if c in ('city', 'datetime') else r6(c) for c in RAW)} FROM raw
WHERE day(datetime) <> 13 AND hour(datetime) % 7 <> 0"""

UPSERT = f"""{ON_HOURLY},
base AS (SELECT city, {EPOCH} AS timestamp, aqi, pm10, hour(datetime) AS hr FROM tgt),
batches AS (
  SELECT city, timestamp, aqi, pm10, 0 AS seq FROM base WHERE hr % 3 <> 0
  UNION ALL SELECT city, timestamp, aqi + 1, pm10, 1 FROM base WHERE hr % 2 = 0
  UNION ALL SELECT city, timestamp, aqi + 2, pm10, 2 FROM base WHERE hr % 2 = 0 AND pm10 > 50)
SELECT city, timestamp, {r6('aqi')}, {r6('pm10')} FROM batches
QUALIFY row_number() OVER (PARTITION BY city, timestamp ORDER BY seq DESC) = 1"""


def copies(direction: str) -> str:
    order = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    by = ", ".join(f"{c} {direction}" for c in order)
    shown = "l_shipdate, l_partkey, l_suppkey, " + ", ".join(r6(c) for c in order[3:])
    return f"""SELECT l_orderkey, l_linenumber, {shown} FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {by}) = 1"""


def chunks(last: str) -> str:
    return f"""WITH ranges AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
starts AS (SELECT o_custkey, b, CAST(unnest(range(CAST(a AS TIMESTAMP), CAST({last} AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 91 DAYS)) AS DATE) AS chunk_start FROM ranges)
SELECT o_custkey, CAST(chunk_start AS VARCHAR) AS chunk_start, CAST(least(chunk_start + 90, b) AS VARCHAR) AS chunk_end FROM starts"""


def label_case(c: str) -> str:
    return "CASE " + c + "".join(f" WHEN '{k}' THEN '{v}'" for k, v in FEATURE_LABELS.items()) + f" ELSE replace({c}, '_', ' ') END"


LABELLED = [*AIR_QUALITY_VARS, *WEATHER_VARS]

LEADERBOARD = """WITH runs AS (SELECT o_orderpriority AS board, o_orderkey AS run_id, o_orderstatus AS model, o_totalprice / 7777.0e0 AS rmse FROM orders),
v AS (SELECT *, row_number() OVER (PARTITION BY board ORDER BY run_id) AS version,
  min(round_even(rmse, 3)) OVER (PARTITION BY board ORDER BY run_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM runs),
g AS (SELECT *, prev IS NULL OR rmse < prev AS promoted FROM v)
SELECT board, version, run_id, model, round_even(rmse, 3) AS rmse, promoted,
  version = max(CASE WHEN promoted THEN version END) OVER (PARTITION BY board) AS is_champion, prev AS prev_champion_rmse FROM g"""

MARGIN = """WITH RECURSIVE v AS (SELECT o_orderpriority AS board, o_orderkey AS run_id, o_orderstatus AS model, o_totalprice / 7777.0e0 + 25.0e0 / (1.0e0 + floor(o_orderkey / 500.0e0)) AS rmse,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS version FROM orders),
w AS (SELECT board, run_id, model, round_even(rmse, 3) AS rmse, version, true AS promoted, CAST(NULL AS DOUBLE) AS prev, round_even(rmse, 3) AS champion FROM v WHERE version = 1
  UNION ALL SELECT v.board, v.run_id, v.model, round_even(v.rmse, 3), v.version, v.rmse < w.champion - 0.75e0, w.champion, CASE WHEN v.rmse < w.champion - 0.75e0 THEN round_even(v.rmse, 3) ELSE w.champion END
  FROM w JOIN v ON v.board = w.board AND v.version = w.version + 1)
SELECT board, version, run_id, model, rmse, promoted, version = max(CASE WHEN promoted THEN version END) OVER (PARTITION BY board) AS is_champion, prev AS prev_champion_rmse FROM w"""

ORACLES: dict[str, str] = {
    "sub_indices": f"""WITH {READINGS} SELECT city, datetime, {r6(sub_index('pm2_5', 'pm2_5'), 'aqi_pm2_5')}, {r6(sub_index('pm10', 'pm10'), 'aqi_pm10')},
{r6(sub_index('t25', 'pm2_5'), 'aqi_pm2_5_truncated')}, {r6(sub_index('t10', 'pm10'), 'aqi_pm10_truncated')}
FROM (SELECT *, {truncated('pm2_5', 10)} AS t25, {truncated('pm10', 1)} AS t10 FROM raw)""",
    "overall_aqi": f"WITH {READINGS} SELECT city, datetime, {r6(OVERALL, 'aqi')} FROM raw",
    "aqi_category": f"""WITH {READINGS} SELECT city, datetime, {category('pm2_5')} AS category, {text_case('pm2_5', lambda c: c[4])} AS color,
{advice('pm2_5')} AS advice, coalesce(pm2_5 > 200, false) AS hazardous FROM raw""",
    "category_lookup": f"""{ON_READINGS} SELECT aqi_category AS name, {'CAST(CASE aqi_category' + ''.join(f" WHEN '{c[0]}' THEN {c[1]}" for c in CATEGORIES) + ' END AS INTEGER)'} AS lo,
{'CAST(CASE aqi_category' + ''.join(f" WHEN '{c[0]}' THEN {c[2]}" for c in CATEGORIES) + ' END AS INTEGER)'} AS hi,
{'CASE aqi_category' + ''.join(f" WHEN '{c[0]}' THEN '{c[4]}'" for c in CATEGORIES) + ' END'} AS color, count(*) AS hours FROM known GROUP BY aqi_category""",
    "breakpoint_bins": f"""WITH {READINGS}, bins(pollutant, c_lo, c_hi, i_lo) AS (VALUES {', '.join(
        f"('{p}', {num(a)}, {num(b)}, {num(i)})" for p, bins in CONCENTRATION_BINS.items() for (a, b), (i, _) in zip(bins, INDEX_BINS))}),
long AS (SELECT 'pm2_5' AS pollutant, pm2_5 AS c FROM raw UNION ALL SELECT 'pm10', pm10 FROM raw)
SELECT b.pollutant, c_lo, i_lo, count(*) AS n_readings FROM long l JOIN bins b ON l.pollutant = b.pollutant AND c BETWEEN c_lo AND c_hi GROUP BY ALL""",
    "target_derivation": f"{ON_READINGS} SELECT city, datetime, {r6('aqi')}, aqi_category FROM known",
    "calendar_features": f"WITH {READINGS} SELECT city, datetime, {aliased(CALENDAR)}, {', '.join(r6(e, n) for n, e in CYCLES.items())} FROM raw",
    "wind_vectors": f"WITH {READINGS} SELECT city, datetime, wind_speed_10m, wind_direction_10m, {', '.join(r6(e, n) for n, e in WIND.items())} FROM raw",
    "epoch_key": f"WITH {READINGS} SELECT city, datetime, {EPOCH} AS timestamp FROM raw",
    "station_location": f"WITH {READINGS} SELECT city, datetime, latitude, longitude FROM raw",
    "type_normalizer": f"""WITH {READINGS} SELECT city, datetime, CAST(hour(datetime) AS DOUBLE) AS hour, CAST(CAST(pm2_5 > 50 AS INTEGER) AS DOUBLE) AS dirty,
{EPOCH} AS timestamp FROM raw""",
    "city_slug": """SELECT c_custkey, replace(lower(c_name || ' ' || c_mktsegment), ' ', '_') AS slug,
lower(c_name || ' ' || c_mktsegment) = lower(c_name || ' building') AS is_building FROM customer""",
    "time_text": f"""WITH {READINGS} SELECT city, datetime, strftime(datetime, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(datetime, '%Y-%m-%d') AS date,
{MONTH_LIST}[month(datetime)] AS month_name FROM raw""",
    "lag_features": f"{READING_FEATURES} SELECT city, datetime, {picked(LAG_COLUMNS)} FROM feats",
    "change_rates": f"{READING_FEATURES} SELECT city, datetime, {picked(CHANGES)} FROM feats",
    "rolling_features": f"{READING_FEATURES} SELECT city, datetime, {picked(ROLL_COLUMNS)} FROM feats",
    "feature_table": f"{READING_FEATURES} SELECT {picked(FEATURE_TABLE_COLUMNS)} FROM feats",
    "feature_table_hourly": f"{HOURLY_FEATURES} SELECT {picked(FEATURE_TABLE_COLUMNS)} FROM feats",
    "feature_table_clock": clock_features(),
    "supervised_rows": f"{READING_SUPERVISED} SELECT {picked([*FEATURE_COLUMNS, 'y_aqi', 'city', 'datetime'])} FROM sup",
    "supervised_clock": f"""{HOURLY_FEATURES}, hz AS (SELECT unnest({list(HORIZONS)}) AS horizon)
SELECT t.city, t.datetime, horizon, {r6('t.aqi', 'y_aqi')}, {', '.join(r6(f's.{c}', f'{c}_anchor') for c in ANCHOR_STATE)}
FROM feats t, hz JOIN feats s ON s.city = t.city AND s.datetime = t.datetime - horizon * INTERVAL 1 HOUR
WHERE {' AND '.join(f's.{c} IS NOT NULL' for c in ANCHOR_STATE)}""",
    "sample_size": f"{READING_SUPERVISED} SELECT least(5000, count(*)) AS n_rows FROM sup",
    "time_split_counts": f"""{READING_SUPERVISED} SELECT CASE WHEN datetime <= {CUTOFF.format('sup')} THEN 'train' ELSE 'valid' END AS part,
count(*) AS n_rows, min(datetime) AS first, max(datetime) AS last FROM sup GROUP BY 1""",
    "persistence_by_horizon": f"""{READING_SUPERVISED} SELECT horizon AS horizon_h, {error_columns('y_aqi', 'aqi_anchor')},
{r6('sqrt(avg((y_aqi - aqi_anchor) * (y_aqi - aqi_anchor)))', 'baseline_rmse')} FROM sup GROUP BY horizon""",
    "residual_intervals": f"{READING_SUPERVISED}, {INTERVALS} SELECT horizon, {r6('low')}, {r6('high')} FROM intervals",
    "walk_forward_folds": folds_sql("SELECT * FROM report"),
    "walk_forward_two_inputs": folds_sql(f""", sums AS (SELECT i, avg(aqi_anchor) AS ma, avg(temperature_2m) AS mb, avg(y_aqi) AS my, stddev_pop(aqi_anchor) AS sa, stddev_pop(temperature_2m) AS sb,
  corr(aqi_anchor, temperature_2m) AS r, covar_pop(aqi_anchor, y_aqi) / stddev_pop(aqi_anchor) AS ca, covar_pop(temperature_2m, y_aqi) / stddev_pop(temperature_2m) AS cb, 1 + 300.0e0 / count(*) AS d
  FROM folded, range(1, 6) s(i) WHERE fold < i GROUP BY i),
scored AS (SELECT folded.*, my + (d * ca - r * cb) / (d * d - r * r) * (aqi_anchor - ma) / sa + (d * cb - r * ca) / (d * d - r * r) * (temperature_2m - mb) / sb AS p FROM folded JOIN sums ON fold = i)
SELECT fold, train_rows, test_rows, test_from, rmse, mae, r2 FROM (SELECT fold, train_rows, test_rows, test_from FROM report)
JOIN (SELECT fold, {error_columns('y_aqi', 'p')} FROM scored GROUP BY fold) USING (fold)"""),
    "fold_summary": folds_sql(f"SELECT {r6('avg(rmse)', 'mean_rmse')}, {r6('stddev_samp(rmse)', 'sd_rmse')} FROM report"),
    "city_ranking": f"{ON_READINGS} SELECT city, {r6('avg(aqi)', 'mean_aqi')} FROM known GROUP BY city",
    "monthly_profile": f"{ON_READINGS} SELECT CAST(month(datetime) AS INTEGER) AS month, {r6('avg(aqi)', 'mean_aqi')} FROM known GROUP BY 1",
    "diurnal_profile": f"{ON_READINGS} SELECT CAST(hour(datetime) AS INTEGER) AS hour, {r6('avg(aqi)', 'mean_aqi')} FROM known GROUP BY 1",
    "dataset_summary": f"""{ON_READINGS} SELECT count(*) AS n_rows, count(DISTINCT city) AS n_cities, strftime(min(datetime), '%Y-%m-%d') AS date_min,
strftime(max(datetime), '%Y-%m-%d') AS date_max FROM known""",
    "dataset_findings": f"""{ON_READINGS}, {CORRELATIONS}, means AS (SELECT city, avg(aqi) AS m FROM known GROUP BY city),
months AS (SELECT month(datetime) AS mo, avg(aqi) AS m FROM known GROUP BY 1)
SELECT count(*) AS n_rows, count(DISTINCT city) AS n_cities, strftime(min(datetime), '%Y-%m-%d') AS date_min, strftime(max(datetime), '%Y-%m-%d') AS date_max,
(SELECT city FROM means ORDER BY m DESC, city LIMIT 1) AS worst_city, (SELECT round_even(max(m), 1) FROM means) AS worst_city_mean,
(SELECT city FROM means ORDER BY m, city DESC LIMIT 1) AS cleanest_city, (SELECT round_even(min(m), 1) FROM means) AS cleanest_city_mean,
CAST((SELECT mo FROM months ORDER BY m DESC, mo LIMIT 1) AS INTEGER) AS worst_month,
(SELECT feature FROM corrs ORDER BY abs(r) DESC, feature LIMIT 1) AS strongest_feature,
(SELECT round_even(r, 2) FROM corrs ORDER BY abs(r) DESC, feature LIMIT 1) AS strongest_r FROM known""",
    "weather_correlation": f"{ON_READINGS}, {CORRELATIONS} SELECT feature, {r6('r')} FROM corrs",
    "aqi_histogram": f"""{ON_READINGS}, b AS (SELECT min(aqi) AS lo, (max(aqi) - min(aqi)) / 60 AS w FROM known),
guessed AS (SELECT aqi, lo, w, CAST(floor((aqi - lo) / w) AS INTEGER) AS g FROM known, b),
binned AS (SELECT least(60, g - CAST(aqi < lo + g * w AS INTEGER) + CAST(aqi >= lo + (g + 1) * w AS INTEGER) + 1) AS bin, count(*) AS c FROM guessed GROUP BY 1),
every AS (SELECT CAST(unnest(range(1, 61)) AS INTEGER) AS bin)
SELECT e.bin, {r6('lo + (e.bin - 1) * w', 'bin_low')}, coalesce(c, 0) AS hours FROM every e CROSS JOIN b LEFT JOIN binned USING (bin)""",
    "history_summary": f"{ON_READINGS}, {HISTORY} SELECT * FROM history",
    "history_lookup": f"""{ON_READINGS}, {HISTORY}, asked(city) AS (VALUES ('view'), ('nowhere'))
SELECT a.city, mean_aqi, max_aqi_on_record, worst_month, cleanest_month, hours_of_data,
CASE WHEN hours_of_data IS NULL THEN 'No history for ' || a.city END AS error FROM asked a LEFT JOIN history USING (city)""",
    "psi_by_feature": f"{ON_READINGS}, {psi_ctes()} SELECT feature, {r6('psi')}, status FROM statuses",
    "drift_report": f"""{ON_READINGS}, {psi_ctes()}, worst AS (SELECT * FROM statuses ORDER BY round(psi, 3) DESC, position LIMIT 1)
SELECT 14 AS recent_days, count(*) FILTER (WHERE datetime < cut) AS reference_rows, count(*) FILTER (WHERE datetime >= cut) AS recent_rows,
(SELECT status FROM worst) AS overall_status, (SELECT feature FROM worst) AS worst_feature FROM known, edge""",
    "forecast_log_latest": f"{HOURLY_FEATURES}, {LOG} SELECT * FROM log",
    "forecast_scores": f"""{HOURLY_FEATURES}, {LOG} SELECT city, target_datetime, generated_at, predicted_aqi, {r6('actual_aqi')}, {r6('error')} FROM scored""",
    "forecast_error": f"""{HOURLY_FEATURES}, {LOG} SELECT 'ok' AS status, count(*) AS scored_points, round_even(avg(abs(error)), 2) AS mae,
round_even(sqrt(avg(error * error)), 2) AS rmse FROM scored""",
    "biggest_misses": f"""{HOURLY_FEATURES}, {LOG} SELECT city, target_datetime AS "when", predicted_aqi AS predicted, CAST(trunc(actual_aqi) AS INTEGER) AS actual,
CAST(trunc(error) AS INTEGER) AS error FROM scored ORDER BY abs(scored.error) DESC, city, target_datetime, generated_at LIMIT 5""",
    "payload_scan": PAYLOAD,
    "payload_rejects": f"""{ON_HOURLY} SELECT city, 'air_quality' AS source, count(DISTINCT CAST(datetime AS DATE)) AS documents FROM raw
WHERE day(datetime) = 13 GROUP BY city""",
    "feature_upsert": UPSERT,
    "keep_first_copy": copies("ASC"),
    "keep_last_copy": copies("DESC"),
    "resume_missing": """SELECT CAST(doc_id AS VARCHAR) AS name, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "stored_cities": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS city FROM events WHERE value IS NOT NULL",
    "range_chunks": chunks("b - 1"),
    "range_chunks_inclusive": chunks("b"),
    "refreshed_store": f"""{HOURLY_FEATURES} SELECT city, datetime, timestamp, {r6('aqi')}, {r6('aqi_lag_24h')}, {r6('aqi_roll_mean_24h')},
{r6('aqi_change_rate')} FROM feats""",
    "refresh_late": f"{GAPPY_FEATURES} SELECT city, datetime, timestamp, {REFRESHED} FROM feats",
    "refresh_sparse_duplicates": f"{GAPPY_FEATURES} SELECT city, datetime, timestamp, {REFRESHED} FROM feats",
    "ingest_rejects": f"""{ON_HOURLY}, docs AS (SELECT city, day(datetime) AS d, count(*) AS n FROM raw GROUP BY 1, 2, CAST(datetime AS DATE)),
found AS (SELECT city, CASE WHEN d = 13 THEN 'no times' WHEN d = 5 AND n > 1 THEN 'arrays of unequal length' WHEN d = 7 THEN 'not a time: soon' END AS reason FROM docs
UNION ALL SELECT city, 'unknown station' FROM docs WHERE city = 'view' AND d <> 13)
SELECT city, 'air_quality' AS source, reason, count(*) AS n FROM found WHERE reason IS NOT NULL GROUP BY 1, 3""",
    "province_cities": """SELECT r_name AS province, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS cities FROM supplier
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
    "leaderboard_history": LEADERBOARD,
    "leaderboard_margin": MARGIN,
    "best_candidate": f"""SELECT o_orderpriority AS model, {r6('avg(o_totalprice / 7777.0e0)', 'rmse')} FROM orders
WHERE o_orderpriority <> '5-LOW' GROUP BY 1 ORDER BY avg(o_totalprice / 7777.0e0), 1 LIMIT 1""",
    "as_of_anchor": f"{HOURLY_FEATURES}, {ANCHOR_ROWS} SELECT city, anchor_datetime, {', '.join(r6(c) for c in ANCHOR_COLUMNS)} FROM anchors",
    "next_hours": f"""{ON_HOURLY} SELECT city, datetime, CAST(step AS INTEGER) AS step, {r6('pm10')} FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY datetime) AS step
FROM raw WHERE datetime > (SELECT min(datetime) + INTERVAL 100 HOURS FROM raw)) WHERE step <= 72""",
    "forecast_inputs": f"{HOURLY_FEATURES}, {ANCHOR_ROWS} SELECT {picked(['city', 'datetime', *FEATURE_COLUMNS])} FROM inputs",
    "forecast_from_store": f"{GAPPY_FEATURES}, {ANCHOR_ROWS} SELECT {picked(['city', 'datetime', *FEATURE_COLUMNS])} FROM inputs",
    "skipped_stations": """SELECT CAST(user_id AS VARCHAR) AS city, max(ts) AS newest FROM events GROUP BY user_id
HAVING max(ts) <= (SELECT date_trunc('hour', max(ts) - INTERVAL 1 DAY) FROM events)""",
    "nearest_horizon_interval": f"{FORECAST} SELECT city, datetime, horizon, {r6('low')}, {r6('high')}, {r6('lower')}, {r6('upper')} FROM bounded",
    "forecast_hours": f"{FORECAST} SELECT * FROM hours",
    "daily_rollup": f"{FORECAST} SELECT * FROM days",
    "current_index": f"{FORECAST} SELECT * FROM curr",
    "hazard_alerts": f"{ON_READINGS}, {alerts_sql('known')} SELECT * FROM alerts",
    "forecast_alerts": f"{FORECAST}, {alerts_sql('hours')} SELECT * FROM alerts",
    "forecast_documents": f"{FORECAST} SELECT 'run-1' AS generated_at, city, datetime AS target_datetime, aqi AS predicted_aqi FROM hours",
    "forecast_lookup": f"""{FORECAST}, {alerts_sql('hours')}, asked(city) AS (VALUES {', '.join(f"('{s[0]}')" for s in STATIONS)}, ('nowhere')),
peak AS (SELECT city, max(aqi) AS p FROM hours GROUP BY city), nd AS (SELECT city, CAST(count(*) AS INTEGER) AS days FROM days GROUP BY city)
SELECT a.city, CASE WHEN c.city IS NOT NULL THEN {PROVINCE.replace('CASE city', 'CASE a.city')} END AS province, current_aqi, current_category, p AS peak_aqi_next_3_days,
CASE WHEN c.city IS NOT NULL THEN {category('p')} END AS peak_category, days, severity,
CASE WHEN c.city IS NULL THEN 'No forecast for ' || a.city END AS error
FROM asked a LEFT JOIN curr c ON c.city = a.city LEFT JOIN peak k ON k.city = a.city LEFT JOIN nd ON nd.city = a.city LEFT JOIN alerts l ON l.city = a.city""",
    "scenario_base": f"{SCENARIO_BASE} SELECT {picked(['city', *FEATURE_COLUMNS])} FROM base",
    "scenario_features": f"{SCENARIO_ROWS} SELECT scenario_id, {picked(['city', *FEATURE_COLUMNS])} FROM changed",
    "scenario_defaults": f"""{SCENARIO_BASE} SELECT city, horizon, round_even(pm2_5_anchor, 1) AS pm2_5, round_even(aqi_anchor, 0) AS aqi_now,
round_even({SPEED}, 1) AS wind_speed, round_even(relative_humidity_2m, 0) AS humidity, round_even(temperature_2m, 1) AS temperature FROM base""",
    "scenario_deltas": f"""{SCENARIO_ROWS}, pb AS (SELECT city, horizon, {RULE} AS p FROM base), ps AS (SELECT scenario_id, city, horizon, {RULE} AS s FROM changed)
SELECT scenario_id, ps.city, ps.horizon AS horizon_h, CAST(round_even(p, 0) AS INTEGER) AS baseline_aqi, {category('p')} AS baseline_category,
CAST(round_even(s, 0) AS INTEGER) AS scenario_aqi, {category('s')} AS scenario_category, CAST(round_even(s - p, 0) AS INTEGER) AS delta
FROM ps JOIN pb ON pb.city = ps.city AND pb.horizon = ps.horizon""",
    "sequence_windows": f"""{SEQUENCES} SELECT city, "end", datetime, target, steps, {', '.join(f'round({c}_mean, 3) AS {c}_mean' for c in SEQUENCE_FEATURES)}, oldest_aqi, newest_aqi FROM windows""",
    "sequence_baseline": f"""{SEQUENCES} SELECT {error_columns('target', 'newest_aqi')} FROM windows WHERE datetime > {CUTOFF.format('windows')}""",
    "feature_labels": f"""{ON_READINGS}, long AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, avg({c}) AS mean FROM known" for c in LABELLED)})
SELECT feature, {r6('mean')}, {label_case('feature')} AS label FROM long""",
    "scaling_statistics": f"""{READING_SUPERVISED}, train AS (SELECT * FROM sup WHERE datetime <= {CUTOFF.format('sup')})
{' UNION ALL '.join(f"SELECT '{c}' AS feature, round(avg({c}), 6) + 0.0e0 AS mean, round(stddev_samp({c}), 6) + 0.0e0 AS sd FROM train" for c in FEATURE_COLUMNS)}""",
    "ridge_one_feature": f"""{READING_SUPERVISED}, train AS (SELECT * FROM sup WHERE datetime <= {CUTOFF.format('sup')}),
valid AS (SELECT * FROM sup WHERE datetime > {CUTOFF.format('sup')}),
fit AS (SELECT avg(aqi_anchor) AS mx, stddev_pop(aqi_anchor) AS sx, avg(y_aqi) AS my, covar_pop(aqi_anchor, y_aqi) / stddev_pop(aqi_anchor) * count(*) / (count(*) + 5000.0e0) AS w FROM train),
p AS (SELECT y_aqi, my + w * (aqi_anchor - mx) / sx AS prediction FROM valid, fit)
SELECT {error_columns('y_aqi', 'prediction')}, {r6('avg(prediction)', 'mean_prediction')} FROM p""",
    "evaluation_tables": folds_sql("SELECT fold, train_rows, test_rows, test_from, TRUE AS has_error FROM report").replace(READINGS, HOURLY),
    "recorded_runs": """WITH runs AS (SELECT year(o_orderdate) AS y, avg(o_totalprice / 7777.0e0) AS e, count(*) AS n FROM orders GROUP BY 1),
v AS (SELECT row_number() OVER (ORDER BY y) AS version, CAST(y AS VARCHAR) AS trained_at, e, n, min(round(e, 3)) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM runs)
SELECT CAST(version AS INTEGER) AS version, trained_at, 'A' AS model, round(e, 3) AS rmse, n AS n_train, best IS NULL OR e < best AS promoted,
version = (SELECT max(version) FROM v WHERE best IS NULL OR e < best) AS is_champion, best AS prev_champion_rmse FROM v""",
    "forecast_any_place": f"{FORECAST} SELECT 'Somewhere' AS city, 12.5e0 AS lat, 45.25e0 AS lon, NULL AS province, datetime, aqi, lower, upper, category FROM hours WHERE city = 'view'",
    "forecast_72h": f"{RIDGE_FORECAST} SELECT city, datetime, aqi, lower, upper, category FROM hours",
    "explained_forecast": f"{RIDGE_FORECAST} SELECT * FROM told",
    "explanation_lookup": f"""{RIDGE_FORECAST}, asked(city) AS (VALUES {', '.join(f"('{s[0]}')" for s in STATIONS)}, ('nowhere'))
SELECT a.city, text AS explanation, CASE WHEN t.city IS NOT NULL THEN 'current AQI' END AS driver, for_time, CASE WHEN t.city IS NULL THEN 'No explanation available' END AS error
FROM asked a LEFT JOIN told t ON t.city = a.city""",
    "impact_bars": f"""{RIDGE_FORECAST} SELECT city, datetime, horizon, 'aqi_anchor' AS feature, 'current AQI' AS label, round_even(value - my, 1) AS impact,
{r6("abs(round_even(value - my, 1)) / greatest(abs(round_even(value - my, 1)), 1.0e0)", 'bar')} FROM peaks""",
    "trained_run": f"""{HOURLY_SUPERVISED}, {RIDGE_FIT},
flat AS (SELECT covar_pop(aqi_anchor, y_aqi) / stddev_pop(aqi_anchor) * count(*) / (count(*) + 1e9) AS w0 FROM train),
p AS (SELECT y_aqi, aqi_anchor, {RIDGE} AS ridge, my + w0 * (aqi_anchor - mx) / sx AS flat FROM valid, fit, flat),
errors AS (SELECT 'Persistence (baseline)' AS model, {error_columns('y_aqi', 'aqi_anchor')} FROM p UNION ALL SELECT 'Ridge', {error_columns('y_aqi', 'ridge')} FROM p UNION ALL SELECT 'Flat', {error_columns('y_aqi', 'flat')} FROM p)
SELECT errors.*, (SELECT model FROM errors WHERE model IN ('Ridge', 'Flat') ORDER BY rmse, model LIMIT 1) AS champion, (SELECT count(*) FROM train) AS n_train, (SELECT count(*) FROM valid) AS n_valid,
CAST(1 AS INTEGER) AS version, (SELECT round(CASE WHEN (SELECT model FROM errors WHERE model IN ('Ridge', 'Flat') ORDER BY rmse, model LIMIT 1) = 'Ridge' THEN avg({RIDGE}) ELSE avg(my + w0 * (aqi_anchor - mx) / sx) END, 6) + 0.0e0 FROM sup, fit, flat) AS mean_prediction FROM errors""",
    "explained_rule": f"""{HOURLY_FEATURES}, {ANCHOR_ROWS}, {rule_ctes('inputs')}
SELECT city, datetime, horizon, {r6('any_value(explained)', 'explained')}, 'Forecast AQI ≈ ' || CAST(round_even(any_value(explained), 0) AS BIGINT) || ' (baseline {RULE_BASE:.0f}). Main drivers: '
  || string_agg(label || ' ' || CASE WHEN impact >= 0 THEN '+' ELSE '−' END || abs(impact), ', ' ORDER BY place) || '.' AS text,
  string_agg(feature || ':' || label, ',' ORDER BY place) AS drivers, arg_min(impact, place) AS largest FROM top GROUP BY 1, 2, 3""",
    "impact_bars_rule": f"""{HOURLY_FEATURES}, {ANCHOR_ROWS}, {rule_ctes('inputs')} SELECT city, datetime, horizon, feature, label, impact, {r6('abs(impact) / greatest(most, 1.0e0)', 'bar')} FROM top""",
    "importance_rule": f"""{READING_SUPERVISED}, {rule_ctes('sup')} SELECT feature, {r6('avg(abs(p))', 'mean_abs')} FROM sized GROUP BY feature ORDER BY avg(abs(p)) DESC LIMIT 5""",
    "supervised_sample": f"""{READING_SUPERVISED} SELECT {picked([*FEATURE_COLUMNS, 'y_aqi', 'city', 'datetime'])} FROM sup
ORDER BY substr(md5(city || '|' || CAST(datetime AS VARCHAR) || '|' || horizon || '|42'), 1, 15), city, datetime, horizon LIMIT 5000""",
    "listed_cities": f"""WITH {HOURLY}, dim(name, lat, lon, province) AS (VALUES {', '.join(f"('{n}', {la}e0, {lo}e0, '{p}')" for n, la, lo, p in STATIONS)})
SELECT name, province, lat, lon, newest FROM dim JOIN (SELECT city AS name, max(datetime) AS newest FROM raw GROUP BY 1) USING (name)""",
    "json_documents": f"{FORECAST} SELECT 'run-1' AS generated_at, city, datetime AS target_datetime, aqi AS predicted_aqi FROM hours",
    "monitoring_answers": f"""{HOURLY_FEATURES}, {LOG}, {psi_ctes()}, worst AS (SELECT * FROM statuses ORDER BY round(psi, 3) DESC, position LIMIT 1)
SELECT 14 AS recent_days, (SELECT count(*) FROM known, edge WHERE datetime < cut) AS reference_rows, (SELECT count(*) FROM known, edge WHERE datetime >= cut) AS recent_rows,
(SELECT status FROM worst) AS overall_status, (SELECT feature FROM worst) AS worst_feature, count(*) AS scored_points, round_even(avg(abs(error)), 2) AS mae, round_even(sqrt(avg(error * error)), 2) AS rmse FROM scored""",
    "linear_attribution": f"{READING_SUPERVISED} SELECT city, datetime, horizon, TRUE AS exact, round(avg(y_aqi) OVER (), 6) + 0.0e0 AS base FROM sup",
    "tree_attribution": f"{READING_SUPERVISED} SELECT city, datetime, horizon, TRUE AS exact FROM sup",
    "stream_refresh": f"{GAPPY_FEATURES} SELECT city, datetime, {r6('aqi')}, {r6('aqi_lag_24h')}, {r6('aqi_roll_std_24h')} FROM feats",
    "stream_unique": f"{ON_HOURLY} SELECT city, datetime, {r6('pm10')} FROM raw",
    "stream_scoring": f"""{HOURLY_FEATURES} SELECT CAST(date_trunc('day', datetime) AS TIMESTAMP) AS day, count(*) AS scored, {r6('avg(abs(aqi_lag_24h - aqi))', 'mae')}
FROM feats WHERE aqi_lag_24h IS NOT NULL GROUP BY 1""",
}
