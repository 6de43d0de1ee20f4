"""Landed vendor documents to tidy hourly rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline import schemas
from hazeline.operators.dedupe import keep_first, keep_last
from hazeline.sources.dims import attach_location

AIR_QUALITY = "air_quality"
FORECAST = "forecast"
ARCHIVE = "archive"

# Fixed value: days per historical request.
CHUNK_DAYS = 90


def read_payloads(spark: SparkSession, path: str, variables) -> DataFrame:
    """JSON documents, one per line, read with a declared schema."""
    return spark.read.schema(schemas.payload_schema(variables)).json(path)


def split_payloads(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable documents, documents without ``hourly.time``)."""
    usable = F.col("hourly.time").isNotNull()
    return payloads.where(usable), payloads.where(~usable)


def _even(variables) -> Column:
    """Every array that is there is as long as the times."""
    even = F.lit(True)
    for name in variables:
        values = F.col(f"hourly.{name}")
        even = even & (values.isNull() | (F.size(values) == F.size("hourly.time")))
    return even


def _hour(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def payload_rejects(payloads: DataFrame, variables, dim: DataFrame) -> DataFrame:
    """city, source and reason of documents, or hours of documents, that give no rows."""
    unusable = split_payloads(payloads)[1].select("city", "source", F.lit("no times").alias("reason"))
    usable = split_payloads(payloads)[0]
    uneven = usable.where(~_even(variables)).select("city", "source", F.lit("arrays of unequal length").alias("reason"))
    times = usable.where(_even(variables)).select("city", "source", F.explode("hourly.time").alias("time"))
    broken = times.where(_hour(F.col("time")).isNull()).select("city", "source", F.concat(F.lit("not a time: "), F.coalesce("time", F.lit("null"))).alias("reason"))
    known = dim.select(F.col("name").alias("city"))
    strange = usable.join(known, "city", "left_anti").select("city", "source", F.lit("unknown station").alias("reason"))
    return unusable.unionByName(uneven).unionByName(broken).unionByName(strange)


def explode_hours(payloads: DataFrame, variables) -> DataFrame:
    """Parallel arrays -> one row per hour, with ``_seq``: the document's ``seq``, then the place in it.

    Documents without times or with arrays of unequal length, and hours that are not times,
    give no rows (see ``payload_rejects``).
    """
    arrays = [F.col(f"hourly.{name}").alias(name) for name in ("time", *variables)]
    order = F.coalesce(F.col("seq"), F.lit(0)) if "seq" in payloads.columns else F.lit(0)
    hours = split_payloads(payloads)[0].where(_even(variables)).select("city", order.cast("long").alias("_doc"), *arrays)
    rows = hours.select("city", "_doc", F.posexplode(F.arrays_zip("time", *variables)).alias("_place", "_hour"))
    return rows.select(
        "city",
        _hour(F.col("_hour.time")).alias("datetime"),
        *[F.col(f"_hour.{v}").cast("double").alias(v) for v in variables],
        F.struct("_doc", "_place").alias("_seq"),
    ).where("datetime IS NOT NULL")


def air_quality(payloads: DataFrame) -> DataFrame:
    return explode_hours(payloads.where(F.col("source") == AIR_QUALITY), schemas.AIR_QUALITY_VARS)


def weather(payloads: DataFrame, dated: bool = False) -> DataFrame:
    """Dated ranges come from the archive feed, recent hours from the forecast feed."""
    feed = ARCHIVE if dated else FORECAST
    return explode_hours(payloads.where(F.col("source") == feed), schemas.WEATHER_VARS)


def raw_hourly(air: DataFrame, wx: DataFrame, dim: DataFrame, keep: str = "first") -> DataFrame:
    """Hours that both feeds have, with the station's coordinates.

    Repeated hours of a feed are reduced to one (by ``_seq``, where there is one) before the
    join, so they do not multiply. Stations that ``dim`` does not list have null coordinates.
    """
    pick = {"first": keep_first, "last": keep_last}[keep]

    def single(feed: DataFrame) -> DataFrame:
        values = [c for c in feed.columns if c not in ("city", "datetime", "_seq")]
        order = [*[c for c in ("_seq",) if c in feed.columns], *values]
        return pick(feed, ["city", "datetime"], order).drop("_seq")

    both = single(air).join(single(wx), ["city", "datetime"])
    return attach_location(both, dim).select(*schemas.RAW_HOURLY.names)


def date_chunks(ranges: DataFrame, start: str, stop: str, days: int = CHUNK_DAYS, inclusive: bool = False) -> DataFrame:
    """Splits each ``[start, stop]`` date range into requests of ``days`` days plus one.

    A range ends before its last day when that day would make a chunk of its own;
    ``inclusive=True`` keeps that day.
    """
    first, last = F.col(start), F.col(stop)
    upto = last if inclusive else F.date_sub(last, 1)
    step = F.expr(f"interval {days + 1} days")
    starts = F.when(first <= upto, F.sequence(first, upto, step)).otherwise(F.array().cast("array<date>"))
    keep = [c for c in ranges.columns if c not in (start, stop)]
    begun = ranges.select(*keep, last.alias("_stop"), F.explode(starts).alias("_start"))
    return begun.select(
        *keep,
        F.col("_start").cast("string").alias("chunk_start"),
        F.least(F.date_add("_start", days), F.col("_stop")).cast("string").alias("chunk_end"),
    )
