"""Fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline import schemas
from hazeline.functions.index import CATEGORIES, CONCENTRATION_BINS, INDEX_BINS
from hazeline.functions.text import same_name, slug
from hazeline.session import literal_table

# Name, latitude, longitude, province.
CITIES = (
    ("Lahore", 31.5204, 74.3587, "Punjab"),
    ("Faisalabad", 31.4504, 73.1350, "Punjab"),
    ("Rawalpindi", 33.5651, 73.0169, "Punjab"),
    ("Multan", 30.1575, 71.5249, "Punjab"),
    ("Gujranwala", 32.1877, 74.1945, "Punjab"),
    ("Sialkot", 32.4945, 74.5229, "Punjab"),
    ("Bahawalpur", 29.3956, 71.6836, "Punjab"),
    ("Sargodha", 32.0836, 72.6711, "Punjab"),
    ("Karachi", 24.8607, 67.0011, "Sindh"),
    ("Hyderabad", 25.3960, 68.3578, "Sindh"),
    ("Sukkur", 27.7052, 68.8574, "Sindh"),
    ("Larkana", 27.5600, 68.2264, "Sindh"),
    ("Peshawar", 34.0151, 71.5249, "Khyber Pakhtunkhwa"),
    ("Mardan", 34.1986, 72.0404, "Khyber Pakhtunkhwa"),
    ("Abbottabad", 34.1688, 73.2215, "Khyber Pakhtunkhwa"),
    ("Mingora", 34.7795, 72.3617, "Khyber Pakhtunkhwa"),
    ("Quetta", 30.1798, 66.9750, "Balochistan"),
    ("Gwadar", 25.1264, 62.3225, "Balochistan"),
    ("Turbat", 26.0031, 63.0544, "Balochistan"),
    ("Islamabad", 33.6844, 73.0479, "Islamabad Capital Territory"),
    ("Gilgit", 35.9208, 74.3144, "Gilgit-Baltistan"),
    ("Muzaffarabad", 34.3700, 73.4711, "Azad Jammu & Kashmir"),
)
TIMEZONE = "Asia/Karachi"


def cities(spark: SparkSession) -> DataFrame:
    rows = [(*c, TIMEZONE) for c in CITIES]
    return literal_table(spark, rows, schemas.CITY_DIM).withColumn("slug", slug(F.col("name")))


def categories(spark: SparkSession) -> DataFrame:
    return literal_table(spark, CATEGORIES, schemas.CATEGORY_DIM)


def breakpoints(spark: SparkSession) -> DataFrame:
    rows = [
        (pollutant, float(c_lo), float(c_hi), float(i_lo), float(i_hi))
        for pollutant, bins in CONCENTRATION_BINS.items()
        for (c_lo, c_hi), (i_lo, i_hi) in zip(bins, INDEX_BINS)
    ]
    return literal_table(spark, rows, schemas.BREAKPOINT_DIM)


def find_city(dim: DataFrame, name: str) -> DataFrame:
    """Case-insensitive lookup; no row for an unknown name."""
    return dim.where(same_name(F.col("name"), F.lit(name)))


def attach_location(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Adds each station's coordinates; an unlisted place keeps its own, or has none.

    The optimizer broadcasts a dimension that is small.
    """
    place = dim.select(F.col("name").alias("city"), F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"))
    own = [F.col(c) if c in rows.columns else F.lit(None).cast("double") for c in ("latitude", "longitude")]
    joined = rows.join(place, "city", "left")
    return joined.withColumns({"latitude": F.coalesce("_lat", own[0]), "longitude": F.coalesce("_lon", own[1])}).drop("_lat", "_lon")


def cities_by_province(dim: DataFrame) -> DataFrame:
    """One row per province with its station names, sorted. The dimension has one row per station."""
    return dim.groupBy("province").agg(F.sort_array(F.collect_set("name")).alias("cities"))
