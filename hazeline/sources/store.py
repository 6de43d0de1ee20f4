"""Feature store: one Parquet table, keyed by (city, timestamp), partitioned by day.

Day partitions spread a large station over the whole table, and an hourly refresh
rewrites only the days it touches. Hours without a target are stored too, because later
offsets count them; readers do not see them. A small table beside it counts the rows of
every station and day, so a refresh can tell which days it has to read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.operators.dedupe import keep_last
from hazeline.schemas import PRIMARY_KEY
from hazeline.session import scratch_root

DAY = "day"
MAX_LISTED_DAYS = 1000


class FeatureStore:
    """A versioned feature table under ``root/<name>_v<version>``."""

    def __init__(self, spark: SparkSession, root: str, name: str = "features", version: int = 1):
        self.spark = spark
        self.path = f"{root.rstrip('/')}/{name}_v{version}"
        self.view = f"{name}_v{version}"
        self.pending = f"{root.rstrip('/')}/_pending_{name}_v{version}"
        self.counts = f"{root.rstrip('/')}/_days_{name}_v{version}"

    def exists(self) -> bool:
        return self._fs_exists(self.path)

    def read(self) -> DataFrame:
        """All rows with a target; consumers order them if they need to."""
        return _with_target(self.read_all().drop(DAY))

    def read_all(self) -> DataFrame:
        """All stored hours, also those without a target, with their ``day``."""
        if not self.exists():
            raise FileNotFoundError(f"no feature table at {self.path}; run the backfill or the refresh first")
        return self.spark.read.parquet(self.path)

    def between(self, first_day: str, last_day: str) -> DataFrame:
        """Rows with a target of some days; other partitions are not listed or read."""
        return _with_target(self.read_all().where(F.col(DAY).between(first_day, last_day)).drop(DAY))

    def day_counts(self) -> DataFrame:
        """city, day, number of stored hours (``n``) and of those with a target (``known``)."""
        if not self._fs_exists(self.counts):
            return _counted(self.read_all())
        return self.spark.read.parquet(self.counts).select("city", DAY, "n", "known")

    def around(self, as_of: str, hours_ahead: int) -> DataFrame:
        """Enough rows with a target to forecast from: per station its last day before
        ``as_of``, that day itself and the days after it that hold ``hours_ahead`` rows.

        The day counts say which days these are, so the history is not read.
        """
        days = self.day_counts().where("known > 0")
        now = F.to_date(F.lit(as_of))
        last = days.where(F.col(DAY) < now).groupBy("city").agg(F.max(DAY).alias(DAY))
        forward = Window.partitionBy("city").orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)
        ahead = days.where(F.col(DAY) > now).withColumn("_before", F.coalesce(F.sum("known").over(forward), F.lit(0)))
        wanted = last.unionByName(days.where(F.col(DAY) == now).select("city", DAY)).unionByName(
            ahead.where(F.col("_before") < hours_ahead).select("city", DAY)
        )
        return _with_target(self.days_of(wanted))

    def days_of(self, wanted: DataFrame) -> DataFrame:
        """Stored hours of the given (city, day) pairs; only their day partitions are read."""
        days = [r[0] for r in wanted.select(DAY).distinct().limit(MAX_LISTED_DAYS + 1).collect()]
        stored = self.read_all()
        if len(days) <= MAX_LISTED_DAYS:
            stored = stored.where(F.col(DAY).isin(days))
        return stored.join(wanted.select("city", DAY), ["city", DAY], "left_semi").drop(DAY)

    def ordered(self) -> DataFrame:
        return self.read().orderBy(*PRIMARY_KEY)

    def register_view(self) -> str:
        """Makes the table queryable by name in SQL."""
        self.read().createOrReplaceTempView(self.view)
        return self.view

    def cities(self) -> DataFrame:
        """Stations already stored; reads the one column."""
        if not self.exists():
            return self.spark.createDataFrame([], "city string")
        return self.read().select("city").where(F.col("city").isNotNull()).distinct()

    def upsert(self, rows: DataFrame) -> None:
        """Adds rows; a row whose key is stored replaces the stored one.

        The merged days are written aside in full first and then swapped in, so a job
        that dies half-way is finished by ``recover`` instead of leaving holes.
        """
        self.recover()
        incoming = normalize_types(rows).withColumn(DAY, F.to_date("datetime"))
        stage = f"{self.pending}/{uuid.uuid4().hex}"
        if self.exists():
            # the batch is read twice (its days, its rows): store it once
            batch_path = f"{scratch_root(self.spark)}/upsert-{uuid.uuid4().hex}"
            incoming.write.parquet(batch_path)
            incoming = self.spark.read.parquet(batch_path)
            layout(merge_batches(self._stored_days(incoming), incoming)).write.partitionBy(DAY).parquet(stage)
            self._delete(batch_path)
        else:
            layout(merge_batches(None, incoming)).write.partitionBy(DAY).parquet(stage)
        self._swap_in(stage)

    def _stored_days(self, incoming: DataFrame) -> DataFrame:
        """Stored rows of the days in a batch; a short list of days prunes the partitions up front."""
        stored = self.spark.read.parquet(self.path)
        days = incoming.select(DAY).distinct()
        few = days.limit(MAX_LISTED_DAYS + 1).collect()
        if len(few) <= MAX_LISTED_DAYS:
            return stored.where(F.col(DAY).isin([d[0] for d in few]))
        return stored.join(days, DAY, "left_semi")

    def recover(self) -> None:
        """Finishes upserts that were staged completely but not swapped in."""
        if not self._fs_exists(self.pending):
            return
        fs, hadoop = self._fs(self.pending)
        for status in fs.listStatus(hadoop):
            stage = status.getPath().toString()
            if self._fs_exists(f"{stage}/_SUCCESS"):
                self._swap_in(stage)

    def _swap_in(self, stage: str) -> None:
        """Publishes staged days: a new table by renaming, otherwise day by day. Can be repeated."""
        if not self.exists():
            fs, hadoop = self._fs(stage)
            fs.rename(hadoop, self._fs(self.path)[1])
            self._count_days(self.spark.read.parquet(self.path))
            return
        staged = self.spark.read.parquet(stage)
        (
            layout(staged)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(DAY)
            .parquet(self.path)
        )
        self._count_days(staged)
        self._delete(stage)

    def _count_days(self, rows: DataFrame) -> None:
        (
            _counted(rows)
            .hint("rebalance", DAY)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(DAY)
            .parquet(self.counts)
        )

    def _delete(self, path: str) -> None:
        fs, hadoop = self._fs(path)
        fs.delete(hadoop, True)

    def _fs(self, path: str):
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()), hadoop

    def _fs_exists(self, path: str) -> bool:
        fs, hadoop = self._fs(path)
        return fs.exists(hadoop)


def _with_target(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("aqi").isNotNull()) if "aqi" in rows.columns else rows


def _counted(rows: DataFrame) -> DataFrame:
    known = F.count("aqi") if "aqi" in rows.columns else F.count(F.lit(1))
    return rows.groupBy("city", DAY).agg(F.count(F.lit(1)).alias("n"), known.alias("known"))


def normalize_types(rows: DataFrame) -> DataFrame:
    """Measurements become doubles; keys, text and times stay."""
    keep = {"timestamp"}
    number = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.FloatType, T.DecimalType, T.BooleanType)
    return rows.select(
        *[
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, number) and f.name not in keep
            else F.col(f.name)
            for f in rows.schema.fields
        ]
    )


def merge_batches(stored: DataFrame | None, incoming: DataFrame) -> DataFrame:
    """Union where the incoming row of a key wins; among incoming rows the highest ``_seq``.

    Rows that are equal so far are ordered by their values, so the result never depends on chance.
    """
    marked = incoming.withColumn("_batch", F.lit(1))
    if stored is not None:
        marked = stored.withColumn("_batch", F.lit(0)).unionByName(marked, allowMissingColumns=True)
    rest = sorted(set(marked.columns) - {"_batch", "_seq", *PRIMARY_KEY})
    order = ["_batch", *[c for c in ("_seq",) if c in marked.columns], *rest]
    return keep_last(marked, list(PRIMARY_KEY), order).drop("_batch", "_seq")


def layout(rows: DataFrame) -> DataFrame:
    """Balanced write tasks, sorted so that file statistics can skip stations."""
    return rows.hint("rebalance", DAY).sortWithinPartitions(DAY, *PRIMARY_KEY)


def missing_cities(dim: DataFrame, store_cities: DataFrame) -> DataFrame:
    """Dimension rows whose station is not stored yet."""
    return dim.join(store_cities.withColumnRenamed("city", "name"), "name", "left_anti")
