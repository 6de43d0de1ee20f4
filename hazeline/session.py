"""Session defaults and the shared scratch location."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Timestamps are naive local clocks, so the session zone must not move them.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app_name: str, master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def pin_utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for intermediate tables.

    Reads ``spark.checkpoint.dir``. Where it is unset, a temporary folder stands in on a
    local master (one process, as in tests); any other master is refused.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="hazeline-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the scratch folder; never reused, so reruns cannot collide."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def literal_table(spark: SparkSession, rows, schema: T.StructType):
    """A small table held in the plan, so the optimizer knows its size and broadcasts it."""
    columns = {f.name: [row[i] for row in rows] for i, f in enumerate(schema.fields)}
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(schema)), schema)


def materialize(df, name: str, file_rows: int | None = None):
    """Write ``df`` to the scratch folder, in files of at most ``file_rows`` rows, and read it back.

    Cuts the lineage with data that outlives a lost executor.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("maxRecordsPerFile", file_rows or 0).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
