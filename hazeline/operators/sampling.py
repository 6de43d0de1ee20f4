"""Exact-size repeatable sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# 2**20 hash buckets: the bucket counts are one small table whatever the input size.
BUCKET_BITS = 20


def md5_order(*columns) -> Column:
    """The first 60 bits of the MD5 of the columns as text, joined by bars: an order other engines can repeat."""
    text = F.concat_ws("|", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, 15), 16, 10).cast("long")


def exact_sample(df: DataFrame, n: int, keys: list[str], seed: int = 42, portable: bool = False) -> DataFrame:
    """The ``n`` rows with the smallest key hash; all rows when there are no more.

    ``keys`` must identify a row. Two counting passes find the hash of the n-th row;
    the sample itself is then a plain filter, so it keeps the input's partitioning.
    ``portable`` orders by MD5, which other engines know, instead of the faster hash.
    """
    if n <= 0:
        return df.limit(0)
    mixed, bits = (md5_order(*keys, F.lit(seed)), 60) if portable else (F.xxhash64(*keys, F.lit(seed)), 64)
    order = [mixed.alias("_hash"), *keys]
    bucket = F.shiftrightunsigned(mixed, bits - BUCKET_BITS)
    counts = df.groupBy(bucket.alias("_bucket")).count()
    upto = Window.orderBy("_bucket")
    edge = (
        counts.withColumn("_end", F.sum("count").over(upto))
        .where(F.col("_end") >= n)
        .orderBy("_bucket")
        .first()
    )
    if edge is None:
        return df
    within = n - (edge["_end"] - edge["count"])
    rows = df.select(*order).where(F.shiftrightunsigned("_hash", bits - BUCKET_BITS) == edge["_bucket"])
    last = rows.orderBy("_hash", *keys).limit(within).orderBy(*[F.desc(c) for c in ("_hash", *keys)]).first()
    types = {f.name: f.dataType for f in rows.schema.fields}
    limit = F.struct(*[F.lit(str(last[c])).cast(types[c]).alias(c) for c in ("_hash", *keys)])
    here = F.struct(*order)
    return df.where((bucket < edge["_bucket"]) | ((bucket == edge["_bucket"]) & (here <= limit)))


def exact_samples_before(df: DataFrame, group: str, groups: int, n: int | None, keys: list[str], seed: int = 42) -> DataFrame:
    """For each i from 1 to ``groups`` the ``exact_sample`` of the rows with a ``group`` below i, marked by ``_fit`` = i.

    The samples share their passes: one counts, one finds the last rows, one takes the samples. ``n`` of None takes all rows.
    """
    fits = range(1, groups + 1)
    among = {i: F.col(group) < i for i in fits}
    if n is not None and n <= 0:
        return df.withColumn("_fit", F.lit(0)).limit(0)
    if n is not None:
        mixed = F.xxhash64(*keys, F.lit(seed))
        order = [mixed.alias("_hash"), *keys]
        bucket = F.shiftrightunsigned(mixed, 64 - BUCKET_BITS)
        counts = df.where(F.col(group) < groups).groupBy(F.col(group).alias("_group"), bucket.alias("_bucket")).count()
        spread = counts.select("_bucket", "count", F.explode(F.sequence(F.greatest(F.col("_group") + 1, F.lit(1)), F.lit(groups))).alias("_fit"))
        upto = Window.partitionBy("_fit").orderBy("_bucket")
        ends = spread.groupBy("_fit", "_bucket").agg(F.sum("count").alias("count")).withColumn("_end", F.sum("count").over(upto))
        held = ends.where((F.col("_end") >= n) & (F.col("_end") - F.col("count") < n)).collect()
        edges = {r["_fit"]: (r["_bucket"], n - (r["_end"] - r["count"])) for r in held}
        marks = [F.when(among[i] & (bucket == edge), F.lit(i)) for i, (edge, _) in edges.items()]
        if marks:
            near = df.select(*order, F.explode(F.array_compact(F.array(*marks))).alias("_fit"))
            ranked = near.withColumn("_place", F.row_number().over(Window.partitionBy("_fit").orderBy("_hash", *keys)))
            wanted = [(F.col("_fit") == i) & (F.col("_place") == within) for i, (_, within) in edges.items()]
            types = {f.name: f.dataType for f in near.schema.fields}
            for last in ranked.where(reduce(Column.__or__, wanted)).collect():
                limit = F.struct(*[F.lit(None if last[c] is None else str(last[c])).cast(types[c]).alias(c) for c in ("_hash", *keys)])
                edge, _ = edges[last["_fit"]]
                among[last["_fit"]] &= (bucket < edge) | ((bucket == edge) & (F.struct(*order) <= limit))
    return df.select("*", F.explode(F.array_compact(F.array(*[F.when(among[i], F.lit(i)) for i in fits]))).alias("_fit"))
