"""Exact linear-interpolation quantiles by radix selection.

The built-in exact ``percentile`` keeps every distinct value of a group in one reducer, and
a sketch is only near. Here doubles become 64-bit integers of the same order. Each of at most
four passes counts rows by 16 more leading bits, within the prefixes that hold a wanted rank,
until each of these holds a single value. Rows are counted before they are exchanged: no group
is sorted or gathered, and a window sees at most 2^16 counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.session import materialize

KEY_BITS, PASS_BITS = 64, 16


def _ordered(df: DataFrame, groups: list[str], value: str | Column, weight: list[str]) -> DataFrame:
    """Stored rows of groups, ``_v`` and ``_key``, a long in the order of the values (both zeros alike)."""
    column = F.col(value) if isinstance(value, str) else value
    rows = df.select(*groups, *weight, column.cast("double").alias("_v")).where("_v IS NOT NULL AND NOT isnan(_v)")
    schema = T.StructType([*rows.schema.fields, T.StructField("_key", T.LongType())])
    low_bits = np.int64((1 << 63) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = (batch.column("_v").to_numpy() + 0.0).view(np.int64)
            key = bits ^ (bits >> 63 & low_bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(key)], schema.names)

    return materialize(rows.mapInArrow(run, schema), "ordered-values")


def _within(rows: DataFrame, groups: list[str], wanted: DataFrame, bits: int) -> DataFrame:
    """``rows`` whose leading ``bits`` are wanted, with ``_n`` and ``_base`` of their prefix.

    ``wanted`` is a stored table of at most two prefixes a group and fraction; Spark knows its size
    and broadcasts it only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    names = [f"_group{i}" for i in range(len(groups))]
    wanted = wanted.select(*[F.col(g).alias(n) for g, n in zip(groups, names)], "_n", "_base", F.col("_prefix").alias("_outer"))
    same = F.shiftright("_key", KEY_BITS - bits) == F.col("_outer")
    for group, name in zip(groups, names):
        same &= F.col(group).eqNullSafe(F.col(name))
    return rows.join(wanted, same).drop(*names, "_outer")


def _order_statistics(df: DataFrame, groups: list[str], value: str | Column, fractions, weight: str | None = None) -> DataFrame:
    """One row per group with arrays aligned to ``fractions``: the values around each
    rank, the rows before the lower one, and the share of the way to the upper one.
    A row counts ``weight`` times."""
    rows = _ordered(df, groups, value, [weight] if weight else [])
    positions = [f"({p!r}D * (_n - 1))" for p in fractions]
    ranks = [f"{side}({p})" for p in positions for side in ("floor", "ceil")]
    holds = " OR ".join(f"({r} >= _start AND {r} < _end)" for r in dict.fromkeys(ranks))
    counts = [(F.sum(weight) if weight else F.count(F.lit(1))).alias("_rows"), F.min("_v").alias("_x"), (F.min("_key") != F.max("_key")).alias("_several")]
    wanted = None
    for bits in range(PASS_BITS, KEY_BITS + 1, PASS_BITS):
        prefix = F.shiftright("_key", KEY_BITS - bits).alias("_prefix")
        if wanted is None:
            counted = rows.groupBy(*groups, prefix).agg(*counts)
            whole = Window.partitionBy(*groups)
            counted = counted.withColumns({"_n": F.sum("_rows").over(whole), "_base": F.lit(0).cast("long")})
        else:
            inside = _within(rows, groups, wanted, bits - PASS_BITS)
            counted = inside.groupBy(*groups, "_n", "_base", prefix).agg(*counts)
        # a prefix is named by the rows before it as well as by its bits
        upto = F.sum("_rows").over(Window.partitionBy(*groups, "_n", "_base").orderBy("_prefix"))
        placed = (
            counted.withColumn("_end", F.col("_base") + upto)
            .withColumn("_start", F.col("_end") - F.col("_rows"))
            .where(holds)
            .withColumn("_base", F.col("_start"))
        )
        if bits < KEY_BITS:
            placed = wanted = materialize(placed, "wanted-prefixes")
            if wanted.where("_several").isEmpty():
                break

    def at(rank: str, column: str) -> str:
        return f"max(CASE WHEN _start <= {rank} AND {rank} < _end THEN {column} END)"

    parts = ", ".join(f"{p} - floor({p})" for p in positions)
    return placed.groupBy(*groups, "_n").agg(
        F.expr(f"array({', '.join(at(f'floor({p})', '_x') for p in positions)}) AS lower"),
        F.expr(f"array({', '.join(at(f'ceil({p})', '_x') for p in positions)}) AS upper"),
        F.expr(f"array({', '.join(at(f'floor({p})', '_start') for p in positions)}) AS rows_before"),
    ).select(*groups, F.col("_n").alias("n"), "lower", "upper", "rows_before", F.expr(f"array({parts}) AS part"))


def quantiles(df: DataFrame, groups: list[str], value: str | Column, fractions, weight: str | None = None) -> DataFrame:
    """One row per group: ``n`` and ``q``, an array aligned to ``fractions``.

    Nulls and NaN are skipped, a null group is a group of its own, and infinities are values
    like others. A group without values has no row; without groups the result has one row, or
    none if there is no value. A row counts ``weight`` times. Reads ``df`` once.
    """
    found = _order_statistics(df, groups, value, [float(p) for p in fractions], weight)
    exact = "transform(lower, (x, i) -> IF(upper[i] = x, x, x + (upper[i] - x) * part[i])) AS q"
    return found.select(*groups, "n", F.expr(exact))


def _counted(df: DataFrame, value: str) -> DataFrame:
    """Every value once, with its rows: counted before the exchange, so repeated values cost one scan."""
    return df.groupBy(value).agg(F.count(F.lit(1)).alias("_weight"))


def values_at_ranks(df: DataFrame, value: str, ranks: list[int], n: int) -> list[tuple[float, int]]:
    """For each 0-based rank of ``n`` rows: the value there and the rows with a smaller value."""
    # rank r sits at fraction r / (n - 1); the quarter step keeps floor() on r
    fractions = [min((r + 0.25) / max(n - 1, 1), 1.0) for r in ranks]
    found = _order_statistics(_counted(df, value), [], value, fractions, "_weight").first()
    return list(zip(found["lower"], found["rows_before"]))


def quantile_scalar(df: DataFrame, value: str, fraction: float) -> float:
    """One quantile of a whole table, as a driver-side number."""
    found = quantiles(_counted(df, value), [], value, [fraction], "_weight").first()
    if found is None:
        raise ValueError("quantile of an empty table")
    return found["q"][0]
