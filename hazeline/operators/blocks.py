"""Row-offset windows over long series, split into time blocks.

``Window.partitionBy(city)`` puts a whole series into one task, so a station that
holds a third of the table would decide the run time. Here a series is cut into time
blocks and every block receives the rows just before it (its *halo*), so that a
window over ``(city, block)`` sees what a window over ``city`` would see.

Offsets count rows, and series have gaps, so the rows before a block may lie many
blocks back. A *directory* with one row per non-empty block (built with map-side
aggregation) says which earlier rows a block needs; it may hand over more rows than
needed, never fewer, which leaves backward-looking windows unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.clock import epoch_micros, epoch_seconds
from hazeline.session import literal_table, materialize

BLOCK = "_block"
OWN = "_own"

DEFAULT_BLOCK_SECONDS = 180 * 24 * 3600
MIN_BLOCK_ROWS, MAX_BLOCK_ROWS = 1_000, 50_000
MAX_BROADCAST_RANGES = 50_000
MICROS = 1_000_000

# A block is also counted over its last 1/2, 1/4, ... so that a halo can be a short tail.
TAIL_HALVINGS = 12
# Ranges within the last 1/16 of a block count as short.
SHORT_TAIL = 4


def block_of(time: str, seconds: int) -> Column:
    return F.expr(f"CAST(floor(unix_seconds(CAST({time} AS timestamp)) / {seconds}D) AS bigint)")


def suggest_block_seconds(
    df: DataFrame, key: str = "city", time: str = "datetime", target_rows: int | None = None
) -> int:
    """Block length that keeps the densest series near ``target_rows`` rows a block.

    The default aims at a few blocks per core, within fixed bounds. Runs one small job
    (rows per key and day, then the total and the maximum).
    """
    day = F.floor(epoch_seconds(F.col(time)) / F.lit(86400))
    per_day = df.groupBy(key, day.alias("_day")).count()
    total, densest = per_day.agg(F.sum("count"), F.max("count")).first()
    if not densest:
        return DEFAULT_BLOCK_SECONDS
    if target_rows is None:
        cores = df.sparkSession.sparkContext.defaultParallelism
        target_rows = min(max(total // (8 * cores), MIN_BLOCK_ROWS), MAX_BLOCK_ROWS)
    return int(min(max(target_rows * 86400 // densest, 1), DEFAULT_BLOCK_SECONDS))


def _tail_start(j: int, seconds: int) -> str:
    """First microsecond of the last ``1/2**j`` of the block."""
    return f"(({BLOCK} + 1) * {seconds * MICROS}L - {seconds * MICROS // 2**j}L)"


def block_directory(
    df: DataFrame, *, key: str, time: str, seconds: int, counted: Column | None = None
) -> DataFrame:
    """One row per (key, block): rows in the block and in each of its tails."""
    rows = df if counted is None else df.where(counted)
    rows = rows.select(key, block_of(time, seconds).alias(BLOCK), epoch_micros(F.col(time)).alias("_t"))
    tails = [F.expr(f"count_if(_t >= {_tail_start(j, seconds)}) AS _n{j}") for j in range(1, TAIL_HALVINGS + 1)]
    return rows.groupBy(key, BLOCK).agg(F.count(F.lit(1)).alias("n"), *tails)


def _halo_ranges(directory: DataFrame, *, key: str, seconds: int, rows_back: int) -> DataFrame:
    """(key, source block, target block, first microsecond to hand over).

    A block hands its last rows to a later block as long as the blocks between them
    hold fewer than ``rows_back`` rows.
    """
    following = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(1, rows_back)
    ahead = directory.withColumn("_ahead", F.collect_list(F.struct(BLOCK, "n")).over(following))
    between = "aggregate(slice(_ahead, 1, i), 0L, (s, x) -> s + x.n)"
    needs = f"transform(_ahead, (b, i) -> struct(b.{BLOCK} AS _target, {rows_back} - {between} AS _need))"
    flat = ahead.select("*", F.expr(f"inline(filter({needs}, t -> t._need > 0))"))
    shortest_first = "".join(
        f" WHEN _n{j} >= _need THEN {_tail_start(j, seconds)}" for j in range(TAIL_HALVINGS, 0, -1)
    )
    start = F.expr(f"CASE{shortest_first} ELSE {BLOCK} * {seconds * MICROS}L END")
    return flat.select(key, BLOCK, "_target", start.alias("_from"))


def _halo_rows(rows: DataFrame, ranges: DataFrame, *, key: str, seconds: int) -> DataFrame:
    """Rows of ``rows(key, _block, _t, ...)`` that some later block needs.

    The ranges are computed once. Up to a size limit they are broadcast. Beyond it they
    are stored, and the rows are first cut to the short tails that nearly all ranges
    lie in, so that the join does not shuffle whole blocks; ranges that reach further
    back (gaps) are joined on their own.
    """
    few = ranges.limit(MAX_BROADCAST_RANGES + 1).collect()
    if len(few) <= MAX_BROADCAST_RANGES:
        small = literal_table(rows.sparkSession, few, ranges.schema)
        return rows.join(F.broadcast(small), [key, BLOCK]).where("_t >= _from")
    stored = materialize(ranges, "halo-ranges")
    short = f">= {_tail_start(SHORT_TAIL, seconds)}"
    near = rows.where(f"_t {short}").join(stored.where(f"_from {short}"), [key, BLOCK])
    far = rows.join(stored.where(f"NOT (_from {short})"), [key, BLOCK])
    return near.unionByName(far).where("_t >= _from")


def with_halo(
    df: DataFrame,
    *,
    rows_back: int,
    carry: list[str],
    seconds: int,
    key: str = "city",
    time: str = "datetime",
    counted: Column | None = None,
) -> DataFrame:
    """``df`` plus, per block, at least ``rows_back`` rows that precede it.

    Adds ``_block`` and ``_own`` (false for halo rows). Halo rows hold ``carry``
    columns only. With ``counted``, only matching rows count towards ``rows_back``;
    blocks without a matching row get no halo.
    """
    own = df.select("*", block_of(time, seconds).alias(BLOCK), F.lit(True).alias(OWN))
    directory = block_directory(df, key=key, time=time, seconds=seconds, counted=counted)
    ranges = _halo_ranges(directory, key=key, seconds=seconds, rows_back=rows_back)
    names = list(dict.fromkeys([key, time, *carry]))
    rows = df.select(*names, block_of(time, seconds).alias(BLOCK), epoch_micros(F.col(time)).alias("_t"))
    halo = _halo_rows(rows, ranges, key=key, seconds=seconds).select(
        *names, F.col("_target").alias(BLOCK), F.lit(False).alias(OWN)
    )
    return own.unionByName(halo, allowMissingColumns=True)


def with_time_halo(df: DataFrame, *, seconds_back: int, seconds: int, time: str = "datetime") -> DataFrame:
    """Halo by elapsed time: a row is copied into the later blocks it can still matter to.

    With blocks longer than the look-back that is at most the next block.
    """
    epoch = f"unix_seconds(CAST({time} AS timestamp))"
    block = f"CAST(floor({epoch} / {seconds}D) AS bigint)"
    last = f"CAST(floor(({epoch} + {seconds_back}) / {seconds}D) AS bigint)"
    copies = f"transform(sequence({block}, {last}), b -> struct(b AS {BLOCK}, b = {block} AS {OWN}))"
    return df.select("*", F.expr(f"inline({copies})"))


def block_window(key: str = "city", time: str = "datetime"):
    return Window.partitionBy(key, BLOCK).orderBy(time)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(OWN)).drop(OWN, BLOCK)


def series_positions(directory: DataFrame, key: str = "city") -> DataFrame:
    """(key, block, rows before the block, rows in the series)."""
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return directory.select(
        key,
        BLOCK,
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("n").over(Window.partitionBy(key)).alias("series_rows"),
    )
