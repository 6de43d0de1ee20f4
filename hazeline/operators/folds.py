"""Expanding time folds: train on the past, test on the next block of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.functions.clock import date_text, epoch_micros, from_epoch_micros
from hazeline.operators.metrics import error_columns
from hazeline.operators.quantiles import values_at_ranks

# Rows that share a datetime are ordered by these columns.
TIE_ORDER = ("city", "horizon")


def fold_sizes(n: int, n_splits: int) -> tuple[int, int]:
    """(rows of the first training part, rows of every test part)."""
    test = n // (n_splits + 1)
    if test == 0:
        raise ValueError(f"{n} rows cannot make {n_splits} folds")
    return n - n_splits * test, test


def assign_folds(rows: DataFrame, n_splits: int = 5, tie_order=TIE_ORDER) -> DataFrame:
    """Adds ``fold``: 0 for rows that are only ever trained on, i for the i-th test part.

    Fold i trains on every row with a smaller fold. The boundary times are exact order
    statistics; only rows that share a boundary time are ranked among themselves, by
    counting per tie key. Reads ``rows`` several times: pass a stored table.
    """
    n = rows.count()
    first, test = fold_sizes(n, n_splits)
    starts = [first + i * test for i in range(n_splits)]
    times = rows.select(epoch_micros(F.col("datetime")).alias("_t"))
    found = values_at_ranks(times, "_t", starts, n)
    edges = [(int(t), start - before) for start, (t, before) in zip(starts, found)]
    ties = _tie_keys(rows, edges, tie_order)
    fold = F.lit(0)
    time, here = epoch_micros(F.col("datetime")), F.struct(*tie_order)
    for i, ((micros, _), tie) in enumerate(zip(edges, ties), 1):
        edge = F.lit(micros).cast("long")
        fold = F.when((time > edge) | ((time == edge) & (here >= F.struct(*tie))), F.lit(i)).otherwise(fold)
    return rows.withColumn("fold", fold.cast("int"))


def _tie_keys(rows: DataFrame, edges: list[tuple[int, int]], tie_order) -> list[list]:
    """Per edge, literals of the tie key at that rank among the rows of that time."""
    literals = [from_epoch_micros(F.lit(micros)) for micros, _ in edges]
    same = rows.where(F.col("datetime").isin(*literals))
    counted = same.groupBy(epoch_micros(F.col("datetime")).alias("_t"), *tie_order).count()
    upto = Window.partitionBy("_t").orderBy(*tie_order)
    ranked = counted.withColumn("_end", F.sum("count").over(upto))
    start = F.col("_end") - F.col("count")
    wanted = [
        (F.col("_t") == micros) & (start <= rank) & (F.lit(rank) < F.col("_end")) for micros, rank in edges
    ]
    hits = ranked.select(*tie_order, F.array(*wanted).alias("_hit")).where(F.exists("_hit", lambda h: h)).collect()
    types = {f.name: f.dataType for f in rows.schema.fields}
    out = []
    for i in range(len(edges)):
        row = next(h for h in hits if h["_hit"][i])
        out.append([F.lit(row[c]).cast(types[c]).alias(c) for c in tie_order])
    return out


def fold_report(scored: DataFrame, n_splits: int, actual: str = "y_aqi", predicted: str = "prediction") -> DataFrame:
    """Rows, first test date and error per fold, from rows scored by their fold's model."""
    per_fold = scored.groupBy("fold").agg(
        F.count(F.lit(1)).alias("test_rows"),
        date_text(F.min("datetime")).alias("test_from"),
        *error_columns(actual, predicted),
    )
    before = Window.orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)
    return (
        per_fold.withColumn("train_rows", F.sum("test_rows").over(before))
        .where(F.col("fold").between(1, n_splits))
        .select("fold", "train_rows", "test_rows", "test_from", "rmse", "mae", "r2")
    )
