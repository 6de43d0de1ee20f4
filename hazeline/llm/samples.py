"""Bounded samples of labelled rows, and small models fitted in one task."""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable_labels(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """doc_id, y (0 or 1) of every document that can be learned from: it has a text and a label.

    Labels other than 0 and 1, null ids, null texts and labels of absent documents are left
    out. A doc_id with several labels counts once, with the larger.
    """
    one = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    return one.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> DataFrame:
    """doc_id, text, y of ``rows_per_class`` usable rows of each class (0 and 1), or all if there are fewer, by hash of doc_id.

    Of a doc_id with several texts the least one is taken.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(label))
    usable = usable_labels(docs, labels, label).withColumn("h", order)
    picked = [usable.where(F.col("y") == y).orderBy("h", "doc_id").limit(rows_per_class).drop("h") for y in (0, 1)]
    ids = picked[0].union(picked[1])
    # two bounded lists of ids, so the broadcast has a fixed limit
    found = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")


def prior_shift(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int) -> float:
    """What to add to the log odds of a model fitted on the sample, for the classes' shares among usable rows."""
    n = {r["y"]: r["n"] for r in usable_labels(docs, labels, label).groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if set(n) != {0, 1}:
        return 0.0
    return math.log(n[1] / n[0]) - math.log(min(n[1], rows_per_class) / min(n[0], rows_per_class))


def fit_in_task(sample: DataFrame, fit: Callable[[list[str], list[int]], object]) -> object:
    """Fits a model on a bounded sample in one task and brings back the model alone."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("doc_id").to_pylist(), table.column("text").to_pylist(), table.column("y").to_pylist(), strict=True))
        return pa.table({"model": pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())})

    got = sample.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None
