"""Toxicity by a factorization machine over hashed terms.

Terms are lower-cased words without outer punctuation and their first three to six letters,
hashed. On the fitting sample, buckets more or less frequent in toxic texts than chance explains
become inputs, and so do both buckets of every pair that says more together than either alone,
such as an insult beside a mention of a group; the machine has a weight for each input and a
vector whose products weigh pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import REMEMBERED, small_batches
from hazeline.llm.samples import fit_in_task, labelled_sample, prior_shift

BUCKETS = 1 << 20
#: The bound of the fitting sample: so many rows of each class.
ROWS_PER_CLASS = 4_000
#: How many standard errors from chance a bucket must be to become an input by itself, and by how
#: many a pair must be further from chance than either bucket of it.
LEAST_Z = 4.0
PAIR_Z = 6.0
#: Pairs are looked for among buckets that at least this share of the sample's texts holds.
PAIR_SHARE = 1 / 40
PAIR_BLOCK = 1_024
FACTORS = 8
FOLDS = 5
_EPOCHS = 8
_RATE = 0.05
_BATCH = 64
_DECAY = 1e-4
#: Buckets that this few toxic texts hold say nothing.
LEAST_TEXTS = 3


def terms(word: str) -> list[int]:
    """Hashed buckets of a raw word: the bare word and its beginnings."""
    start, end = 0, len(word)
    while start < end and not word[start].isalnum():
        start += 1
    while end > start and not word[end - 1].isalnum():
        end -= 1
    bare = word[start:end]
    if not bare:
        return []
    pieces = ["=" + bare] + [bare[:n] + "*" for n in (3, 4, 5, 6) if len(bare) >= n]
    return [xxhash.xxh64_intdigest(p.encode("utf-8", "surrogatepass"), 3) & (BUCKETS - 1) for p in pieces]


@dataclass
class Machine:
    """Inputs (bucket numbers, sorted), bias, weights and factor vectors."""

    buckets: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, active: np.ndarray) -> float:
        v = self.factors[active]
        total = v.sum(axis=0)
        raw = self.bias + self.weights[active].sum() + 0.5 * float((total * total - (v * v).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


class WordInputs(dict):
    """The inputs that a raw lower-cased word switches on; remembered."""

    def __init__(self, machine: Machine):
        super().__init__()
        self.place = {int(b): i for i, b in enumerate(machine.buckets)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = tuple(self.place[t] for t in terms(word) if t in self.place)
        return found

    def active(self, text: str | None) -> np.ndarray:
        found: set[int] = set()
        for own in set(map(self.__getitem__, (text or "").lower().split())):
            found.update(own)
        return np.array(sorted(found), np.int64)


def _buckets(text: str) -> np.ndarray:
    return np.unique(np.array([t for w in set(text.lower().split()) for t in terms(w)], np.int64))


def _excess(in1: np.ndarray, in0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Standard errors by which toxic texts hold something more often than clean ones."""
    share = (in1 + in0) / (n1 + n0)
    return (in1 / n1 - in0 / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))


def _paired(held: list[np.ndarray], y: np.ndarray, texts: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Buckets of pairs that together say more than either alone, also where each alone says nothing.

    A pair's z is below the root of the texts that hold it, so buckets in very few texts cannot
    make one; ``PAIR_SHARE`` bounds the others. They are counted in pairs, block by block.
    """
    usual = np.flatnonzero(texts >= max(PAIR_Z**2, PAIR_SHARE * len(y)))
    place = np.full(BUCKETS, -1)
    place[usual] = np.arange(len(usual))
    order = np.argsort(y, kind="stable")
    table = np.zeros((len(held), len(usual)), np.uint8)
    for i, own in enumerate(held):
        at = place[own]
        table[i, at[at >= 0]] = 1
    sides = [order[: int((y == 0).sum())], order[int((y == 0).sum()) :]]
    alone, found = np.abs(z[usual]), np.zeros(len(usual), bool)
    for start in range(0, len(usual), PAIR_BLOCK):
        cut, rest = slice(start, start + PAIR_BLOCK), slice(start, None)
        counts = []
        for side in sides:
            total = np.zeros((len(alone[cut]), len(alone[rest])), np.float32)
            for at in range(0, len(side), PAIR_BLOCK):
                part = table[side[at : at + PAIR_BLOCK], start:].astype(np.float32)
                total += part[:, :PAIR_BLOCK].T @ part
            counts.append(total)
        both = _excess(counts[1], counts[0], len(sides[1]), len(sides[0]))
        more = np.abs(both) - np.maximum(alone[cut][:, None], alone[rest]) >= PAIR_Z
        found[cut] |= more.any(axis=1)
        found[rest] |= more.any(axis=0)
    return usual[found]


def fit(texts: list[str], labels: list[int], seed: int = 3) -> Machine | None:
    """Mini-batch gradient steps (Adam) on the log loss; None without both classes."""
    y = np.array(labels, float)
    n1 = y.sum()
    n0 = len(y) - n1
    if not n1 or not n0:
        return None
    held = [_buckets(t) for t in texts]
    in1, in0 = np.zeros(BUCKETS, np.int32), np.zeros(BUCKETS, np.int32)
    for own, label in zip(held, labels, strict=True):
        (in1 if label else in0)[own] += 1
    z = _excess(in1, in0, n1, n0)
    z[in1 < LEAST_TEXTS] = 0
    buckets = np.union1d(np.flatnonzero(np.abs(z) >= LEAST_Z), _paired(held, y, in1 + in0, z))
    rows = [np.searchsorted(buckets, own[np.isin(own, buckets)]) for own in held]
    k = len(buckets)
    rng = np.random.default_rng(seed)
    theta = np.concatenate([[np.log(n1 / n0)], np.zeros(k), rng.normal(0, 0.01, k * FACTORS)])
    m, s, t = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(_EPOCHS):
        shuffled = rng.permutation(len(y))
        for at in range(0, len(y), _BATCH):
            w, v = theta[1 : k + 1], theta[k + 1 :].reshape(k, FACTORS)
            grad = _DECAY * theta
            gw, gv = grad[1 : k + 1], grad[k + 1 :].reshape(k, FACTORS)
            batch = shuffled[at : at + _BATCH]
            for i in batch:
                own = rows[i]
                total = v[own].sum(axis=0)
                raw = theta[0] + w[own].sum() + 0.5 * (total @ total - (v[own] ** 2).sum())
                error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[i]) / len(batch)
                grad[0] += error
                gw[own] += error
                gv[own] += error * (total - v[own])
            t += 1
            m = 0.9 * m + 0.1 * grad
            s = 0.999 * s + 0.001 * grad * grad
            theta = theta - _RATE * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    return Machine(buckets, float(theta[0]), theta[1 : k + 1].copy(), theta[k + 1 :].reshape(k, FACTORS).copy())


def held_out(doc_id) -> object:
    """crc32 of the id as text leaves no remainder; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(0)) == 0


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Machine | None:
    seen = labels.where(~held_out(F.col("doc_id")))
    machine = fit_in_task(labelled_sample(docs, seen, "toxic", rows_per_class), fit)
    if machine:
        machine.bias += prior_shift(docs, seen, "toxic", rows_per_class)
    return machine


def score(docs: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from 0.5 on) of every row.

    Null and empty texts switch no input on and get the score of the bias. Without a machine
    (no labels of both classes) the score is 0. Repeated rows are scored alike.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = WordInputs(machine) if machine else None
        for batch in batches:
            values = [machine.score(inputs.active(t.as_py())) if machine else 0.0 for t in batch.column("text")]
            marks = [int(s >= 0.5) for s in values]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    "score": pa.array(values, pa.float64()), "predicted": pa.array(marks, pa.int32()),
                }
            )

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
