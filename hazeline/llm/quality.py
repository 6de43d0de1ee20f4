"""Quality rules: fixed counts, and a calibrated logistic regression on hashed n-grams.

Features are the shares of hashed word n-grams (1 and 2 words) and character n-grams (3 and
5 characters) among those of the text. The regression is fitted on a bounded sample of
labelled rows and its scores are turned into probabilities on rows it was not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazeline.llm.common import mix, small_batches, window_hash, window_sums, word_hashes
from hazeline.llm.samples import fit_in_task, labelled_sample, prior_shift

BUCKETS = 1 << 16
#: The bound of the fitting sample: so many rows of each class.
ROWS_PER_CLASS = 2_000
#: A text is kept from this probability of good quality on.
KEEP_FROM = 0.5
MIN_WORDS = 50
MOST_REPEATED = 50
#: Texts are scored in slices of so many characters, so a huge text needs no huge arrays.
SLICE = 1 << 20
SYMBOLS = b"#*$%&|<>"
_EPOCHS = 8
_RATE = 0.5
_DECAY = 1e-6
_SCALE = 8.0

def _bucket(hashes: np.ndarray, table: int) -> np.ndarray:
    return ((mix(hashes + np.uint64(table)) >> np.uint64(48)).astype(np.int64)) + table * BUCKETS


def word_buckets(hashes: np.ndarray) -> np.ndarray:
    sums = window_sums(hashes)
    return _bucket(np.concatenate([window_hash(sums, 1), window_hash(sums, 2)]), 0)


def char_buckets(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sums = window_sums(mix(points + np.uint64(1)))
    return _bucket(np.concatenate([window_hash(sums, 3), window_hash(sums, 5)]), 1)


def _parts(text: str) -> Iterator[np.ndarray]:
    for i in range(0, len(text), SLICE):
        yield char_buckets(text[i : i + SLICE + 4])


@dataclass
class Regression:
    """Weights of word and character buckets, intercept, and the calibration line."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def raw(self, text: str, word_hashes: np.ndarray) -> float:
        total = self.intercept
        if len(word_hashes):
            total += _SCALE * float(self.weights[word_buckets(word_hashes)].mean())
        seen, summed = 0, 0.0
        for part in _parts(text):
            seen += len(part)
            summed += float(self.weights[part].sum())
        return total + (_SCALE * summed / seen if seen else 0.0)

    def probability(self, raw: float) -> float:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * raw + self.shift, -30, 30)))


def _shares(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and the weight of each."""
    out_i, out_v = [], []
    for buckets in (word_buckets(word_hashes(text.encode("utf-8", "surrogatepass"))[1]), np.concatenate([np.zeros(0, np.int64), *_parts(text)])):
        if len(buckets):
            at, n = np.unique(buckets, return_counts=True)
            out_i.append(at)
            out_v.append(_SCALE * n / len(buckets))
    return (np.concatenate(out_i), np.concatenate(out_v)) if out_i else (np.zeros(0, np.int64), np.zeros(0))


def _line(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability line, by damped Newton steps with softened targets."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    scale = max(float(raw.std()), 1e-9)
    x = np.column_stack([raw / scale, np.ones_like(raw)])

    def loss(line: np.ndarray) -> float:
        z = x @ line
        return float(np.logaddexp(0, z).sum() - target @ z) + 1e-3 * float(line @ line)

    line = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        step = np.linalg.solve(hessian, x.T @ (p - target) + 2e-3 * line)
        while np.abs(step).max() > 1e-9 and loss(line - step) > loss(line):
            step = step / 2
        line = line - step
    return float(line[0]) / scale, float(line[1])


def fit(texts: list[str], labels: list[int], seed: int = 5) -> Regression | None:
    """Adaptive gradient steps over single rows; a fifth of the rows calibrates. None without both classes."""
    y = np.array(labels, float)
    if len(set(labels)) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    hold, train = order[: len(y) // 5], order[len(y) // 5 :]
    rows = [_shares(t) for t in texts]
    weights, grown, intercept, grown0 = np.zeros(2 * BUCKETS), np.full(2 * BUCKETS, 1e-4), 0.0, 1e-4
    for _ in range(_EPOCHS):
        for i in rng.permutation(train):
            at, value = rows[i]
            error = 1 / (1 + np.exp(-np.clip(intercept + value @ weights[at], -30, 30))) - y[i]
            step = error * value + _DECAY * weights[at]
            grown[at] += step * step
            weights[at] -= _RATE * step / np.sqrt(grown[at])
            grown0 += error * error
            intercept -= _RATE * error / np.sqrt(grown0)
    model = Regression(weights.astype(np.float32), float(intercept))
    if len(hold) and len(set(y[hold])) == 2:
        raw = np.array([intercept + rows[i][1] @ weights[rows[i][0]] for i in hold])
        model.slope, model.shift = _line(raw, y[hold])
    return model


def base_counts(text: str | None) -> tuple[int, int, int, int, int, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and the words' hashes."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    points = len(raw) - int(counts[0x80:0xC0].sum())
    word_chars = points - int(counts[9:14].sum() + counts[32])
    lines = [x for x in raw.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    hashes = word_hashes(raw)[1]
    repeated = 0
    if len(words) >= 4:
        triples = window_hash(window_sums(hashes), 3)
        _, inverse, n = np.unique(triples, return_inverse=True, return_counts=True)
        twice = n[inverse] > 1
        if twice.any():
            cover = np.zeros(len(words), bool)
            for k in range(3):
                cover[k : k + len(twice)] |= twice
            repeated = int(cover.sum())
    return len(words), word_chars, int(counts[list(SYMBOLS)].sum()), len(lines) - len(set(lines)), repeated, hashes


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, quality double"


def train(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> Regression | None:
    """The regression; its probabilities follow the share of good rows among all labels."""
    model = fit_in_task(labelled_sample(docs, labels, "quality", rows_per_class), fit)
    if model:
        model.shift += prior_shift(docs, labels, "quality", rows_per_class)
    return model


def judge(docs: DataFrame, model: Regression | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """Every row with its counts, ``base_failed``, ``quality`` (a probability) and ``kept``.

    The new columns replace columns of the same names. Null and empty texts have no words
    and fail the base rules. Without a model (no labels of both classes) the base rules
    decide alone and quality is null. Repeated rows are judged alike.
    """
    small_batches(docs.sparkSession)
    new = [c.split()[0] for c in COLUMNS.split(", ")]
    own = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column("text"):
                text = value.as_py()
                *counts, hashes = base_counts(text)
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MOST_REPEATED * counts[0]
                p = None if model is None else float(model.probability(model.raw(text or "", hashes)))
                rows.append((*counts, failed, not failed and (p is None or p >= keep_from), p))
            columns = list(zip(*rows, strict=True)) or [()] * len(new)
            types = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], [*batch.schema.names, *new])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields]
    return own.mapInArrow(run, ", ".join([*fields, COLUMNS]))
