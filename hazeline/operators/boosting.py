"""Gradient boosting on histograms, as many models at once as there are groups.

Groups of at most ``TASK_ROWS`` rows are fitted in one task each, those of more than ``PLAIN_ROWS`` from
blocks of bytes (``operators.binned``) that every row was put into before. Larger groups stay where they are:
every level of a tree is one job in which each task adds up its blocks, for all groups at once. All ways grow
the same trees. Inputs are
binned once to bytes at exact quantiles; each level of a tree adds up gradients per node, input
and bin, and leaves have regularised second-order values. A missing input goes right at
every split. Scoring and attribution read the trees as arrays, batch by batch, over all rows.
"""

from __future__ import annotations

import os
import pickle
import shutil
import tempfile
import uuid
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazeline.operators.binned import BINS, Blocks, binned_blocks, fit_columns, inputs_of
from hazeline.operators.supervised import FEATURE_COLUMNS, TARGET

#: Rows of a group that are fitted in one task, as numbers and as bytes.
PLAIN_ROWS = 262_144
TASK_ROWS = 1_048_576
#: Tasks whose sums go straight to the driver; those of more tasks are added up in between.
DIRECT_PARTS = 32
#: Rows that are walked through the trees together.
SCORED_TOGETHER = 4_096


@dataclass(frozen=True)
class Settings:
    """The compared settings, with the usual regularisation."""

    rounds: int = 600
    rate: float = 0.05
    depth: int = 8
    row_share: float = 0.8
    column_share: float = 0.8
    penalty: float = 1.0
    least_rows: float = 1.0
    seed: int = 42


@dataclass(frozen=True)
class Boosted:
    """A fitted ensemble: full binary trees of one depth, node i above 2 i + 1 and 2 i + 2.

    A node that is no split has an infinite threshold, and all leaves below it one value.
    """

    features: tuple[str, ...]
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    rows: np.ndarray

    @property
    def depth(self) -> int:
        return self.value.shape[1].bit_length() - 1

    def score(self, x: np.ndarray) -> np.ndarray:
        """Predictions of rows with inputs ``x`` (NaN: missing)."""
        out = np.full(len(x), self.base)
        feature, cut, edges, kind, last = self.codes
        for start in range(0, len(x), SCORED_TOGETHER):
            part = x[start : start + SCORED_TOGETHER]
            codes = np.stack([np.where(np.isnan(part[:, j]), last, np.searchsorted(edges[j], part[:, j])) for j in range(part.shape[1])], axis=1).astype(kind)
            at = np.arange(len(part)) * part.shape[1]
            flat, total = codes.ravel(), np.zeros(len(part))
            node, place = np.empty(len(part), np.intp), np.empty(len(part), np.intp)
            code, edge, right = np.empty(len(part), kind), np.empty(len(part), kind), np.empty(len(part), bool)
            first = self.value.shape[1] - 1
            for used, limit, value in zip(feature, cut, self.value, strict=True):
                node[:] = 0
                for _ in range(self.depth):
                    np.take(used, node, out=place, mode="clip")
                    place += at
                    np.take(flat, place, out=code, mode="clip")
                    np.take(limit, node, out=edge, mode="clip")
                    np.greater(code, edge, out=right)
                    node *= 2
                    node += 1
                    node += right
                node -= first
                total += np.take(value, node, mode="clip")
            out[start : start + SCORED_TOGETHER] += total
        return out

    @cached_property
    def codes(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], type, int]:
        """Inputs and thresholds as places among the sorted thresholds of each input, these, and the type and top value of a place.

        A value is at most the i-th threshold (from 0) exactly where fewer than i + 1 of them are smaller;
        a missing one gets the top value, which only fits where there is no split.
        """
        split = np.isfinite(self.threshold)
        edges = [np.unique(self.threshold[split & (self.feature == j)]) for j in range(len(self.features))]
        kind = np.uint8 if max(map(len, edges), default=0) < 255 else np.uint16
        last = np.iinfo(kind).max
        cut = np.full(self.threshold.shape, last, kind)
        for j, own in enumerate(edges):
            here = split & (self.feature == j)
            cut[here] = np.searchsorted(own, self.threshold[here])
        return np.asarray(self.feature, np.intp), cut, edges, kind, last

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a ``prediction`` column."""
        return scored(rows, self.features, lambda batch, x: pa.array(self.score(x)))

    predict = transform

    def save(self, spark: SparkSession, path: str) -> None:
        """One row a tree, and one of the shared values."""
        trees = [(i, *(a.tolist() for a in tree)) for i, tree in enumerate(zip(self.feature, self.threshold, self.value, self.rows, strict=True))]
        schema = "tree int, feature array<int>, threshold array<double>, value array<double>, rows array<double>"
        spark.createDataFrame(trees, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")
        spark.createDataFrame([(self.base, list(self.features))], "base double, features array<string>").coalesce(1).write.mode("overwrite").parquet(f"{path}/shared")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Boosted:
        shared = spark.read.parquet(f"{path}/shared").first()
        trees = spark.read.parquet(f"{path}/trees").orderBy("tree").collect()
        arrays = [np.array([t[c] for t in trees], kind) for c, kind in (("feature", np.int16), ("threshold", float), ("value", float), ("rows", float))]
        return Boosted(tuple(shared["features"]), shared["base"], *arrays)


def scored(rows: DataFrame, features: tuple[str, ...], score: Callable[[pa.RecordBatch, np.ndarray], pa.Array], keep: list[str] | None = None) -> DataFrame:
    """``rows``, or their columns ``keep``, with ``prediction`` from their inputs as doubles (NaN: missing); no column changes."""
    kept = rows.select(*keep).schema if keep else rows.schema
    own = len(kept)
    inputs = [F.col(c).cast("double").alias(f"__input_{i}") for i, c in enumerate(features)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[own:]]).astype(float)
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], score(batch, x)], [*batch.schema.names[:own], "prediction"])

    return rows.select(*kept.names, *inputs).mapInArrow(run, T.StructType([*kept.fields, T.StructField("prediction", T.DoubleType())]))


def bin_edges(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Largest values of all bins but the last: all distinct values, or exact quantiles of them."""
    known = np.sort(values[~np.isnan(values)])
    if not len(known):
        return known
    distinct = np.unique(known)
    if len(distinct) <= bins:
        return distinct[:-1]
    ranks = np.arange(1, bins) * len(known) // bins
    edges = np.unique(known[ranks - 1])
    return edges[edges < known[-1]]


def grow(x: np.ndarray, y: np.ndarray, features: tuple[str, ...], settings: Settings = Settings()) -> Boosted:
    """Fits an ensemble to rows ``x`` (NaN: missing) and targets ``y`` on the squared error."""
    n, d = x.shape
    edges = [bin_edges(x[:, j]) for j in range(d)]
    binned = np.empty((d, n), np.uint8)
    for j in range(d):
        binned[j] = np.where(np.isnan(x[:, j]), BINS, np.searchsorted(edges[j], x[:, j]))
    return _grow(binned, y, edges, features, settings)


def _grow(binned: np.ndarray, y: np.ndarray, edges: list[np.ndarray], features: tuple[str, ...], settings: Settings) -> Boosted:
    d, n = binned.shape
    by_row = np.ascontiguousarray(binned.T).ravel()
    base = float(y.mean()) if n else 0.0
    fitted = np.full(n, base)
    start = np.arange(n) * d
    trees = []
    for round_ in range(settings.rounds):
        drawn, columns = _drawn(settings, round_, n, d)
        tree = _tree(binned[:, drawn], (fitted - y)[drawn], columns, edges, settings)
        node = np.zeros(n, np.intp)
        feature, cut = tree[0], tree[4]
        for _ in range(settings.depth):
            node = 2 * node + 2 - (by_row[start + feature[node]] <= cut[node])
        fitted += tree[2][node - (2**settings.depth - 1)]
        trees.append(tree[:4])
    return _ensemble(features, base, trees, settings)


def _ensemble(features: tuple[str, ...], base: float, trees: list[tuple[np.ndarray, ...]], settings: Settings) -> Boosted:
    shapes = ((0, 2**settings.depth - 1), (0, 2**settings.depth - 1), (0, 2**settings.depth), (0, 2 ** (settings.depth + 1) - 1))
    arrays = [np.array([t[k] for t in trees]) if trees else np.zeros(shapes[k]) for k in range(4)]
    return Boosted(features, base, *arrays)


def _drawn(settings: Settings, round_: int, n: int, d: int, start: int = 0, own: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Rows drawn for a tree from the ``own`` (all) rows that follow the first ``start`` of ``n``, and the inputs drawn for it."""
    bits = np.random.PCG64([settings.seed, round_])
    own = n if own is None else own
    if settings.row_share < 1:
        # one step of the generator a row
        rows = np.flatnonzero(np.random.Generator(bits.advance(start)).random(own) < settings.row_share)
        bits = bits.advance(n - start - own)
    else:
        rows = np.arange(own)
    return rows, np.sort(np.random.Generator(bits).permutation(d)[: max(1, int(settings.column_share * d))])


def _tree(binned: np.ndarray, gradient: np.ndarray, columns: np.ndarray, edges: list[np.ndarray], settings: Settings):
    """Split inputs, thresholds, leaf values and rows of one tree, and the bins behind the thresholds."""
    n = len(gradient)
    node = np.zeros(n, np.intp)
    steps = _growing(columns, edges, settings)
    asked = next(steps)
    while True:
        if asked.level:
            first = 2 ** (asked.level - 1) - 1 + node
            node = 2 * node + (binned[asked.feature[first], np.arange(n)] > asked.cut[first])
        try:
            asked = steps.send(_counts(binned, None, gradient, node, asked))
        except StopIteration as grown:
            return grown.value


@dataclass(frozen=True)
class _Asked:
    """A level of a growing tree: its splits so far, the nodes to count (None: all), the inputs (none at the leaves), and the sums of its nodes by the splits above."""

    level: int
    feature: np.ndarray
    cut: np.ndarray
    counted: np.ndarray | None
    columns: list[int]
    totals: np.ndarray | None = None


def _counts(binned: np.ndarray, place: np.ndarray | None, gradient: np.ndarray, node: np.ndarray, asked: _Asked):
    """Gradients per node, rows, and per input the gradients and rows per node and bin; nodes of a pair share a place as one of them is counted.

    ``place`` is the column of ``binned`` of each row (None: in order).
    """
    nodes, width = 2**asked.level, BINS + 1
    total = np.bincount(node, gradient, nodes)
    if not asked.columns:
        return total, len(node), []
    if asked.counted is None:
        key, part, bins_of, picked = np.zeros(len(node), np.intp), gradient, 1, place
    else:
        own = np.flatnonzero(asked.counted[node])
        key, part, bins_of, picked = (node[own] >> 1) * width, gradient[own], nodes // 2, own if place is None else place[own]
    found = []
    for j in asked.columns:
        at = key + (binned[j] if picked is None else binned[j][picked])
        found.append((np.bincount(at, part, bins_of * width).reshape(bins_of, width), np.bincount(at, minlength=bins_of * width).reshape(bins_of, width)))
    return total, len(node), found


def _growing(columns: np.ndarray, edges: list[np.ndarray], settings: Settings) -> Generator[_Asked, tuple, tuple]:
    """Grows one tree from the ``_counts`` of its levels, which it asks for one after the other."""
    depth, width = settings.depth, BINS + 1
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int16), np.full(inner, 255, np.uint8)
    threshold, rows = np.full(inner, np.inf), np.zeros(2 ** (depth + 1) - 1)
    value = np.zeros(2**depth)
    done = np.zeros(1, bool)
    used = [j for j in columns.tolist() if len(edges[j])]
    above: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    totals = None
    for level in range(depth):
        nodes, first = 2**level, 2**level - 1
        size = rows[first : first + nodes]
        counted = None
        # of two siblings only the smaller is counted; the other is the parent less that one
        if level:
            small = 2 * np.arange(nodes // 2) + (size[1::2] < size[0::2])
            counted = np.zeros(nodes, bool)
            counted[small] = ~done[small]
        total, n, found_in = yield _Asked(level, feature, cut, counted, used)
        if not level:
            rows[0] = n
        best, where = np.zeros(nodes), np.full(nodes, -1)
        # rows and gradients left of the best split
        lefts, left_sums = np.zeros(nodes), np.zeros(nodes)
        own = total * total / (size + settings.penalty)
        for j, (sums, counts) in zip(used, found_in, strict=True):
            if level:
                sums, counts = _siblings(sums, above[j][0], small), _siblings(counts, above[j][1], small)
            above[j] = (sums, counts)
            left, count = np.cumsum(sums[:, : len(edges[j])], axis=1), np.cumsum(counts[:, : len(edges[j])], axis=1)
            right, rest = total[:, None] - left, size[:, None] - count
            gain = left * left / (count + settings.penalty) + right * right / (rest + settings.penalty) - own[:, None]
            gain[(count < settings.least_rows) | (rest < settings.least_rows)] = 0
            at = gain.argmax(axis=1)
            found = gain[np.arange(nodes), at]
            # a later input has to win clearly, so that rounding picks no other split
            better = found > best + 1e-9 * np.maximum(1, np.abs(best))
            best[better], where[better] = found[better], (j * width + at)[better]
            lefts[better], left_sums[better] = count[better, at[better]], left[better, at[better]]
        ends = done | (where < 0)
        for i in np.flatnonzero(ends & ~done).tolist():
            below = 2 ** (depth - level)
            value[i * below : (i + 1) * below] = -settings.rate * total[i] / (size[i] + settings.penalty)
        split = np.flatnonzero(~ends)
        feature[first + split], cut[first + split] = where[split] // width, where[split] % width
        threshold[first + split] = [edges[w // width][w % width] for w in where[split].tolist()]
        # rows of a node that is no split go left
        lefts[ends], left_sums[ends] = size[ends], total[ends]
        rows[2 * nodes - 1 : 4 * nodes - 1] = np.stack([lefts, size - lefts], axis=1).ravel()
        totals = np.stack([left_sums, total - left_sums], axis=1).ravel()
        done = np.repeat(ends, 2)
    total, _, _ = yield _Asked(depth, feature, cut, None, [], totals)
    size = rows[2**depth - 1 :]
    value[~done] = (-settings.rate * total / (size + settings.penalty))[~done]
    return feature, threshold, value, rows, cut


def _siblings(small_sums: np.ndarray, above: np.ndarray, small: np.ndarray) -> np.ndarray:
    out = np.empty((2 * len(above), above.shape[1]), above.dtype)
    out[small], out[small ^ 1] = small_sums, above - small_sums
    return out


def fit_groups(rows: DataFrame, group: str, groups: int, features=FEATURE_COLUMNS, label: str = TARGET, settings: Settings = Settings()) -> dict[int, Boosted]:
    """One ensemble for each of the ``groups`` values of the integer column ``group``, fitted on all its rows.

    The rows of a group are put in order first, so a fit does not depend on how they came.
    """
    names = list(features)
    picked = fit_columns(rows, group, names, label)
    sizes = {r["_group"]: (r["n"], r["mean"]) for r in picked.groupBy("_group").agg(F.count(F.lit(1)).alias("n"), F.avg("_label").alias("mean")).collect()}
    most = max((n for n, _ in sizes.values()), default=0)
    if most <= PLAIN_ROWS:
        return _fit_tasks(picked, groups, tuple(names), settings)
    blocks = binned_blocks(picked, len(names), sum(n for n, _ in sizes.values()))
    if most <= TASK_ROWS:
        return _fit_bytes(blocks, tuple(names), settings)
    return _fit_blocks(blocks, {g: mean for g, (_, mean) in sizes.items()}, tuple(names), settings)


def _fit_tasks(picked: DataFrame, groups: int, names: tuple[str, ...], settings: Settings) -> dict[int, Boosted]:
    """One task a group: groups are dealt out by range and fitted side by side."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x = np.ascontiguousarray(inputs_of(table, len(names)).T)
        y = table.column("_label").to_numpy()
        order = np.lexsort([*np.nan_to_num(x, nan=-1e300).T, y])
        model = grow(x[order], y[order], names, settings)
        return pa.table({"g": pa.array([key[0].as_py()], pa.int32()), "model": pa.array([pickle.dumps(model)], pa.binary())})

    dealt = picked.repartitionByRange(groups, "_group")
    return {r["g"]: pickle.loads(bytes(r["model"])) for r in dealt.groupBy("_group").applyInArrow(run, "g int, model binary").collect()}


def _fit_bytes(blocks: Blocks, names: tuple[str, ...], settings: Settings) -> dict[int, Boosted]:
    """One task a group, which gets its blocks one by one."""
    groups, edges = sorted(blocks.rows), blocks.edges

    def run(part: int, held: Iterator[tuple]) -> Iterator[tuple[int, Boosted]]:
        own = sorted(((number, codes, labels) for _, number, _, codes, labels in held), key=lambda b: b[0])
        if own:
            g = groups[part]
            yield g, _grow(np.concatenate([b[1] for b in own], axis=1), np.concatenate([b[2] for b in own]), edges[g], names, settings)

    dealt = _loaded(blocks).keyBy(lambda b: b[0]).partitionBy(len(groups), groups.index).values()
    return dict(dealt.mapPartitionsWithIndex(run).collect())


def _fit_blocks(blocks: Blocks, bases: dict[int, float], names: tuple[str, ...], settings: Settings) -> dict[int, Boosted]:
    """One job a level for all groups: tasks add up the blocks they hold, the driver picks the splits from the sums.

    A task keeps the running predictions of its blocks in a file of its own; where that is lost, they are
    made again from the trees so far.
    """
    d, sizes = len(names), blocks.rows
    held, parts = _held(blocks)
    folder = f"hazeline-{uuid.uuid4().hex}"
    trees: dict[int, list[tuple[np.ndarray, ...]]] = {g: [] for g in sizes}
    try:
        for round_ in range(settings.rounds):
            growing = {g: _growing(_drawn(settings, round_, n, d, 0, 0)[1], blocks.edges[g], settings) for g, n in sizes.items()}
            asked = {g: next(steps) for g, steps in growing.items()}
            last = {g: (t[-1][0], t[-1][4], t[-1][2]) for g, t in trees.items() if t}
            for _ in range(settings.depth):
                counts = _added(held, parts, _Work(folder, round_, asked, last, None, bases, sizes, settings))
                if counts is None:
                    history = {g: [(t[0], t[4], t[2]) for t in grown] for g, grown in trees.items()}
                    counts = _added(held, parts, _Work(folder, round_, asked, last, history, bases, sizes, settings))
                asked = {g: steps.send(counts[g]) for g, steps in growing.items()}
            for g, steps in growing.items():
                # the sums of the leaves are known from the last splits
                try:
                    steps.send((asked[g].totals, 0, []))
                except StopIteration as grown:
                    trees[g].append(grown.value)
    finally:
        held.foreachPartition(lambda _: shutil.rmtree(os.path.join(tempfile.gettempdir(), folder), ignore_errors=True))
        held.unpersist()
    return {g: _ensemble(names, float(bases[g]), [t[:4] for t in trees[g]], settings) for g in sizes}


def _loaded(blocks: Blocks):
    """The blocks as objects: group, number, rows of the group before it, codes by input, labels."""
    place = blocks.place

    def load(r) -> tuple:
        number, start = place[r["g"], r["part"], r["seq"]]
        return r["g"], number, start, np.frombuffer(bytes(r["codes"]), np.uint8).reshape(-1, r["n"]), np.frombuffer(bytes(r["labels"]))

    return blocks.table.rdd.map(load)


def _held(blocks: Blocks):
    """The blocks dealt out evenly and kept, and the number of their parts."""
    parts = min(blocks.table.sparkSession.sparkContext.defaultParallelism, len(blocks.place))
    dealt = _loaded(blocks).keyBy(lambda b: b[1]).partitionBy(parts, lambda number: number % parts).values()
    return dealt.persist(StorageLevel.MEMORY_AND_DISK), parts


@dataclass(frozen=True)
class _Work:
    """What a task needs to count a level: the round, what is asked of each group, and the trees its predictions lack."""

    folder: str
    round: int
    asked: dict[int, _Asked]
    last: dict[int, tuple[np.ndarray, ...]]
    history: dict[int, list[tuple[np.ndarray, ...]]] | None
    bases: dict[int, float]
    rows: dict[int, int]
    settings: Settings

    def fitted(self, group: int, number: int, codes: np.ndarray) -> np.ndarray | None:
        """Predictions of the rounds before this one; None where they are lost and no history is given."""
        n, kept = codes.shape[1], os.path.join(tempfile.gettempdir(), self.folder)

        def at(round_: int) -> str:
            return os.path.join(kept, f"{number}-{round_}.npy")

        def load(round_: int) -> np.ndarray | None:
            try:
                return np.load(at(round_))
            except (OSError, ValueError, EOFError):
                return None

        if (found := load(self.round)) is not None:
            return found
        if not self.round:
            out = np.full(n, self.bases[group])
        elif (out := load(self.round - 1)) is not None:
            out += _leaves(codes, *self.last[group])
        elif self.history is None:
            return None
        else:
            out = np.full(n, self.bases[group])
            for tree in self.history[group]:
                out += _leaves(codes, *tree)
        os.makedirs(kept, exist_ok=True)
        handle, path = tempfile.mkstemp(dir=kept)
        with os.fdopen(handle, "wb") as f:
            np.save(f, out)
        os.replace(path, at(self.round))
        if self.round and os.path.exists(at(self.round - 1)):
            os.remove(at(self.round - 1))
        return out

    def count(self, held: Iterator[tuple]) -> Iterator[tuple]:
        """Per group the ``_counts`` of the blocks of a task, or None for lost predictions."""
        sums: dict[int, tuple | None] = {}
        for group, number, start, codes, labels in held:
            asked, fitted = self.asked[group], self.fitted(group, number, codes)
            if fitted is None:
                yield group, None
                return
            drawn, _ = _drawn(self.settings, self.round, self.rows[group], len(codes), start, len(labels))
            node = _walked(codes, drawn, asked.feature, asked.cut, asked.level)
            total, n, found = _counts(codes, drawn, (fitted - labels)[drawn], node, asked)
            if group in sums:
                whole = sums[group]
                sums[group] = (whole[0] + total, whole[1] + n, [(a + s, b + c) for (a, b), (s, c) in zip(whole[2], found, strict=True)])
            else:
                sums[group] = (total, n, found)
        for group, own in sums.items():
            yield group, (own[0], own[1], [(s, c.astype(np.int32)) for s, c in own[2]])


def _walked(codes: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Places in their level of ``rows`` (columns of ``codes``) after so many splits."""
    node = np.zeros(len(rows), np.intp)
    for level in range(levels):
        at = 2**level - 1 + node
        node = 2 * node + (codes[feature[at], rows] > cut[at])
    return node


def _leaves(codes: np.ndarray, feature: np.ndarray, cut: np.ndarray, value: np.ndarray) -> np.ndarray:
    return value[_walked(codes, np.arange(codes.shape[1]), feature, cut, len(value).bit_length() - 1)]


def _sum(counts: list[tuple]) -> tuple:
    return (
        np.sum([c[0] for c in counts], axis=0), sum(c[1] for c in counts),
        [(np.sum([s for s, _ in own], axis=0), np.sum([c for _, c in own], axis=0, dtype=np.int64)) for own in zip(*[c[2] for c in counts])],
    )


def _added(held, parts: int, work: _Work) -> dict[int, tuple] | None:
    """The counts of all tasks, added up in the order of the tasks; None if predictions are lost somewhere."""

    def count(part: int, blocks: Iterator[tuple]) -> Iterator[tuple]:
        for group, own in work.count(blocks):
            yield (group, part // DIRECT_PARTS), (part, own)

    counted = held.mapPartitionsWithIndex(count)
    if parts > DIRECT_PARTS:
        def add(several: list[tuple]) -> tuple:
            own = sorted(several, key=lambda p: p[0])
            return own[0][0], None if any(c is None for _, c in own) else _sum([c for _, c in own])

        counted = counted.groupByKey(-(-parts // DIRECT_PARTS)).mapValues(lambda several: add(list(several)))
    by_group: dict[int, list] = {}
    for (group, _), (part, own) in counted.collect():
        by_group.setdefault(group, []).append((part, own))
    if any(own is None for several in by_group.values() for _, own in several):
        return None
    return {g: _sum([own for _, own in sorted(several, key=lambda p: p[0])]) for g, several in by_group.items()}


def predict_groups(rows: DataFrame, group: str, fitted: dict[int, Boosted], keep: list[str] | None = None) -> DataFrame:
    """Adds ``prediction`` to ``rows``, or to their columns ``keep``: each row by the ensemble of its ``group``, null where there is none."""
    place = (keep or rows.columns).index(group)

    def score(batch: pa.RecordBatch, x: np.ndarray) -> pa.Array:
        which = batch.column(place).to_numpy(zero_copy_only=False)
        out, known = np.zeros(len(x)), np.zeros(len(x), bool)
        for g, model in fitted.items():
            own = which == g
            if own.any():
                out[own], known[own] = model.score(x[own]), True
        return pa.array(out, mask=~known)

    return scored(rows, next(iter(fitted.values())).features, score, keep)


class HistogramBoosting:
    """An estimator: ``fit(rows)`` gives a ``Boosted`` of all the rows."""

    def __init__(self, features=FEATURE_COLUMNS, label: str = TARGET, **settings):
        self.features, self.label, self.settings = tuple(features), label, Settings(**settings)

    def fit(self, rows: DataFrame) -> Boosted:
        return fit_groups(rows.withColumn("_all", F.lit(0)), "_all", 1, self.features, self.label, self.settings)[0]
