"""Language ID by prediction by partial matching.

Each language has a tree of byte contexts, up to ``ORDER`` bytes long. A context gives each
byte that it has seen count / (total + distinct) and keeps distinct / (total + distinct) for an
escape to the context one byte shorter, whose probabilities are spread over the bytes
not yet seen (exclusion); below the empty context all 256 bytes are alike. So every context
is a distribution over bytes, and the negative logarithms along a text add up to the exact
length of its code. Statistics are frozen after the fit: the code lengths of each context are
written out once, and a text is scored by walking the trees of all languages together from
the byte before each place backwards. The language with the shortest code wins.

Nulls: a null text, or one without a letter, is ``und`` with score 0; rows without lang are not
learned. Ties go to the language that sorts first. Texts of any length are scored whole, in
slices that overlap by one context. Repeated rows are scored alike; an empty table, or one
without a learnable language, gives ``und`` for every text. Other columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import small_batches

#: Bytes of the longest context.
ORDER = 4
#: The bounds of the fitting sample: so many texts of each language, and of each text so many
#: bytes at most, in ``PARTS`` parts that lie evenly over the whole of it.
ROWS_PER_LANG = 400
BYTES_PER_ROW = 1 << 16
PARTS = 16
#: Contexts seen less often, in all languages together, are left out of the tree.
LEAST_SEEN = 3
#: Places of the tables of code lengths (contexts x bytes x languages) at most; the most frequent contexts stay.
TABLE_CELLS = 1 << 24
#: Bytes scored together.
SLICE = 1 << 20
FOLDS = 3
HELD_OUT = 1
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def fold(doc_id) -> object:
    """crc32 of the id as text, modulo 3; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS, F.lit(HELD_OUT))


@dataclass
class Trees:
    """Walking and code lengths of all languages' trees together.

    Node 0 is nowhere and node 1 the empty context. ``step[node, c]`` is the context longer by
    the byte of class c in front, ``bits[node, c]`` the code lengths of a byte of class c.
    """

    langs: list[str]
    classes: np.ndarray
    step: np.ndarray
    bits: np.ndarray

    def code_lengths(self, raw: bytes, before: bytes = b"") -> np.ndarray:
        """Bits of every byte of ``raw`` (rows) in every language, after the bytes ``before``."""
        before = before[-ORDER:]
        data = np.zeros(ORDER + len(raw), np.intp)
        data[ORDER - len(before) : ORDER] = self.classes[np.frombuffer(before, np.uint8)]
        data[ORDER:] = self.classes[np.frombuffer(raw, np.uint8)]
        return self._walk(data)

    def _walk(self, data: np.ndarray) -> np.ndarray:
        """Code lengths of the classes after the first ``ORDER``; class 0 belongs to no context."""
        width = self.bits.shape[1]
        n = len(data) - ORDER
        node = np.ones(n, np.intp)
        on = node
        step = self.step.ravel()
        for back in range(1, ORDER + 1):
            on = step[on * width + data[ORDER - back : len(data) - back]]
            node = np.maximum(node, on)
        return self.bits.reshape(-1, len(self.langs))[node * width + data[ORDER:]]

    def totals(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every whole text (rows) in every language."""
        out = np.zeros((len(texts), len(self.langs)))
        at = 0
        while at < len(texts):
            upto, size = at + 1, len(texts[at])
            while upto < len(texts) and size + len(texts[upto]) <= SLICE:
                size += len(texts[upto])
                upto += 1
            if upto == at + 1:
                raw = texts[at]
                for start in range(0, len(raw), SLICE):
                    out[at] += self.code_lengths(raw[start : start + SLICE], raw[max(0, start - ORDER) : start]).sum(axis=0, dtype=np.float64)
            else:
                # class 0 between texts, so that no context reaches across
                gap = np.zeros(ORDER, np.intp)
                data = np.concatenate([x for t in texts[at:upto] for x in (gap, self.classes[np.frombuffer(t, np.uint8)])])
                sizes = np.array([len(t) + ORDER for t in texts[at:upto]])
                ends = np.cumsum(sizes)
                sums = np.zeros((len(data) - ORDER + 1, len(self.langs)))
                np.cumsum(self._walk(data), axis=0, dtype=np.float64, out=sums[1:])
                # text i lies at [start, stop) of the places after the first gap
                stop = ends - ORDER
                out[at:upto] = sums[stop] - sums[stop - (sizes - ORDER)]
            at = upto
        return out


@dataclass
class Statistics:
    """Frozen counts: of each order the (context, byte) grams of each language, as class codes."""

    langs: list[str]
    classes: np.ndarray
    grams: list[list[tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)

    def trees(self) -> Trees:
        width, n_langs = int(self.classes.max()) + 1, len(self.langs)
        known = width - 1
        room = max(1, TABLE_CELLS // (width * n_langs))
        step = [np.zeros((2, width), np.int32)]
        # order 0: nowhere, and the empty context over the uniform bytes
        below = np.full((1, width, n_langs), 1 / 256)
        tables = [np.zeros((1, width, n_langs), np.float32)]
        keys = np.zeros(1, np.int64)
        first, total = 1, 2
        for order in range(ORDER + 1):
            probs = self._blend(order, keys, below, width, known)
            tables.append(-np.log2(np.maximum(probs, 1e-30)).astype(np.float32))
            if order == ORDER:
                break
            longer = self._contexts(order + 1, width, keys, room - total)
            if not len(longer):
                break
            scale = width**order
            parent = np.searchsorted(keys, longer % scale)
            step.append(np.zeros((len(longer), width), np.int32))
            joined = np.concatenate(step)
            joined[first + parent, longer // scale] = total + np.arange(len(longer))
            step = [joined]
            below, keys, first = probs[parent], longer, total
            total += len(longer)
        return Trees(self.langs, self.classes, np.concatenate(step), np.concatenate(tables))

    def _contexts(self, order: int, width: int, shorter: np.ndarray, room: int) -> np.ndarray:
        """Sorted contexts of ``order`` bytes seen often enough whose shorter context is in the tree."""
        grams = np.concatenate([g for g, _ in self.grams[order]])
        counts = np.concatenate([c for _, c in self.grams[order]])
        keys, at = np.unique(grams // width, return_inverse=True)
        seen = np.bincount(at, counts, len(keys))
        tail = keys % width ** (order - 1)
        place = np.minimum(np.searchsorted(shorter, tail), len(shorter) - 1)
        fit = (seen >= LEAST_SEEN) & (shorter[place] == tail)
        keys, seen = keys[fit], seen[fit]
        if len(keys) > room:
            keys = np.sort(keys[np.argsort(-seen, kind="stable")[: max(0, room)]])
        return keys

    def _blend(self, order: int, keys: np.ndarray, below: np.ndarray, width: int, known: int) -> np.ndarray:
        """Probabilities of each byte after each context, from those after the context one byte shorter."""
        probs = below.copy()
        # class 0 stands for each of the bytes that the fit has not met
        unmet = 256 - known
        for lang, (grams, counts) in enumerate(self.grams[order]):
            at = np.searchsorted(keys, grams // width)
            at = np.minimum(at, len(keys) - 1)
            here = keys[at] == grams // width
            at, byte, counts_here = at[here], grams[here] % width, counts[here].astype(float)
            total = np.bincount(at, counts_here, len(keys))
            distinct = np.bincount(at, minlength=len(keys)).astype(float)
            met = total > 0
            mine = below[:, :, lang]
            everything = mine[:, 1:].sum(axis=1) + unmet * mine[:, 0]
            left = everything - np.bincount(at, mine[at, byte], len(keys))
            escape = np.where(met, distinct / np.maximum(total + distinct, 1), 1.0)
            # with all 256 bytes seen nothing is left to escape to
            share = np.where(met, escape / np.maximum(left, 1e-12), 1.0)
            probs[:, :, lang] = mine * share[:, None]
            probs[at, byte, lang] = counts_here / (total + distinct)[at]
        return probs


def learn(texts: list[bytes], langs: list[str]) -> Statistics | None:
    """Counts of every (context, byte) of up to ``ORDER`` + 1 bytes, by language; None without texts."""
    names = sorted(set(langs))
    if not names:
        return None
    seen = np.zeros(256, bool)
    for text in texts:
        seen[np.frombuffer(text, np.uint8)] = True
    classes = np.where(seen, np.cumsum(seen), 0).astype(np.intp)
    width = int(classes.max()) + 1
    stats = Statistics(names, classes)
    gap = np.zeros(ORDER, np.int64)
    runs = [[x for t, own in zip(texts, langs, strict=True) if own == name for x in (gap, classes[np.frombuffer(t, np.uint8)])] for name in names]
    whole = [np.concatenate(run).astype(np.int64) for run in runs]
    for order in range(ORDER + 1):
        grams = []
        for data in whole:
            code, full = np.zeros(max(0, len(data) - order), np.int64), np.ones(max(0, len(data) - order), bool)
            for i in range(order + 1):
                part = data[i : len(data) - order + i]
                code = code * width + part
                full &= part > 0
            grams.append(np.unique(code[full], return_counts=True))
        stats.grams.append(grams)
    return stats


def _parts(raw: bytes) -> list[bytes]:
    """A text, or of a longer one parts that lie evenly over it."""
    if len(raw) <= BYTES_PER_ROW:
        return [raw]
    size = BYTES_PER_ROW // PARTS
    return [raw[start : start + size] for start in np.linspace(0, len(raw) - size, PARTS).astype(int)]


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Statistics | None:
    """Statistics of a bounded sample of the documents (text, lang, doc_id) that are not held out.

    The sample is taken by hash of the id, then of the text, after all rows that cannot be learned are gone.
    """
    able = docs.where("text IS NOT NULL AND lang IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT)
    rank = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sample = able.select("doc_id", "text", "lang").withColumn("place", F.row_number().over(rank)).where(F.col("place") <= rows_per_lang)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(lang, part) for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True) for part in _parts(text.as_py().encode("utf-8", "surrogatepass"))]
            yield pa.RecordBatch.from_pydict({"lang": pa.array([r[0] for r in rows], pa.string()), "part": pa.array([r[1] for r in rows], pa.binary())})

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = learn(table.column("part").to_pylist(), table.column("lang").to_pylist())
        return pa.table({"model": pa.array([pickle.dumps(found)], pa.binary())})

    parts = sample.select("lang", "text").mapInArrow(cut, "lang string, part binary")
    got = parts.groupBy(F.lit(0).alias("all")).applyInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0]["model"])) if got else None


#: The trees that this worker has written out, by the statistics they come from.
_trees: dict[bytes, Trees] = {}


def _ready(packed: bytes) -> Trees:
    key = xxhash.xxh128_digest(packed)
    if key not in _trees:
        _trees.clear()
        _trees[key] = pickle.loads(packed).trees()
    return _trees[key]


def best(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of the shortest code of each row, and its probability among all codes."""
    at = bits.argmin(axis=1)
    gap = np.minimum(bits - bits[np.arange(len(bits)), at][:, None], 1000)
    return at, 1 / np.exp2(-gap).sum(axis=1)


def identify(docs: DataFrame, stats: Statistics | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of ``docs`` (doc_id, text)."""
    small_batches(docs.sparkSession)
    packed = pickle.dumps(stats) if stats else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = _ready(packed) if packed else None
        for batch in batches:
            texts = [t.as_py() for t in batch.column("text")]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            able = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if trees else []
            if able:
                at, share = best(trees.totals([texts[i].encode("utf-8", "surrogatepass") for i in able]))
                for i, place, score in zip(able, at, share, strict=True):
                    langs[i], scores[i] = trees.langs[place], float(score)
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), "lang_pred": pa.array(langs, pa.string()), "score": pa.array(scores, pa.float64())}
            )

    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")
