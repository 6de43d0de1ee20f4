"""SimHash near-duplicates through an index of positional bytes with a count filter.

Fingerprints of 64 bits are 8 bytes at fixed positions. Two that differ in at most 3 bits
differ in at most 3 bytes, so at least 5 positional bytes are shared, and of the first 7
at least 4. The index therefore holds each distinct fingerprint under every choice of 4 of
its first 7 positional bytes; within a posting list, shared bytes are tallied, pairs with
fewer than 5 are dropped, and the rest are verified bit by bit. Only links that join two
parts of a posting list are emitted, never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import free_names, small_batches, store, words_of
from hazeline.llm.components import connected_components

BITS = 3
SEED = 42
#: A longer posting list is split by a fifth byte.
LIST_ROWS = 2_048

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def _mask(positions: tuple[int, ...]) -> int:
    mask = sum(0xFF << (8 * p) for p in positions)
    return mask - (1 << 64) if mask >> 63 else mask


FOUR = list(combinations(range(7), 4))


def fingerprint(text: str | None, shingle_words: int) -> int:
    """A bit is 1 if set in over half of the shingles' hashes; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    words = [w.lower() for w in words]
    spans = [words[i:] for i in range(shingle_words)] if len(words) >= shingle_words else [[b" ".join(words)]]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*spans, strict=False)), repeat(SEED)), np.uint64)
    places = hashes.view(np.uint8).reshape(-1, 8) + (np.arange(8, dtype=np.int64) << 8)
    counts = np.bincount(places.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS
    return sum(1 << int(b) for b in np.flatnonzero(counts.ravel() * 2 > len(hashes)))


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, text_hash and signed 64-bit ``fp`` of every row; A-Z are lower-cased, other letters kept."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py(), shingle_words) for t in batch.column("text")]
            fp = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_hash": batch.column("text_hash"), "fp": pa.array(fp)})

    return docs.mapInArrow(run, "doc_id long, text_hash long, fp long")


class Parts:
    """Union-find over 0..n-1 that joins many pairs at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.parent[i], self.parent[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            if len(i):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))
                self.flatten()


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Count filter on shared positional bytes, then the exact number of differing bits."""
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    near = shared >= 8 - BITS
    near[near] = np.bitwise_count(differ[near]) <= BITS
    return near


def posting_links(lists: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal ``lists`` numbers: each fingerprint and its part's first one."""
    parts = Parts(len(fp))
    lengths = np.bincount(lists)
    left = np.arange(len(fp))
    ends = np.cumsum(lengths)[lists]
    step = 1
    while len(left := left[left + step < ends[left]]):
        for part in np.array_split(left, -(-len(left) // 1_000_000)):
            near = close(fp[part], fp[part + step])
            parts.join(part[near], part[near] + step)
        step += 1
    return _to_links(parts, fp)


def neighbour_links(fp: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one long list of sorted fingerprints that differ only in the ``free`` bits.

    Every change of up to 3 free bits is looked up, so the work is proportional to the list.
    """
    parts = Parts(len(fp))
    for n in range(1, BITS + 1):
        for bits in combinations(free.tolist(), n):
            other = fp ^ np.uint64(sum(1 << b for b in bits))
            at = np.searchsorted(fp, other)
            at[at == len(fp)] = 0
            found = np.flatnonzero(fp[at] == other)
            parts.join(found, at[found])
    return _to_links(parts, fp)


def _to_links(parts: Parts, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    tied = np.flatnonzero(parts.parent != np.arange(len(fp)))
    return fp[tied], fp[parts.parent[tied]]


def _lists(index: DataFrame, keys: list[str], most: int | None) -> DataFrame:
    """Links of every posting list: a, b; lists longer than ``most`` come back as rows with b null."""

    def links(lists: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        if most is not None or len(fp) <= LIST_ROWS:
            yield batch(*posting_links(lists, fp))
        else:
            differ = int(np.bitwise_or.reduce(fp ^ fp[0]))
            yield batch(*neighbour_links(np.sort(fp), np.array([b for b in range(64) if differ >> b & 1])))

    def batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        which = np.full(len(a), -1, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(which)], ["a", "b", "spill"])

    def spilled(fp: np.ndarray, which: np.ndarray) -> pa.RecordBatch:
        empty = pa.nulls(len(fp), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), empty, pa.array(which.astype(np.int32))], ["a", "b", "spill"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept_fp = np.zeros((len(keys), 0), np.int64), np.zeros(0, np.uint64)
        over = None  # the key of a list that has become too long
        for rows in batches:
            key = np.concatenate([kept_key, np.stack([rows.column(k).to_numpy().astype(np.int64) for k in keys])], axis=1)
            fp = np.concatenate([kept_fp, rows.column("fp").to_numpy().view(np.uint64)])
            if over is not None:
                same = (key == over[:, None]).all(axis=0)
                if same.any():
                    yield spilled(fp[same], key[0][same])
                    key, fp = key[:, ~same], fp[~same]
            if not len(fp):
                kept_key, kept_fp = key, fp
                continue
            starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
            last = starts[-1]
            yield from finish(key[:, :last], fp[:last], starts[:-1])
            kept_key, kept_fp = key[:, last:], fp[last:]
            if most is not None and len(kept_fp) > most:
                over = kept_key[:, 0]
                yield spilled(kept_fp, kept_key[0])
                kept_key, kept_fp = kept_key[:, :0], kept_fp[:0]
        if len(kept_fp):
            yield from finish(kept_key, kept_fp, np.array([0]))

    def finish(key: np.ndarray, fp: np.ndarray, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Whole lists, of which those with one fingerprint say nothing."""
        lengths = np.diff(np.append(starts, len(fp)))
        long = lengths > (most or LIST_ROWS)
        for s, n in zip(starts[long], lengths[long], strict=True):
            if most is None:
                yield from links(np.zeros(n, np.int64), fp[s : s + n])
            else:
                yield spilled(fp[s : s + n], key[0][s : s + n])
        use = np.repeat((lengths > 1) & ~long, lengths)
        if use.any():
            number = np.repeat(np.arange(len(starts)), lengths)[use]
            number = np.cumsum(np.concatenate([[0], (number[1:] != number[:-1]).astype(np.int64)]))
            yield batch(*posting_links(number, fp[use]))

    return index.mapInArrow(run, "a long, b long, spill int")


def _dealt(index: DataFrame, keys: list[str]) -> DataFrame:
    return index.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, "fp")


def links(distinct: DataFrame) -> DataFrame:
    """a, b: enough links between different fingerprints to connect all that differ in at most 3 bits."""
    spark = distinct.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100000")
    index = distinct.select(
        "fp",
        F.inline(F.array(*[F.struct(F.lit(n).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for n, c in enumerate(FOUR)])),
    )
    first = store(_lists(_dealt(index, ["choice", "bytes"]), ["choice", "bytes"], LIST_ROWS), "posting-links")
    # of a long list, pairs share one more of the four other positions: at most 2^24 fingerprints share five
    fifths = F.array(*[F.array(*[F.struct(F.lit(n * 8 + p).alias("choice"), F.lit(_mask((*c, p))).alias("mask")) for p in range(8) if p not in c]) for n, c in enumerate(FOUR)])
    longer = (
        first.where("b IS NULL")
        .select(F.col("a").alias("fp"), F.inline(F.element_at(fifths, F.col("spill") + 1)))
        .select("fp", "choice", F.col("fp").bitwiseAND(F.col("mask")).alias("bytes"))
    )
    second = _lists(_dealt(longer, ["choice", "bytes"]), ["choice", "bytes"], None)
    return first.where("b IS NOT NULL").select("a", "b").union(second.select("a", "b"))


def members(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, text_hash, fp, component_id and ``root`` (a fingerprint that names the component) of every row."""
    prints = store(fingerprints(docs, shingle_words), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    tied = connected_components(links(distinct.select("fp")))
    named = distinct.join(tied, distinct["fp"] == tied["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    component = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(named.join(component, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row.

    ``component_id`` is the smallest doc_id that links reach, a link being at most 3
    differing bits; equal fingerprints are always linked, also those of texts without words
    (zero) and of null texts. It is null only where no row of the component has an id.
    Repeated rows come back as often as they are there; no rows, no result.
    """
    return members(docs, shingle_words).select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def first_of_each(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """One row of each component, with all its columns: ``first_of_roots``."""
    return first_of_roots(docs, members(docs, shingle_words))


def first_of_roots(docs: DataFrame, rooted: DataFrame) -> DataFrame:
    """One row of each ``root`` of ``rooted`` (doc_id, text_hash, root): the smallest doc_id, then the smallest hash of the text.

    Null ids come last, and of equal rows one stays.
    """
    key = free_names(docs.columns, "null", "id", "hash")
    place = [F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("text_hash")]
    stays = rooted.groupBy("root").agg(F.min(F.struct(*[c.alias(k) for c, k in zip(place, key, strict=True)])).alias("first")).select("first.*")
    place[2] = F.xxhash64("text")
    placed = docs.withColumns(dict(zip(key, place, strict=True)))
    return placed.join(stays, key, "left_semi").dropDuplicates(key).select(*docs.columns)
