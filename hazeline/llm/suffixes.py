"""Repeated passages by their hashes, split by a prefix that copies choose alike.

Of each passage of ``window`` words the place whose next ``prefix`` words hash lowest names
its group; copies of a passage choose alike. Where a prefix is so frequent that its group
would not fit in memory, the hash of the whole window names the group instead. Within a
group, passages with equal hashes are one repeat, and all but the earliest are removed. No
suffix is sorted and no tree is built: that would need the words behind each place in its
group, many times the bytes of a hash.

Passages are compared by the 64-bit hash of the whole window, within a task and across tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import (
    WordHash,
    group_count,
    joined,
    mix,
    sliding_min,
    small_batches,
    window_hash,
    window_sums,
    words_of,
)

WINDOW = 20
PREFIX = 8
#: Words that a task sorts at once before it sends its suffixes.
FLUSH_WORDS = 1_000_000
#: Bytes of text behind one group of suffixes.
GROUP_BYTES = 12 << 20
#: Prefixes are counted in so many slots, a fixed size whatever the input.
SLOTS = 1 << 18
SLOT_BLOCKS = 64
#: A slot with more suffixes than this share of a group's gets longer prefixes.
HEAVY_SHARE = 0.02
SEED = 7

_hashes: dict[int, WordHash] = {}


def _word_hash() -> WordHash:
    return _hashes.setdefault(SEED, WordHash(SEED))


class Flush:
    """Words of many documents side by side; long documents come in overlapping parts."""

    def __init__(self, window: int):
        self.window = window
        self.clear()

    def clear(self) -> None:
        self.hashes: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []  # null flag, doc_id, hash of the text
        self.parts: list[tuple[int, int, int]] = []  # document, place of the first word, words
        self.words = 0

    def add(self, doc_id: int | None, text_hash: int, hashes: np.ndarray) -> Iterator[None]:
        """Yields whenever the flush is full; the caller then takes and clears it."""
        if len(hashes) < self.window:
            return
        for first in range(0, len(hashes) - self.window + 1, FLUSH_WORDS):
            part = hashes[first : first + FLUSH_WORDS + self.window - 1]
            self.parts.append((len(self.docs), first, len(part)))
            self.docs.append((int(doc_id is None), doc_id or 0, text_hash))
            self.hashes.append(part)
            self.words += len(part)
            if self.words >= FLUSH_WORDS:
                yield

    def windows(self, prefix: int) -> tuple[np.ndarray, ...]:
        """Of every whole window: prefix hash, window hash, document, place."""
        sums = window_sums(np.concatenate(self.hashes))
        low = sliding_min(window_hash(sums, prefix), self.window - prefix + 1)
        own = window_hash(sums, self.window)
        doc, first, n = np.array(self.parts).T
        starts = np.cumsum(n) - n
        count = n - self.window + 1
        use = np.repeat(starts - (np.cumsum(count) - count), count) + np.arange(count.sum())
        place = use - np.repeat(starts - first, count)
        return low[use], own[use], np.repeat(doc, count), place


def _flushes(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[Flush]:
    flush, hasher = Flush(window), _word_hash()
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text"))
        for doc_id, text_hash, text in zip(*columns, strict=True):
            for _ in flush.add(doc_id, text_hash, hasher.many(words_of(text))):
                yield flush
                flush.clear()
    if flush.parts:
        yield flush


def _slot(low: np.ndarray) -> np.ndarray:
    return (mix(low) >> np.uint64(64 - 18)).astype(np.int64)


def _heavy_slots(docs: DataFrame, window: int, prefix: int, limit: int) -> bytes:
    """One bit per slot: whether more than ``limit`` suffixes of the corpus have a prefix in it."""
    width = SLOTS // SLOT_BLOCKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.int64)
        for flush in _flushes(batches, window):
            counts += np.bincount(_slot(flush.windows(prefix)[0]), minlength=SLOTS)
        if counts.any():
            blobs = [counts[b * width : (b + 1) * width].tobytes() for b in range(SLOT_BLOCKS)]
            yield pa.RecordBatch.from_pydict({"block": pa.array(range(SLOT_BLOCKS), pa.int32()), "counts": pa.array(blobs, pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for batch in batches:
            for blob in batch.column("counts"):
                total += np.frombuffer(blob.as_py(), np.int64)
        bits = np.packbits(total > limit).tobytes()
        yield pa.RecordBatch.from_pydict({"block": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([bits], pa.binary())})

    blocks = docs.mapInArrow(count, "block int, counts binary").groupBy("block").applyInArrow(add, "block int, bits binary").collect()
    by_block = {r["block"]: bytes(r["bits"]) for r in blocks}
    return b"".join(by_block.get(b, bytes(width // 8)) for b in range(SLOT_BLOCKS))


def _runs(doc: np.ndarray, place: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Where a new run of consecutive places in one document, with equal ``same``, begins."""
    new = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    for x in same:
        new |= x[1:] != x[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1]) if len(doc) else np.zeros(0, np.int64)


def _later(key: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Marks every entry whose key also occurs with a smaller ``order``."""
    later = np.zeros(len(key), bool)
    if len(key):
        by_key = np.argsort(key)
        sorted_key, sorted_order = key[by_key], order[by_key]
        starts = np.concatenate([[0], np.flatnonzero(sorted_key[1:] != sorted_key[:-1]) + 1])
        least = np.minimum.reduceat(sorted_order, starts)
        later[by_key] = sorted_order != np.repeat(least, np.diff(np.append(starts, len(key))))
    return later


def _ranks(docs: np.ndarray) -> np.ndarray:
    """Rank of each document (null flag, doc_id, text hash) in reading order; equal documents share one."""
    order = np.lexsort((docs[:, 2], docs[:, 1], docs[:, 0]))
    new = (docs[order][1:] != docs[order][:-1]).any(axis=1)
    ranks = np.empty(len(docs), np.int64)
    ranks[order] = np.concatenate([[0], np.cumsum(new)])
    return ranks


SUFFIXES = "bucket int, docs binary, low binary, doc binary, place binary, n binary, own binary, known binary"


def _suffixes(docs: DataFrame, window: int, prefix: int, buckets: int, heavy: bytes) -> DataFrame:
    """One row per flush and group: its suffixes as packed arrays.

    Of passages that a flush holds more than once only the earliest is sent on; the others
    are known repeats. So a passage reaches its group at most once per flush.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_heavy = np.unpackbits(np.frombuffer(heavy, np.uint8)).astype(bool)
        for flush in _flushes(batches, window):
            low, own, doc, place = flush.windows(prefix)
            table = np.array(flush.docs, np.int64).reshape(-1, 3)
            repeat = _later(own, (_ranks(table)[doc] << 32) + place)
            rdoc, rplace = doc[repeat], place[repeat]
            at = _runs(rdoc, rplace)
            known = np.stack([rdoc[at], rplace[at], np.diff(np.append(at, len(rdoc)))], axis=1)
            low, own, doc, place = low[~repeat], own[~repeat], doc[~repeat], place[~repeat]
            target = np.where(is_heavy[_slot(low)], mix(own), mix(low)) >> np.uint64(20)
            bucket = (target % np.uint64(buckets)).astype(np.int64)
            by_bucket = np.argsort(bucket, kind="stable")
            low, own, doc, place, bucket = (x[by_bucket] for x in (low, own, doc, place, bucket))
            edges = np.flatnonzero(np.diff(bucket)) + 1
            rows: list[tuple] = []
            for part in np.split(np.arange(len(low)), edges) if len(low) else []:
                at = _runs(doc[part], place[part], low[part]) + part[0]
                n = np.diff(np.append(at, part[-1] + 1))
                used, number = np.unique(doc[at], return_inverse=True)
                rows.append(
                    (
                        int(bucket[part[0]]), table[used].tobytes(), low[at].tobytes(), number.astype(np.uint32).tobytes(),
                        place[at].astype(np.uint32).tobytes(), n.astype(np.uint32).tobytes(), own[part].tobytes(), b"",
                    )
                )
            for chunk in np.array_split(known, -(-len(known) // 20_000)) if len(known) else []:
                used, number = np.unique(chunk[:, 0], return_inverse=True)
                spans = np.column_stack([number, chunk[:, 1:]]).astype(np.int64)
                rows.append((int(chunk[0, 1] % buckets), table[used].tobytes(), b"", b"", b"", b"", b"", spans.tobytes()))
            for rest in range(0, len(rows), 256):
                columns = list(zip(*rows[rest : rest + 256], strict=True))
                names = [f.split()[0] for f in SUFFIXES.split(", ")]
                arrays = [pa.array(c, pa.int32() if k == "bucket" else pa.binary()) for k, c in zip(names, columns, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.mapInArrow(run, SUFFIXES)


SPANS = "null_id int, doc_id long, text_hash long, start int, n int"


def _subtree_repeats(suffixes: DataFrame) -> DataFrame:
    """Starts of passages whose hash an earlier passage of the group has, as spans of starts."""

    def spans(docs: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        null, ids, text = docs[doc].T if len(doc) else np.zeros((3, 0), np.int64)
        return pa.RecordBatch.from_pydict(
            {
                "null_id": pa.array(null.astype(np.int32)), "doc_id": pa.array(ids), "text_hash": pa.array(text),
                "start": pa.array(start.astype(np.int32)), "n": pa.array(n.astype(np.int32)),
            }
        )

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, lows, doc, place, counts, owns, first = [], [], [], [], [], [], 0
        for batch in batches:
            for r in batch.to_pylist():
                table = np.frombuffer(r["docs"], np.int64).reshape(-1, 3)
                if r["known"]:
                    known = np.frombuffer(r["known"], np.int64).reshape(-1, 3)
                    yield spans(table, known[:, 0], known[:, 1], known[:, 2])
                    continue
                tables.append(table)
                lows.append(np.frombuffer(r["low"], np.uint64))
                doc.append(np.frombuffer(r["doc"], np.uint32).astype(np.int64) + first)
                place.append(np.frombuffer(r["place"], np.uint32))
                counts.append(np.frombuffer(r["n"], np.uint32))
                owns.append(np.frombuffer(r["own"], np.uint64))
                first += len(table)
        if not tables:
            return
        table, n = np.concatenate(tables), joined(counts, np.int64)
        run_starts = np.cumsum(n) - n
        within = np.arange(n.sum()) - np.repeat(run_starts, n)
        doc_of, at = np.repeat(joined(doc, np.int64), n), np.repeat(joined(place, np.int64), n) + within
        leaf = mix(np.repeat(joined(lows, np.uint64), n) ^ mix(joined(owns, np.uint64)))
        repeat = _later(leaf, (_ranks(table)[doc_of] << 32) + at)
        doc_of, at = doc_of[repeat], at[repeat]
        new = _runs(doc_of, at)
        yield spans(table, doc_of[new], at[new], np.diff(np.append(new, len(at))))

    return suffixes.groupBy("bucket").applyInArrow(run, SPANS)


def _kept(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words_n, removed_n, digests = [], [], []
            for text, spans in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = words_of(text.as_py())
                removed = 0
                if spans.is_valid:
                    cover = np.zeros(len(words) + 1, np.int64)
                    starts, lengths = (spans.values.field(f).to_numpy() for f in ("start", "n"))
                    np.add.at(cover, starts, 1)
                    np.add.at(cover, starts + lengths + window - 1, -1)
                    keep = np.cumsum(cover[:-1]) == 0
                    removed = int((~keep).sum())
                words_n.append(len(words))
                removed_n.append(removed)
                kept = [w for w, k in zip(words, keep.tolist(), strict=True) if k] if removed else words
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "n_words": pa.array(words_n, pa.int64()),
                    "n_removed": pa.array(removed_n, pa.int64()), "kept_sha256": pa.array(digests, pa.string()),
                }
            )

    return docs.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def repeated_spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Spans of window starts that also start earlier: null_id, doc_id, text_hash, start, n."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = group_count(size, GROUP_BYTES)
    small_batches(docs.sparkSession)
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    limit = int(HEAVY_SHARE * GROUP_BYTES / 6)
    heavy = _heavy_slots(keyed, window, prefix, limit)
    return _subtree_repeats(_suffixes(keyed, window, prefix, buckets, heavy))


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """Per row: doc_id, n_words, n_removed and the SHA-256 of the words that stay.

    A word goes if a window over it also starts earlier, in a smaller doc_id or before it in
    the same document. Null doc_ids come last. Rows of equal doc_id are one document: equal
    texts are the same passages and keep their first, different texts are ordered by hash.
    Null, empty and short texts have no windows and stay whole. No rows, no result.
    """
    spans = (
        repeated_spans(docs, window, prefix)
        .groupBy("null_id", "doc_id", "text_hash")
        .agg(F.collect_list(F.struct("start", "n")).alias("spans"))
        .withColumnsRenamed({"doc_id": "id", "text_hash": "hash"})
    )
    keyed = docs.select("doc_id", "text")
    match = (
        (F.col("doc_id").isNull().cast("int") == F.col("null_id"))
        & (F.coalesce("doc_id", F.lit(0)) == F.col("id"))
        & (F.xxhash64("text") == F.col("hash"))
    )
    small_batches(docs.sparkSession)
    return _kept(keyed.join(spans.hint("shuffle_hash"), match, "left").select("doc_id", "text", "spans"), window)
