"""Collocations: phrases of 2 to 4 words that occur more often than their parts explain.

Texts are split at ``[.,;:!?\\x0A-\\x0D]`` into pieces and those at blanks and tabs into words.
First pass: the hashes of all runs of 1 to 4 words are counted in Misra-Gries summaries. Hash
space is cut into partitions; the summary of a partition has more counters than the
partition's mass (runs, with repeats) divided by the threshold, so what all its
decrements take from one counter stays below the threshold and every frequent run survives.
Summaries of parts of the input are merged by adding them up and decrementing by the first
counter beyond the capacity. Second pass: runs that may have survived are counted by
their words, which is exact, whatever the summaries let through. Frequent runs hold only
frequent runs, so parts of candidates are in the same table.

Nulls: a null lang is ``und`` (together with a lang of that name), a null text is empty.
Empty tables give no rows. Texts of any length are read whole, in slices that overlap by three
words where no piece ends. Repeated rows count as often as they occur; other columns
are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazeline.llm.common import mix, small_batches, store, word_hashes

#: Words of the longest phrase, and the least count of a candidate.
MOST_WORDS = 4
THRESHOLD = 30
#: A candidate goes if a longer one that holds it has this many hundredths of its count.
COVERED = 80
MOST_RANKS = 2000
#: Bytes of text whose runs are put together before they are sent.
CHUNK = 1 << 22
#: Counters of one partition's summary that are aimed at; more input makes more partitions.
COUNTERS = 1 << 18
LEAST_PARTITIONS = 1 << 10
#: Runs of words to expect from a byte of text; only the number of partitions depends on it.
RUNS_PER_BYTE = 0.65
#: The filter of survivors has so many bits for each, and 2 to this power at most.
BITS_EACH = 32
MOST_BITS = 27
_SEED = 29

_MAP = bytearray(range(256))
_MAP[65:91] = bytes(range(97, 123))
_MAP[9] = 32
for _c in b".,;:!?\x0a\x0b\x0c\x0d":
    _MAP[_c] = 10
_FACTORS = mix(np.arange(1, MOST_WORDS + 1, dtype=np.uint64) + np.uint64(101)) | np.uint64(1)


def slices(text: str | None, size: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """A text in lower case, with one mark between words and another between pieces, in slices
    of about ``size`` bytes; each with the number of its first words that the one before had too."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(bytes(_MAP))
    start = done = again = 0
    while len(raw) - done > size:
        end = raw.rfind(b"\n", done + size // 2, done + size)
        if end >= 0:
            yield raw[start:end], again
            start, done, again = end, end, 0
            continue
        end = raw.rfind(b" ", done + size // 2, done + size)
        end = end if end >= 0 else _next_gap(raw, done + size)
        yield raw[start:end], again
        # the last words of this piece stand before the next slice again
        last, n = end, 0
        for word in reversed(raw[start:end].rsplit(None, MOST_WORDS - 1)[-(MOST_WORDS - 1) :]):
            at = raw.rfind(word, start, last)
            if raw.find(b"\n", at, end) >= 0:
                break
            last, n = at, n + 1
        start, done, again = last, end, n
    yield raw[start:], again


def _next_gap(raw: bytes, at: int) -> int:
    found = [x for x in (raw.find(b" ", at), raw.find(b"\n", at)) if x >= 0]
    return min(found, default=len(raw))


def runs_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a slice, and the number of the piece that each lies in; the words are ``raw.split()``."""
    starts, hashes = word_hashes(raw)
    return hashes, np.searchsorted(np.flatnonzero(np.frombuffer(raw, np.uint8) == 10), starts)


def hashes_of(words: np.ndarray, piece: np.ndarray, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1 to ``MOST_WORDS`` words: hashes of all runs, and which of them lie in one piece."""
    out = []
    with np.errstate(over="ignore"):
        for k in range(1, MOST_WORDS + 1):
            n = max(0, len(words) - k + 1)
            total = np.full(n, (seed * 2 + k) & 0xFFFFFFFFFFFFFFFF, np.uint64)
            for j in range(k):
                total += words[j : j + n] * _FACTORS[j]
            out.append((mix(total), piece[k - 1 : k - 1 + n] == piece[:n]))
    return out


def lang_seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), _SEED) >> 2


class Chunks:
    """Slices of texts, gathered by lang up to ``CHUNK`` bytes and joined where nothing overlaps."""

    def __init__(self) -> None:
        self.held: dict[str, list[bytes]] = {}
        self.size = 0

    def read(self, batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes, int]]]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                for raw, again in slices(text.as_py()):
                    if again:
                        yield [(lang, raw, again)]
                        continue
                    self.held.setdefault(lang, []).append(raw)
                    self.size += len(raw)
                    if self.size >= CHUNK:
                        yield self.taken()
        yield self.taken()

    def taken(self) -> list[tuple[str, bytes, int]]:
        out = [(lang, b"\n".join(parts), 0) for lang, parts in self.held.items()]
        self.held, self.size = {}, 0
        return out


class Summary:
    """A Misra-Gries summary: counters, what decrements took from each at most, and the mass counted.

    Nothing that occurs more than ``mass / (capacity + 1)`` times is lost: each unit of a
    decrement takes one from at least ``capacity + 1`` counters. ``merge`` keeps that bound.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.taken = 0
        self.mass = 0

    def merge(self, keys: np.ndarray, counts: np.ndarray, taken: int = 0) -> None:
        """Adds counted keys, or the counters of another summary and what was taken from them."""
        self.mass += int(counts.sum())
        self.taken += taken
        both = np.concatenate([self.keys, keys])
        order = np.argsort(both, kind="stable")
        both, held = both[order], np.concatenate([self.counts, counts])[order]
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.intp)
        self.keys, self.counts = both[new], np.add.reduceat(held, new) if len(new) else held
        if len(self.keys) > self.capacity:
            beyond = len(self.keys) - self.capacity - 1
            cut = int(np.partition(self.counts, beyond)[beyond])
            left = self.counts > cut
            self.keys, self.counts = self.keys[left], self.counts[left] - cut
            self.taken += cut

    def frequent(self, threshold: int) -> np.ndarray:
        """Keys that may occur ``threshold`` times or more."""
        return self.keys[self.counts + self.taken >= threshold]


def _counted_runs(texts: DataFrame, power: int) -> DataFrame:
    """Per chunk and partition of hash space: keys seen once, keys seen more often with counts, and mass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.arange(1, 1 << power, dtype=np.uint64) << np.uint64(64 - power)
        for chunk in Chunks().read(batches):
            found = []
            for lang, raw, again in chunk:
                for k, (hashes, whole) in enumerate(hashes_of(*runs_of(raw), lang_seed(lang)), 1):
                    found.append(hashes[max(0, again - k + 1) :][whole[max(0, again - k + 1) :]])
            if not found or not sum(map(len, found)):
                continue
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            bounds = np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])
            short = ((keys >> np.uint64(32 - power)) & np.uint64(0xFFFFFFFF)).astype("<u4")
            rows = []
            for part in np.flatnonzero(np.diff(bounds)).tolist():
                own, n = short[bounds[part] : bounds[part + 1]], counts[bounds[part] : bounds[part + 1]]
                once = n == 1
                rows.append((part, own[once].tobytes(), own[~once].tobytes(), n[~once].astype("<u4").tobytes(), int(n.sum())))
            for at in range(0, len(rows), 4096):
                part, ones, more, n, mass = zip(*rows[at : at + 4096], strict=True)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(part, pa.int32()), "ones": pa.array(ones, pa.binary()), "more": pa.array(more, pa.binary()), "n": pa.array(n, pa.binary()), "mass": pa.array(mass, pa.int64())}
                )

    return texts.mapInArrow(run, "part int, ones binary, more binary, n binary, mass long")


def _survivors(counted: DataFrame, threshold: int) -> DataFrame:
    """part, n, keys: what the summary of each partition of hash space cannot rule out.

    The mass of a partition is added up before its rows are read, so its capacity is known;
    rows then stream through, and only the summary and a few chunks are in memory.
    """
    whole = Window.partitionBy("part")
    rows = counted.repartition("part").withColumn("mass", F.sum("mass").over(whole))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, summary, waiting, size = None, Summary(1), [], 0

        def settle() -> None:
            nonlocal waiting, size
            if waiting:
                summary.merge(np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]))
            waiting, size = [], 0

        def closed() -> pa.RecordBatch:
            settle()
            left = summary.frequent(threshold)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": pa.array([len(left)], pa.int64()), "keys": pa.array([left.astype("<u4").tobytes()], pa.binary())})

        for batch in batches:
            for own, ones, more, n, mass in zip(*(batch.column(c) for c in ("part", "ones", "more", "n", "mass")), strict=True):
                if own.as_py() != part:
                    if part is not None:
                        yield closed()
                    part, summary = own.as_py(), Summary(mass.as_py() // threshold + 1)
                once, often = np.frombuffer(ones.as_py(), "<u4"), np.frombuffer(more.as_py(), "<u4")
                waiting.append((np.concatenate([once, often]), np.concatenate([np.ones(len(once), np.int64), np.frombuffer(n.as_py(), "<u4").astype(np.int64)])))
                size += len(once) + len(often)
                if size >= max(summary.capacity, 1 << 16):
                    settle()
        if part is not None:
            yield closed()

    return rows.mapInArrow(run, "part int, n long, keys binary")


def _bitmap(survivors: DataFrame, power: int) -> tuple[bytes, int]:
    """A filter of all survivors: a bit for each leading part of a hash, and the bits of such a part.

    It has ``BITS_EACH`` bits a survivor but 2^``MOST_BITS`` at most, whatever the input; a full one lets
    more runs through to the exact count and loses none.
    """
    total = survivors.agg(F.sum("n")).first()[0] or 0
    bits = int(min(max(total * BITS_EACH, 1).bit_length(), MOST_BITS))
    bits = max(bits, power + 3)
    own = bits - power

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = []
            for keys in batch.column("keys"):
                on = np.zeros(1 << own, np.uint8)
                on[np.frombuffer(keys.as_py(), "<u4") >> np.uint32(32 - own)] = 1
                marks.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_pydict({"part": batch.column("part"), "marks": pa.array(marks, pa.binary())})

    out = bytearray(1 << (bits - 3))
    for row in survivors.select("part", "keys").mapInArrow(run, "part int, marks binary").collect():
        out[row["part"] << (own - 3) : (row["part"] + 1) << (own - 3)] = row["marks"]
    return bytes(out), bits


def _exact_counts(texts: DataFrame, marks: bytes, bits: int) -> DataFrame:
    """lang, phrase, words, f of all runs that the filter lets through; words 0 has the number of words of a lang."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.frombuffer(marks, np.uint8)
        for chunk in Chunks().read(batches):
            for lang, raw, again in chunk:
                words = raw.split()
                shorter = np.ones(len(words) + 1, bool)
                phrases, sizes, counts = [""], [0], [len(words) - again]
                for k, (hashes, whole) in enumerate(hashes_of(*runs_of(raw), lang_seed(lang)), 1):
                    at = hashes >> np.uint64(64 - bits)
                    # a frequent run holds only frequent runs
                    able = whole & shorter[:-1] & shorter[1:]
                    able[able] = (on[at[able] >> np.uint64(3)] >> (at[able] & np.uint64(7)).astype(np.uint8)) & 1 > 0
                    shorter = able
                    mine = able.copy()
                    mine[: max(0, again - k + 1)] = False
                    if k == 1:
                        found = Counter(compress(words, mine.tolist()))
                    else:
                        found = Counter([b" ".join(words[i : i + k]) for i in np.flatnonzero(mine).tolist()])
                    phrases += [p.decode("utf-8", "surrogatepass") for p in found]
                    sizes += [k] * len(found)
                    counts += found.values()
                for at in range(0, len(phrases), 1 << 16):
                    cut = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_pydict(
                        {"lang": pa.array([lang] * len(phrases[cut]), pa.string()), "phrase": pa.array(phrases[cut], pa.string()), "words": pa.array(sizes[cut], pa.int32()), "f": pa.array(counts[cut], pa.int64())}
                    )

    rows = texts.mapInArrow(run, "lang string, phrase string, words int, f long")
    return rows.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f"))


def frequent_runs(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """lang, phrase, words, f of every run of 1 to 4 words with f >= threshold; words 0: all words of a lang.

    ``docs`` has columns lang and text. The result is written.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text").where("text IS NOT NULL")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(LEAST_PARTITIONS, int(size * RUNS_PER_BYTE / threshold / COUNTERS))
    power = min((wanted - 1).bit_length(), MOST_BITS - 3)
    survivors = store(_survivors(_counted_runs(texts, power), threshold), "phrase-survivors")
    marks, bits = _bitmap(survivors, power)
    counts = _exact_counts(texts, marks, bits)
    return store(counts.where((F.col("words") == 0) | (F.col("f") >= threshold)), "phrase-counts")


def _ratio(over: str, under: str, scale: int) -> object:
    """floor(scale * over / under), exact beyond 64 bits."""
    return F.expr(f"(CAST({over} AS DECIMAL(20, 0)) * CAST({scale} AS DECIMAL(10, 0))) DIV ({under})")


def collocations(docs: DataFrame, threshold: int = THRESHOLD, most_ranks: int = MOST_RANKS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each lang's best phrases."""
    runs = frequent_runs(docs, threshold)
    known = runs.where("words > 0").select("lang", "phrase", "f")
    candidates = runs.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))

    cuts = candidates.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k",
        F.expr("array_join(slice(w, 1, k), ' ')").alias("first"),
        F.expr("array_join(slice(w, k + 1, size(w) - k), ' ')").alias("rest"),
    )
    left = known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    right = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    under = "CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0))"
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", _ratio("a", under, 2_000_000))
    lowest = scored.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where(F.size("w") > 2).select("lang", "w", "a", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("at"))
    longer = longer.select("lang", "w", "a", "at", F.explode(F.expr("sequence(2, least(size(w) - 1, greatest(2, size(w) - at + 1)))")).alias("n"))
    inside = longer.where("at + n - 1 <= size(w)").select("lang", F.expr("array_join(slice(w, at, n), ' ')").alias("phrase"), "a")
    covers = inside.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    hidden = F.expr(f"CAST(cover AS DECIMAL(20, 0)) * 100 >= CAST(a AS DECIMAL(20, 0)) * {COVERED}")
    left_over = lowest.join(covers, ["lang", "phrase"], "left").where(F.col("cover").isNull() | ~hidden)

    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))
    ranked = left_over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_ranks)
    sizes = runs.where("words = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").alias("score"))
