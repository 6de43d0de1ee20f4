"""Line dedup by an exact set-similarity join.

A line is the set of its words; lines are alike when the Jaccard similarity of their sets is
at least 4/5. Words are ordered by rarity, and a line is indexed under the rarest of them,
as many as it can miss and still be alike to another (prefix filter). Within the lines
under one word, sizes (length filter), places in the order (positional filter) and small
bitmaps rule pairs out; the rest are verified on their words. A line goes if any line
before it in the corpus is alike to it, so one verified earlier line settles it: a line
with many candidates is first tried against the earliest few, and only lines that these
leave open are compared with all their candidates. No group is expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm.common import free_names, mix, small_batches, store

#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
#: Words are counted in so many slots, a fixed size whatever the input; the order within a slot is by hash.
SLOTS = 1 << 18
SLOT_BLOCKS = 64
#: Places (a power of two) that tell words in one line of the corpus from words in more; also a fixed size.
TWICE_BITS = 22
#: More lines than this under one word are compared in pairs of blocks, each a task's group of its own.
LIST_ROWS = 1 << 15
#: Sets of up to so many words have a bitmap of 64 and of 128 bits, larger ones one of 256.
BITMAP_WORDS = (64, 128)
#: Candidates of a set under one word that are tried first.
FIRST_TRIED = 3
#: Index rows travel in buckets of words: at least 2^BUCKET_BITS of them, and one for so many words of the corpus.
BUCKET_BITS = 10
BUCKET_WORDS = 1 << 19
#: Index rows that a task holds before it deals them to their buckets.
DEALT_ROWS = 400_000
#: Index rows in one value, and such values in an Arrow batch.
VALUE_ROWS = 4096
VALUES_TOGETHER = 200
#: Rows of a few numbers in an Arrow batch.
NUMBERS_TOGETHER = 20_000
#: Lines looked up in documents by a broadcast join; more are looked up by a shuffle.
FEW_LINES = 20_000


#: Bytes of text whose lines are looked at together.
SLICE = 1 << 20


def _slices(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Runs of texts of about ``SLICE`` bytes, each with the place of its first."""
    texts = column.cast(pa.binary()).to_pylist()
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or i == len(texts) - 1:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0


#: Words of up to so many times 8 bytes are hashed side by side.
_CHUNKS = 4
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_LENGTHS = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word, from its bytes eight at a time."""
    data = np.frombuffer(raw + bytes(8), np.uint8)
    space = np.ones(len(raw) + 2, bool)
    np.logical_or(data[:-8] == 32, (data[:-8] - np.uint8(9)) < 5, out=space[1:-1])
    edge = np.flatnonzero(space[1:] != space[:-1])
    starts, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.lib.stride_tricks.as_strided(data, (len(raw) + 1, 8), (1, 1), writeable=False)
    hashes = size.astype(np.uint64) * _LENGTHS
    at = np.flatnonzero(size <= 8 * _CHUNKS)
    for chunk in range(0, 8 * _CHUNKS, 8):
        at = at[size[at] > chunk]
        value = np.ascontiguousarray(eight[starts[at] + chunk]).view(np.uint64)[:, 0]
        hashes[at] = mix(hashes[at] + (value & _MASKS[np.minimum(size[at] - chunk, 8)]))
    for i in np.flatnonzero(size > 8 * _CHUNKS).tolist():
        hashes[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + size[i]])
    return starts, hashes


def _sorted_words(line: np.ndarray, lead: np.ndarray, hashes: np.ndarray, lines: int) -> np.ndarray:
    """Places of words ordered by line, lead (below 256) and hash.

    One integer holds line, lead, leading hash bits and the place, so that a plain sort does;
    where the bits kept do not tell two words of a line apart, all keys are compared.
    """
    place_bits = max(len(hashes) - 1, 1).bit_length()
    room = 64 - place_bits - 8 - max(lines, 1).bit_length()
    if room >= 16:
        front = (line.astype(np.uint64) << np.uint64(8) | lead.astype(np.uint64)) << np.uint64(room) | hashes >> np.uint64(64 - room)
        key = np.sort(front << np.uint64(place_bits) | np.arange(len(hashes), dtype=np.uint64))
        order = (key & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        alike = key[1:] >> np.uint64(place_bits) == key[:-1] >> np.uint64(place_bits)
        if (hashes[order[1:][alike]] == hashes[order[:-1][alike]]).all():
            return order
    return np.lexsort((hashes, lead, line))


class Corpus(NamedTuple):
    """How often words of each slot are held by lines, in quarters of powers of two (a coarse
    count orders as well as a fine one), which places hold a word of two lines or more, and how
    many words all lines hold."""

    lead: np.ndarray
    twice: np.ndarray
    words: int

    def bucket_bits(self) -> int:
        """So many leading bits of a word's hash name its bucket; buckets stay of one size whatever the input."""
        return max(BUCKET_BITS, (self.words // BUCKET_WORDS).bit_length())


class Sets:
    """The distinct word hashes of many lines side by side, rarest first, and which line each belongs to."""

    def __init__(self, texts: Sequence[str | bytes | None], corpus: Corpus | None = None):
        raw = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"" for t in texts]
        whole = b"\n".join(raw)
        text_starts = np.cumsum([0, *[len(r) + 1 for r in raw]])[:-1]
        breaks = np.flatnonzero(np.frombuffer(whole, np.uint8) == 10)
        word_starts, hashes = _word_hashes(whole)
        words = np.diff(np.concatenate([[0], np.searchsorted(word_starts, breaks), [len(hashes)]]))
        held = np.flatnonzero(words)
        line = np.repeat(np.arange(len(held)), words[held])
        line_starts = np.concatenate([[0], breaks + 1])
        self.text = np.searchsorted(text_starts, line_starts[held], side="right") - 1
        self.number = held - np.searchsorted(line_starts, text_starts)[self.text]
        lead = np.zeros(len(hashes), np.uint8)
        if corpus is not None:
            lead = corpus.lead[_slot(hashes)]
        order = _sorted_words(line, lead, hashes, len(self.text))
        line, hashes = line[order], hashes[order]
        once = np.ones(len(line), bool)
        once[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        self.line, self.hashes = line[once], hashes[once]
        self.size = np.bincount(self.line, minlength=len(self.text))
        self.start = np.cumsum(self.size) - self.size
        self.set = self._set_hashes()

    def __len__(self) -> int:
        return len(self.text)

    def _set_hashes(self) -> np.ndarray:
        if not len(self):
            return np.zeros(0, np.int64)
        total = np.add.reduceat(mix(mix(self.hashes)), self.start)
        return mix(total + self.size.astype(np.uint64)).view(np.int64)

    def bitmaps(self) -> np.ndarray:
        """Four 64-bit words per line, zero beyond ``_bitmap_width``: the parity of its words per bit, folded for smaller sets.

        Differing bits never outnumber differing words.
        """
        bits = mix(self.hashes + np.uint64(5)) >> np.uint64(56)
        one = np.uint64(1) << (bits & np.uint64(63))
        part = bits >> np.uint64(6)
        w = [np.bitwise_xor.reduceat(np.where(part == np.uint64(k), one, np.uint64(0)), self.start) for k in range(4)]
        small, middle = self.size <= BITMAP_WORDS[0], self.size <= BITMAP_WORDS[1]
        none = np.uint64(0)
        out = [
            np.where(small, w[0] ^ w[1] ^ w[2] ^ w[3], np.where(middle, w[0] ^ w[2], w[0])),
            np.where(small, none, np.where(middle, w[1] ^ w[3], w[1])),
            np.where(middle, none, w[2]),
            np.where(middle, none, w[3]),
        ]
        return np.stack(out, axis=1)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - 18)).astype(np.int64)


def _twice_place(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes) >> np.uint64(64 - TWICE_BITS)).astype(np.int64)


def _mark(places: np.ndarray, once: np.ndarray, twice: np.ndarray) -> None:
    """Adds words at ``places`` to the places seen once and those seen more often."""
    places = np.sort(places)
    again = places[1:] == places[:-1]
    twice[places[1:][again]] = True
    first = places[np.concatenate([[True], ~again])] if len(places) else places
    twice[first[once[first]]] = True
    once[first] = True


def _bits(packed: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(packed, np.uint8)).astype(bool)


def _corpus(counted: DataFrame) -> Corpus:
    """What all tasks counted, added up (2 MB of counts and half a MB of places reach the driver).

    ``counted`` has the rows ``set`` (a block of slots) and ``counts`` of every task: the counts
    of its slots, then bit by bit its places seen and those seen twice.
    """
    width, places = SLOTS // SLOT_BLOCKS, (1 << TWICE_BITS) // SLOT_BLOCKS
    ends = [8 * width, 8 * width + places // 8]

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, once, twice = np.zeros(width, np.int64), np.zeros(places, bool), np.zeros(places, bool)
        for batch in batches:
            for value in batch.column("counts"):
                blob = value.as_py()
                total += np.frombuffer(blob[: ends[0]], np.int64)
                seen = _bits(blob[ends[0] : ends[1]])
                twice |= _bits(blob[ends[1] :]) | (once & seen)
                once |= seen
        blob = total.tobytes() + np.packbits(twice).tobytes()
        yield pa.RecordBatch.from_pydict({"set": pa.array([key[0].as_py()], pa.int64()), "counts": pa.array([blob], pa.binary())})

    lead, all_twice, words = np.zeros(SLOTS, np.uint8), np.zeros(1 << TWICE_BITS, bool), 0
    for r in counted.groupBy("set").applyInArrow(add, "set long, counts binary").collect():
        blob, block = bytes(r["counts"]), r["set"]
        counts = np.frombuffer(blob[: ends[0]], np.int64)
        words += int(counts.sum())
        lead[block * width : (block + 1) * width] = 4 * np.log2(1 + counts)
        all_twice[block * places : (block + 1) * places] = _bits(blob[ends[0] :])
    return Corpus(lead, all_twice, words)


def _keyed(docs: DataFrame) -> DataFrame:
    """Documents in reading order: null ids last, equal ids by the hash of their texts."""
    return docs.select(
        F.col("doc_id").isNull().cast("int").alias("null_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("text_hash"),
        "text",
    )


PLACE = ("null_id", "id", "text_hash")


def _lines(keyed: DataFrame) -> DataFrame:
    """null_id, id, text_hash, line, set of every line with a word, and on the first of a text n_lines, how many it has.

    Each task also gives its counts of words per slot, in rows with a null ``line``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros(SLOTS, np.int64)
        once, twice = np.zeros(1 << TWICE_BITS, bool), np.zeros(1 << TWICE_BITS, bool)
        for batch in batches:
            for first, texts in _slices(batch.column("text")):
                sets = Sets(texts)
                if not len(sets):
                    continue
                totals += np.bincount(_slot(sets.hashes), minlength=SLOTS)
                _mark(_twice_place(sets.hashes), once, twice)
                at = pa.array(sets.text + first, pa.int64())
                columns = {c: batch.column(c).take(at) for c in PLACE}
                further = np.concatenate([[False], sets.text[1:] == sets.text[:-1]])
                n_lines = pa.array(np.bincount(sets.text)[sets.text], pa.int64(), mask=further)
                columns |= {"line": pa.array(sets.number, pa.int32()), "set": pa.array(sets.set), "n_lines": n_lines}
                yield pa.RecordBatch.from_pydict(columns | {"counts": pa.nulls(len(sets), pa.binary())})
        if totals.any():
            n = SLOT_BLOCKS
            parts = [totals.reshape(n, -1), np.packbits(once).reshape(n, -1), np.packbits(twice).reshape(n, -1)]
            columns = {"null_id": pa.nulls(n, pa.int32()), "id": pa.nulls(n, pa.int64()), "text_hash": pa.nulls(n, pa.int64()), "line": pa.nulls(n, pa.int32())}
            columns |= {"set": pa.array(range(n), pa.int64()), "n_lines": pa.nulls(n, pa.int64())}
            blobs = [b"".join(part[b].tobytes() for part in parts) for b in range(n)]
            yield pa.RecordBatch.from_pydict(columns | {"counts": pa.array(blobs, pa.binary())})

    return keyed.mapInArrow(run, "null_id int, id long, text_hash long, line int, set long, n_lines long, counts binary")


#: ``shape`` is size and place in the order in one number, ``bits`` a bitmap of 8, 16 or 32 bytes.
POSTING = ("word", "set", "shape", "first", "bits")
_KINDS = {c: "binary" if c == "bits" else "long" for c in POSTING}
_ARROW = {c: pa.binary() if k == "binary" else pa.int64() for c, k in _KINDS.items()}


def _bitmap_width(size: np.ndarray) -> np.ndarray:
    """64-bit words of the bitmaps of sets of these sizes."""
    return np.where(size <= BITMAP_WORDS[0], 1, np.where(size <= BITMAP_WORDS[1], 2, 4))


def _packed(rows: dict[str, np.ndarray]) -> list[pa.Array]:
    """The columns of ``POSTING`` of rows with size, place and four words of bits each."""
    width = _bitmap_width(rows["size"])
    data = rows["bits"][np.arange(4) < width[:, None]]
    ends = np.concatenate([[0], np.cumsum(8 * width)]).astype(np.int32)
    bits = pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())])
    shape = rows["size"].astype(np.int64) << 32 | rows["place"]
    return [pa.array(rows["word"]), pa.array(rows["set"]), pa.array(shape), pa.array(rows["first"]), bits]


def _unpacked(batch: pa.RecordBatch, more: list[str]) -> dict[str, np.ndarray]:
    """Rows as ``_packed`` takes them, with the columns ``more`` as they are."""
    rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ["word", "set", "first", *more]}
    shape = batch.column("shape").to_numpy()
    rows["size"], rows["place"] = shape >> 32, shape & 0xFFFFFFFF
    rows["bits"] = np.zeros((len(shape), 4), np.uint64)
    column = batch.column("bits")
    _, ends, data = column.buffers()
    if len(shape):
        first, last = np.frombuffer(ends, np.int32)[[column.offset, column.offset + len(shape)]]
        rows["bits"][np.arange(4) < _bitmap_width(rows["size"])[:, None]] = np.frombuffer(data, np.uint64, (last - first) // 8, first)
    return rows


def _posting_rows(sets: Sets, ids: np.ndarray, corpus: Corpus) -> dict[str, np.ndarray]:
    """Index rows of the lines of some texts, whose ids are given.

    A word that no other line of the corpus holds gives no pair and no row.
    """
    # huge ids and line numbers tie; ties are tried both ways
    seen = np.clip(ids[sets.text], -(1 << 50), 1 << 50) * 4096 + np.minimum(sets.number, 4095)
    # of equal sets the earliest stands for all
    order = np.lexsort((seen, sets.set))
    stands = np.zeros(len(sets), bool)
    stands[order] = np.concatenate([[True], sets.set[order][1:] != sets.set[order][:-1]])
    stands &= sets.size >= NUM
    line = sets.line
    place = np.arange(len(line)) - sets.start[line]
    n = sets.size - -(-NUM * sets.size // DEN) + 1
    use = stands[line] & (place < n[line])
    use[use] = corpus.twice[_twice_place(sets.hashes[use])]
    line = line[use]
    rows = {"word": sets.hashes[use].view(np.int64), "set": sets.set[line], "size": sets.size[line], "place": place[use]}
    return rows | {"first": seen[line], "bits": sets.bitmaps()[line]}


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    return {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}


def _cut(rows: dict[str, np.ndarray], where) -> dict[str, np.ndarray]:
    return {c: v[where] for c, v in rows.items()}


def _dealt(rows: dict[str, np.ndarray], bucket_bits: int) -> pa.RecordBatch:
    """Index rows by bucket, up to ``VALUE_ROWS`` of a bucket in one value: four columns of numbers, then the bitmaps."""
    bucket = (rows["word"].view(np.uint64) >> np.uint64(64 - bucket_bits)).astype(np.int32)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = _cut(rows, order), bucket[order]
    new = np.concatenate([[True], bucket[1:] != bucket[:-1]])
    nth = np.arange(len(bucket)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    starts = np.flatnonzero(nth % VALUE_ROWS == 0)
    ends = np.append(starts[1:], len(bucket))
    numbers = np.stack([rows["word"], rows["set"], rows["size"].astype(np.int64) << 32 | rows["place"], rows["first"]])
    width = _bitmap_width(rows["size"])
    bits = rows["bits"][np.arange(4) < width[:, None]]
    at = np.concatenate([[0], np.cumsum(width)])
    values = [numbers[:, i:j].tobytes() + bits[at[i] : at[j]].tobytes() for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array((ends - starts).astype(np.int32)), pa.array(values, pa.binary())], ["bucket", "n", "rows"])


def _undealt(parts: list[tuple[int, bytes]]) -> dict[str, np.ndarray]:
    """The rows that values of ``_dealt`` hold."""
    held = [(np.frombuffer(value, np.int64), n) for n, value in parts]
    word, own, shape, first = np.concatenate([v[: 4 * n].reshape(4, n) for v, n in held], axis=1)
    size = shape >> 32
    bits = np.zeros((len(word), 4), np.uint64)
    bits[np.arange(4) < _bitmap_width(size)[:, None]] = np.concatenate([v[4 * n :] for v, n in held]).view(np.uint64)
    return {"word": word, "set": own, "size": size, "place": shape & 0xFFFFFFFF, "first": first, "bits": bits}


def _postings(keyed: DataFrame, corpus: Corpus) -> DataFrame:
    """bucket, n, rows: n index rows, one per set of a slice of texts and indexed word, as ``_dealt`` packs them.

    A row has word, set, size and place in the order, bitmap, and as ``first`` about where the set
    is first seen in the texts (by document, then line); it only says which candidates to try
    first. Sets of fewer than NUM words are alike only to themselves and need no index.
    """
    bucket_bits = corpus.bucket_bits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            null_ids, ids = batch.column("null_id").to_numpy(), batch.column("id").to_numpy()
            for at, texts in _slices(batch.column("text")):
                sets = Sets(texts, corpus)
                if len(sets):
                    held.append(_posting_rows(sets, np.where(null_ids == 1, 1 << 50, ids)[at : at + len(texts)], corpus))
                if sum(len(rows["set"]) for rows in held) > DEALT_ROWS:
                    yield _dealt(_joined(held), bucket_bits)
                    held = []
        if sum(len(rows["set"]) for rows in held):
            yield _dealt(_joined(held), bucket_bits)

    return keyed.select("null_id", "id", "text").mapInArrow(run, "bucket int, n int, rows binary")


def _differing_bits(rows: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Differing bits of two bitmaps at the width of the smaller set, which is i's."""
    x = (rows["bits"][i] ^ rows["bits"][j]).T
    small, middle = rows["size"][i] <= BITMAP_WORDS[0], rows["size"][i] <= BITMAP_WORDS[1]
    none = np.uint64(0)
    folded = [
        np.where(small, x[0] ^ x[1] ^ x[2] ^ x[3], np.where(middle, x[0] ^ x[2], x[0])),
        np.where(small, none, np.where(middle, x[1] ^ x[3], x[1])),
        np.where(middle, none, x[2]),
        np.where(middle, none, x[3]),
    ]
    return sum(np.bitwise_count(w).astype(np.int64) for w in folded)


def _survivors(group: np.ndarray, rows: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs within runs of equal ``group`` (sorted by size) that pass all filters, in portions."""
    n = len(group)
    ends = np.searchsorted(group, group, side="right")
    size, left_over = rows["size"].astype(np.int64), (rows["size"] - rows["place"]).astype(np.int64)
    left, step = np.arange(n), 1
    while True:
        left = left[left + step < ends[left]]
        left = left[size[left] * DEN >= size[left + step] * NUM]  # sizes only grow, so these stay out
        if not len(left):
            return
        for i in np.array_split(left, -(-len(left) // 500_000)):
            j = i + step
            both = size[i] + size[j]
            need = -(-NUM * both // (NUM + DEN))
            fits = (np.minimum(left_over[i], left_over[j]) >= need) & (rows["set"][i] != rows["set"][j])
            i, j, spare = i[fits], j[fits], (both - 2 * need)[fits]
            fits = _differing_bits(rows, i, j) <= spare
            yield i[fits], j[fits]
        step += 1


class Tried:
    """For every row the earliest few other rows that passed, and whether there were more."""

    def __init__(self, rows: dict[str, np.ndarray], most: int | None):
        self.rows, self.most = rows, most
        self.late: list[np.ndarray] = []
        self.early: list[np.ndarray] = []
        self.more = np.zeros(len(rows["set"]), bool)
        self.kept = 0

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        first = self.rows["first"]
        up, down = first[i] >= first[j], first[i] <= first[j]
        self.late += [i[up], j[down]]
        self.early += [j[up], i[down]]
        self.kept += int(up.sum() + down.sum())
        if self.most is not None and self.kept > 2_000_000:
            self._thin()

    def _thin(self) -> None:
        late, early = np.concatenate(self.late), np.concatenate(self.early)
        order = np.lexsort((self.rows["first"][early], late))
        late, early = late[order], early[order]
        starts = np.concatenate([[0], np.flatnonzero(late[1:] != late[:-1]) + 1]) if len(late) else np.zeros(0, np.int64)
        nth = np.arange(len(late)) - np.repeat(starts, np.diff(np.append(starts, len(late))))
        self.more[late[nth >= self.most]] = True
        self.late, self.early = [late[nth < self.most]], [early[nth < self.most]]
        self.kept = len(self.late[0])

    def pairs(self) -> np.ndarray:
        """Sets (later, earlier) as far as ``first`` tells, one a row."""
        if not self.late:
            return np.zeros((0, 2), np.int64)
        if self.most is not None:
            self._thin()
        own = self.rows["set"]
        return np.unique(np.stack([own[np.concatenate(self.late)], own[np.concatenate(self.early)]], axis=1), axis=0)


def _new_keys(rows: dict[str, np.ndarray], keys: list[str]) -> np.ndarray:
    return np.concatenate([[True], np.logical_or.reduce([rows[k][1:] != rows[k][:-1] for k in keys])])


def _once(rows: dict[str, np.ndarray], keys: list[str]) -> dict[str, np.ndarray]:
    """Rows whose lists follow each other, each list by size with a set once, at its earliest."""
    group, size = np.cumsum(_new_keys(rows, keys)), rows["size"]
    if group[-1] >> 20 or size.max() >> 20:
        order = np.lexsort((rows["set"], size, group))
    else:  # bits of the set part all but a few equal sizes; a set that stays twice is only tried twice
        key = (group << 20 | size).astype(np.uint64) << np.uint64(24) | rows["set"].view(np.uint64) >> np.uint64(40)
        order = np.argsort(key)
    rows = {c: v[order] for c, v in rows.items()}
    starts = np.flatnonzero(_new_keys(rows, [*keys, "set"]))
    out = {c: v[starts] for c, v in rows.items()}
    out["first"] = np.minimum.reduceat(rows["first"], starts)
    return out


def _runs(group: np.ndarray) -> np.ndarray:
    """The number of the run of equal values, for each of them."""
    return np.cumsum(np.concatenate([[0], group[1:] != group[:-1]])) if len(group) else group


#: Columns of what comparing gives: a pair, or an index row with b null.
_REST = [c for c in POSTING if c != "set"]
_FOUND = ", ".join(["a long", "b long", *[f"{c} {_KINDS[c]}" for c in _REST], "too_long boolean"])


def _found_rows(rows: dict[str, np.ndarray], too_long: bool) -> pa.RecordBatch:
    """Index rows as they are, of lists that are too long or that left candidates untried."""
    n = len(rows["set"])
    packed = dict(zip(POSTING, _packed(rows), strict=True))
    return pa.RecordBatch.from_arrays([packed["set"], pa.nulls(n, pa.int64()), *[packed[c] for c in _REST], pa.array(np.full(n, too_long))], ["a", "b", *_REST, "too_long"])


def _found_pairs(rows: dict[str, np.ndarray], tried: Tried) -> pa.RecordBatch:
    pairs, more = tried.pairs(), np.flatnonzero(tried.more)
    columns = [pa.array(np.concatenate([pairs[:, 0], rows["set"][more]])), pa.array(np.concatenate([pairs[:, 1], np.zeros(len(more), np.int64)]))]
    word = pa.array(np.concatenate([np.zeros(len(pairs), np.int64), rows["word"][more]]))
    none = pa.nulls(len(word), pa.bool_())
    return pa.RecordBatch.from_arrays([*columns, *[word if c == "word" else pa.nulls(len(word), _ARROW[c]) for c in _REST], none], ["a", "b", *_REST, "too_long"])


def _by_word(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Rows in lists, each by size with a set once; a word with one row has no list."""
    if not len(rows["word"]):
        return rows
    order = np.argsort(rows["word"])
    word = rows["word"][order]
    alike = word[1:] == word[:-1]
    order = order[np.concatenate([[False], alike]) | np.concatenate([alike, [False]])]
    rows = _cut(rows, order)
    return _once(rows, ["word"]) if len(order) else rows


def _compare_buckets(postings: DataFrame, most: int) -> DataFrame:
    """Candidate pairs a (later), b (earlier) of the rows of ``_postings``, bucket by bucket.

    A set has at most ``most`` under a word, and a row with b = 0 and the word if it had more. With
    b null come the index rows of such words, and (``too_long``) of words with too many lines, which are not compared here.
    """

    def parted(rows: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        group = _runs(rows["word"])
        long = (np.bincount(group) > LIST_ROWS)[group] if len(group) else np.zeros(0, bool)
        return _cut(rows, long), _cut(rows, ~long)

    def candidates(rows: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
        group = _runs(rows["word"])
        tried = Tried(rows, most)
        for i, j in _survivors(group, rows):
            tried.add(i, j)
        yield _found_pairs(rows, tried)
        if tried.more.any():
            yield _found_rows(_cut(rows, np.isin(group, group[tried.more])), False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held, over, size, room = None, [], np.zeros(0, np.int64), 0, 0
        parts: list[tuple[int, bytes]] = []

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            """Takes long lists out of the rows of the bucket, and once all are here compares the others."""
            nonlocal held, parts, over, size, room
            rows = _joined([*held, _undealt(parts)] if parts else held)
            again = np.isin(rows["word"], over)
            if again.any():
                yield _found_rows(_cut(rows, again), True)
                rows = _cut(rows, ~again)
            lists = _by_word(rows)
            long, short = parted(lists)
            if len(long["set"]):
                yield _found_rows(long, True)
                over = np.union1d(over, long["word"])
            if last:
                if len(short["set"]):
                    yield from candidates(short)
                return
            rows = _cut(rows, ~np.isin(rows["word"], lists["word"]))
            held, parts = [rows, short], []
            size = len(rows["set"]) + len(short["set"])
            room = max(8 * LIST_ROWS, 2 * size)

        for batch in batches:
            for own, n, value in zip(*[batch.column(c).to_pylist() for c in ("bucket", "n", "rows")], strict=True):
                if own != bucket:
                    if bucket is not None:
                        yield from settle(True)
                    bucket, held, parts, over, size, room = own, [], [], np.zeros(0, np.int64), 0, 8 * LIST_ROWS
                parts.append((n, value))
                size += n
                if size > room:
                    yield from settle(False)
        if bucket is not None:
            yield from settle(True)

    return postings.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "n", "rows").mapInArrow(run, _FOUND)


def _compare_blocks(blocks: DataFrame, most: int | None, asked: bool = False) -> DataFrame:
    """Candidate pairs a (later), b (earlier) within pairs of blocks.

    With ``most``, a set has at most that many under a word, and a row with b = 0 and the word
    if it had more. With ``asked``, only pairs of which one row has ``open`` come back.
    """
    keys = ["word", "block_a", "block_b"]
    extra = [*keys[1:], *(["open"] if asked else [])]

    def candidates(rows: dict[str, np.ndarray], starts: np.ndarray) -> pa.RecordBatch:
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows["set"]))))
        tried = Tried(rows, most)
        for i, j in _survivors(group, rows):
            if asked:
                use = rows["open"][i] | rows["open"][j]
                i, j = i[use], j[use]
            tried.add(i, j)
        return _found_pairs(rows, tried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, np.ndarray] | None = None
        for batch in batches:
            rows = _unpacked(batch, extra)
            if kept is not None:
                rows = _joined([kept, rows])
            if not len(rows["set"]):
                kept = rows
                continue
            rows = _once(rows, keys)
            starts = np.flatnonzero(_new_keys(rows, keys))
            if starts[-1]:
                yield candidates(_cut(rows, slice(0, starts[-1])), starts[:-1])
            kept = _cut(rows, slice(starts[-1], None))
        if kept is not None and len(kept["set"]):
            yield candidates(kept, np.array([0]))

    # rows of a list need only be neighbours: a sort by one number is quick, the rest is sorted list by list
    dealt = blocks.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return dealt.select(*POSTING, *extra).mapInArrow(run, _FOUND)


def _in_blocks(long: DataFrame) -> DataFrame:
    """Rows of words with too many lines, once for every pair of blocks they take part in."""
    blocks = long.groupBy("word").agg(F.ceil(F.count(F.lit(1)) / F.lit(LIST_ROWS)).cast("int").alias("blocks"))
    own = F.pmod("set", F.col("blocks")).cast("int")
    return (
        long.join(blocks, "word")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"block_a": F.least("own", "other"), "block_b": F.greatest("own", "other")})
    )


def _batches_of(spark: SparkSession, rows: int) -> None:
    """Arrow batches of rows of a few numbers may be longer than those of texts, batches of dealt values must be shorter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def _candidates(postings: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """a, b, word: candidate pairs of different sets, a later than b as far as ``first`` tells, and
    (set, 0, word) for sets that had more than ``most`` under a word; then the index rows of such words.
    """
    _batches_of(postings.sparkSession, VALUES_TOGETHER)
    first = store(_compare_buckets(postings, most), "line-pairs")
    rows = first.where("b IS NULL").drop("b").withColumnRenamed("a", "set")
    same = [c for c in POSTING if c != "first"]
    long = rows.where("too_long").groupBy(*same).agg(F.min("first").alias("first"))
    _batches_of(postings.sparkSession, NUMBERS_TOGETHER)
    second = _compare_blocks(_in_blocks(long), most)
    found = first.where("b IS NOT NULL").select("a", "b", "word").union(second.select("a", "b", "word")).distinct()
    return store(found, "line-candidates"), rows.select(*POSTING)


def _words_of_sets(keyed: DataFrame, wanted: DataFrame) -> DataFrame:
    """set and its words, for the sets whose first line is in ``wanted`` (place, line, set)."""
    by_doc = wanted.groupBy(*PLACE).agg(F.collect_list("line").alias("lines"))
    by_doc = F.broadcast(by_doc) if wanted.count() <= FEW_LINES else by_doc.hint("shuffle_hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, numbers in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("lines").to_pylist(), strict=True):
                lines = text.split(b"\n")
                texts.append(b"\n".join(lines[n] for n in numbers))
            sets = Sets(texts)
            words = pa.ListArray.from_arrays(pa.array(np.append(sets.start, len(sets.hashes)).astype(np.int32)), pa.array(sets.hashes.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"set": pa.array(sets.set), "words": words})

    small_batches(keyed.sparkSession)
    found = keyed.join(by_doc, list(PLACE)).select("text", "lines")
    # a document that is there twice gives its lines twice
    return found.mapInArrow(run, "set long, words array<long>").dropDuplicates(["set"])


def _verified(keyed: DataFrame, firsts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The sets (``set``) of ``pairs`` that an earlier line is alike to, checked on words and places."""
    asked = pairs.select(F.col("a").alias("set")).union(pairs.select(F.col("b").alias("set"))).distinct()
    places = store(firsts.join(asked.hint("shuffle_hash"), "set").select("set", *PLACE, "line"), "line-places")
    words = store(_words_of_sets(keyed, places.select(*PLACE, "line", "set")).join(places, "set"), "line-words")
    side = {k: words.select(F.col("set").alias(k), F.col("words").alias(f"words_{k}"), F.struct(*PLACE, "line").alias(f"at_{k}")) for k in ("a", "b")}
    both = F.size("words_a") + F.size("words_b")
    shared = F.size(F.array_intersect("words_a", "words_b"))
    alike = pairs.join(side["a"], "a").join(side["b"], "b").where(shared * (NUM + DEN) >= both * NUM)
    # the order of the pairs was a guess; the places decide
    return alike.select(F.when(F.col("at_a") > F.col("at_b"), F.col("a")).otherwise(F.col("b")).alias("set")).distinct()


def late_sets(keyed: DataFrame, firsts: DataFrame, corpus: Corpus) -> DataFrame:
    """The sets whose first line comes after a line of another set that is alike to it."""
    tried, rows = _candidates(_postings(keyed, corpus), FIRST_TRIED)
    late = store(_verified(keyed, firsts, tried.where("b != 0").select("a", "b").distinct()), "line-late")
    # sets with more candidates than were tried, none of which settled them
    still_open = store(tried.where("b = 0").select(F.col("a").alias("set"), "word").join(late, "set", "left_anti"), "line-open")
    if still_open.isEmpty():
        return late
    words = still_open.select("word").distinct()
    sets = still_open.select("set").distinct().withColumn("open", F.lit(True))
    again = rows.join(words, "word", "left_semi").join(sets, "set", "left")
    again = store(again.withColumn("open", F.coalesce("open", F.lit(False))), "line-again")
    _batches_of(keyed.sparkSession, NUMBERS_TOGETHER)
    # one pass in blocks, whatever the length of a list
    rest = store(_compare_blocks(_in_blocks(again), None, asked=True).select("a", "b").distinct(), "line-candidates")
    return late.union(_verified(keyed, firsts, rest)).distinct()


def line_decisions(docs: DataFrame) -> DataFrame:
    """null_id, id, text_hash, n_lines (with a word) and removed_lines of every document that has lines.

    A line is removed if a line before it, in a smaller doc_id or above it, is alike to it;
    all are judged on the input. Null ids come last; rows of equal id and text are one document.
    """
    keyed = _keyed(docs)
    small_batches(docs.sparkSession)
    stored = store(_lines(keyed), "lines")
    corpus = _corpus(stored.where("line IS NULL").select("set", "counts"))
    lines = stored.where("line IS NOT NULL").drop("counts")
    place = F.struct(*PLACE, "line")
    firsts = lines.groupBy("set").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("held"))
    firsts = store(firsts.select("set", "first.*", "held"), "line-firsts")
    late = late_sets(keyed, firsts, corpus).withColumn("late", F.lit(True))
    # only sets that are late or on several lines lose lines
    marked = firsts.select("set", "held", place.alias("first")).join(late, "set", "left").where("late OR held > 1")
    removed = lines.join(marked.hint("shuffle_hash"), "set").where(F.coalesce("late", F.lit(False)) | (place != F.col("first")))
    # equal documents have equal lines, so their lines are taken once
    counted = lines.where("n_lines IS NOT NULL").select(*PLACE, "n_lines", F.lit(None).cast("int").alias("line"))
    both = counted.union(removed.select(*PLACE, F.lit(None).cast("long"), "line"))
    return both.groupBy(*PLACE).agg(F.max("n_lines").alias("n_lines"), F.array_sort(F.collect_set("line")).alias("removed_lines"))


def _matched(docs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """``docs`` with the removed lines of each document as one more column, ``name``."""
    null_id, own_id, own_hash = free_names([*docs.columns, name], "null_id", "id", "text_hash")
    found = found.select(
        F.col("null_id").alias(null_id), F.col("id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("removed_lines").alias(name)
    )
    match = (
        (F.col("doc_id").isNull().cast("int") == F.col(null_id))
        & (F.coalesce("doc_id", F.lit(0)) == F.col(own_id))
        & (F.xxhash64("text") == F.col(own_hash))
    )
    return docs.join(found.hint("shuffle_hash"), match, "left").select(*docs.columns, name)


def line_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines (with a word), n_removed, removed_lines (numbers from 0).

    Null, empty and blank texts have no lines. Repeated rows get the same answer each.
    """
    hashed = docs.select("doc_id", F.xxhash64("text").alias("own_hash"))
    found = line_decisions(docs)
    found = found.select(*[F.col(c).alias(f"_{c}") for c in found.columns])
    match = (
        (F.col("doc_id").isNull().cast("int") == F.col("_null_id"))
        & (F.coalesce("doc_id", F.lit(0)) == F.col("_id"))
        & (F.col("own_hash") == F.col("_text_hash"))
    )
    none = F.array().cast("array<int>")
    return hashed.join(found, match, "left").select(
        "doc_id",
        F.coalesce("_n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce(F.size("_removed_lines"), F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("_removed_lines", none).alias("removed_lines"),
    )


def drop_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with removed lines cut out of ``text``; other columns stay.

    Kept lines are joined by newlines as they were; a text that loses all its lines becomes
    empty, and a null text stays null. A document's lines lose nothing else.
    """
    removed = line_decisions(docs).where(F.size("removed_lines") > 0).select(*PLACE, "removed_lines")
    names = docs.columns
    (gone_name,) = free_names(names, "removed_lines")
    found = _matched(docs, removed, gone_name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for text, gone in zip(batch.column("text"), batch.column(gone_name), strict=True):
                value = text.as_py()
                if gone.is_valid:
                    out = set(gone.as_py())
                    value = "\n".join(x for i, x in enumerate(value.split("\n")) if i not in out)
                texts.append(value)
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    return found.mapInArrow(run, docs.schema)
