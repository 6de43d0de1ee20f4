"""Benchmark decontamination by the q-gram lemma and banded alignment.

An item of m characters that a text holds with at most k edits shares at least
m - q + 1 - k * q of its q-grams with it, all near one diagonal (place in the text minus
place in the item). Shared q-grams are counted in overlapping bands of diagonals twice as
wide as the edits can shift; bands that reach the bound are aligned, within the band.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import group_count, mix, small_batches

Q = 8
#: Edits allowed for each character of an item.
EDIT_RATE = 0.1
#: Characters of benchmark text that go to the tasks at a time; a larger benchmark takes several passes.
BLOCK_CHARS = 1 << 20
#: Characters of documents that are looked up together.
FLUSH_CHARS = 1 << 20
_FILTER_BITS = 22
#: Stands between documents and after items; no text holds it.
_GAP = 0x10FFFF + 1


def normal(text: str | None) -> str:
    """Lower-cased, with every run of white space as one space and none outside."""
    return " ".join((text or "").lower().split())


def budget(chars: int, q: int = Q, rate: float = EDIT_RATE) -> int:
    """Edits allowed in an item: ``rate`` of its length, as far as the lemma still asks for a shared q-gram."""
    return max(0, min(int(rate * chars), (chars - q) // q))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_char_hash: list[np.ndarray] = []


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of the q-gram at every place."""
    if not _char_hash:
        _char_hash.append(mix(np.arange(_GAP + 1, dtype=np.uint64) + np.uint64(1)))
    h = _char_hash[0][points]
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = h[:n].copy()
    for i in range(1, q):
        out *= _BASE
        out += h[i : i + n]
    return out * np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Items:
    """Benchmark items of one block with their q-gram index."""

    ids: list[int | None]
    points: list[np.ndarray]
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    q: int

    @property
    def reach(self) -> int:
        return max(len(p) for p in self.points) + 4 * int(self.edits.max()) + 4

    def present(self) -> np.ndarray:
        """Which leading bits of a hash occur; most texts' q-grams stop here."""
        mask = np.zeros(1 << _FILTER_BITS, bool)
        mask[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return mask


def index_items(rows: list[tuple[int | None, str | None]], q: int = Q, rate: float = EDIT_RATE) -> Items | None:
    """Items with fewer than ``q`` characters hold no q-gram and never match; None if all are so."""
    rows = [(i, p) for i, p in ((i, _points(normal(t))) for i, t in rows) if len(p) >= q]
    if not rows:
        return None
    lengths = np.array([len(p) for _, p in rows])
    edits = np.array([budget(int(n), q, rate) for n in lengths])
    grams = np.concatenate([_grams(p, q) for _, p in rows])
    item = np.repeat(np.arange(len(rows)), lengths - q + 1)
    place = np.concatenate([np.arange(n - q + 1) for n in lengths])
    order = np.argsort(grams, kind="stable")
    unique, first = np.unique(grams[order], return_index=True)
    least = lengths - q + 1 - edits * q
    return Items([i for i, _ in rows], [p for _, p in rows], edits, least, unique, np.append(first, len(grams)), item[order], place[order], q)


def _regions(points: np.ndarray, starts: np.ndarray, items: Items, present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, item, lowest diagonal) of all bands that reach their item's bound."""
    grams = _grams(points, items.q)
    at = np.flatnonzero(present[(grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    found = np.searchsorted(items.grams, grams[at])
    found[found == len(items.grams)] = 0
    same = items.grams[found] == grams[at]
    at, found = at[same], found[same]
    n = items.first[found + 1] - items.first[found]
    hit = np.repeat(items.first[found], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(at, n)
    item = items.item[hit]
    text = np.searchsorted(starts, at, side="right") - 1
    # shifted by the longest reach so that no diagonal is negative
    diagonal = at - starts[text] - items.place[hit] + items.reach
    width = items.edits[item] + 1
    band = diagonal // width
    key = (text.astype(np.int64) << 44) | (item.astype(np.int64) << 24)
    key, count = np.unique(np.concatenate([key | band, key | (band - 1)]), return_counts=True)
    item = (key >> 24) & 0xFFFFF
    enough = count >= items.least[item]
    key, item = key[enough], item[enough]
    low = (key & 0xFFFFFF) * (items.edits[item] + 1) - items.reach
    return key >> 44, item, low


def align(text: np.ndarray, low: np.ndarray, item: np.ndarray, items: Items) -> np.ndarray:
    """Fewest edits that turn each item into a stretch of the text, within its band.

    ``low`` is the band's lowest diagonal, as a place in ``text``. All regions advance
    together, one item character at a time; columns are diagonals.
    """
    longest = max(len(items.points[i]) for i in item)
    edits = items.edits[item]
    width = int((2 * (edits + 1) + 2 * edits).max())
    table = np.full((len(item), longest), _GAP, np.uint32)
    for row, i in enumerate(item):
        table[row, : len(items.points[i])] = items.points[i]
    ends = np.array([len(items.points[i]) for i in item])
    columns = np.arange(width)
    place = (low - edits)[:, None] + columns
    cost = np.zeros((len(item), width), np.int32)
    best = np.full(len(item), longest, np.int32)
    far = np.int32(1 << 20)
    for i in range(longest):
        where = place + i
        inside = (where >= 0) & (where < len(text))
        chars = np.where(inside, text[np.clip(where, 0, len(text) - 1)], _GAP)
        step = cost + ((chars != table[:, i : i + 1]) | ~inside)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        step = np.minimum(step, far)
        cost = np.minimum.accumulate(step - columns, axis=1) + columns
        done = ends == i + 1
        if done.any():
            best[done] = cost[done].min(axis=1)
    return best


class Reader:
    """Looks texts up in one block of items; remembers which items each text holds."""

    def __init__(self, items: Items):
        self.items, self.mask = items, items.present()

    def read(self, texts: list[str | None]) -> list[dict[int, int]]:
        """For each text the items it holds, with the fewest edits."""
        found: list[dict[int, int]] = [{} for _ in texts]
        parts: list[tuple[int, np.ndarray]] = []
        size = 0
        for number, text in enumerate(texts):
            points = _points(normal(text))
            # long texts come in parts that overlap by more than an item can span
            for a in range(0, max(len(points), 1), FLUSH_CHARS):
                part = points[a : a + FLUSH_CHARS + self.items.reach]
                if len(part) >= self.items.q:
                    parts.append((number, part))
                    size += len(part)
            if size >= FLUSH_CHARS:
                self._flush(parts, found)
                parts, size = [], 0
        self._flush(parts, found)
        return found

    def _flush(self, parts: list[tuple[int, np.ndarray]], found: list[dict[int, int]]) -> None:
        if not parts:
            return
        gap = np.array([_GAP], np.uint32)
        text = np.concatenate([x for _, p in parts for x in (p, gap)])
        lengths = np.array([len(p) + 1 for _, p in parts])
        starts = np.cumsum(lengths) - lengths
        number, item, low = _regions(text, starts, self.items, self.mask)
        for some in np.array_split(np.arange(len(item)), -(-len(item) // 2_000)) if len(item) else []:
            edits = align(text, starts[number[some]] + low[some], item[some], self.items)
            for n, i, e in zip(number[some], item[some], edits, strict=True):
                if e <= self.items.edits[i]:
                    own = found[parts[n][0]]
                    own[int(i)] = min(int(e), own.get(int(i), int(e)))


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str | None]]]:
    """The benchmark in blocks of about ``BLOCK_CHARS``; only one block is in the driver at a time."""
    size = benchmark.select(F.sum(F.length("text"))).first()[0] or 0
    count = group_count(size, BLOCK_CHARS)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for n in range(count):
        yield [(r["item_id"], r["text"]) for r in benchmark.where(block == n).select("item_id", "text").collect()]


LEAKS = "leaks array<struct<item_id: bigint, edits: int>>"


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` (columns ``keep``, all by default) with ``leaks``.

    ``leaks`` lists the items (item_id, edits) that the text holds with at most ``budget``
    edits, by item_id, nulls first; empty where there are none, also for null and empty
    texts. Case and the amount of white space do not matter. Null and short items never
    match; items that are there twice are listed twice. A column named leaks is replaced.
    """
    keep = [c for c in keep or docs.columns if c != "leaks"]
    small_batches(docs.sparkSession)
    blocks = [items for items in map(index_items, _blocks(benchmark)) if items]
    names = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(names)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    if not blocks:
        return rows.select(*keep, F.from_json(F.lit("[]"), LEAKS.split(" ", 1)[1]).alias("leaks"))
    for turn, items in enumerate(blocks):
        last = turn == len(blocks) - 1
        own = keep if last else names
        rows = rows.mapInArrow(_pass(items, own, turn > 0, last), ", ".join([*[f"`{c}` {kinds[c]}" for c in own], LEAKS]))
    return rows


def _pass(items: Items, keep: list[str], again: bool, last: bool):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(items)
        for batch in batches:
            found = reader.read(batch.column("text").to_pylist())
            leaks = [[{"item_id": items.ids[i], "edits": e} for i, e in own.items()] for own in found]
            if again:
                leaks = [[*old, *new] for old, new in zip(batch.column("leaks").to_pylist(), leaks, strict=True)]
            if last:
                for own in leaks:
                    own.sort(key=lambda x: (x["item_id"] is not None, x["item_id"] or 0, x["edits"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(leaks, kind)], [*keep, "leaks"])

    return run
