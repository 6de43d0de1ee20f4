"""Small helpers that several of these operators share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.session import scratch_path

#: Distinct words that a Python worker remembers before it starts afresh.
REMEMBERED = 600_000
#: Rows of an Arrow batch; texts are long, so batches are short.
BATCH_ROWS = 1_000

_BASE = 0x9E3779B97F4A7C15 | 1
_UNBASE = pow(_BASE, -1, 1 << 64)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts stay small enough for a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def store(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared scratch folder: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; a null text has none."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


class WordHash(dict):
    """64-bit hash of a word, remembered; forgets everything when it grows too large."""

    def __init__(self, seed: int):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, self.seed)
        return value

    def many(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[str, np.ndarray] = {}


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", _UNBASE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.cumprod(table, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(23))
#: Bytes hashed side by side.
_PART = 1 << 18


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of a text, without a loop over words."""
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        first = starts[at]
        upto = max(int(np.searchsorted(ends, first + _PART, side="right")), at + 1)
        last = ends[upto - 1]
        up, down = power_tables(int(last - first) + 1)
        sums = np.zeros(int(last - first) + 1, np.uint64)
        np.cumsum(_BYTE[data[first:last]] * up[:-1], out=sums[1:])
        a, b = starts[at:upto] - first, ends[at:upto] - first
        hashes[at:upto] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
        at = upto
    return starts, hashes


def window_sums(hashes: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``window_hash`` reads windows of any length from them."""
    up, _ = power_tables(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return sums


def window_hash(sums: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every window of ``k`` consecutive items."""
    n = len(sums) - 1
    if n < k:
        return np.zeros(0, np.uint64)
    _, down = power_tables(n + 1)
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1])


def sliding_min(x: np.ndarray, k: int) -> np.ndarray:
    """Smallest of every ``k`` consecutive values (``len(x) - k + 1`` results)."""
    if len(x) < k:
        return x[:0]
    width, low = 1, x
    while width * 2 <= k:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = k - width
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def joined(arrays: list[np.ndarray], dtype) -> np.ndarray:
    return np.concatenate(arrays).astype(dtype, copy=False) if arrays else np.zeros(0, dtype)


def binary_list(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def group_count(total: int, target: int) -> int:
    return max(1, -(-total // target))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def ascii_lower(column):
    """A-Z only, so that other letters stay as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_names(taken: Sequence[str], *wanted: str) -> list[str]:
    """``wanted`` names with as many underscores in front as it takes to differ from all of ``taken``."""
    held = {t.lower() for t in taken}
    front = "_"
    while any((front + w).lower() in held for w in wanted):
        front += "_"
    return [front + w for w in wanted]
