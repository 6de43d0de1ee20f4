"""Packed id matrices: best-fit decreasing with a segment tree over the free space.

Each row of the result is one row of an id matrix with ``row_tokens`` columns, the
cumulative lengths of its segments and the position ids that restart in each segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazeline.llm.common import group_count
from hazeline.llm.pieces import token_pieces

ROW_TOKENS = 2048
#: Bytes of text that are packed together; a group's ids are held in memory once.
GROUP_BYTES = 6 << 20
SCHEMA = (
    "sequence_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, pieces array<int>, starts array<long>"
)


class SpaceTree:
    """Segment tree over free space 0..capacity that counts the open rows with each free space."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, space: int, by: int) -> None:
        node = self.leaves + space
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, need: int) -> int:
        """Smallest free space of at least ``need`` among the open rows; -1 if none."""
        node = self.leaves + need
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if self.count[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_rows(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the pieces of each row; longest first, each into the tightest open row."""
    tree = SpaceTree(capacity)
    open_rows: dict[int, list[int]] = {}
    rows: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        space = tree.tightest(lengths[i])
        if space < 0:
            row, space = len(rows), capacity
            rows.append([])
        else:
            row = open_rows[space].pop()
            tree.add(space, -1)
        rows[row].append(i)
        space -= lengths[i]
        if space:
            open_rows.setdefault(space, []).append(row)
            tree.add(space, 1)
    return rows


def packed_matrices(docs: DataFrame, tokenizer_path: str, row_tokens: int = ROW_TOKENS, end_id: int = 0, pad_id: int = 0, id_type: str = "<u2") -> DataFrame:
    """One matrix row per result row.

    ``ids`` are ``row_tokens`` little-endian ids of ``id_type`` (which must hold the
    vocabulary), filled up with ``pad_id`` after ``n_tokens``; segment i is
    ids[cu_seqlens[i]:cu_seqlens[i + 1]] and holds the ids of doc_ids[i] from starts[i] on.
    ``position_ids`` (16-bit) count from 0 in each segment and are 0 in the padding. Longer
    documents are cut losslessly. Null and empty texts give a segment with the end id alone;
    rows with equal or null doc_id each keep their segments; no documents, no rows.
    """
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = group_count(size, GROUP_BYTES)
    pieces = token_pieces(docs, tokenizer_path, row_tokens, end_id, with_ids=True, id_type=id_type)
    # by place, so that no frequent key fills a group
    dealt = pieces.drop("ids_crc32").withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lengths = table.column("length").to_pylist()
        doc_ids, piece, start, ids = (table.column(c).to_pylist() for c in ("doc_id", "piece", "start", "ids"))
        rows = best_fit_rows(lengths, row_tokens)
        out: dict[str, list] = {f.split()[0]: [] for f in SCHEMA.split(", ")}
        for number, own in enumerate(rows):
            ends = np.cumsum([lengths[i] for i in own])
            packed = b"".join(ids[i] for i in own)
            padding = np.full(row_tokens - int(ends[-1]), pad_id, id_type).tobytes()
            positions = np.zeros(row_tokens, "<u2")
            for i, end in zip(own, ends, strict=True):
                positions[end - lengths[i] : end] = np.arange(lengths[i])
            out["sequence_id"].append((key[0].as_py() << 32) + number)
            out["n_tokens"].append(int(ends[-1]))
            out["n_segments"].append(len(own))
            out["ids"].append(packed + padding)
            out["cu_seqlens"].append([0, *ends.tolist()])
            out["position_ids"].append(positions.tobytes())
            for name, values in (("doc_ids", doc_ids), ("pieces", piece), ("starts", start)):
                out[name].append([values[i] for i in own])
        return pa.table(
            {
                "sequence_id": pa.array(out["sequence_id"], pa.int64()),
                "n_tokens": pa.array(out["n_tokens"], pa.int32()),
                "n_segments": pa.array(out["n_segments"], pa.int32()),
                "ids": pa.array(out["ids"], pa.binary()),
                "cu_seqlens": pa.array(out["cu_seqlens"], pa.list_(pa.int32())),
                "position_ids": pa.array(out["position_ids"], pa.binary()),
                "doc_ids": pa.array(out["doc_ids"], pa.list_(pa.int64())),
                "pieces": pa.array(out["pieces"], pa.list_(pa.int32())),
                "starts": pa.array(out["starts"], pa.list_(pa.int64())),
            }
        )

    return dealt.groupBy("group").applyInArrow(run, SCHEMA)


def write_matrices(docs: DataFrame, path: str, tokenizer_path: str, **options) -> DataFrame:
    """Writes ``packed_matrices`` as Parquet files below ``path`` and returns them as written."""
    packed = packed_matrices(docs, tokenizer_path, **options)
    packed.write.parquet(path)
    return docs.sparkSession.read.schema(packed.schema).parquet(path)
