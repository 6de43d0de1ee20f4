"""Documents as token ids, cut into pieces of at most one sequence."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hazeline.llm.common import small_batches
from hazeline.llm.tokens import tokenizer


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int, with_ids: bool, id_type: str = "<u4") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, ids.

    A document is its token ids and then ``end_id``; one longer than ``max_tokens`` is cut
    every ``max_tokens`` ids, so joining its pieces in order gives all ids back. Null and
    empty texts are the end id alone. Rows with equal or null doc_id are kept apart. The
    checksum is over little-endian 32-bit ids; ``ids`` holds them as ``id_type``.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(tokenizer_path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows, pieces, starts, lengths, sums, blobs = [], [], [], [], [], []
            for row, ids in enumerate(encoder.encode_texts(texts)):
                ids = np.append(ids, np.uint32(end_id))
                for piece, start in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[start : start + max_tokens]
                    rows.append(row)
                    pieces.append(piece)
                    starts.append(start)
                    lengths.append(len(part))
                    sums.append(zlib.crc32(part.astype("<u4").tobytes()))
                    if with_ids:
                        blobs.append(part.astype(id_type).tobytes())
            columns = {
                "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                "piece": pa.array(pieces, pa.int32()),
                "start": pa.array(starts, pa.int64()),
                "length": pa.array(lengths, pa.int64()),
                "ids_crc32": pa.array(sums, pa.int64()),
            }
            if with_ids:
                columns["ids"] = pa.array(blobs, pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
