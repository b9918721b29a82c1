"""Packing without padding: each document is cut into pieces whose lengths are powers of two, and equal lengths share a bucket.

A document of n tokens (its end token included) becomes as many pieces of ``max_len`` as fit, then one piece for each binary
digit of the rest, longest first. A piece fills its sequence, so no sequence crosses documents and none is padded; a
batch of one shape is read from one bucket. Work and memory are linear in a document, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bpe import coder, slices
from keyloom.llm.common import bounded_batches, texts

COLUMNS = "start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids binary"


def piece_lengths(n: int, max_len: int) -> list[int]:
    """The decomposition of n: whole pieces of max_len, then the binary digits of what is left."""
    whole, rest = divmod(n, max_len)
    return [max_len] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Write pieces by bucket, so that sequences of one length lie together and a batch of one shape is read from one folder.
    Each task writes its own file of a bucket: nothing is shuffled."""
    pieces.write.partitionBy("bucket").parquet(path)


def pack(docs: DataFrame, path: str, max_len: int = 2048, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, bucket (log2 of the length), sequence_id, offset, ids (binary,
    little-endian unsigned 32-bit).

    ``max_len`` is a power of two. A null or empty text has only the end token (no piece at all if ``end_id`` is None).
    Repeated rows and null ids are packed like any others; other columns are not carried. Sequence ids are unique and
    not dense: the number of the task, then a count in it. One text may have up to 500 million tokens (offsets in a batch are
    32 bits). An empty table gives no rows.
    """
    if max_len < 1 or max_len & max_len - 1:
        raise ValueError("max_len must be a power of two")
    bounded_batches(docs.sparkSession)
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in slices(values):
                got = [g + tail for g in bpe.encode_bytes(values[a:b])]
                lengths = [piece_lengths(len(g) // 4, max_len) for g in got]
                counts = np.array([len(x) for x in lengths])
                length = np.array([y for x in lengths for y in x], dtype=np.int64)
                tokens = np.repeat(np.array([len(g) // 4 for g in got], dtype=np.int64), counts)
                ends = np.cumsum(length)
                starts = ends - length
                before = np.repeat(np.cumsum([len(g) // 4 for g in got]) - np.array([len(g) // 4 for g in got], dtype=np.int64), counts)
                offsets = np.concatenate([[0], ends * 4]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(np.repeat(np.arange(b - a), counts))),
                        pa.array(starts - before),
                        pa.array(length),
                        pa.array(tokens),
                        pa.array(np.log2(np.maximum(length, 1)).astype(np.int32)),
                        pa.array(sequence + np.arange(len(length))),
                        pa.array(np.zeros(len(length), dtype=np.int64)),
                        pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(got))]),
                    ],
                    ["id", "start", "length", "doc_tokens", "bucket", "sequence_id", "offset", "ids"],
                )
                sequence += len(length)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, {COLUMNS}").withColumnRenamed("id", id_col)
