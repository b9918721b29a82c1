"""Repeated lines: a filter of twice-seen line hashes finds suspects, and only suspects shuffle for exact confirmation.

1. Hashes of long line keys, one per document, feed the two Bloom filters; the twice-seen filter is broadcast.
2. Suspected lines travel as whole keys. Counts and the document that keeps the line are exact, and partial sums come
   before the shuffle, so a line of a third of all documents costs one row per task.
3. Documents without a suspect pass straight through; the others meet their list of lines to drop.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bloom import repeated_hashes, size_for
from keyloom.llm.common import bounded_batches, row_key, texts, written


def line_key(line: bytes) -> bytes:
    """The line without ASCII white space at its ends, A-Z lower-cased."""
    return line.strip(b" \t\n\v\f\r").lower()


def _long(key: bytes, least: int) -> bool:
    return len(key) >= least and (key.isascii() or len(key.decode("utf-8", errors="replace")) >= least)


def _keys(text: bytes, least: int) -> set[bytes]:
    return {k for line in text.split(b"\n") if len(line) >= least and _long(k := line_key(line), least)}


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5, bits: int | None = None) -> DataFrame:
    """(id, text, n_lines, n_dropped): texts without their widely repeated lines.

    A line whose key has at least ``min_chars`` code points and is in at least ``min_docs`` documents stays only in the
    document with the largest id among those that hold it (in all its places there). Each row is a document: repeated
    rows count, and rows with the largest id all keep the line. A null id is never the largest; if all are null, the line
    stays. A null or empty text is one empty line and comes back empty. Only the columns named are read. An empty table
    gives no rows.
    """
    if min_docs < 2:
        raise ValueError("a line of one document is not repeated")
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = size_for(size // 300)

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(k) for t in texts(batch.column(1)) for k in _keys(t, min_chars)], dtype=np.uint64)

    has = repeated_hashes(rows, hashes, bits)

    def suspects_of(values: list[bytes]) -> list[list[bytes]]:
        keys = [list(_keys(t, min_chars)) for t in values]
        flat = [k for ks in keys for k in ks]
        found = iter(has(np.array([xxhash.xxh64_intdigest(k) for k in flat], dtype=np.uint64)).tolist() if flat else [])
        return [[k for k in ks if next(found)] for ks in keys]

    kind = docs.schema[id_col].dataType.simpleString()

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = texts(batch.column(1))
            free = [i for i, s in enumerate(suspects_of(values)) if not s]
            if free:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(free)), pa.array([values[i] for i in free], pa.binary()), pa.array([values[i].count(b"\n") + 1 for i in free]), pa.array([0] * len(free), pa.int64())], ["id", "text", "n_lines", "n_dropped"])

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(i, s) for i, s in enumerate(suspects_of(texts(batch.column(1)))) if s]
            if got:
                at = pa.array([i for i, _ in got])
                yield pa.RecordBatch.from_arrays([*[c.take(at) for c in batch.columns], pa.array([s for _, s in got], pa.list_(pa.binary()))], ["id", "text", "_k1", "_k2", "keys"])

    # The suspected documents, with their keys; two readers need them alike.
    held = written(rows.select("id", "text", *row_key(F.col("id"), F.col("text"))).mapInArrow(suspected, f"id {kind}, text binary, _k1 long, _k2 long, keys array<binary>"), "line-dedup")
    lines = held.select("id", "_k1", "_k2", F.explode("keys").alias("key"))
    # A table of its own, not an aggregate above the join's exchange: so adaptive execution may split the partition of a line
    # that very many documents hold. It is merged at any size, as repeated lines grow with the corpus.
    counted = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where((F.col("n") >= min_docs) & F.col("keeper").isNotNull())
    repeated = written(counted.select("key", "keeper"), "line-dedup-repeated")
    drops = lines.join(repeated.hint("merge"), "key").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy("_k1", "_k2").agg(F.collect_set("key").alias("drop"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n, dropped = [], [], []
            for text, drop in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                lines = text.split(b"\n")
                gone = frozenset(drop or ())
                kept = [x for x in lines if line_key(x) not in gone] if gone else lines
                out.append(b"\n".join(kept))
                n.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())], ["id", "text", "n_lines", "n_dropped"])

    shape = f"id {kind}, text binary, n_lines long, n_dropped long"
    mended = held.select("id", "text", "_k1", "_k2").join(drops, ["_k1", "_k2"], "left").select("id", "text", "drop").mapInArrow(apply, shape)
    both = rows.mapInArrow(clean, shape).unionByName(mended)
    return both.select(F.col("id").alias(id_col), F.col("text").cast("string").alias(text_col), "n_lines", "n_dropped")
