"""Exact duplicates by radix tries: each owner of lengths and content hashes inserts whole byte strings into a Patricia trie.

1. Every task inserts its own texts into a trie and keeps one row for each distinct text, so that a text with very many
   copies travels once per task and not once per copy.
2. Those rows go to the owner of their (length, hash), which inserts the whole texts. They arrive sorted by the first bytes
   of the text, then by length and hash, so the trie grows subtree by subtree: what lies under the first bytes, length and
   hash that went before is complete when the next begins, and complete subtrees leave memory, as verdicts, when the trie is
   over its limit. Spark's sort, which spills, is what holds the rest.
3. Terminal nodes hold the best row, and which local texts ended there.

Hashes only decide the owner; texts are equal when their bytes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyloom.llm.common import bounded_batches, texts, written

_LOCAL_BYTES = 48 << 20
_OWNER_BYTES = 32 << 20
_HEAD = 16  # bytes of a text that rows are sorted by first


class _Node:
    __slots__ = ("edges", "value")

    def __init__(self):
        self.edges: dict[int, tuple[bytes, _Node]] = {}
        self.value = None


def _shared(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of a and b[at:]."""
    low, high = 0, min(len(a), len(b) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Patricia:
    """A compressed radix trie of byte strings. ``bytes`` counts the labels, each byte once per branch."""

    def __init__(self):
        self.root, self.bytes, self.terminals = _Node(), 0, []

    def node(self, key: bytes) -> _Node:
        """The node where ``key`` ends, made if need be."""
        node, at, n = self.root, 0, len(key)
        while at < n:
            edge = node.edges.get(key[at])
            if edge is None:
                leaf = _Node()
                node.edges[key[at]] = (key[at:], leaf)
                self.bytes += n - at + 200
                return leaf
            label, child = edge
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            k = _shared(label, key, at)
            middle = _Node()
            middle.edges[label[k]] = (label[k:], child)
            node.edges[key[at]] = (label[:k], middle)
            self.bytes += 200
            node, at = middle, at + k
        return node


def _better(a, b, largest: bool) -> bool:
    """Whether id a goes before id b; null goes last, and of equal ids the one seen first stays."""
    if a is None or b is None:
        return a is not None
    return a > b if largest else a < b


def _local(docs: DataFrame, id_col: str, text_col: str, largest: bool, members: bool) -> DataFrame:
    """Rows of two kinds: 0, each document with the number of its local text; 1, each local text with its best row."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    others = [c for c in docs.columns if c != text_col]
    row = F.struct(*[F.col(f"`{c}`") for c in others])
    carried = docs.select(row.alias("r")).schema["r"].dataType
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("id", kind), T.StructField("local", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("n", T.LongType()), T.StructField("head", T.BinaryType()), T.StructField("len", T.LongType()), T.StructField("h", T.LongType()), T.StructField("sha", T.StringType()), T.StructField("text", T.BinaryType()), T.StructField("was_null", T.BooleanType()), T.StructField("row", carried)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def summaries(trie: Patricia) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for node in trie.terminals:
            local, n, best, seq, text, was_null, rest = node.value
            norm = text.lower()
            out.append((1, best, local, seq, n, norm[:_HEAD], len(norm), xxhash.xxh64_intdigest(norm) - (1 << 63), None, text, was_null, rest))
            size += len(text)
            if size > 8 << 20 or len(out) >= 2048:
                yield emit(out)
                out, size = [], 0
        if out:
            yield emit(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, local, seq = Patricia(), TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            ids, raw, rest = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            out = []
            for i, (doc, given) in enumerate(zip(ids, raw, strict=True)):
                text = given or b""
                norm = text.lower()
                node = trie.node(norm)
                if node.value is None:
                    node.value = [local, 1, doc, seq, text, given is None, rest[i].as_py()]
                    trie.terminals.append(node)
                    trie.bytes += 2 * len(text)
                    local += 1
                else:
                    value = node.value
                    value[1] += 1
                    if _better(doc, value[2], largest):
                        value[2:] = [doc, seq, text, given is None, rest[i].as_py()]
                if members:
                    out.append((0, doc, node.value[0], seq, 1, None, len(norm), 0, hashlib.sha256(norm).hexdigest(), None, None, None))
                seq += 1
            if out:
                yield emit(out)
            if trie.bytes > _LOCAL_BYTES:
                yield from summaries(trie)
                trie = Patricia()
        yield from summaries(trie)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), row.alias("row")).mapInArrow(run, schema)


def _owned(local: DataFrame, largest: bool) -> DataFrame:
    """The owners' verdicts: for each local text, which of them stays, its id and the group's size; the winner has its row."""
    schema = T.StructType([T.StructField("local", T.LongType()), T.StructField("keep_local", T.LongType()), T.StructField("keep_seq", T.LongType()), local.schema["id"], T.StructField("group_size", T.LongType()), T.StructField("text", T.BinaryType()), T.StructField("was_null", T.BooleanType()), local.schema["row"]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def flush(trie: Patricia) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for node in trie.terminals:
            total, best, locals_ = node.value
            doc, keep, seq, text, was_null, rest = best
            for x in locals_:
                won = x == keep
                out.append((x, keep, seq, doc, total, text if won else None, was_null if won else None, rest if won else None))
                size += len(text) if won else 0
                if size > 8 << 20 or len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, subtree = Patricia(), None
        for batch in batches:
            for head, length, h, doc, loc, seq, n, text, was_null, rest in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (head, length, h) != subtree:
                    subtree = (head, length, h)
                    if trie.bytes > _OWNER_BYTES:
                        yield from flush(trie)
                        trie = Patricia()
                node = trie.node(text.lower())
                best = (doc, loc, seq, text, was_null, rest)
                if node.value is None:
                    node.value = [n, best, [loc]]
                    trie.terminals.append(node)
                    trie.bytes += 2 * len(text)
                else:
                    value = node.value
                    value[0] += n
                    value[2].append(loc)
                    if _better(doc, value[1][0], largest) or doc == value[1][0] and loc < value[1][1]:
                        value[1] = best
        yield from flush(trie)

    return local.where("kind = 1").select("head", "len", "h", "id", "local", "seq", "n", "text", "was_null", "row").repartition("len", "h").sortWithinPartitions("head", "len", "h").mapInArrow(run, schema)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the smallest
    (or ``keep="largest"``) id stays; a null id stays only in a group without others, and of rows with equal ids exactly
    one stays. Other columns have no effect. An empty table gives no rows.
    """
    largest = keep == "largest"
    local = written(_local(docs.select(F.col(id_col), F.col(text_col)), id_col, text_col, largest, True), "exact-dedup", ["kind"])
    verdict = _owned(local, largest).select("local", "keep_local", "keep_seq", F.col("id").alias("keep_id"), "group_size")
    return (
        local.where("kind = 0")
        .select("id", "local", "seq", "sha")
        .join(verdict, "local")
        .select(F.col("id").alias(id_col), "keep_id", "group_size", ((F.col("local") == F.col("keep_local")) & (F.col("seq") == F.col("keep_seq"))).alias("kept"), F.col("sha").alias("text_sha256"))
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they were; the rules are those of
    ``duplicate_groups``. One shuffle, of one row per task and distinct text."""
    largest = keep == "largest"
    won = _owned(_local(docs, id_col, text_col, largest, False), largest).where("local = keep_local")
    text = F.when(~F.col("was_null"), F.col("text").cast("string")).alias(text_col)
    return won.select(*[text if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
