"""Repeated passages by relative Lempel-Ziv parsing over windows of words.

The letters of the parse are the windows themselves: a document is the sequence of its runs of ``window`` words, each
overlapping the next. A document is factored greedily, each factor the longest run of letters that an indexed reference block has
anywhere else, so a factor of one letter is just long enough to count, and a factor of n letters covers n + window - 1
words. Two factors that follow each other share the words of the letters between them: every window that straddles a factor's
end is a letter and is looked up like the others, so that no repeated window is hidden by where a factor ends.

1. Letters are 128-bit fingerprints, made of two independent hashes of every word.
2. Reference blocks are dealt out by content. Each letter has an anchor, the least hash of its 16-word runs, and the block of
   an anchor indexes all letters that have it, so that a document need be factored against no other block. Anchors feed a
   pair of Bloom filters; a run whose anchor is not repeated is a literal and goes no further.
3. Letters of an anchor that very many rows share (a boilerplate shorter than a window, among others) are dealt by their own
   fingerprints instead, so that no anchor is one task's.
4. A task settles what it holds twice itself and sends one witness for it, so that a passage of a third of all documents
   costs one row per task.
5. A block is indexed by a suffix array of its letters, and all its phrases are factored at once. Blocks stream (Spark's sort
   spills, a block does not grow) and return factors by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.bloom import repeated_hashes, size_for
from keyloom.llm.common import bounded_batches, mix, rolling, row_key, texts, word_bounds, word_hashes

_ANCHOR = 16
_WORDS_HELD = 1 << 20
_BLOCK = 1 << 20


def _sliding(x: np.ndarray, k: int, op) -> np.ndarray:
    """op (minimum or maximum) over each run of k values, by doubling."""
    n = len(x) - k + 1
    if n <= 0:
        return x[:0]
    span, part = 1, x
    while span * 2 <= k:
        part = op(part[: len(part) - span], part[span:])
        span *= 2
    return op(part[:n], part[k - span : k - span + n])


class _Words:
    """The words of some documents in one row, and which runs of them lie in one document."""

    def __init__(self, values: list[bytes]):
        buf = np.frombuffer(b"\n".join(values), dtype=np.uint8)
        starts, ends = word_bounds(buf)
        self.buf, self.starts, self.ends = buf, starts, ends
        self.hashes = word_hashes(buf, starts, ends)
        sizes = np.array([len(v) + 1 for v in values], dtype=np.int64)
        self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        self.doc = np.searchsorted(np.cumsum(sizes), starts, side="right")

    def whole(self, k: int) -> np.ndarray:
        """For each run of k words, whether it is one document's."""
        return self.doc[: max(0, len(self.doc) - k + 1)] == self.doc[k - 1 :]


def _anchors(w: _Words, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of the anchor runs, the least one in each window, and which windows are whole."""
    runs = rolling(w.hashes, anchor)
    return runs, _sliding(runs, window - anchor + 1, np.minimum), w.whole(window)


def longest_elsewhere(letter: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place of phrases of ``n`` letters, one after another: how many letters from there on are found at some other
    place too, as far as phrases go. By a suffix array of the phrases, made by doubling, and common prefixes of neighbours in it."""
    total = len(letter)
    left = np.repeat(np.cumsum(n), n) - np.arange(total)  # letters to the phrase's end
    ranks, span, most = [letter + 1], 1, int(n.max())
    while span < most:
        last = ranks[-1]
        after = np.zeros(total, dtype=np.int64)
        inside = np.flatnonzero(left > span)
        after[inside] = last[inside + span]
        pair = last * (total + 2) + after
        order = np.argsort(pair, kind="stable")
        rank = np.empty(total, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], pair[order][1:] != pair[order][:-1]]))
        ranks.append(rank)
        span *= 2
    order = np.argsort(ranks[-1], kind="stable")
    a, b = order[:-1], order[1:]
    common = np.zeros(max(0, total - 1), dtype=np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        step = 1 << k
        fits = np.flatnonzero((left[a] - common >= step) & (left[b] - common >= step))
        same = fits[ranks[k][a[fits] + common[fits]] == ranks[k][b[fits] + common[fits]]]
        common[same] += step
    out = np.zeros(total, dtype=np.int64)
    out[a] = common
    out[b] = np.maximum(out[b], common)
    return out


def factors(longest: np.ndarray, n: np.ndarray, parsed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(phrase, place in it, letters) of the factors of a greedy parse from the left; places without a match are literals."""
    first = np.cumsum(n) - n
    row = np.flatnonzero(parsed & (n > 0))
    place = np.zeros(len(row), dtype=np.int64)
    found = []
    while len(row):
        length = longest[first[row] + place]
        hit = length > 0
        found.append((row[hit], place[hit], length[hit]))
        place = place + np.maximum(length, 1)
        on = place < n[row]
        row, place = row[on], place[on]
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (row, place, place)


def remove_repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, bits: int | None = None, layout: bool = False) -> DataFrame:
    """(id, text, n_words, n_removed): the words that are in no repeated passage, joined by one space. With ``layout`` a text
    that loses no word stays as it is, white space included.

    Words are runs of bytes other than ASCII white space, unchanged. Each word covered by a window of ``window`` words of
    one row whose words also start anywhere else, the same row included, goes; windows are judged on the input. Rows are
    documents, so repeated rows of enough words lose all of them. A null or empty text has no words and comes back
    empty; short texts keep all words. Null ids are ids like others. Only the columns named are read. An empty table
    gives no rows.
    """
    bounded_batches(docs.sparkSession)
    anchor = min(_ANCHOR, max(1, window // 2))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    if bits is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = size_for(size // 6 * 2 // (window - anchor + 2))

    def hashes(batch: pa.RecordBatch) -> np.ndarray:
        runs, least, whole = _anchors(_Words(texts(batch.column(1))), window, anchor)
        if not whole.any():
            return np.empty(0, dtype=np.uint64)
        # A run is some window's anchor if it equals the largest of the least values of the windows over it.
        span = window - anchor + 1
        some = np.where(whole, least, np.uint64(0))
        around = _sliding(np.concatenate([np.zeros(span - 1, dtype=np.uint64), some, np.zeros(span - 1, dtype=np.uint64)]), span, np.maximum)
        return runs[(around == runs) & (runs > 0)]

    has, crowded = repeated_hashes(rows, hashes, bits, crowd=True)

    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            values = [t for t, _, _ in held]
            w = _Words(values)
            _, least, whole = _anchors(w, window, anchor)
            at = np.flatnonzero(whole)
            at = at[has(least[at])]
            if not len(at):
                return
            one, two = rolling(w.hashes, window)[at], rolling(word_hashes(w.buf, w.starts, w.ends, seed=1), window, seed=1)[at]
            v, doc = least[at], w.doc[at]
            v = np.where(crowded(v), mix(one), v)
            order = np.lexsort((two, one))
            same = (one[order][1:] == one[order][:-1]) & (two[order][1:] == two[order][:-1])
            first = np.concatenate([[True], ~same])
            group = np.cumsum(first) - 1
            local = np.empty(len(at), dtype=bool)
            local[order] = np.bincount(group)[group] > 1
            witness = np.zeros(len(at), dtype=bool)
            witness[order[first]] = True
            place = at - w.first[doc]
            k1, k2 = np.array([k for _, k, _ in held], dtype=np.int64), np.array([k for _, _, k in held], dtype=np.int64)

            def batch_of(pick: np.ndarray, kind: int) -> pa.RecordBatch | None:
                if not len(pick):
                    return None
                new = np.concatenate([[True], (np.diff(at[pick]) != 1) | (v[pick][1:] != v[pick][:-1] if kind < 2 else False) | (np.diff(doc[pick]) != 0)])
                heads = np.flatnonzero(new)
                cuts = np.concatenate([heads, [len(pick)]])
                prints = np.empty((len(pick) if kind < 2 else 0, 2), dtype=np.uint64)
                if kind < 2:
                    prints[:, 0], prints[:, 1] = one[pick], two[pick]
                raw = prints.tobytes()
                offsets = (cuts * 16 if kind < 2 else cuts * 0).astype(np.int32)
                d = doc[pick][heads]
                route = v[pick][heads].view(np.int64) if kind < 2 else mix(k1[d].view(np.uint64)).view(np.int64)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(heads), kind, dtype=np.int32)), pa.array(route), pa.array(k1[d]), pa.array(k2[d]), pa.array(place[pick][heads].astype(np.int32)), pa.array(np.diff(cuts).astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])],
                    ["kind", "route", "k1", "k2", "start", "n", "prints"],
                )

            for pick, kind in ((np.flatnonzero(~local), 0), (np.flatnonzero(local & witness), 1), (np.flatnonzero(local), 2)):
                out = batch_of(pick, kind)
                if out is not None:
                    yield out

        for batch in batches:
            for item in zip(texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held.append(item)
                size += len(item[0])
                if size > _WORDS_HELD * 6:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by route; those of kind 2 are settled, the others are settled route by route."""
        held: list[tuple] = []
        size, last = 0, None

        def settle(part: list[tuple]) -> pa.RecordBatch | None:
            out = [(k1, k2, np.array([[start, start + n + window - 1]], dtype=np.int32).tobytes()) for kind, _, k1, k2, start, n, _ in part if kind == 2]
            open_ = [r for r in part if r[0] < 2]
            if open_:
                prints = np.frombuffer(b"".join(r[6] for r in open_), dtype=np.uint64).reshape(-1, 2)
                n = np.array([r[5] for r in open_])
                order = np.lexsort((prints[:, 1], prints[:, 0]))
                p = prints[order]
                letter = np.empty(len(p), dtype=np.int64)
                letter[order] = np.concatenate([[0], np.cumsum((p[1:] != p[:-1]).any(axis=1))])
                # A witness stands for letters that its task has more than once: it is text of the block, but is not factored.
                longest = longest_elsewhere(letter, n)
                row, place, length = factors(longest, n, np.array([r[0] == 0 for r in open_]))
                begin = np.array([r[4] for r in open_])[row] + place
                bounds = np.stack([begin, begin + length + window - 1], axis=1).astype(np.int32)
                out += [(open_[r][2], open_[r][3], b.tobytes()) for r, b in zip(row.tolist(), bounds, strict=True)]
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["_k1", "_k2", "span"])

        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size > _BLOCK and r[1] != last:
                    out = settle(held)
                    if out is not None:
                        yield out
                    held, size = [], 0
                held.append(r)
                size += r[5] + 4
                last = r[1]
        out = settle(held) if held else None
        if out is not None:
            yield out

    keyed = rows.select("text", *row_key(F.col("id"), F.col("text")))
    sent = keyed.mapInArrow(phrases, "kind int, route long, k1 long, k2 long, start int, n int, prints binary")
    found = sent.repartition("route").sortWithinPartitions("route").mapInArrow(block, "_k1 long, _k2 long, span binary")
    by_doc = found.groupBy("_k1", "_k2").agg(F.collect_list("span").alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, n, removed = [], [], []
            for text, got in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                n.append(len(words))
                if got:
                    change = np.zeros(len(words) + 1, dtype=np.int64)
                    s = np.frombuffer(b"".join(got), dtype=np.int32).reshape(-1, 2)
                    np.add.at(change, s[:, 0], 1)
                    np.add.at(change, s[:, 1], -1)
                    words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                out.append(text if layout and not got else b" ".join(words))
                removed.append(n[-1] - len(words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["id", "text", "n_words", "n_removed"])

    kind = docs.schema[id_col].dataType.simpleString()
    # Building on the side of the spans leaves the texts unsorted.
    joined = rows.select("id", "text", *row_key(F.col("id"), F.col("text"))).join(by_doc.hint("shuffle_hash"), ["_k1", "_k2"], "left")
    out = joined.select("id", "text", "spans").mapInArrow(cut, f"id {kind}, text binary, n_words long, n_removed long")
    return out.select(F.col("id").alias(id_col), F.col("text").cast("string").alias(text_col), "n_words", "n_removed")
