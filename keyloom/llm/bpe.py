"""BPE by speculation: greedy longest matches are proposed, pairs of neighbours are verified, and only words that fail are merged.

Every token of a byte-pair vocabulary is made by one merge, and a merge comes later than those that made its parts. So a
sequence of tokens is the encoding of its bytes exactly if no boundary between neighbours is crossed by a merge: no token
``a`` that ends at the boundary while the left side is built, and no ``b`` that starts there on the right side, have a
merge that comes before ``a`` and ``b`` are used up inside their own sides. These two "spines" of a token are tables, so
all the pairs of a batch are tested together.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, texts, word_hashes

# White space, and the pattern that cuts a text into words, as the byte-level pre-tokenizer has them.
_S = "\t\n\v\f\r \x85\xa0  -     　"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
#: A unit is a run without white space, with the one space before it. No word crosses a unit's end.
_UNITS = re.compile(f"[{_S}]+(?![^{_S}])| ?[^{_S}]+|[{_S}]+")
_PUNCTUATION = ".,;:!?|&%$*#)"
_SPACES = [c for c in map(chr, range(0x3001)) if re.fullmatch(f"[{_S}]", c)]
#: White space beyond ASCII: a text that has some is cut by the pattern, others byte by byte.
_WIDE = "|".join(c for c in _SPACES if ord(c) > 127).encode()
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[ord(c) for c in _SPACES if ord(c) < 128]] = True
_CACHE = 1_000_000
_LANE = 48  # bytes of words that are matched, and merged, side by side; longer ones are taken one by one
_NEVER = np.int64(1) << 40


def _byte_chars() -> dict[str, int]:
    """The printable stand-ins of bytes in the vocabulary file: Latin-1's visible characters for themselves, then 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


def _same(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray) -> bool:
    """Whether each run of bytes is the same as that numbered ``other``, eight bytes at a time."""
    n = ends - starts
    if not (n == n[other]).all():
        return False
    pad = np.zeros(len(buf) + 8, dtype=np.uint8)
    pad[: len(buf)] = buf
    view = np.lib.stride_tricks.as_strided(pad, shape=(len(buf) + 1, 8), strides=(1, 1))
    apart = np.flatnonzero(other != np.arange(len(other)))
    a, b, left = starts[apart], starts[other[apart]], n[apart]
    while len(a):
        x = np.ascontiguousarray(view[a]).view("<u8").ravel() ^ np.ascontiguousarray(view[b]).view("<u8").ravel()
        x <<= ((8 - np.minimum(left, 8)) * 8).astype(np.uint64)
        if x.any():
            return False
        more = left > 8
        a, b, left = a[more] + 8, b[more] + 8, left[more] - 8
    return True


class IntMap:
    """A fixed map from non-negative longs to longs, looked up for whole arrays; what is missing gives -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(8, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.full(1 << self.bits, -1, dtype=np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            take, at = left[free], slot[free]
            at, first = np.unique(at, return_index=True)
            self.keys[at], self.values[at] = keys[take[first]], values[take[first]]
            lost = self.keys[slot] != keys[left]
            left, slot = left[lost], (slot[lost] + 1) & (1 << self.bits) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        rows = np.flatnonzero((found != keys) & (found >= 0))
        while len(rows):
            at = (slot[rows] + 1) & (1 << self.bits) - 1
            slot[rows], found = at, self.keys[at]
            hit = found == keys[rows]
            out[rows[hit]] = self.values[at[hit]]
            rows = rows[~hit & (found >= 0)]
        return out


class Bpe:
    """An encoder and decoder over a ``tokenizers`` JSON file of a byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        raw = lambda token: bytes(chars[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.odd = re.compile(b"|".join([_WIDE, *(re.escape(t.encode()) for t in self.special)]))
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = raw(token)
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        self.of = {raw(token): i for token, i in vocab.items()}
        self.single = [self.of[bytes([b])] for b in range(256)]
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])]
        self.merge = {(a, b): (rank, made) for rank, (a, b, made) in reversed([*enumerate(pairs)])}
        self.words = regex.compile(_WORDS)
        self._spines(pairs, size)
        self.proposed = {b: i for b, i in self.of.items() if self.exact(b) == [i]}
        self._single = np.array(self.single, dtype=np.int64)
        self._trie()
        self.cache: dict[bytes, bytes] = {}

    def _spines(self, pairs: list[tuple[int, int, int]], size: int) -> None:
        parts = {made: (a, b, rank) for rank, (a, b, made) in reversed([*enumerate(pairs)])}

        def spine(token: int, side: int) -> list[tuple[int, int]]:
            out, used = [(token, int(_NEVER))], 0
            while token in parts:
                used = parts[token][2]
                token = parts[token][side]
                out.append((token, used))
            return out

        def padded(side: int) -> tuple[np.ndarray, np.ndarray]:
            all_ = [spine(t, side) for t in range(size)]
            depth = max(map(len, all_))
            token, used = np.full((size, depth), -1, dtype=np.int64), np.full((size, depth), -1, dtype=np.int64)
            for t, s in enumerate(all_):
                token[t, : len(s)], used[t, : len(s)] = [x[0] for x in s], [x[1] for x in s]
            return token, used

        self.left, self.right = padded(1), padded(0)
        self.pairs = IntMap(np.array([a << 32 | b for a, b in self.merge], dtype=np.int64), np.array([r for r, _ in self.merge.values()], dtype=np.int64))
        self.made = np.array([made for _, _, made in pairs], dtype=np.int64)

    def compatible(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours stands: no merge crosses the boundary between them."""
        (lt, lu), (rt, ru) = self.left, self.right
        good = np.ones(len(first), dtype=bool)
        for i in range(lt.shape[1]):
            rows = np.flatnonzero(good & (lt[first, i] >= 0))
            if not len(rows):
                break
            for j in range(rt.shape[1]):
                b = rt[second[rows], j]
                rows, b = rows[b >= 0], b[b >= 0]
                if not len(rows):
                    break
                key = lt[first[rows], i] << 32 | b
                rank = self.pairs.get(key)
                crossed = (rank >= 0) & (rank < lu[first[rows], i]) & (rank <= ru[second[rows], j])
                good[rows[crossed]] = False
        return good

    def exact(self, word: bytes) -> list[int]:
        """The merges of one word in order of rank, from the left among equals."""
        ids = [self.single[b] for b in word]
        merge = self.merge
        if len(ids) > _LANE:
            return self._exact_long(ids)
        while len(ids) > 1:
            best, at, made = 1 << 40, -1, -1
            for i, pair in enumerate(zip(ids, ids[1:], strict=False)):
                m = merge.get(pair)
                if m is not None and m[0] < best:
                    best, at, made = m[0], i, m[1]
            if at < 0:
                break
            ids[at : at + 2] = [made]
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and a linked list, for words without white space of any length."""
        n, merge = len(ids), self.merge
        after, before, live = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merge.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if not live[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], live[j], after[i] = made, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := merge.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [t for t, k in zip(ids, live, strict=True) if k]

    def _exact_many(self, words: np.ndarray) -> list[np.ndarray]:
        """The same for words of one length at once (a matrix of bytes): each step merges the first best pair of every row."""
        ids = self._single[words]
        out: list[np.ndarray] = [ids[0]] * len(ids)
        row = np.arange(len(ids))
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        while len(row):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(row), dtype=np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), _NEVER)
            ended = best == _NEVER
            for r, x in zip(row[ended].tolist(), ids[ended], strict=True):
                out[r] = x
            go = ~ended
            row, ids, rank, at, best = row[go], ids[go], rank[go], at[go], best[go]
            if not len(row):
                break
            here, width = np.arange(len(row)), ids.shape[1]
            ids[here, at] = self.made[best]
            keep = np.ones(ids.shape, dtype=bool)
            keep[here, at + 1] = False
            ids = ids[keep].reshape(-1, width - 1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[here, at] = False
            rank = rank[keep].reshape(-1, width - 2)
            for shift in (-1, 0):
                i = at + shift
                ok = (i >= 0) & (i < width - 2)
                rank[here[ok], i[ok]] = self._ranks(ids[here[ok], i[ok]], ids[here[ok], i[ok] + 1])
        return out

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.pairs.get((a << 32 | b).ravel()).reshape(a.shape)
        return np.where(got < 0, _NEVER, got)

    def _trie(self) -> None:
        """The vocabulary as a trie whose edges are a map from (node, byte) to node."""
        edges: dict[int, int] = {}
        terminal = [-1]
        for token, i in self.proposed.items():
            node = 0
            for b in token:
                to = edges.get(node << 8 | b)
                if to is None:
                    to = edges[node << 8 | b] = len(terminal)
                    terminal.append(-1)
                node = to
            terminal[node] = i
        self.steps, self.ends = edges, terminal
        self.edges = IntMap(np.array([*edges], dtype=np.int64), np.array([*edges.values()], dtype=np.int64))
        self.terminal = np.array(terminal, dtype=np.int64)

    def _greedy_one(self, word: bytes) -> list[int]:
        """The same longest matches for one word: for long ones, that would keep a lane alone."""
        out, step, ends = [], self.steps.get, self.ends
        at, n = 0, len(word)
        while at < n:
            node, i, token, until = 0, at, -1, at
            while i < n and (to := step(node << 8 | word[i])) is not None:
                node, i = to, i + 1
                if ends[node] >= 0:
                    token, until = ends[node], i
            out.append(token)
            at = until
        return out

    def _greedy(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest matches from the left in all the words at once: the tokens, word by word, and each word's number."""
        lane, at, end = np.arange(len(starts)), starts.copy(), ends
        node, token, until = np.zeros(len(lane), dtype=np.int64), np.full(len(lane), -1), at.copy()
        lanes, tokens = [], []
        while len(lane):
            inside = at < end
            to = np.where(inside, self.edges.get(node << 8 | buf[np.minimum(at, end - 1)]), -1)
            stuck = to < 0
            node = np.where(stuck, 0, to)
            at = np.where(stuck, until, at + 1)
            if stuck.any():
                lanes.append(lane[stuck])
                tokens.append(token[stuck])
            term = np.where(stuck, -1, self.terminal[node])
            good = term >= 0
            token, until = np.where(good, term, token), np.where(good, at, until)
            live = ~(stuck & (at >= end))
            if not live.all():
                lane, at, end, node, token, until = lane[live], at[live], end[live], node[live], token[live], until[live]
        order = np.concatenate(lanes) if lanes else np.empty(0, dtype=np.int64)
        by = np.argsort(order, kind="stable")
        return (np.concatenate(tokens) if tokens else order)[by], order[by]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Speculate on all the words, verify all their boundaries at once, merge those that fail."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes)
        starts = ends - sizes
        buf = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
        lanes, alone = np.flatnonzero(sizes <= _LANE), np.flatnonzero(sizes > _LANE).tolist()
        flat, word = self._greedy(buf, starts[lanes], ends[lanes])
        word = lanes[word]
        if alone:
            more = [self._greedy_one(words[i]) for i in alone]
            flat = np.concatenate([flat, *[np.array(m, dtype=np.int64) for m in more]])
            word = np.concatenate([word, np.repeat(alone, [len(m) for m in more])])
            order = np.argsort(word, kind="stable")
            flat, word = flat[order], word[order]
        inner = np.flatnonzero(word[1:] == word[:-1])
        pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
        failing = np.unique(word[inner[~self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]])
        raw, cuts = flat.astype("<u4").tobytes(), (np.searchsorted(word, np.arange(len(words) + 1)) * 4).tolist()
        out = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        for n in np.unique(sizes[failing]).tolist():
            same = failing[sizes[failing] == n]
            if n > _LANE:
                found = (np.array(self._exact_long([self.single[b] for b in words[i]])) for i in same.tolist())
            else:
                found = self._exact_many(buf[starts[same][:, None] + np.arange(n)])
            for i, ids in zip(same.tolist(), found, strict=True):
                out[i] = ids.astype("<u4").tobytes()
        return out

    def _learn(self, units: list[bytes]) -> None:
        plain, parts, distinct = [], [], set()
        find = self.words.findall
        for raw in units:
            u = raw.decode("utf-8", errors="replace")
            # Letters with plain punctuation after them, the most common unit, need no pattern.
            if u.isalpha() or u[:1] == " " and u[1:].isalpha():
                plain.append(raw)
                continue
            core = u.rstrip(_PUNCTUATION)
            if core.isalpha() or core[:1] == " " and core[1:].isalpha():
                ws = (core.encode(), u[len(core) :].encode())
            else:
                ws = [w.encode() for w in find(u)]
            parts.append((raw, ws))
            distinct.update(ws)
        ids = self.cache
        words = [w for w in distinct.difference(plain) if w not in ids]
        made = self.encode_words(plain + words)
        ids.update(zip(plain, made, strict=False))
        own = dict(zip(words, made[len(plain) :], strict=True))
        ids.update((u, b"".join([own[w] if w in own else ids[w] for w in ws])) for u, ws in parts)

    def _known(self, units: list[bytes]) -> list[bytes]:
        """The ids of distinct units, from the cache or learned."""
        new = [u for u in units if u not in self.cache]
        if len(self.cache) + len(new) > _CACHE:
            self.cache = {u: self.cache[u] for u in units if u in self.cache}
        if new:
            self._learn(new)
        return list(map(self.cache.__getitem__, units))

    def encode_batch(self, batch: Iterable[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit values. Strings of special tokens become their ids."""
        return self.encode_bytes([t.encode("utf-8", errors="replace") for t in batch])

    def encode_bytes(self, values: list[bytes]) -> list[bytes]:
        """The same of texts in UTF-8. Texts without special tokens and white space beyond ASCII are cut, and their equal units
        told, in arrays; the others text by text."""
        out = [b""] * len(values)
        odd = self.odd.search
        usual = [i for i, v in enumerate(values) if not odd(v)]
        done = set(usual) if usual and self._encode_arrays(values, usual, out) else set()
        rest = [i for i in range(len(values)) if i not in done]
        for i, ids in zip(rest, self._encode_each([values[i].decode("utf-8", errors="replace") for i in rest]), strict=True):
            out[i] = ids
        return out

    def _encode_arrays(self, values: list[bytes], usual: list[int], out: list[bytes]) -> bool:
        """Fill ``out``; False, with nothing done, if two different units have one hash."""
        some = [values[i] for i in usual]
        raw = b"\n".join(some) + b"\n"
        buf = np.frombuffer(raw, dtype=np.uint8)
        ends_of = np.cumsum([len(v) + 1 for v in some]) - 1  # the line ends between texts
        kind = _BLANK[buf].astype(np.int8)
        kind[ends_of] = 2
        change = np.flatnonzero(np.diff(kind)) + 1
        first = np.concatenate([[0], change])
        last = np.concatenate([change, [len(buf)]])
        of = kind[first]
        # Units begin where a run does, but a word takes the one space before it, and of a longer run before a word the last
        # character stands apart.
        begins = np.zeros(len(buf), dtype=bool)
        begins[first] = True
        begins[ends_of] = True
        begins[ends_of[:-1] + 1] = True
        blank = np.flatnonzero((of[:-1] == 1) & (of[1:] == 0)) if len(of) > 1 else np.empty(0, dtype=np.int64)
        tail = last[blank] - 1
        begins[tail] = True
        begins[tail[buf[tail] == 32] + 1] = False
        starts = np.flatnonzero(begins)
        ends = np.concatenate([starts[1:], [len(buf)]])
        keep = kind[starts] != 2
        starts, ends = starts[keep], ends[keep]
        if len(starts):
            hashes = word_hashes(buf, starts, ends)
            order = np.argsort(hashes)
            new = np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]])
            number = np.empty(len(order), dtype=np.int64)
            number[order] = np.cumsum(new) - 1
            one = order[new]
            if not _same(buf, starts, ends, one[number]):
                return False
            units = [raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
            known = self._known(units)
            flat = np.frombuffer(b"".join(known), dtype="<u4")
            size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) >> 2
            begin = np.cumsum(size) - size
            each = size[number]
            upto = np.cumsum(each)
            ids = flat[np.repeat(begin[number] - (upto - each), each) + np.arange(int(upto[-1]))].astype("<u4").tobytes()
            upto = np.concatenate([[0], upto])
        else:
            ids, upto = b"", np.zeros(1, dtype=np.int64)
        cuts = (upto[np.searchsorted(starts, np.concatenate([[0], ends_of]))] * 4).tolist()
        for i, a, b in zip(usual, cuts, cuts[1:], strict=False):
            out[i] = ids[a:b]
        return True

    def _encode_each(self, batch: list[str]) -> list[bytes]:
        if not batch:
            return []
        cut, find = self.cut, _UNITS.findall
        parts = [[p if i % 2 else find(p) for i, p in enumerate(cut.split(t))] if cut else [find(t)] for t in batch]
        units = list({u for ps in parts for us in ps[::2] for u in us})
        get = dict(zip(units, self._known([u.encode() for u in units]), strict=True)).__getitem__
        out = []
        for ps in parts:
            got = b"".join(map(get, ps[0]))
            for special, units in zip(ps[1::2], ps[2::2], strict=True):
                got += self.special[special].to_bytes(4, "little") + b"".join(map(get, units))
            out.append(got)
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", errors="replace")


_coders: dict[str, Bpe] = {}


def coder(path: str) -> Bpe:
    """One per worker process and vocabulary."""
    if path not in _coders:
        _coders[path] = Bpe(path)
    return _coders[path]


def slices(values: list[bytes], most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` bytes, so that what is held at once does not depend on the length of the texts."""
    start = size = 0
    for i, v in enumerate(values):
        if size and size + len(v) > most:
            yield start, i
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield start, len(values)


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = True) -> DataFrame:
    """Encode every text and decode the ids again: (id, ids array<int>, decoded string).

    Null and empty texts have no ids and decode to the empty text. Repeated rows and null ids stay as they are, one row
    each; other columns of ``docs`` are not carried. An empty table gives no rows. The pass needs no shuffle.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path)
        for batch in batches:
            values = texts(batch.column(1))
            for a, b in slices(values):
                got = bpe.encode_bytes(values[a:b])
                ids = np.frombuffer(b"".join(got), dtype="<i4")
                offsets = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype(np.int32)
                back = [bpe.decode(ids[s:e].tolist()) for s, e in zip(offsets, offsets[1:], strict=False)] if decode else [None] * (b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(back, pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, f"id {kind}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Append the decoded text of an array of ids; a null array decodes to null."""

    @F.pandas_udf("string")
    def back(s):
        bpe = coder(path)
        return s.map(lambda ids: None if ids is None else bpe.decode(ids))

    return df.withColumn(out_col, back(F.col(ids_col)))
