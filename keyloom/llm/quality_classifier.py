"""Quality by co-training: one classifier reads the words, the other what a page's record says, and they teach each other.

The text view has the presence of words, their beginnings and endings, and how often words recur. The metadata view has
language, source, size, and the make-up of lines and characters, and never sees a word (the tables' own columns of that kind,
language, source and length, say next to nothing of quality, so the make-up that a crawler can count is part of it). Each round both are fitted on their own
labels, calibrated on labelled documents that neither was fitted on, and all documents of the unlabelled pool that one is sure of
are given to the other. At the end the calibrated views are combined. Low quality and toxicity are two such pairs, and each has
a limit at which it catches a stated share of the held-out bad documents.

The labelled rows are bounded (``labelled``, by a hash of the id). The pool is every other row: each exchange scores all of it
in one pass, and what is summed of it, how many taught documents have a feature and how many of these are bad, leaves a task in
place of rows. Every document is scored, in one pass without a shuffle; a view that is broadcast has at most ``features``
weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, mix, release, texts, word_bounds, word_hashes, written

_FEATURE = np.uint64(0xFFFFFFFFFFFFFF00)
_LEAST = 3  # documents of the sample that a feature is in
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Classes of bytes: other, letter a-z, letter A-Z, digit, white space, line end, the rest of ASCII, beyond ASCII.
_OF = np.zeros(256, dtype=np.int64)
_OF[33:127] = 6
_OF[97:123], _OF[65:91], _OF[48:58], _OF[[9, 11, 12, 13, 32]], _OF[10], _OF[128:] = 1, 2, 3, 4, 5, 7
_CLASS = (_OF[:, None] == np.arange(8)).astype(np.int64)


@lru_cache(1 << 16)
def _named(kind: int, *values: int) -> int:
    h = np.array([kind], dtype=np.uint64)
    for v in values:
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(v & 0xFFFFFFFFFFFFFFFF))
    return int(h[0])


@dataclass
class Features:
    """The distinct features of some documents, in order, and a table of ones and zeros: which of the documents has which."""

    keys: np.ndarray
    has: np.ndarray


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, the number of each value among them, and a place of each."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(order)]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number, order[new]


def _features(n: int, values: list[np.ndarray], docs: list[np.ndarray], members: list[np.ndarray]) -> Features:
    """For each part, its features, and pairs of a document and the place in the part of a feature that it has."""
    keys, number, _ = _numbered(np.concatenate(values) & _FEATURE)
    has = np.zeros((n, len(keys)), dtype=np.float32)
    at = 0
    for part, doc, member in zip(values, docs, members, strict=True):
        has[doc, number[at : at + len(part)][member]] = 1
        at += len(part)
    return Features(keys, has)


def text_features(values: list[bytes]) -> Features:
    """The text view: words, their beginnings and endings, and how often words recur. A distinct word is looked at once."""
    n = len(values)
    buf = _LOWER[np.frombuffer(b"\n".join(values), dtype=np.uint8)]
    starts, ends = word_bounds(buf)
    many = np.diff(np.searchsorted(starts, np.cumsum([0, *(len(v) + 1 for v in values)])))
    doc = np.repeat(np.arange(n), many)
    words, word, first = _numbered(word_hashes(buf, starts, ends))
    present = np.zeros((n, len(words)), dtype=bool)
    present[doc, word] = True
    starts, ends = starts[first], ends[first]
    parts = [words]
    for kind, (a, b) in enumerate(((starts, np.minimum(starts + 4, ends)), (starts, np.minimum(starts + 5, ends)), (starts, np.minimum(starts + 6, ends)), (np.maximum(ends - 2, starts), ends)), start=1):
        parts.append(mix(word_hashes(buf, a, b) ^ np.uint64(kind)))
    shape = np.array([_named(9, int(min(m.bit_length(), 8)), int(20 * d // max(1, m))) for m, d in zip(many.tolist(), present.sum(axis=1).tolist(), strict=True)], dtype=np.uint64)
    each = np.arange(n)
    return _features(n, [*parts, shape], [*[doc] * len(parts), each], [*[word] * len(parts), each])


def record_features(values: list[bytes], langs: list, sources: list) -> Features:
    """The metadata view: language, source, size, and the make-up that a page's record counts. It sees no word."""
    docs, feats = [], []
    for i, (v, lang, source) in enumerate(zip(values, langs, sources, strict=True)):
        n = len(v)
        counts = np.bincount(np.frombuffer(v, dtype=np.uint8), minlength=256)
        share = (counts @ _CLASS / max(1, n)).tolist()
        lines, bars = int(counts[10]) + 1, int(counts[124])
        got = [_named(20, hash_of(lang)), _named(21, hash_of(source)), _named(22, n.bit_length()), _named(23, lines.bit_length()), _named(24, (n // lines).bit_length())]
        got += [_named(30 + c, int(40 * share[c])) for c in range(8)] + [_named(40, int(200 * share[6])), _named(41, int(100 * bars / max(1, n)))]
        docs += [i] * len(got)
        feats += got
    return _features(len(values), [np.array(feats, dtype=np.uint64)], [np.array(docs, dtype=np.int64)], [np.arange(len(feats))])


def chunks(values: list[bytes]) -> Iterator[slice]:
    """Runs of at most 64 texts and about a megabyte, as what is made of them is a table of texts by features."""
    start = size = 0
    for i, v in enumerate(values):
        if i > start and (i - start == 64 or size + len(v) > 1 << 20):
            yield slice(start, i)
            start, size = i, 0
        size += len(v)
    if start < len(values):
        yield slice(start, len(values))


@lru_cache(1 << 12)
def hash_of(value) -> int:
    if value is None:
        return 1
    h = 14695981039346656037
    for b in str(value).encode():
        h = (h ^ b) * 1099511628211 & 0xFFFFFFFFFFFFFFFF
    return h


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit_dense(x: np.ndarray, y: np.ndarray, penalty: float) -> np.ndarray:
    """Logistic regression by Newton steps; the last column is a constant and has no penalty."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = _sigmoid(x @ w)
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass
class View:
    """A sparse logistic model: sorted feature hashes, their weights, a bias, then the calibration's slope and shift."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def __post_init__(self):
        self.weights = np.round(self.weights * 4096) / 4096  # sums of such values are exact, so a text scores alike in any batch

    def score(self, f: Features) -> np.ndarray:
        """The calibrated log odds of each document; a feature counts once."""
        w = np.zeros(len(f.keys), dtype=np.float32)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, f.keys), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == f.keys)
            w[hit] = self.weights[at[hit]]
        return self.slope * ((f.has @ w).astype(np.float64) + self.bias) + self.shift


_TEACH = "slot int, feature long, n long, a long"
_TOTAL = np.uint64(1)  # the key of a tally's sums: the low bits of a feature are clear
_LEAST_Z = (3.5, 2.0)
#: The share of the bad documents, by target, that its limit is to catch, and the most of the others that it may cost.
_RECALL = {"low": 0.95, "toxic": 0.9}
_COST = 0.01


class _Tally:
    """Of each feature: how many of the documents that teach have it, and how many of these are bad."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size, self.most = 0, 1 << 19

    def add(self, keys: np.ndarray, n: np.ndarray, a: np.ndarray, total: int, bad: int) -> None:
        """Keys in order, how many of ``total`` documents have each, and how many of the ``bad`` ones."""
        if total:
            some = np.flatnonzero(n)
            self._put(keys[some], n[some], a[some])
            self.parts.append((np.array([_TOTAL]), np.array([total]), np.array([bad])))
            if self.size > self.most:
                self._merge()
                self.most = (1 << 19) + 2 * self.size

    def _merge(self) -> None:
        keys, n, a = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.argsort(keys, kind="stable")
        self.parts, self.size = [], 0
        self._put(keys[order], n[order], a[order])

    def _put(self, keys: np.ndarray, n: np.ndarray, a: np.ndarray) -> None:
        """Keys in order."""
        if len(keys):
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts.append((keys[first], np.add.reduceat(n, first), np.add.reduceat(a, first)))
            self.size += len(first)

    def sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        self._merge()
        out = self.parts[0]
        self.__init__()
        return out


def _teach(tallies: list[_Tally], made: list[Features], given: list[np.ndarray]) -> None:
    """Add documents to the tallies by their labels, a list of them for each; those with a label of nan do not teach."""
    for v, f in enumerate(made):
        labels = np.stack(given[v :: len(made)])
        rows = np.concatenate([~np.isnan(labels), labels == 1]).astype(np.float32)
        taught = np.flatnonzero(rows.any(axis=0))
        if not len(taught):
            continue
        sums = (rows @ f.has).astype(np.int64)
        totals = rows.sum(axis=1).astype(np.int64).tolist()
        for i, tally in enumerate(tallies[v :: len(made)]):
            tally.add(f.keys, sums[i], sums[i + len(labels)], totals[i], totals[i + len(labels)])


def _taught(views: list[View], made: list[Features], sure: float) -> list[np.ndarray]:
    """The labels that each view is given by the other, nan where that is not sure."""
    out = []
    for other in (1, 0):
        p = _sigmoid(views[other].score(made[other]))
        out.append(np.where(p >= sure, 1.0, np.where(p <= 1 - sure, 0.0, np.nan)))
    return out


def _summed(to: np.ndarray, value: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The sums of ``value[at]`` by ``to``, in pieces, as all entries at once would take the driver's memory."""
    out = np.zeros(n)
    for i in range(0, len(to), 1 << 18):
        c = slice(i, i + (1 << 18))
        out += np.bincount(to[c], weights=value[at[c]], minlength=n)
    return out


def _limit(p: np.ndarray, y: np.ndarray, recall: float) -> float:
    """The highest limit, up to 0.5, at which that share of the bad is rejected; higher where it would cost more than ``_COST``
    of the others."""
    bad, rest = np.sort(p[y == 1]), np.sort(p[y == 0])
    caught = bad[min(int(np.floor((1 - recall) * len(bad))), len(bad) - 1)]
    cost = np.nextafter(rest[max(int(np.ceil((1 - _COST) * len(rest))) - 1, 0)], 1)
    return float(np.clip(max(caught, cost), 0.01, 0.5))


def _fit(keys: np.ndarray, n: np.ndarray, a: np.ndarray, total: int, bad: int, doc: np.ndarray, number: np.ndarray, y: np.ndarray, steps: int) -> View:
    """Features weigh what the counts of all documents that teach say (log odds, as naive Bayes does); gradient steps on the
    labelled ones then scale each. A feature that none of those has is scaled as the others are on average."""
    r = np.log((a + 0.5) / (bad + 1)) - np.log((n - a + 0.5) / (total - bad + 1))
    raw = _summed(doc, r, number, len(y))
    wide = float(raw.std()) or 1.0
    first = _fit_dense(raw[:, None] / wide, y, 1.0)
    r = r * max(float(first[0]), 1e-3) / wide
    u, bias = np.ones(len(keys)), float(first[1])
    m, v, mb, vb = np.zeros(len(keys)), np.zeros(len(keys)), 0.0, 0.0
    for t in range(1, steps + 1):
        p = _sigmoid(_summed(doc, r * u, number, len(y)) + bias)
        e = (p - y) / len(y)
        g, gb = _summed(number, e, doc, len(keys)) * r + 1e-7 * (u - 1), e.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.2 / (1 + t / 50)
        u -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-9)
    seen = np.bincount(number, minlength=len(keys)) > 0
    if seen.any():
        u[~seen] = max(float(u[seen].mean()), 0.0)
    return View(keys, r * u, bias)


@dataclass
class Target:
    """One reason to reject: the two views' models, and how they are combined."""

    name: str
    views: list[View]
    mix: np.ndarray
    limit: float = 0.5

    def score(self, made: list[Features]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b = (v.score(f) for v, f in zip(self.views, made, strict=True))
        return _sigmoid(a), _sigmoid(b), _sigmoid(a * self.mix[0] + b * self.mix[1] + self.mix[2])


@dataclass
class Model:
    targets: list[Target]

    def score(self, values: list[bytes], langs: list, sources: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By the text, by the record, by both: the highest of the targets' probabilities, in the last with odds that are even
        at the target's limit."""
        made = _views(values, langs, sources)
        scores = []
        for t in self.targets:
            a, b, p = t.score(made)
            scores.append((a, b, p * (1 - t.limit) / (p * (1 - t.limit) + (1 - p) * t.limit)))
        return tuple(np.maximum.reduce(p) for p in zip(*scores, strict=True))


def _views(values: list[bytes], langs: list, sources: list) -> list[Features]:
    return [text_features(values), record_features(values, langs, sources)]


class _Rows:
    """(text, lang, source, bad or None) rows in memory, for ``co_train``."""

    def __init__(self, rows: list[tuple]):
        known = [r for r in rows if r[3] is not None]
        self.names, self.y = ["bad"], np.array([[float(r[3])] for r in known]).reshape(len(known), 1)
        self.held = np.arange(len(known)) % 4 == 3
        self.known, self.pool = ([_views([r[0]], [r[1]], [r[2]]) for r in part] for part in (known, [r for r in rows if r[3] is None]))

    def counts(self, targets: list[list[View]], own: np.ndarray, sure: float, most: int) -> list[tuple]:
        out = []
        for t in range(own.shape[1]):
            tallies = [_Tally(), _Tally()]
            for made, y in [(f, [own[i, t : t + 1]] * 2) for i, f in enumerate(self.known)] + [(f, _taught(targets[t], f, sure)) for f in self.pool if targets]:
                _teach(tallies, made, y)
            for v in range(2):
                keys, n, a = tallies[v].sums()
                total, bad = (int(c[keys == _TOTAL][0]) for c in (n, a))
                with np.errstate(divide="ignore", invalid="ignore"):
                    g2 = 2 * (np.where(a > 0, a * np.log(a * total / (n * bad)), 0) + np.where(n > a, (n - a) * np.log((n - a) * total / (n * (total - bad))), 0))
                good = np.flatnonzero((g2 >= _LEAST_Z[v] ** 2) & (n >= _LEAST) & (keys != _TOTAL))
                good = np.sort(good[np.argsort(-g2[good], kind="stable")[:most]])
                out.append((keys[good], n[good], a[good], total, bad))
        return out

    def entries(self, view: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _joined([_numbers(keys, f[view].keys) for f in self.known])


def _numbers(keys: np.ndarray, feature: np.ndarray) -> np.ndarray:
    """The places in ``keys`` of a document's features, which are in order."""
    if not len(keys):
        return np.empty(0, dtype=np.int32)
    at = np.minimum(np.searchsorted(keys, feature), len(keys) - 1)
    return at[keys[at] == feature].astype(np.int32)


def _joined(found: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.repeat(np.arange(len(found), dtype=np.int32), [len(x) for x in found]), np.concatenate([*found, np.empty(0, dtype=np.int32)])


class _Tables:
    """The same of tables: features of the labelled rows are made once and written, those of the pool are made in each pass and
    only their sums leave a task."""

    def __init__(self, docs: DataFrame, chosen: DataFrame, names: list[str], id_col: str):
        self.spark, self.names = docs.sparkSession, names
        bounded_batches(self.spark)
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col("text").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
        ids = chosen.select("doc_id")
        # What is broadcast is bounded by the limit.
        self.pool = rows.join(F.broadcast(ids), "doc_id", "left_anti").select("text", "lang", "source")
        kind = docs.schema[id_col].dataType.simpleString()

        def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = [[f.keys.tobytes() for f in _views([x], [lang], [source])] for x, lang, source in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
                columns = [pa.array([g[i] for g in got], pa.binary()) for i in range(2)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "f0", "f1"])

        # Of rows that repeat an id the least teaches, whatever the partitioning.
        some = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang", "source")).alias("r")).select("doc_id", "r.*")
        self.known = written(some.mapInArrow(made, f"doc_id {kind}, f0 binary, f1 binary").join(F.broadcast(chosen), "doc_id").select("doc_id", F.array(*names).alias("y"), "f0", "f1"), "classifier-labelled")
        got = sorted(self.known.select("doc_id", "y", F.xxhash64(F.lit("sample"), "doc_id").alias("r")).collect(), key=lambda r: (r.r, r.doc_id))
        self.at = {r.doc_id: i for i, r in enumerate(got)}
        self.y = np.array([r.y for r in got], dtype=float).reshape(len(got), len(names))
        self.held = np.arange(len(got)) % 4 == 3

    def counts(self, targets: list[list[View]], own: np.ndarray, sure: float, most: int) -> list[tuple]:
        n_targets = own.shape[1]
        shared = self.spark.sparkContext.broadcast((targets, self.at, own))

        def out(tallies: list[_Tally]) -> Iterator[pa.RecordBatch]:
            for slot, tally in enumerate(tallies):
                keys, n, a = tally.sums()
                for i in range(0, len(keys), 1 << 16):
                    c = slice(i, i + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys[c]), slot, dtype=np.int32)), pa.array(keys[c].view(np.int64)), pa.array(n[c]), pa.array(a[c])], ["slot", "feature", "n", "a"])

        def of_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tallies = [_Tally() for _ in range(2 * n_targets)]
            for batch in batches:
                for d, *f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    y = shared.value[2][shared.value[1][d]]
                    for slot, tally in enumerate(tallies):
                        if not np.isnan(y[slot // 2]):
                            keys, bad = np.frombuffer(f[slot % 2], dtype=np.uint64), int(y[slot // 2])
                            one = np.ones(len(keys), dtype=np.int64)
                            tally.add(keys, one, bad * one, 1, bad)
                if sum(t.size for t in tallies) > 1 << 20:
                    yield from out(tallies)
            yield from out(tallies)

        def of_pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tallies = [_Tally() for _ in range(2 * n_targets)]
            for batch in batches:
                values, langs, sources = texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()
                for c in chunks(values):
                    made = _views(values[c], langs[c], sources[c])
                    _teach(tallies, made, [y for views in shared.value[0] for y in _taught(views, made, sure)])
                    if sum(t.size for t in tallies) > 1 << 20:
                        yield from out(tallies)
            yield from out(tallies)

        rows = self.known.select("doc_id", "f0", "f1").mapInArrow(of_known, _TEACH)
        if targets:
            rows = rows.unionByName(self.pool.mapInArrow(of_pool, _TEACH))
        sums = written(rows.groupBy("slot", "feature").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).where(f"n >= {_LEAST} OR feature = 1"), "classifier-counts")
        totals = {r.slot: (r.n, r.a) for r in sums.where("feature = 1").collect()}
        result = []
        for slot in range(2 * n_targets):
            total, bad = totals[slot]
            g2 = F.expr(f"2 * (CASE WHEN a > 0 THEN a * ln(a * {total}D / (n * {bad}D)) ELSE 0 END + CASE WHEN n > a THEN (n - a) * ln((n - a) * {total}D / (n * {total - bad}D)) ELSE 0 END)")
            best = sums.where(f"slot = {slot} AND feature <> 1").select("feature", "n", "a", g2.alias("g2")).where(f"g2 >= {_LEAST_Z[slot % 2] ** 2}D").orderBy(F.desc("g2"), "feature").limit(most).select("feature", "n", "a").toArrow()
            keys, n, a = (best.column(i).to_numpy().copy() for i in range(3))
            keys = keys.astype(np.int64).view(np.uint64)
            order = np.argsort(keys)
            result.append((keys[order], n[order], a[order], total, bad))
        release(sums)
        shared.destroy()
        return result

    def entries(self, view: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shared = self.spark.sparkContext.broadcast(keys)
        kind = self.known.schema["doc_id"].dataType.simpleString()

        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                numbers = [_numbers(shared.value, np.frombuffer(x, dtype=np.uint64)).tobytes() for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.binary())], ["doc_id", "numbers"])

        got = self.known.select("doc_id", f"f{view}").mapInArrow(found, f"doc_id {kind}, numbers binary").toArrow()
        shared.destroy()
        numbers = got.column(1).to_pylist()
        return _joined([np.frombuffer(numbers[i], dtype=np.int32) for i in np.argsort([self.at[d] for d in got.column(0).to_pylist()])])


def co_train(source, rounds: int = 3, features: int = 20_000, sure: float = 0.98) -> Model | None:
    """Fit on (text, lang, source, bad or None) rows, a list of them or tables. None if the labels are not of both classes."""
    if isinstance(source, list):
        source = _Rows(source)
    told = [t for t, c in enumerate(source.y.T) if len(np.unique(c[~np.isnan(c)])) == 2]
    if not told:
        return None
    y = source.y[:, told]
    held = np.repeat(source.held[:, None], len(told), axis=1)
    for t, c in enumerate(y.T):
        # Each class must be among the rows that are fitted on and among those that are held out.
        if any(len(np.unique(c[part & ~np.isnan(c)])) < 2 for part in (held[:, t], ~held[:, t])):
            held[:, t] = False
    own = np.where(held, np.nan, y)
    test = [np.flatnonzero((held[:, t] | ~held[:, t].any()) & ~np.isnan(y[:, t])) for t in range(len(told))]
    views: list[list[View]] = []
    for turn in range(rounds):
        counts = source.counts(views, own, sure, features)
        fitted, raws = [], []
        for slot, c in enumerate(counts):
            t = slot // 2
            doc, number = source.entries(slot % 2, c[0])
            use = ~np.isnan(own[:, t])
            place, mine = (np.cumsum(use) - 1).astype(np.int32), use[doc]
            view = _fit(*c, place[doc[mine]], number[mine], own[use, t], 100 if turn == rounds - 1 else 40)
            raw = _summed(doc, view.weights, number, len(y)) + view.bias
            w = _fit_dense(np.clip(raw[test[t]], -12, 12)[:, None], y[test[t], t], 1.0)
            view.slope, view.shift = max(float(w[0]), 0.0), float(w[1])
            fitted.append(view)
            raws.append(view.slope * raw + view.shift)
        views = [fitted[i : i + 2] for i in range(0, len(fitted), 2)]
    out = []
    for t, (i, v) in enumerate(zip(told, views, strict=True)):
        x, of = np.column_stack([s[test[t]] for s in raws[2 * t : 2 * t + 2]]), y[test[t], t]
        blend = _fit_dense(x, of, 1.0)
        p = _sigmoid(np.column_stack([x, np.ones(len(x))]) @ blend)
        out.append(Target(source.names[i], v, blend, _limit(p, of, _RECALL.get(source.names[i], 0.5))))
    return Model(out)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", labelled: int = 10_000, rounds: int = 3, features: int = 20_000) -> Model | None:
    """Fit on at most ``labelled`` labelled rows, those with the least hashes of their ids, and on every other row of ``docs`` as
    unlabelled. Low quality and toxicity are told apart each by models of their own; a document is bad if it is either.
    Memory of the driver is bounded by the numbers of features of the labelled rows; texts stay in tasks.

    Labels of a null id, or of an id without a document, are not used; of several labels of an id the worst counts. Null
    texts, languages and sources are values. Of rows that repeat a labelled id the least (text, lang, source) teaches and the
    others neither teach nor are taught from; other repeated rows count as often as they are there. Ties of the sampling hash
    go by id. None if there are no labels of both classes, as in empty tables."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg((1 - F.min("quality") > 0).cast("double").alias("low"), (F.max("toxic") > 0).cast("double").alias("toxic")).where("low is not null or toxic is not null")
    chosen = known.join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi").orderBy(F.xxhash64(F.lit("sample"), F.col("doc_id")), "doc_id").limit(labelled)
    chosen = written(chosen, "classifier-chosen")
    source = _Tables(docs, chosen, ["low", "toxic"], id_col)
    model = co_train(source, rounds=rounds, features=features)
    release(source.known)
    release(chosen)
    return model


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", reject: float = 0.5, carry: bool = False) -> DataFrame:
    """(id, p_text, p_record, p_bad, kept) for every row, and with ``carry`` the row itself as a struct ``row``.

    Whole texts are read. Null texts are empty, null languages and sources are values of their own; repeated rows score
    alike. Without a model (no labels, or of one class) nothing is rejected and scores are null. An empty table gives
    no rows. Columns other than those named are carried untouched, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            n = batch.num_rows
            if m is None:
                got = [pa.nulls(n, pa.float64())] * 3 + [pa.array([True] * n)]
            else:
                parts, values = [], texts(batch.column(1))
                langs, sources = batch.column(2).to_pylist(), batch.column(3).to_pylist()
                for c in chunks(values):
                    parts.append(m.score(values[c], langs[c], sources[c]))
                p = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0)] * 3
                got = [pa.array(x) for x in p] + [pa.array(p[2] < reject)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *got, *batch.columns[4:]], ["id", "p_text", "p_record", "p_bad", "kept", "row"][: 5 + carry])

    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"), F.col("lang").cast("string"), F.col("source").cast("string"), *[row][: int(carry)])
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, p_text double, p_record double, p_bad double, kept boolean" + (f", row {at.schema['row'].dataType.simpleString()}" if carry else "")
    return at.mapInArrow(run, shape).withColumnRenamed("id", id_col)
