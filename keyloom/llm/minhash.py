"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations give the whole signature: sigma places a shingle, and coordinate k is the least value of pi, circularly
shifted by k, over the places of a set. With pi stored twice in a row the coordinates of one shingle are one contiguous
slice, so a signature is a minimum over slices.

Documents with the same words are one class; only classes are banded. In a bucket of classes each is verified, on the
full sets, against one centre and against its neighbours in the order of the bands that follow, where the most alike
stand together: pairs grow with the rows, not with the square of a bucket. Where a bucket still holds several components
after that, its sets meet in one task (in blocks of bounded size), which counts all intersections across components as
products of matrices and emits one link for two components: no link of a bucket is lost, and no pairs are emitted.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import bounded_batches, mix, release, rolling, row_key, texts, word_bounds, word_hashes, written

_PLACES = 1 << 20
_PER_TASK = 256
_BLOCK = 1 << 19  # shingles of one side of a block
_SETS = 2048  # sets of one side of a block
_CELLS = 1 << 22


def shingle_sets(values: list[bytes], k: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's k-word shingles; the whole sequence is one if it is shorter, none if empty."""
    buf = np.frombuffer(b"\n".join(values).lower(), dtype=np.uint8)
    starts, ends = word_bounds(buf)
    words = word_hashes(buf, starts, ends)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum([len(v) + 1 for v in values])]))
    runs = rolling(words, k)
    out = []
    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
        n = b - a
        out.append(np.unique(runs[a : b - k + 1]) if n >= k else rolling(words[a:b], n, seed=n) if n else words[:0])
    return out


class Circulant:
    """Signatures of ``size`` coordinates and their bands of ``rows`` coordinates."""

    def __init__(self, size: int = 128, rows: int = 4, seed: int = 7):
        pi = np.random.default_rng(seed).permutation(_PLACES).astype(np.uint32)
        self.size, self.rows = size, rows
        self.shifted = np.lib.stride_tricks.sliding_window_view(np.concatenate([pi, pi[:size]]), size)

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.empty((len(sets), self.size), dtype=np.uint32)
        for i, s in enumerate(sets):
            places = (mix(s ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(44)).astype(np.int64)  # sigma
            best = None
            for at in range(0, len(places), 4096):
                part = self.shifted[places[at : at + 4096]].min(axis=0)
                best = part if best is None else np.minimum(best, part)
            out[i] = 0xFFFFFFFF if best is None else best
        return out

    def bands(self, signatures: np.ndarray) -> np.ndarray:
        parts = signatures.reshape(len(signatures), -1, self.rows).astype(np.uint64)
        h = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
        for r in range(self.rows):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r] + np.uint64(1))
        return h.view(np.int64)


_circulants: dict[tuple, Circulant] = {}


def _circulant(*key: int) -> Circulant:
    if key not in _circulants:
        _circulants[key] = Circulant(*key)
    return _circulants[key]


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of edges (a, b), by alternating large and small stars.

    The edges of a round, and the least neighbours that they are joined with, are tables in the shared folder, so that adaptive
    execution can split the join of a hub; only whether a round is the last comes to the driver. Edges with a null are not
    edges; no edges give no rows.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "stars")
    while True:
        # Every edge points down. Done when it points at a root, and from a node with no other edge.
        inner = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
        if inner.unionByName(now.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("a")).isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a"), F.least("a", "m").alias("m")), "stars-least")
        large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "stars-large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "stars-low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        new = written(small, "stars")
        for made in (now, least, large, low):
            release(made)
        now = new


def _links(names: list, labels: list, sets: list[np.ndarray], threshold: int) -> Iterator[pa.RecordBatch]:
    """A link for each two labels that have one, from all intersections of a block."""
    n = np.array([len(s) for s in sets])
    _, label = np.unique(np.array(labels, dtype=object), return_inverse=True)
    if len(sets) < 2 or label.max() == 0:
        return
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(count > 1) - 1
    owner, column = np.repeat(np.arange(len(sets)), n), number[place]
    common = count[place] > 1
    owner, column = owner[common], column[common]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    inter = np.zeros((len(sets), len(sets)), dtype=np.float64 if n.max() >= 1 << 24 else np.float32)
    columns = int(column[-1]) + 1 if len(column) else 0
    width = min(columns, max(64, _CELLS // len(sets)))
    for at in range(0, columns, max(1, width)):
        a, b = np.searchsorted(column, (at, at + width))
        dense = np.zeros((len(sets), width), dtype=np.float32)
        dense[owner[a:b], column[a:b] - at] = 1
        inter += dense @ dense.T
    # Counts up to 2**24 are exact in float32; a block has no more shingles of one set than that, unless a set alone does.
    inter = inter.astype(np.int64)
    linked = 100 * inter >= threshold * (n[:, None] + n[None, :] - inter)
    x, y = np.nonzero(np.triu(linked, 1))
    apart = label[x] != label[y]
    x, y = x[apart], y[apart]
    if len(x):
        pair = np.minimum(label[x], label[y]).astype(np.int64) * len(names) + np.maximum(label[x], label[y])
        first = np.unique(pair, return_index=True)[1]
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in side[first]], pa.binary()) for side in (x, y)], ["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, shingle: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """(id, n_shingles, component_id, kept) for every row of ``docs``.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set is its distinct ``shingle``-word
    shingles, the whole sequence if it is shorter. Sets with 100 * intersection >= threshold * union are linked; a component
    has the smallest id reachable, and a row is kept if that is its own. Null or empty texts have no set, are linked
    with nothing and kept. Null ids count only where a component has no other id, and are kept only there. Rows that
    repeat an id are classed by their own texts. With 32 bands of 4 a pair at the threshold is missed once in 200,000
    times, and less the more similar it is. Only the columns named are read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    keyed = source.select("id", "text", *row_key(F.col("id"), F.col("text")))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = _circulant(bands * rows, rows)
        for batch in batches:
            values = texts(batch.column(1))
            sets = shingle_sets(values, shingle)
            classes = [hashlib.sha256(b" ".join(v.lower().split())).digest()[:16] if len(s) else None for v, s in zip(values, sets, strict=True)]
            new = [i for c, i in {c: i for i, c in reversed([*enumerate(classes)])}.items() if c is not None]
            keys = dict(zip(new, maker.bands(maker.signatures([sets[i] for i in new])), strict=True)) if new else {}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), batch.column(3), pa.array(classes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array([keys.get(i) for i in range(len(values))], pa.list_(pa.int64()))],
                ["id", "_k1", "_k2", "class", "n", "bands"],
            )

    signed = written(keyed.mapInArrow(sign, f"id {kind}, _k1 long, _k2 long, class binary, n long, bands array<long>"), "minhash-signed")
    classes = signed.where("bands is not null").dropDuplicates(["class"]).select("class", "n", "bands")
    # ``next`` has bits of the two bands that follow: it puts what shares more of them side by side.
    follow = f"shiftleft(shiftrightunsigned(get(bands, (i + 1) % {bands}), 32), 32) | shiftrightunsigned(get(bands, (i + 2) % {bands}), 32)"
    every = written(classes.select("class", "n", F.expr(f"explode(transform(bands, (b, i) -> struct(b AS band, {follow} AS next)))").alias("e")).select("class", "n", "e.*"), "minhash-bands")
    shared = every.groupBy("band").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("band")
    # From here on only classes that share a bucket: their buckets, and their texts.
    buckets = written(every.join(shared, "band"), "minhash-buckets")
    release(every)
    wanted = signed.where("bands is not null").select("_k1", "_k2", "class").join(buckets.select("class").distinct(), "class", "left_semi").dropDuplicates(["class"])
    held = written(keyed.select("text", "_k1", "_k2").join(wanted.hint("shuffle_hash"), ["_k1", "_k2"]).dropDuplicates(["class"]).select("class", "text"), "minhash-texts")

    def against_centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, centre = None, None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            sets = shingle_sets(texts(batch.column(3)), shingle)
            members = batch.column(2).to_pylist()
            out = []
            for key, member, s in zip(keys, members, sets, strict=True):
                if member is None:
                    now, centre = key, s
                elif key == now:
                    common = len(np.intersect1d(centre, s, assume_unique=True))
                    if 100 * common >= threshold * (len(centre) + len(s) - common):
                        out.append((key[0], member))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    def verified(pairs: DataFrame) -> DataFrame:
        """The linked ones of pairs (a, b): a's text is dealt once to each task that holds some of its partners."""
        counts = written(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _PER_TASK).cast("int").alias("parts")), "minhash-centres")
        partners = pairs.join(counts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
        centres = counts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        rows_ = partners.join(held.withColumnRenamed("class", "b"), "b").select("a", "part", "b", "text").unionByName(centres.join(held.withColumnRenamed("class", "a"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "text"))
        return rows_.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).mapInArrow(against_centre, "a binary, b binary")

    fits = f"100 * least(n, cn) >= {threshold} * greatest(n, cn)"
    stars = buckets.groupBy("band").agg(F.min(F.struct("class", "n")).alias("c")).select("band", F.col("c.class").alias("a"), F.col("c.n").alias("cn"))
    to_centre = buckets.join(stars, "band").where(f"class <> a and {fits}").select("a", F.col("class").alias("b"))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                band, member, n = row
                out += [(min(x, member), max(x, member)) for b, x, m in last if b == band and 100 * min(m, n) >= threshold * max(m, n)]
                last = [*last[-1:], row]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], ["a", "b"])

    # Ranges, not keys, are dealt out: a bucket of any size is split, and only the pairs at a cut are left to what follows.
    order = ["band", "next", "class"]
    beside = buckets.repartitionByRange(*order).sortWithinPartitions(*order).select("band", "class", "n").mapInArrow(neighbours, "a binary, b binary")
    labels = connected(verified(written(to_centre.unionByName(beside).distinct(), "minhash-pairs")))
    of = written(buckets.join(labels.select(F.col("node").alias("class"), "label"), "class", "left").select("band", "class", "n", F.coalesce("label", "class").alias("label")), "minhash-labels")
    mixed = of.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("sets")).where("low <> high")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, labels_, sets = None, [], [], []
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for *key, name, label, s in zip(*columns, shingle_sets(texts(batch.column(5)), shingle), strict=True):
                if key != now:
                    if now is not None:
                        yield from _links(names, labels_, sets, threshold)
                    now, names, labels_, sets = key, [], [], []
                names.append(name)
                labels_.append(label)
                sets.append(s)
        if now is not None:
            yield from _links(names, labels_, sets, threshold)

    size = mixed.select("band", F.greatest(F.ceil(F.col("total") / _BLOCK), F.ceil(F.col("sets") / _SETS)).cast("int").alias("parts"))
    dealt = of.join(size, "band").withColumn("p", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    blocks = dealt.select("band", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "class", "label").join(held, "class")
    found = blocks.select("band", "i", "j", "class", "label", "text").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j", "class").mapInArrow(across, "a binary, b binary")
    more = written(found, "minhash-edges")
    if not more.isEmpty():  # the labels stand for all links so far
        labels = connected(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    ids = signed.where("class is not null").groupBy("class").agg(F.min("id").alias("least"))
    linked = ids.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    roots = linked.groupBy("label").agg(F.min("least").alias("component_id"))
    found = linked.join(roots, "label").select("class", "component_id")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return signed.select("id", "class", "n").join(found, "class", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
