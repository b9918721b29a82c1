"""A pair of Bloom filters over hashes, "seen once" and "seen twice", built in shards and read from a broadcast.

Tasks send each distinct hash once per buffer (with a mark if they saw it twice); the owner of a shard streams them
through its two filters and gives back only the second. What is broadcast has a size fixed beforehand, by ``bits``.
Too many hashes for the bits only make more hashes look repeated: none that is repeated is ever missed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import mix

_SHARD_BITS = 6
_PROBES = 4
_MANY, _CROWD, _NAMED = 64, 1024, 4096  # a buffer's count worth telling, a count that makes a crowd, crowds told by a shard at most


def size_for(expected: int, least: int = 1 << 20, most: int = 1 << 29) -> int:
    """Bits for so many distinct hashes, about ten each, within bounds (64 MB at most)."""
    return max(least, min(most, 1 << max(1, 10 * max(1, expected) - 1).bit_length()))


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The shard of each hash and its probes in the shard."""
    inside = np.uint64((bits >> _SHARD_BITS) - 1)
    step = (h >> np.uint64(20)) | np.uint64(1)
    return (h >> np.uint64(64 - _SHARD_BITS)).astype(np.int64), [((h + np.uint64(i) * step) & inside).astype(np.int64) for i in range(_PROBES)]


class Repeated:
    """The second filter, with all its shards."""

    def __init__(self, bits: int, shards: dict[int, bytes]):
        self.bits = bits
        per = bits >> _SHARD_BITS >> 3
        self.table = np.zeros(bits >> 3, dtype=np.uint8)
        for shard, packed in shards.items():
            self.table[shard * per : (shard + 1) * per] = np.frombuffer(zlib.decompress(packed), dtype=np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        shard, probes = _places(h, self.bits)
        base = shard * (self.bits >> _SHARD_BITS)
        out = np.ones(len(h), dtype=bool)
        for p in probes:
            at = base + p
            out &= (self.table[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
        return out


_loaded: dict[str, Repeated] = {}


def _of(name: str, broadcast, bits: int) -> Repeated:
    """The filter of a broadcast, unpacked once per worker; only the last one is held."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = Repeated(bits, broadcast.value)
    return _loaded[name]


def repeated_hashes(docs: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int, buffer: int = 1 << 20, crowd: bool = False):
    """Broadcast the filter of hashes that ``hashes`` gives at least twice over all of ``docs``, as a function to call in tasks.
    With ``crowd``, also a function that tells hashes that are there very often (the most frequent of each shard, 2 MB at most),
    for callers that deal these out in another way; it is no more than a hint, and the same in all tasks."""
    spark = docs.sparkSession
    n = 1 << _SHARD_BITS

    def flush(held: list[np.ndarray]) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(held), return_counts=True)
        shard = (h >> np.uint64(64 - _SHARD_BITS)).astype(np.int64)
        cuts = np.searchsorted(shard, np.arange(n + 1))
        twice = count > 1
        one, two, many = [], [], []
        for a, b in zip(cuts, cuts[1:], strict=False):
            one.append(h[a:b][~twice[a:b]].tobytes())
            two.append(h[a:b][twice[a:b]].tobytes())
            often = count[a:b] >= _MANY
            many.append(np.stack([h[a:b][often], count[a:b][often].astype(np.uint64)], axis=1).tobytes() if crowd else b"")
        return pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), *[pa.array(c, pa.binary()) for c in (one, two, many)]], ["shard", "one", "two", "many"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            got = mix(hashes(batch))  # shards go by the first bits, which callers may have picked by
            if len(got):
                held.append(got)
                size += len(got)
            if size > buffer:
                yield flush(held)
                held, size = [], 0
        if held:
            yield flush(held)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, twice, often = None, None, None, {}

        def done():
            crowds = sorted(((c, x) for x, c in often.items() if c >= _CROWD), reverse=True)[:_NAMED]
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([zlib.compress(np.packbits(twice, bitorder="little").tobytes(), 1)], pa.binary()), pa.array([np.array([x for _, x in crowds], dtype=np.uint64).tobytes()], pa.binary())], ["shard", "bits", "crowds"])

        for batch in batches:
            for shard, one, two, many in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if shard != now:
                    if now is not None:
                        yield done()
                    now, once, twice, often = shard, np.zeros(bits >> _SHARD_BITS, dtype=bool), np.zeros(bits >> _SHARD_BITS, dtype=bool), {}
                for x, c in np.frombuffer(many, dtype=np.uint64).reshape(-1, 2).tolist():
                    often[x] = often.get(x, 0) + c
                if len(often) > 32 * _NAMED:
                    often = dict(sorted(often.items(), key=lambda i: -i[1])[: 16 * _NAMED])
                for raw, sure in ((one, False), (two, True)):
                    probes = _places(np.frombuffer(raw, dtype=np.uint64), bits)[1]
                    seen = np.ones(len(raw) // 8, dtype=bool)
                    if not sure:
                        for p in probes:
                            seen &= once[p]
                    for p in probes:
                        twice[p[seen]] = True
                        once[p] = True
        if now is not None:
            yield done()

    sent = docs.mapInArrow(send, "shard int, one binary, two binary, many binary").where((F.length("one") > 0) | (F.length("two") > 0))
    rows = sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(own, "shard int, bits binary, crowds binary").collect()  # 64 rows
    shared = spark.sparkContext.broadcast({r.shard: bytes(r.bits) for r in rows})

    name = uuid.uuid4().hex

    def has(h: np.ndarray) -> np.ndarray:
        return _of(name, shared, bits).has(mix(h))

    if not crowd:
        return has
    crowds = np.sort(np.concatenate([np.empty(0, dtype=np.uint64), *[np.frombuffer(r.crowds, dtype=np.uint64) for r in rows]]))
    return has, lambda h: np.isin(mix(h), crowds)
