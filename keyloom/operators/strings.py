"""Strings and counters: rows (key, val), or a log (key, version, val)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import clamp_range
from keyloom.functions.ranks import beside


def set_(kv: DataFrame, new: DataFrame, nx: bool = False, xx: bool = False, if_equal: str | None = None) -> DataFrame:
    """(key, val, old) after writing ``new`` (key, val), one row per key; the conditions are on the old value."""
    both = kv.select("key", F.col("val").alias("old")).join(new.select("key", F.col("val").alias("_new")), "key", "full_outer")
    ok = F.col("_new").isNotNull()
    ok = ok & F.col("old").isNull() if nx else ok
    ok = ok & F.col("old").isNotNull() if xx else ok
    ok = ok & F.col("old").eqNullSafe(F.lit(if_equal)) if if_equal is not None else ok
    return both.select("key", F.when(ok, F.col("_new")).otherwise(F.col("old")).alias("val"), "old").where("val is not null")


def msetnx(kv: DataFrame, new: DataFrame) -> DataFrame:
    """All of ``new``, or nothing if any of its keys exists."""
    clash = new.join(kv.select("key"), "key", "left_semi").agg(F.count(F.lit(1)).alias("_n"))
    return kv.select("key", "val").unionByName(new.select("key", "val").join(F.broadcast(clash.where("_n = 0")), how="left_semi"))  # at most one row


def mget(kv: DataFrame, keys: DataFrame) -> DataFrame:
    """(pos, key, val) for request rows (pos, key), null where absent."""
    return keys.join(kv.select("key", "val"), "key", "left").select("pos", "key", "val")


def delifeq(kv: DataFrame, key: str, value: str) -> DataFrame:
    return kv.where(~((F.col("key") == key) & F.col("val").eqNullSafe(F.lit(value))))


def append(log: DataFrame) -> DataFrame:
    """Values of a log (key, version, val) joined in the order of version. A key's value is one cell by its nature."""
    parts = F.array_sort(F.collect_list(F.struct("version", "val")))
    return log.groupBy("key").agg(F.array_join(F.transform(parts, lambda x: x["val"]), "").alias("val"))


def getrange(kv: DataFrame, start: int, end: int) -> DataFrame:
    """Bytes start..end, inclusive, negative ends from the tail."""
    raw = F.col("val").cast("binary")
    low, high = clamp_range(F.octet_length(raw), start, end)
    piece = F.when(low <= high, F.substring(raw, low + 1, high - low + 1)).otherwise(F.lit("").cast("binary"))
    return kv.withColumn("piece", piece.cast("string"))


def setrange(kv: DataFrame, offset: int, value: str) -> DataFrame:
    """``value`` over the bytes from ``offset``; a gap is filled with zero bytes."""
    if offset < 0:
        raise ValueError("offset is out of range")
    raw, new = F.coalesce(F.col("val"), F.lit("")).cast("binary"), F.lit(value).cast("binary")
    head = F.rpad(F.substring(raw, 1, offset), offset, F.lit(b"\0")) if offset else F.lit("").cast("binary")
    tail = F.substring(raw, F.lit(offset + len(value.encode()) + 1), F.octet_length(raw) + 1)
    return kv.withColumn("val", F.concat(head, new, tail).cast("string"))


def strlen(kv: DataFrame) -> DataFrame:
    """Bytes; a value that is not there has none."""
    return kv.withColumn("length", F.coalesce(F.octet_length("val"), F.lit(0)).cast("long"))


def incrby(deltas: DataFrame, key: str = "key", delta: str = "delta") -> DataFrame:
    """Counters as sums of whole increments; an overflow of 64 bits is an error."""
    return deltas.groupBy(key).agg(F.sum(F.col(delta).cast("long")).alias("val"))


def incrbyfloat(deltas: DataFrame) -> DataFrame:
    bad = F.isnan(F.col("delta")) | F.col("delta").isin(float("inf"), float("-inf"))
    return deltas.groupBy("key").agg(F.sum(F.when(bad, F.raise_error(F.lit("increment is not a finite number")).cast("double")).otherwise(F.col("delta"))).alias("val"))


def getset(log: DataFrame) -> DataFrame:
    """Each write of a log with the value it replaced."""
    return beside(log, ["key"], "version", "val", "old")


def lcs_table(a: str, b: str) -> tuple[str, list[tuple[int, int, int, int, int]]]:
    """A longest common subsequence of two strings and its matching ranges (a_lo, a_hi, b_lo, b_hi, length), last first.

    Of equal ways the walk back prefers to go down in ``b``. Lengths are made row by row, each at once, as the greatest so far
    of what the row above gives; of a row only one bit a column is kept, which way to walk: 50 MB for two texts of 20,000."""
    import numpy as np

    n, m = len(a), len(b)
    x, y = (np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32) for t in (a, b))
    last, up = np.zeros(m + 1, dtype=np.int32), []
    for i in range(n):
        now = np.zeros(m + 1, dtype=np.int32)
        now[1:] = np.maximum.accumulate(np.where(y == x[i], last[:-1] + 1, last[1:]))
        up.append(np.packbits(last[1:] > now[:-1]))
        last = now
    i, j, text, ranges = n, m, [], []
    while i and j:
        if x[i - 1] == y[j - 1]:
            text.append(a[i - 1])
            i, j = i - 1, j - 1
            if ranges and ranges[-1][0] == i + 1 and ranges[-1][2] == j + 1:
                r = ranges[-1]
                ranges[-1] = (i, r[1], j, r[3], r[4] + 1)
            else:
                ranges.append((i, i, j, j, 1))
        elif up[i - 1][j - 1 >> 3] >> (7 - (j - 1 & 7)) & 1:
            i -= 1
        else:
            j -= 1
    return "".join(reversed(text)), ranges


def lcs(pairs: DataFrame, a: str = "a", b: str = "b", min_match_len: int = 0) -> DataFrame:
    """Append ``lcs``, ``lcs_len`` and ``matches`` of two string columns. No built-in function has it, so it is an Arrow function."""

    @F.pandas_udf("lcs string, lcs_len int, matches array<struct<a_lo int, a_hi int, b_lo int, b_hi int, len int>>")
    def run(x, y):
        import pandas as pd

        out = []
        for p, q in zip(x, y, strict=True):
            if p is None or q is None:
                out.append((None, None, None))
                continue
            text, ranges = lcs_table(p, q)
            out.append((text, len(text), [dict(zip(("a_lo", "a_hi", "b_lo", "b_hi", "len"), r, strict=True)) for r in ranges if r[4] >= min_match_len]))
        return pd.DataFrame(out, columns=["lcs", "lcs_len", "matches"])

    return pairs.withColumn("_l", run(F.col(a), F.col(b))).select("*", "_l.*").drop("_l")


def setex(kv: DataFrame, new: DataFrame, now_ms: int, ttl_ms: int) -> DataFrame:
    """(key, val, expire_ms) with ``new`` written and given a time; other keys keep theirs. A time of 0 or less is an error."""
    if ttl_ms <= 0:
        raise ValueError("invalid expire time")
    n = new.select("key", F.col("val").alias("_new"), F.lit(now_ms + ttl_ms).cast("long").alias("_t"))
    both = kv.select("key", "val", "expire_ms").join(n, "key", "full_outer")
    return both.select("key", F.coalesce("_new", "val").alias("val"), F.coalesce("_t", "expire_ms").alias("expire_ms"))
