"""Lists: rows (key, pos, val) in the order of ``pos``, which need be neither dense nor whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import clamp_range
from keyloom.functions.ranks import numbered


def _at(rev: bool = False):
    return Window.partitionBy("key").orderBy(F.col("pos").desc() if rev else F.col("pos"))


def indexed(lst: DataFrame) -> DataFrame:
    """With ``idx`` from the head and ``len``; a list is spread over tasks by its positions."""
    return numbered(lst, ["key"], "pos", out="idx", total="len")


def llen(lst: DataFrame) -> DataFrame:
    return lst.groupBy("key").agg(F.count(F.lit(1)).alias("len"))


def lrange(lst: DataFrame, start: int, stop: int) -> DataFrame:
    if 0 <= start <= stop:  # a group limit keeps this from sorting whole lists
        return lst.withColumn("idx", F.row_number().over(_at())).where(F.col("idx") <= stop + 1).withColumn("idx", (F.col("idx") - 1).cast("long")).where(F.col("idx") >= start)
    rows = indexed(lst)
    low, high = clamp_range(F.col("len"), start, stop)
    return rows.where(F.col("idx").between(low, high)).drop("len")


def lindex(lst: DataFrame, index: int) -> DataFrame:
    rev = index < 0
    n = -index if rev else index + 1
    return lst.withColumn("_i", F.row_number().over(_at(rev))).where(F.col("_i") <= n).where(F.col("_i") == n).drop("_i")


def ltrim(lst: DataFrame, start: int, stop: int) -> DataFrame:
    return lrange(lst, start, stop).drop("idx")


def lpop(lst: DataFrame, count: int = 1, tail: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, kept)."""
    ranked = numbered(lst, ["key"], "pos", desc=tail, out="_i")
    return ranked.where(F.col("_i") < count).drop("_i"), ranked.where(F.col("_i") >= count).drop("_i")


def lpush(lst: DataFrame, new: DataFrame, tail: bool = False, only_existing: bool = False) -> DataFrame:
    """``new`` (key, ord, val) pushed one after another in the order of ``ord``, at the head or the tail."""
    ends = lst.groupBy("key").agg((F.max("pos") if tail else F.min("pos")).cast("double").alias("_e"))
    more = numbered(new, ["key"], "ord", out="_i").withColumn("_i", F.col("_i") + 1).join(ends, "key", "inner" if only_existing else "left")
    pos = F.coalesce("_e", F.lit(0.0)) + (F.col("_i") if tail else -F.col("_i"))
    return lst.select("key", F.col("pos").cast("double").alias("pos"), "val").unionByName(more.select("key", pos.alias("pos"), "val"))


def linsert(lst: DataFrame, pivot: str, value: str, before: bool = True) -> DataFrame:
    """``value`` next to the first ``pivot`` of each list that has it, halfway to its neighbour."""
    first = lst.where(F.col("val") == pivot).groupBy("key").agg(F.min("pos").cast("double").alias("_at"))
    beyond = F.col("pos") < F.col("_at") if before else F.col("pos") > F.col("_at")
    same = F.col("l.key").eqNullSafe(F.col("f.key"))
    near = lst.select("key", "pos").alias("l").join(first.alias("f"), same).where(beyond).groupBy("l.key").agg((F.max if before else F.min)("pos").cast("double").alias("_near"))
    at = F.coalesce(F.col("l._near"), F.col("f._at") + (-1.0 if before else 1.0))
    new = first.alias("f").join(near.alias("l"), same, "left").select("f.key", ((F.col("f._at") + at) / 2).alias("pos"), F.lit(value).alias("val"))
    return lst.select("key", F.col("pos").cast("double").alias("pos"), "val").unionByName(new)


def lset(lst: DataFrame, index: int, value: str) -> DataFrame:
    rows = indexed(lst)
    at = F.col("len") + index if index < 0 else F.lit(index)
    wrong = F.raise_error(F.lit("index out of range")).cast("string")
    return rows.withColumn("val", F.when((at < 0) | (at >= F.col("len")), wrong).when(F.col("idx") == at, F.lit(value)).otherwise(F.col("val"))).drop("idx", "len")


def lrem(lst: DataFrame, count: int, value: str) -> DataFrame:
    """Without the first ``count`` equal elements, the last ones if it is negative, all if it is 0."""
    if count == 0:
        return lst.where(F.col("val") != value)
    matches = numbered(lst.where(F.col("val") == value), ["key"], "pos", desc=count < 0, out="_m")
    return lst.where(F.col("val") != value).unionByName(matches.where(F.col("_m") >= abs(count)).drop("_m"))


def lpos(lst: DataFrame, value: str, rank: int = 1, count: int | None = 1, maxlen: int = 0) -> DataFrame:
    """(key, idx) of matches from the ``rank``-th on (from the tail if negative), at most ``count``, all for 0."""
    rev = rank < 0
    rows = indexed(lst)
    if maxlen:
        rows = rows.where((F.col("len") - F.col("idx") if rev else F.col("idx") + 1) <= maxlen)
    hits = numbered(rows.where(F.col("val") == value), ["key"], "idx", desc=rev, out="_m")
    hits = hits.where(F.col("_m") >= abs(rank) - 1)
    hits = hits.where(F.col("_m") < abs(rank) - 1 + count) if count else hits
    return hits.select("key", "idx")


def lmove(lst: DataFrame, source: str, destination: str, from_tail: bool = True, to_tail: bool = False) -> DataFrame:
    """One element of the source list put on the destination; the two may be the same list."""
    end = lst.where(F.col("key") == source).agg((F.max if from_tail else F.min)("pos").alias("_p"))  # one row
    marked = lst.join(F.broadcast(end))
    taken = F.coalesce((F.col("key") == source) & (F.col("pos") == F.col("_p")), F.lit(False))
    kept = marked.where(~taken).select("key", F.col("pos").cast("double").alias("pos"), "val")
    beyond = kept.where(F.col("key") == destination).agg((F.max if to_tail else F.min)("pos").alias("_e"))  # one row
    pos = F.coalesce("_e", F.lit(0.0)) + (1.0 if to_tail else -1.0)
    return kept.unionByName(marked.where(taken).join(F.broadcast(beyond)).select(F.lit(destination).alias("key"), pos.alias("pos"), "val"))


def serve(queue: DataFrame, waiters: DataFrame) -> DataFrame:
    """Blocking pops over what is there: waiters (key, client, ord) get the elements of their list one each, first come, first
    served; those beyond its end keep a null. ``streaming.jobs.blocking_pops`` is the same on a stream."""
    ranked = numbered(queue.select("key", "pos", "val"), ["key"], "pos", out="_i").drop("pos")
    return numbered(waiters, ["key"], "ord", out="_i").join(ranked, ["key", "_i"], "left").drop("_i")


def lmpop(lst: DataFrame, keys: list[str], count: int = 1, tail: bool = False) -> DataFrame:
    order = F.coalesce(*[F.when(F.col("key") == k, F.lit(i)) for i, k in enumerate(keys)])
    some = lst.where(F.col("key").isin(keys)).withColumn("_o", order)
    first = some.agg(F.min("_o").alias("_o"))
    return lpop(some.join(F.broadcast(first), "_o").drop("_o"), count, tail)[0]  # one row is broadcast
