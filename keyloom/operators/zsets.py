"""Ordered sets: rows (key, member, score), ordered by score, then by the member's bytes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import clamp_range, lex_range, score_range
from keyloom.functions.ranks import numbered


def _window(rev: bool = False):
    order = [F.col("score").desc(), F.col("member").desc()] if rev else [F.col("score").asc(), F.col("member").asc()]
    return Window.partitionBy("key").orderBy(*order)


def zadd(z: DataFrame, new: DataFrame, nx: bool = False, xx: bool = False, gt: bool = False, lt: bool = False, incr: bool = False, order: str | None = None) -> DataFrame:
    """The set with rows of ``new`` put in, and columns ``added`` and ``changed``. Of several rows for a member the last by the
    column ``order`` counts; without one, several rows are an error."""
    if order is None:
        several = F.raise_error(F.concat(F.lit("several rows for a member: "), F.col("member").cast("string"))).cast("double")
        n = new.groupBy("key", "member").agg(F.first("score").alias("_s"), F.count(F.lit(1)).alias("_n"))
        n = n.select("key", "member", F.when(F.col("_n") > 1, several.cast(new.schema["score"].dataType)).otherwise(F.col("_s")).alias("_new"))
    else:
        n = new.groupBy("key", "member").agg(F.max_by("score", order).alias("_new"))
    both = z.select("key", "member", F.col("score").alias("_old")).join(n, ["key", "member"], "full_outer")
    old, fresh = F.col("_old"), F.col("_new")
    value = F.coalesce(old, F.lit(0.0)) + fresh if incr else fresh
    ok = fresh.isNotNull() & ~F.isnan(value)
    ok = ok & old.isNull() if nx else ok
    ok = ok & old.isNotNull() if xx else ok
    ok = ok & (old.isNull() | (value > old)) if gt else ok
    ok = ok & (old.isNull() | (value < old)) if lt else ok
    score = F.when(ok, value).otherwise(old)
    return both.select("key", "member", score.alias("score"), (old.isNull() & ok).alias("added"), (ok & (old.isNull() | (old != score))).alias("changed")).where("score is not null")


def zincrby(deltas: DataFrame) -> DataFrame:
    """Scores as sums of increments (key, member, delta)."""
    return deltas.groupBy("key", "member").agg(F.sum("delta").alias("score"))


def zcard(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count(F.lit(1)).alias("card"))


def zcount(z: DataFrame, low="-inf", high="+inf") -> DataFrame:
    return z.groupBy("key").agg(F.count_if(score_range(F.col("score"), low, high)).alias("n"))


def zlexcount(z: DataFrame, low: str = "-", high: str = "+") -> DataFrame:
    return z.groupBy("key").agg(F.count_if(lex_range(F.col("member"), low, high)).alias("n"))


def zrank(z: DataFrame, rev: bool = False) -> DataFrame:
    """0-based ranks of all members; a key is spread over tasks by its scores."""
    return numbered(z, ["key"], "score", ["member"], desc=rev, out="rank")


def ztop(z: DataFrame, k: int, rev: bool = True) -> DataFrame:
    """The first k of each key. The rank filter becomes a group limit before the shuffle, so no key is sorted whole."""
    return z.withColumn("rank", F.row_number().over(_window(rev))).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


def zrange(z: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    """Members by rank, ends inclusive, negative ends from the tail."""
    if 0 <= start <= stop:
        return ztop(z, stop + 1, rev).where(F.col("rank") >= start)
    if start < 0 and stop < 0:  # the same rows counted from the other end
        sizes = z.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
        back = ztop(z, -start, not rev).where(F.col("rank") >= -stop - 1).join(sizes, "key")
        return back.withColumn("rank", (F.col("_n") - 1 - F.col("rank")).cast("long")).drop("_n")
    sized = numbered(z, ["key"], "score", ["member"], desc=rev, out="rank", total="_n")
    low, high = clamp_range(F.col("_n"), start, stop)
    return sized.where(F.col("rank").between(low, high)).drop("_n")


def _limited(df: DataFrame, rev: bool, offset: int, count: int | None) -> DataFrame:
    if not offset and count is None:
        return df
    at = F.row_number().over(_window(rev))
    df = df.withColumn("_at", at).where(F.col("_at") > offset)
    return (df if count is None or count < 0 else df.where(F.col("_at") <= offset + count)).drop("_at")


def zrangebyscore(z: DataFrame, low="-inf", high="+inf", offset: int = 0, count: int | None = None, rev: bool = False) -> DataFrame:
    return _limited(z.where(score_range(F.col("score"), low, high)), rev, offset, count)


def zrangebylex(z: DataFrame, low: str = "-", high: str = "+", offset: int = 0, count: int | None = None, rev: bool = False) -> DataFrame:
    return _limited(z.where(lex_range(F.col("member"), low, high)), rev, offset, count)


def zpop(z: DataFrame, count: int = 1, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(popped, kept)."""
    popped = ztop(z, count, highest).drop("rank")
    return popped, z.join(popped.select("key", "member"), ["key", "member"], "left_anti")


def zmpop(z: DataFrame, keys: list[str], count: int = 1, highest: bool = False) -> DataFrame:
    """What the first key in the list that has members gives up."""
    order = F.coalesce(*[F.when(F.col("key") == k, F.lit(i)) for i, k in enumerate(keys)])
    some = z.where(F.col("key").isin(keys)).withColumn("_i", order)
    first = some.agg(F.min("_i").alias("_i"))
    return ztop(some.join(F.broadcast(first), "_i").drop("_i"), count, highest).drop("rank")  # one row is broadcast


def zrem(z: DataFrame, members: DataFrame) -> DataFrame:
    return z.join(members.select("key", "member"), ["key", "member"], "left_anti")


def zremrangebyscore(z: DataFrame, low="-inf", high="+inf") -> DataFrame:
    return z.where(~score_range(F.col("score"), low, high))


def zremrangebylex(z: DataFrame, low: str = "-", high: str = "+") -> DataFrame:
    return z.where(~lex_range(F.col("member"), low, high))


def zremrangebyrank(z: DataFrame, start: int, stop: int) -> DataFrame:
    sized = numbered(z, ["key"], "score", ["member"], out="rank", total="_n")
    low, high = clamp_range(F.col("_n"), start, stop)
    return sized.where(~F.col("rank").between(low, high)).drop("_n", "rank")


def zmscore(z: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (key, member) with their scores, null where absent."""
    return probes.join(z.select("key", "member", "score"), ["key", "member"], "left")


def zrandmember(z: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """``count`` distinct members of each key in a seeded order; a negative count draws with replacement."""
    if count >= 0:
        w = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "member"), "member")
        return z.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")
    n = z.groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    draws = n.select("key", "_n", F.explode(F.sequence(F.lit(1), F.lit(-count))).alias("draw")).withColumn("rank", F.pmod(F.xxhash64(F.lit(seed), "key", "draw"), F.col("_n")))
    return draws.select("key", "draw", "rank").join(zrank(z), ["key", "rank"]).drop("rank")


def _operands(z: DataFrame, keys: list[str], weights: list[float] | None) -> DataFrame:
    """The rows of the operands with weighted scores; a product that is not a number counts as 0."""
    some = z.where(F.col("key").isin(keys))
    weight = F.coalesce(*[F.when(F.col("key") == k, F.lit(float(w))) for k, w in zip(keys, weights or [1.0] * len(keys), strict=True)])
    return some.withColumn("score", F.nanvl(F.col("score").cast("double") * weight, F.lit(0.0)))


def _merged(aggregate: str):
    return {"SUM": F.nanvl(F.sum("score"), F.lit(0.0)), "MIN": F.min("score"), "MAX": F.max("score")}[aggregate.upper()]


def zunion(z: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """(member, score): partial sums before one shuffle."""
    return _operands(z, keys, weights).groupBy("member").agg(_merged(aggregate).alias("score"))


def zinter(z: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    g = _operands(z, keys, weights).groupBy("member").agg(_merged(aggregate).alias("score"), F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_n") == len(set(keys))).drop("_n")


def zdiff(z: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first key in none of the others, in one shuffle."""
    first = F.col("key") == keys[0]
    g = z.where(F.col("key").isin(keys)).groupBy("member").agg(F.max(F.when(first, F.col("score"))).alias("score"), F.count_if(~first).alias("_n"))
    return g.where(F.col("score").isNotNull() & (F.col("_n") == 0)).drop("_n")


def zintercard(z: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = zinter(z, keys).agg(F.count(F.lit(1)).alias("card"))
    return n.select(F.least("card", F.lit(limit)).alias("card")) if limit else n


def store(df: DataFrame, key: str) -> DataFrame:
    """The result of an operator under a key of its own."""
    return df.withColumn("key", F.lit(key)).select("key", *[c for c in df.columns if c != "key"])


def zsum_range(z: DataFrame, low="-inf", high="+inf") -> DataFrame:
    return z.groupBy("key").agg(F.sum(F.when(score_range(F.col("score"), low, high), F.col("score"))).alias("total"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
