"""Sets: rows (key, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sadd(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.select("key", "member").unionByName(new.select("key", "member")).distinct()


def srem(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone.select("key", "member"), ["key", "member"], "left_anti")


def smembers(s: DataFrame, key) -> DataFrame:
    return s.where(F.col("key") == key).select("member")


def scard(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count(F.lit(1)).alias("card"))


def sunion(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.where(F.col("key").isin(keys)).select("member").distinct()


def sinter(s: DataFrame, keys: list[str]) -> DataFrame:
    """One aggregation instead of a join per operand. Needs distinct (key, member) rows, as sets are."""
    g = s.where(F.col("key").isin(keys)).groupBy("member").agg(F.count(F.lit(1)).alias("_n"))
    return g.where(F.col("_n") == len(set(keys))).select("member")


def sdiff(s: DataFrame, keys: list[str]) -> DataFrame:
    first = F.col("key") == keys[0]
    g = s.where(F.col("key").isin(keys)).groupBy("member").agg(F.bool_or(first).alias("_in"), F.bool_or(~first).alias("_out"))
    return g.where("_in AND NOT _out").select("member")


def sintercard(s: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = sinter(s, keys).agg(F.count(F.lit(1)).alias("card"))
    return n.select(F.least("card", F.lit(limit)).alias("card")) if limit else n


def store(members: DataFrame, key: str) -> DataFrame:
    """The result of an operation as a set of its own, for a union with the table or a snapshot."""
    return members.select(F.lit(key).alias("key"), "member")


def put(s: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """The table with a set's members replaced by a result; an empty result leaves no such set."""
    return s.where(F.col("key") != key).select("key", "member").unionByName(store(members, key))


def smismember(s: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (key, member) with ``is_member`` 0 or 1."""
    hit = s.select("key", "member").distinct().withColumn("_hit", F.lit(1))
    return probes.join(hit, ["key", "member"], "left").withColumn("is_member", F.coalesce("_hit", F.lit(0))).drop("_hit")


def smove(s: DataFrame, source: str, destination: str, member) -> DataFrame:
    """The set with ``member`` under the destination if the source held it."""
    moved = F.when((F.col("key") == source) & (F.col("member") == member), F.lit(destination)).otherwise(F.col("key"))
    return s.select(moved.alias("key"), "member").distinct()


def srandmember(s: DataFrame, count: int, seed: int = 0) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "member"), "member")
    return s.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def spop(s: DataFrame, count: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    popped = srandmember(s, count, seed)
    return popped, srem(s, popped)
