"""Hashes: rows (key, field, val, field_expire_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import expire_applies, lit, live, ttl_code


def live_fields(h: DataFrame, now_ms) -> DataFrame:
    return h.where(live(F.col("field_expire_ms"), now_ms))


def hset(h: DataFrame, new: DataFrame, only_new: bool = False, only_old: bool = False) -> DataFrame:
    """(key, field, val, field_expire_ms, added). A written field loses its time; ``new`` has one row per field."""
    n = new.select("key", "field", F.col("val").alias("_new"), F.lit(True).alias("_w"))
    both = h.select("key", "field", F.col("val").alias("_old"), "field_expire_ms", F.lit(True).alias("_o")).join(n, ["key", "field"], "full_outer")
    ok = F.coalesce(F.col("_w"), F.lit(False))
    ok = ok & F.col("_o").isNull() if only_new else ok
    ok = ok & F.col("_o").isNotNull() if only_old else ok
    out = both.select("key", "field", F.when(ok, F.col("_new")).otherwise(F.col("_old")).alias("val"), F.when(~ok, F.col("field_expire_ms")).alias("field_expire_ms"), (ok & F.col("_o").isNull()).alias("added"), F.col("_o"))
    return out.where(F.col("_o").isNotNull() | F.col("added")).drop("_o")


def hsetex(h: DataFrame, new: DataFrame, expire_ms: int | None = None, all_new: bool = False, all_old: bool = False, keep_ttl: bool = False) -> DataFrame:
    """``new`` with a time, for the keys where all (``all_new``: none) of its fields exist already."""
    have = new.join(h.select("key", "field", F.lit(1).alias("_h")), ["key", "field"], "left").groupBy("key").agg(F.count("_h").alias("_h"), F.count(F.lit(1)).alias("_n"))
    good = have.where(F.col("_h") == 0) if all_new else have.where(F.col("_h") == F.col("_n")) if all_old else have
    pick = new.join(good.select("key"), "key", "left_semi")
    out = hset(h, pick).drop("added").join(pick.select("key", "field", F.lit(True).alias("_w")), ["key", "field"], "left")
    time = F.lit(expire_ms).cast("long")
    if keep_ttl:
        old = h.select("key", "field", F.col("field_expire_ms").alias("_t"))
        return out.join(old, ["key", "field"], "left").withColumn("field_expire_ms", F.coalesce("field_expire_ms", "_t")).drop("_t", "_w")
    return out.withColumn("field_expire_ms", F.when(F.col("_w"), time).otherwise(F.col("field_expire_ms"))).drop("_w")


def hdel(h: DataFrame, gone: DataFrame) -> DataFrame:
    return h.join(gone.select("key", "field"), ["key", "field"], "left_anti")


def hmget(h: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (key, field, …) with ``val``, null where absent."""
    return probes.join(h.select("key", "field", "val"), ["key", "field"], "left")


def hgetall(h: DataFrame) -> DataFrame:
    """One map per key."""
    return h.groupBy("key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "val")))).alias("fields"))


def hlen(h: DataFrame) -> DataFrame:
    return h.groupBy("key").agg(F.count(F.lit(1)).alias("len"))


def hstrlen(h: DataFrame) -> DataFrame:
    return h.withColumn("length", F.coalesce(F.octet_length("val"), F.lit(0)).cast("long"))


def hincrby(deltas: DataFrame, kind: str = "long") -> DataFrame:
    return deltas.groupBy("key", "field").agg(F.sum(F.col("delta").cast(kind)).alias("val"))


def hrandfield(h: DataFrame, count: int, seed: int = 0) -> DataFrame:
    w = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed), "key", "field"), "field")
    return h.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= count).drop("_r")


def hexpire(h: DataFrame, probes: DataFrame, now_ms: int, expire_ms: int, flag: str | None = None) -> DataFrame:
    """Probes (key, field) with ``code``, 2 for a field that goes because the time is past, 1 set, 0 refused, -2 no such field,
    and the field's time afterwards."""
    t = lit(expire_ms).cast("long")
    both = probes.join(h.select("key", "field", "field_expire_ms", F.lit(True).alias("_o")), ["key", "field"], "left")
    ok = expire_applies(F.col("field_expire_ms"), t, flag)
    code = F.when(F.col("_o").isNull(), -2).when(~ok, 0).when(t <= now_ms, 2).otherwise(1)
    out = both.withColumn("code", code)
    return out.withColumn("field_expire_ms", F.when(F.col("code") == 1, t).when(F.col("code") == 0, F.col("field_expire_ms"))).drop("_o")


def httl(h: DataFrame, probes: DataFrame, now_ms: int, millis: bool = False) -> DataFrame:
    both = probes.join(live_fields(h, now_ms).select("key", "field", "field_expire_ms", F.lit(True).alias("_o")), ["key", "field"], "left")
    return both.withColumn("ttl", ttl_code(F.col("_o").isNotNull(), F.col("field_expire_ms"), now_ms, millis)).drop("_o", "field_expire_ms")


def hpersist(h: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes with ``code``: 1 the time went, -1 there was none, -2 no such field."""
    both = probes.join(h.select("key", "field", "field_expire_ms", F.lit(True).alias("_o")), ["key", "field"], "left")
    return both.withColumn("code", F.when(F.col("_o").isNull(), -2).when(F.col("field_expire_ms").isNull(), -1).otherwise(1)).drop("_o", "field_expire_ms")
