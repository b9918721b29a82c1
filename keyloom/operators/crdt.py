"""Replicated data types as op-logs. A merge is a union of logs and a fold, so it is commutative, associative and idempotent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(*replicas: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, replicas)


def gcounter_state(ops: DataFrame) -> DataFrame:
    """(key, node, v) from increments (key, node, delta). Negative increments are an error."""
    checked = F.when(F.col("delta") < 0, F.raise_error(F.lit("a grow-only counter cannot shrink")).cast("long")).otherwise(F.col("delta"))
    return ops.groupBy("key", "node").agg(F.sum(checked).alias("v"))


def gcounter_merge(*states: DataFrame) -> DataFrame:
    """The greatest count of each node."""
    return merge(*states).groupBy("key", "node").agg(F.max("v").alias("v"))


def gcounter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg(F.sum("v").alias("value"))


def pncounter_state(ops: DataFrame) -> DataFrame:
    d = F.col("delta")
    return ops.groupBy("key", "node").agg(F.sum(F.greatest(d, F.lit(0))).alias("pos"), F.sum(F.greatest(-d, F.lit(0))).alias("neg"))


def pncounter_merge(*states: DataFrame) -> DataFrame:
    return merge(*states).groupBy("key", "node").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))


def pncounter_value(state: DataFrame) -> DataFrame:
    return state.groupBy("key").agg((F.sum("pos") - F.sum("neg")).alias("value"))


def orset_merge(*states: DataFrame) -> DataFrame:
    """(key, value, tag, origin, removed): a tag once removed stays removed."""
    return merge(*states).groupBy("key", "value", "tag", "origin").agg(F.bool_or("removed").alias("removed"))


def orset_members(state: DataFrame, distinct: bool = False) -> DataFrame:
    rows = state.where(~F.col("removed")).select("key", "value")
    return rows.distinct() if distinct else rows


def orset_remove(state: DataFrame, gone: DataFrame) -> DataFrame:
    """All observed tags of the values (key, value) removed."""
    hit = state.join(gone.select("key", "value", F.lit(True).alias("_g")).distinct(), ["key", "value"], "left")
    return hit.withColumn("removed", F.col("removed") | F.coalesce("_g", F.lit(False))).drop("_g")


def lww_merge(*states: DataFrame) -> DataFrame:
    """(key, val, ts, node): the write with the greatest time, then node."""
    order = F.struct("ts", "node")
    return merge(*states).groupBy("key").agg(F.max_by(F.struct("val", "ts", "node"), order).alias("r")).select("key", "r.*")


def vector_clock(ops: DataFrame) -> DataFrame:
    """The greatest time of each node."""
    return ops.groupBy("key", "node").agg(F.max("ts").alias("ts"))
