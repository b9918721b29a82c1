"""Places, neighbours and running sums within keys without a task per key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BUCKETS = 1024


def _bucketed(df: DataFrame, by: str) -> DataFrame:
    """Append ``_b``, a bucket of one width of the range of ``by`` over all rows. It follows from the least and greatest value
    alone, so it is the same whenever a lost task is run again. Nulls come before all numbers and what is not finite beyond
    them, as in the order itself."""
    value = F.col(by).cast("double")
    finite = F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    ends = df.agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))  # one row
    share = F.try_divide(value - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    inside = F.coalesce(F.least(F.floor(share * _BUCKETS), F.lit(_BUCKETS - 1)), F.lit(0))
    bucket = F.when(value.isNull(), -2).when(F.isnan(value), _BUCKETS + 1).when(value == float("inf"), _BUCKETS).when(value == -float("inf"), -1).otherwise(inside)
    return df.join(F.broadcast(ends)).withColumn("_b", bucket.cast("int")).drop("_lo", "_hi")


def _with(rows: DataFrame, of_bucket: DataFrame, keys: list[str], *columns: str) -> DataFrame:
    """Rows with columns of their key's bucket; null keys are keys."""
    on = reduce(Column.__and__, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in [*keys, "_b"]])
    return rows.alias("l").join(of_bucket.alias("r"), on).select("l.*", *[f"r.{c}" for c in columns])


def _order(by: str, then: list[str] | None, desc: bool) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c) for c in [by, *(then or [])]]


def numbered(df: DataFrame, keys: list[str], by: str, then: list[str] | None = None, desc: bool = False, out: str = "idx", total: str | None = None) -> DataFrame:
    """Append ``out``, the 0-based place of each row among those of its keys in the order of ``by`` (a number), then ``then``, and
    with ``total`` how many there are.

    Rows are dealt by keys and bucket, counted by bucket (with partial sums, so a hot key costs a row per task and bucket), and
    a row's place is what lies in the buckets before, at most a thousand rows to sum up, and its place in its own. So a key is
    spread over as many tasks as its values are; only rows whose values stand very close together share one."""
    rows = _bucketed(df, by)
    counts = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_c"))
    side = F.col("_b").desc() if desc else F.col("_b")
    w = Window.partitionBy(*keys)
    before = counts.select(*keys, "_b", (F.sum("_c").over(w.orderBy(side)) - F.col("_c")).alias("_before"), F.sum("_c").over(w).alias("_all"))
    at = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(*_order(by, then, desc))) - 1
    ranked = _with(rows, before, keys, "_before", "_all").withColumn(out, (at + F.col("_before")).cast("long"))
    return (ranked.withColumn(total, F.col("_all")) if total else ranked).drop("_b", "_before", "_all")


def beside(df: DataFrame, keys: list[str], by: str, value: str, out: str, then: list[str] | None = None, desc: bool = False) -> DataFrame:
    """Append ``out``, what ``value`` is in the row before, among those of the same keys in the order of ``by`` (a number), then
    ``then``: null in the first, and with ``desc`` that of the row after. Dealt as in ``numbered``: the first row of a bucket takes
    what the last one of the nearest bucket before has."""
    rows = _bucketed(df, by)
    place = F.struct(by, *(then or []))
    last = rows.groupBy(*keys, "_b").agg((F.min_by if desc else F.max_by)(F.struct(F.col(value).alias("v")), place).alias("_last"))
    side = F.col("_b").desc() if desc else F.col("_b")
    before = last.select(*keys, "_b", F.lag("_last").over(Window.partitionBy(*keys).orderBy(side)).alias("_before"))
    w = Window.partitionBy(*keys, "_b").orderBy(*_order(by, then, desc))
    near = F.coalesce(F.lag(F.struct(F.col(value).alias("v"))).over(w), F.col("_before"))
    return _with(rows, before, keys, "_before").withColumn(out, near["v"]).drop("_b", "_before")


def running(df: DataFrame, keys: list[str], by: str, value: Column, out: str, then: list[str] | None = None) -> DataFrame:
    """Append ``out``, the sum of ``value`` up to and with each row, in the order of ``by`` (a number), then ``then``; dealt as in
    ``numbered``."""
    rows = _bucketed(df.withColumn("_v", value), by)
    w = Window.partitionBy(*keys)
    sums = rows.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = sums.select(*keys, "_b", F.sum("_s").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    own = F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(*_order(by, then, False)).rowsBetween(Window.unboundedPreceding, 0))
    return _with(rows, before, keys, "_before").withColumn(out, F.coalesce(own + F.col("_before"), own, F.col("_before"))).drop("_b", "_before", "_v")
