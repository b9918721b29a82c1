"""Time series: rows (series, ts, value) with ``ts`` in milliseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.ranks import beside, running


def ts_range(samples: DataFrame, start: int, end: int, limit: int | None = None) -> DataFrame:
    rows = samples.where(F.col("ts").between(start, end))
    return rows if limit is None else rows.orderBy("series", "ts").limit(limit)


def ts_aggregate(samples: DataFrame, start: int, end: int, kind: str, series: DataFrame | None = None) -> DataFrame:
    """One number per series over an inclusive range; 0.0 for a series of ``series`` without samples in it."""
    f = {"AVG": F.avg, "SUM": F.sum, "MIN": F.min, "MAX": F.max, "COUNT": F.count}[kind.upper()]
    out = ts_range(samples, start, end).groupBy("series").agg(f("value").cast("double").alias("value"))
    if series is None:
        return out
    return series.join(out, "series", "left").withColumn("value", F.coalesce("value", F.lit(0.0)))


def ts_retain(samples: DataFrame, retention_ms: int) -> DataFrame:
    """Samples not older than the retention before the last one of their series."""
    last = samples.groupBy("series").agg(F.max("ts").alias("_last"))
    return samples.join(last, "series").where(F.col("ts") >= F.col("_last") - retention_ms).drop("_last")


def ts_del(samples: DataFrame, series: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Without a series, or without its samples in an inclusive range."""
    gone = F.col("series") == series
    gone = gone & (F.col("ts") >= start) if start is not None else gone
    return samples.where(~(gone & (F.col("ts") <= end) if end is not None else gone))


def ts_add(samples: DataFrame, new: DataFrame, retention_ms: int | None = None) -> DataFrame:
    """Samples with new ones; of two at one time the new one stays, and with a retention old ones go."""
    both = samples.join(new.select("series", "ts"), ["series", "ts"], "left_anti").select("series", "ts", "value").unionByName(new.select("series", "ts", "value"))
    return both if retention_ms is None else ts_retain(both, retention_ms)


def ts_buckets(samples: DataFrame, width_ms: int) -> DataFrame:
    """All five aggregates per series and time bucket."""
    at = (F.floor(F.col("ts") / width_ms) * width_ms).cast("long").alias("bucket")
    return samples.groupBy("series", at).agg(F.count("value").alias("n"), F.avg("value").alias("avg"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max"))


def delta_encode(samples: DataFrame, resolution: float = 0.001) -> DataFrame:
    """Differences of rounded values as zigzag whole numbers."""
    rows = beside(samples.withColumn("_q", F.round(F.col("value") / resolution).cast("long")), ["series"], "ts", "_q", "_prior")
    d = F.col("_q") - F.coalesce("_prior", F.lit(0))
    return rows.withColumn("delta", F.when(d >= 0, d * 2).otherwise(-d * 2 - 1)).drop("_q", "_prior")


def delta_decode(encoded: DataFrame, resolution: float = 0.001) -> DataFrame:
    d = F.when(F.col("delta") % 2 == 0, F.floor(F.col("delta") / 2)).otherwise(-F.floor((F.col("delta") + 1) / 2))
    return running(encoded, ["series"], "ts", d, "_sum").withColumn("value", F.col("_sum") * resolution).drop("_sum")
