"""Detector rules, latency reports, quotas and command logs over event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def per_tick(events: DataFrame, tick_ms: int, keys: list[str] | None = None) -> DataFrame:
    """Counts, sums and means of (ts in ms, value) per tick."""
    at = F.floor(F.col("ts") / tick_ms).cast("long").alias("tick")
    return events.groupBy(*(keys or []), at).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("peak"))


def anomalies(ticks: DataFrame, factor: float = 3.0, critical: float = 10.0, warm_up: int = 10, ring: int = 300, key: str = "key", metric: str = "mean") -> DataFrame:
    """Ticks above ``factor`` times the running mean, which includes the tick itself, with ``severity``; rows (key, tick, metric)."""
    w = Window.partitionBy(key).orderBy("tick")
    base = F.avg(metric).over(w.rowsBetween(-(ring - 1), 0))
    rows = ticks.withColumns({"age": F.row_number().over(w), "base": base})
    hit = (F.col("age") > warm_up) & (F.col(metric) > F.col("base") * factor)
    return rows.where(hit).withColumn("severity", F.when(F.col(metric) > F.col("base") * critical, "CRITICAL").otherwise("WARNING"))


def rate_alerts(ticks: DataFrame, limit: int, critical: float = 5.0) -> DataFrame:
    """Ticks with more than ``limit`` events (hot keys, evictions)."""
    return ticks.where(F.col("n") > limit).withColumn("severity", F.when(F.col("n") > limit * critical, "CRITICAL").otherwise("WARNING"))


def growth_alerts(ticks: DataFrame, share: float = 0.1, back: int = 30, warm_up: int = 300, key: str = "key", metric: str = "mean") -> DataFrame:
    """Ticks more than ``share`` above the value ``back`` ticks before (the oldest there is)."""
    w = Window.partitionBy(key).orderBy("tick")
    old = F.first(metric).over(w.rowsBetween(-(back - 1), 0))
    rows = ticks.withColumns({"age": F.row_number().over(w), "old": old})
    return rows.where((F.col("age") > warm_up) & (F.col(metric) > F.col("old") * (1 + share)))


def error_alerts(ticks: DataFrame, share: float = 0.05, critical: float = 0.2) -> DataFrame:
    """Ticks (n, errors) with too large a share of errors."""
    rate = F.col("errors") / F.col("n")
    return ticks.where(rate > share).withColumn("severity", F.when(rate > critical, "CRITICAL").otherwise("WARNING"))


def latency_report(samples: DataFrame, keep: int = 160) -> DataFrame:
    """Per event over its last ``keep`` samples (event, ts, ms): mean, least, greatest and mean absolute deviation, in whole
    numbers cut towards zero, and the greatest of all time."""
    w = Window.partitionBy("event").orderBy(F.col("ts").desc(), F.col("ms").desc())
    ring = samples.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep)
    mean = ring.groupBy("event").agg(F.floor(F.sum("ms") / F.count(F.lit(1))).cast("long").alias("avg"), F.min("ms").alias("min"), F.max("ms").alias("max"), F.count(F.lit(1)).alias("samples"))
    spread = ring.join(mean.select("event", "avg"), "event").groupBy("event").agg(F.floor(F.sum(F.abs(F.col("ms") - F.col("avg"))) / F.count(F.lit(1))).cast("long").alias("mad"))
    ever = samples.groupBy("event").agg(F.max("ms").alias("all_time_high"))
    return mean.join(spread, "event").join(ever, "event")


def latency_histogram(samples: DataFrame) -> DataFrame:
    """Per event the cumulative counts of values up to each power of two from 1024."""
    step = F.greatest(F.ceil(F.log2(F.greatest(F.col("value"), F.lit(1)).cast("double"))), F.lit(10)).cast("int")
    bins = samples.groupBy("event", step.alias("step")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("event").orderBy("step")
    return bins.select("event", F.pow(F.lit(2.0), F.col("step")).cast("long").alias("upto"), F.sum("n").over(w).alias("count"))


def slowlog(commands: DataFrame, threshold_us: int, n: int = 128) -> DataFrame:
    """The last ``n`` commands at or over a duration; rows (id, ts, us, …)."""
    return commands.where(F.col("us") >= threshold_us).orderBy(F.col("id").desc()).limit(n)


def over_quota(ops: DataFrame, per_second: int) -> DataFrame:
    """Seconds in which a namespace (ns, ts in ms) did more than it may, with how many operations to refuse."""
    g = ops.groupBy("ns", F.floor(F.col("ts") / 1000).cast("long").alias("second")).agg(F.count(F.lit(1)).alias("n"))
    return g.where(F.col("n") > per_second).withColumn("refused", F.col("n") - per_second)


def over_memory(usage: DataFrame, limits: DataFrame) -> DataFrame:
    """Namespaces (ns, key, size) at or over their limits (ns, max_bytes, max_keys), null or 0 for none: ``refused`` names the
    first limit that refuses further writes, memory before keys."""
    g = usage.groupBy("ns").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("keys")).join(limits, "ns")
    over = lambda v, m: (F.coalesce(F.col(m), F.lit(0)) > 0) & (F.col(v) >= F.col(m))
    return g.withColumn("refused", F.when(over("bytes", "max_bytes"), "memory").when(over("keys", "max_keys"), "keys")).where("refused is not null").select("ns", "bytes", "keys", "refused")


def eviction_storms(ticks: DataFrame, limit: int = 1000) -> DataFrame:
    """Ticks (n evictions) over a rate."""
    return ticks.where(F.col("n") > limit).withColumn("severity", F.lit("WARNING"))


def connection_surges(ticks: DataFrame, factor: float = 5.0, warm_up: int = 30, ring: int = 300, key: str = "key") -> DataFrame:
    """Ticks with more connections (n) than so many times their running mean, after a warm-up."""
    w = Window.partitionBy(key).orderBy("tick")
    rows = ticks.withColumns({"age": F.row_number().over(w), "base": F.avg("n").over(w.rowsBetween(-(ring - 1), 0))})
    return rows.where((F.col("age") > warm_up) & (F.col("base") > 0) & (F.col("n") > F.col("base") * factor)).withColumn("severity", F.lit("WARNING"))


def latency_history(samples: DataFrame, event: str, keep: int = 160) -> DataFrame:
    """The last ``keep`` samples (event, ts, ms) of an event."""
    return samples.where(F.col("event") == event).orderBy(F.col("ts").desc(), F.col("ms").desc()).limit(keep)


def latency_latest(samples: DataFrame) -> DataFrame:
    """Per event: time and length of its last sample, and the longest ever."""
    return samples.groupBy("event").agg(F.max("ts").alias("ts"), F.max_by("ms", F.struct("ts", "ms")).alias("last_ms"), F.max("ms").alias("max_ms"))


def percentiles(samples: DataFrame, at: list[float], exact: bool = True) -> DataFrame:
    """Per event the percentiles of ``ms``: interpolated from counted values, or estimated by a sketch of bounded size."""
    f = (lambda p: F.percentile("ms", F.lit(p))) if exact else (lambda p: F.percentile_approx("ms", F.lit(p), F.lit(10_000)))
    return samples.groupBy("event").agg(*[f(p).alias(f"p{p * 100:g}".replace(".", "_")) for p in at])


def command_stats(commands: DataFrame) -> DataFrame:
    """Calls, total and mean time per command (cmd, us)."""
    return commands.groupBy("cmd").agg(F.count(F.lit(1)).alias("calls"), F.sum("us").alias("usec"), (F.sum("us") / F.count(F.lit(1))).alias("usec_per_call"))
