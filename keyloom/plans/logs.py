"""Queries of streams, time series, replicated types, pub/sub and detector rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import crdt, observability, pubsub, scripting, streams, timeseries
from keyloom.plans.base import SAMPLES, STREAM, samples, stream
from keyloom.plans.registry import query
from keyloom.sources.tables import read


def _middle(spark, d) -> tuple[int, int]:
    r = read(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("m")).agg(F.min("m").alias("a"), F.max("m").alias("b")).first()
    return r.a + (r.b - r.a) // 4, r.b - (r.b - r.a) // 4


MIDDLE = "m AS (SELECT min((epoch_us(ts) // 1000)) + (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) // 4 AS a, max((epoch_us(ts) // 1000)) - (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) // 4 AS b FROM events)"
S = "key, ms, event_id, user_id, seq"


@query("stream_range", f"WITH {STREAM}, {MIDDLE} SELECT {S} FROM stream, m WHERE ms BETWEEN a AND b")
def stream_range(spark, d):
    a, b = _middle(spark, d)
    return streams.xrange(stream(spark, d), str(a), str(b))


@query("stream_revrange", f"WITH {STREAM}, {MIDDLE}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS i FROM stream, m WHERE ms <= b) SELECT {S} FROM r WHERE i <= 5")
def stream_revrange(spark, d):
    return streams.xrange(stream(spark, d), "-", str(_middle(spark, d)[1]), count=5, rev=True)


@query("stream_len", f"WITH {STREAM} SELECT key, count(*) AS len FROM stream GROUP BY key")
def stream_len(spark, d):
    return streams.xlen(stream(spark, d))


@query("stream_trim_maxlen", f"WITH {STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS i FROM stream) SELECT {S} FROM r WHERE i <= 100")
def stream_trim_maxlen(spark, d):
    return streams.xtrim(stream(spark, d), maxlen=100)


@query("stream_trim_minid", f"WITH {STREAM}, {MIDDLE} SELECT {S} FROM stream, m WHERE ms >= a")
def stream_trim_minid(spark, d):
    return streams.xtrim(stream(spark, d), minid=str(_middle(spark, d)[0]))


@query("stream_info", f"WITH {STREAM} SELECT key, count(*) AS length, min((ms, seq)).ms AS first_ms, min((ms, seq)).seq AS first_seq, max((ms, seq)).ms AS last_ms, max((ms, seq)).seq AS last_seq FROM (SELECT key, {{'ms': ms, 'seq': seq}} AS i FROM stream) t(key, i) GROUP BY key".replace("min((ms, seq))", "min(i)").replace("max((ms, seq))", "max(i)"))
def stream_info(spark, d):
    return streams.xinfo_stream(stream(spark, d))


@query("stream_del", f"WITH {STREAM} SELECT {S} FROM stream WHERE event_id % 10 <> 0")
def stream_del(spark, d):
    s = stream(spark, d)
    return streams.xdel(s, s.where("event_id % 10 = 0"))


@query("stream_read", f"WITH {STREAM}, {MIDDLE}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM stream, m WHERE ms > a OR ms = a AND seq > 0) SELECT {S} FROM r WHERE i <= 20")
def stream_read(spark, d):
    s = stream(spark, d)
    after = s.select("key").distinct().withColumns({"last_ms": F.lit(_middle(spark, d)[0]), "last_seq": F.lit(0).cast("long")})
    return streams.xread(s, after, count=20)


@query("stream_add_ids", f"WITH {STREAM} SELECT {S} FROM stream UNION ALL SELECT key, max(ms) + 1, -1, -1, 0 FROM stream GROUP BY key")
def stream_add_ids(spark, d):
    s = stream(spark, d)
    new = s.groupBy("key").agg((F.max("ms") + 1).alias("ms")).select("key", "ms", F.lit(-1).cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit(0).cast("long").alias("seq"))
    return streams.xadd(s, new)


def _groups(spark, d):
    a, _ = _middle(spark, d)
    s = stream(spark, d)
    first = s.where(F.col("ms") <= a).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    g = s.select("key").distinct().join(first, "key", "left").select("key", F.lit("g").alias("grp"), F.lit(a).alias("last_ms"), F.lit((1 << 62)).alias("last_seq"), F.coalesce("n", F.lit(0)).cast("long").alias("entries_read"))
    return s, g


GROUP = f"{STREAM}, {MIDDLE}, del AS (SELECT *, CASE (row_number() OVER (PARTITION BY key ORDER BY ms, seq) - 1) % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS consumer FROM stream, m WHERE ms > a)"


@query("group_read", f"WITH {GROUP} SELECT {S}, 'g' AS grp, consumer FROM del")
def group_read(spark, d):
    s, g = _groups(spark, d)
    return streams.xreadgroup(s, g, ["x", "y", "z"])[0]


@query("group_pending", f"WITH {GROUP}, p AS (SELECT key, {{'ms': ms, 'seq': seq}} AS i, consumer FROM del WHERE event_id % 4 <> 0) SELECT key, 'g' AS grp, count(*) AS pending, min(i).ms AS min_ms, min(i).seq AS min_seq, max(i).ms AS max_ms, max(i).seq AS max_seq, count(DISTINCT consumer) AS consumers FROM p GROUP BY key")
def group_pending(spark, d):
    s, g = _groups(spark, d)
    delivered, pending, _ = streams.xreadgroup(s, g, ["x", "y", "z"])
    return streams.xpending(streams.xack(pending, delivered.where("event_id % 4 = 0"))).withColumn("pending", F.col("pending").cast("long"))


@query("group_lag", f"WITH {STREAM}, {MIDDLE} SELECT key, 'g' AS grp, count(*) FILTER (WHERE ms > a) AS lag, count(*) FILTER (WHERE ms <= a) AS entries_read FROM stream, m GROUP BY key")
def group_lag(spark, d):
    s, g = _groups(spark, d)
    none = spark.createDataFrame([], "key string, grp string, ms long, seq long, consumer string")
    return streams.xinfo_groups(s, g, none).select("key", "grp", "lag", "entries_read")


@query("group_claim", f"WITH {GROUP} SELECT key, count(*) FILTER (WHERE event_id % 2 = 0 OR consumer = 'x') AS mine, count(*) FILTER (WHERE event_id % 2 = 0) AS again FROM del GROUP BY key")
def group_claim(spark, d):
    s, g = _groups(spark, d)
    delivered = streams.xreadgroup(s, g, ["x", "y", "z"])[0]
    pending = delivered.select("key", "grp", "ms", "seq", "consumer", F.lit(1).alias("delivery_count"), F.when(F.col("event_id") % 2 == 0, 1000).otherwise(5000).cast("long").alias("delivery_ms"))
    out = streams.xclaim(pending, "x", 6000, 2000)
    return out.groupBy("key").agg(F.count_if(F.col("consumer") == "x").alias("mine"), F.count_if(F.col("delivery_count") == 2).alias("again"))


@query("stream_backpressure", "WITH o AS (SELECT event_type AS stream, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events) SELECT stream, least(count(*), 50) AS taken, greatest(count(*) - 50, 0) AS dropped FROM o GROUP BY stream")
def stream_backpressure(spark, d):
    ops = read(spark, d, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("ord"), F.lit("add").alias("op"), F.lit(1).alias("n"))
    return streams.backpressure(ops, "DROP", 50).groupBy("stream").agg(F.count_if(F.col("result") == 0).alias("taken"), F.count_if(F.col("result") == 1).alias("dropped"))


# -- time series


@query("ts_range", f"WITH {SAMPLES}, {MIDDLE} SELECT samples.* FROM samples, m WHERE ts BETWEEN a AND b")
def ts_range(spark, d):
    return timeseries.ts_range(samples(spark, d), *_middle(spark, d))


@query("ts_aggregate", f"WITH {SAMPLES}, {MIDDLE} SELECT series, CAST(coalesce(sum(value) FILTER (WHERE ts BETWEEN a AND b), 0) AS DOUBLE) AS value FROM samples, m GROUP BY series")
def ts_aggregate(spark, d):
    s = samples(spark, d)
    return timeseries.ts_aggregate(s, *_middle(spark, d), "SUM", s.select("series").distinct())


@query("ts_buckets", f"WITH {SAMPLES} SELECT series, ts // 3600000 * 3600000 AS bucket, count(*) AS n, round(avg(value), 6) AS avg, CAST(sum(value) AS BIGINT) AS sum, min(value) AS min, max(value) AS max FROM samples GROUP BY 1, 2")
def ts_buckets(spark, d):
    return timeseries.ts_buckets(samples(spark, d), 3_600_000).withColumn("avg", F.round("avg", 6))


@query("ts_retention", f"WITH {SAMPLES} SELECT series, ts, value, event_id, user_id FROM (SELECT *, max(ts) OVER (PARTITION BY series) AS last FROM samples) WHERE ts >= last - 86400000")
def ts_retention(spark, d):
    return timeseries.ts_retain(samples(spark, d), 86_400_000)


# -- replicated types


def _ops(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("key"), (F.col("user_id") % 3).alias("node"), (F.col("event_id") % 13).alias("delta"), F.col("event_id").alias("ts"), "user_id")


@query("crdt_gcounter", "SELECT event_type AS key, CAST(sum(event_id % 13) AS BIGINT) AS value FROM events GROUP BY 1")
def crdt_gcounter(spark, d):
    a = crdt.gcounter_state(_ops(spark, d))
    return crdt.gcounter_value(crdt.gcounter_merge(a, a.where("node <> 1"), a))


@query("crdt_pncounter", "SELECT event_type AS key, CAST(sum(event_id % 13 - 6) AS BIGINT) AS value FROM events GROUP BY 1")
def crdt_pncounter(spark, d):
    a = crdt.pncounter_state(_ops(spark, d).withColumn("delta", F.col("delta") - 6))
    return crdt.pncounter_value(crdt.pncounter_merge(a.where("node <> 2"), a))


@query("crdt_orset", "SELECT DISTINCT event_type AS key, user_id AS value FROM events WHERE event_id % 5 <> 0")
def crdt_orset(spark, d):
    state = _ops(spark, d).select("key", F.col("user_id").alias("value"), F.col("ts").alias("tag"), F.col("node").alias("origin"), F.lit(False).alias("removed"))
    gone = state.where("tag % 5 = 0").withColumn("removed", F.lit(True))
    return crdt.orset_members(crdt.orset_merge(state, gone, state), distinct=True)


@query("crdt_lww", "SELECT event_type AS key, max_by(user_id, event_id) AS val, max(event_id) AS ts, max_by(user_id % 3, event_id) AS node FROM events GROUP BY 1")
def crdt_lww(spark, d):
    w = _ops(spark, d).select("key", F.col("user_id").alias("val"), "ts", "node")
    return crdt.lww_merge(w.where("ts % 2 = 0"), w, w.where("ts % 2 = 1"))


@query("crdt_vector_clock", "SELECT event_type AS key, user_id % 3 AS node, max(event_id) AS ts FROM events GROUP BY 1, 2")
def crdt_vector_clock(spark, d):
    return crdt.vector_clock(_ops(spark, d))


# -- pub/sub


SUBS = [("c1", "channel", "src1"), ("c1", "pattern", "src1*"), ("c2", "pattern", "src?"), ("c3", "channel", "src7"), ("c4", "shard", "src1"), ("c5", "pattern", "*")]


@query("pubsub_deliver", "WITH s(client, test) AS (VALUES ('c1', 'src1'), ('c1', 'src1.*'), ('c2', 'src.'), ('c3', 'src7'), ('c5', '.*')) SELECT client, source AS channel, count(*) AS n FROM documents JOIN s ON regexp_full_match(source, test) GROUP BY 1, 2")
def pubsub_deliver(spark, d):
    messages = read(spark, d, "documents").select(F.col("source").alias("channel"), "doc_id")
    return pubsub.deliver(messages, SUBS).groupBy("client", "channel").agg(F.count(F.lit(1)).alias("n"))


@query("pubsub_numsub", "SELECT event_type AS channel, count(DISTINCT user_id) AS n FROM events GROUP BY 1")
def pubsub_numsub(spark, d):
    subs = read(spark, d, "events").select(F.col("user_id").alias("client"), F.lit("channel").alias("kind"), F.col("event_type").alias("pattern"))
    return pubsub.numsub(subs)


@query("pubsub_keyspace", "SELECT '__keyspace@0__:' || user_id AS channel, event_type AS message, event_id FROM events UNION ALL SELECT '__keyevent@0__:' || event_type, CAST(user_id AS VARCHAR), event_id FROM events")
def pubsub_keyspace(spark, d):
    log = read(spark, d, "events").select(F.lit(0).alias("db"), F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("event"), "event_id")
    return pubsub.keyspace_events(log).select("channel", "message", "event_id")


# -- detector rules and reports


TICKS = f"{SAMPLES}, t AS (SELECT series AS key, ts // 3600000 AS tick, count(*) AS n, avg(value) AS mean FROM samples GROUP BY 1, 2)"


def _ticks(spark, d):
    return observability.per_tick(samples(spark, d).withColumnRenamed("series", "key"), 3_600_000, ["key"])


@query("anomaly_latency", f"WITH {TICKS}, b AS (SELECT *, row_number() OVER w AS age, avg(mean) OVER (PARTITION BY key ORDER BY tick ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS base FROM t WINDOW w AS (PARTITION BY key ORDER BY tick)) SELECT key, tick, n, CASE WHEN mean > base * 2.5 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM b WHERE age > 10 AND mean > base * 1.5")
def anomaly_latency(spark, d):
    return observability.anomalies(_ticks(spark, d), factor=1.5, critical=2.5).select("key", "tick", "n", "severity")


@query("anomaly_hot", f"WITH {TICKS} SELECT key, tick, n, CASE WHEN n > 10 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM t WHERE n > 2")
def anomaly_hot(spark, d):
    return observability.rate_alerts(_ticks(spark, d), 2).select("key", "tick", "n", "severity")


@query("latency_report", "WITH s AS (SELECT event_type AS event, event_id AS ts, CAST(round(value * 100) AS BIGINT) AS ms FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY ts DESC, ms DESC) AS i FROM s), k AS (SELECT *, sum(ms) OVER (PARTITION BY event) // count(*) OVER (PARTITION BY event) AS a FROM r WHERE i <= 160) SELECT event, CAST(any_value(a) AS BIGINT) AS avg, min(ms) AS min, max(ms) AS max, count(*) AS samples, CAST(sum(abs(ms - a)) // count(*) AS BIGINT) AS mad, (SELECT max(ms) FROM s WHERE s.event = k.event) AS all_time_high FROM k GROUP BY event")
def latency_report(spark, d):
    s = samples(spark, d)
    return observability.latency_report(s.select(F.col("series").alias("event"), F.col("event_id").alias("ts"), F.col("value").alias("ms")))


@query("latency_histogram", "WITH s AS (SELECT event_type AS event, CAST(round(value * 10000) AS BIGINT) AS v FROM events), b AS (SELECT event, greatest(10, length(bin(greatest(v, 1) - 1)) + CASE WHEN v <= 1 THEN -1 ELSE 0 END) AS step, count(*) AS n FROM s GROUP BY 1, 2) SELECT event, CAST(1 AS BIGINT) << step AS upto, CAST(sum(n) OVER (PARTITION BY event ORDER BY step) AS BIGINT) AS count FROM b")
def latency_histogram(spark, d):
    return observability.latency_histogram(read(spark, d, "events").select(F.col("event_type").alias("event"), F.round(F.col("value") * 10000).cast("long").alias("value")))


@query("slowlog", "SELECT event_id AS id, CAST(round(value * 100) AS BIGINT) AS us FROM events WHERE CAST(round(value * 100) AS BIGINT) >= 5000 ORDER BY event_id DESC LIMIT 128")
def slowlog(spark, d):
    return observability.slowlog(samples(spark, d).select(F.col("event_id").alias("id"), F.col("value").alias("us")), 5000)


@query("command_stats", "SELECT event_type AS cmd, count(*) AS calls, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS usec, round(CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) / count(*), 6) AS usec_per_call FROM events GROUP BY 1")
def command_stats(spark, d):
    return observability.command_stats(samples(spark, d).select(F.col("series").alias("cmd"), F.col("value").alias("us"))).withColumn("usec_per_call", F.round("usec_per_call", 6))


@query("quota_refusals", "WITH g AS (SELECT event_type AS ns, (epoch_us(ts) // 1000) // 1000 AS second, count(*) AS n FROM events GROUP BY 1, 2) SELECT ns, second, n, n - 1 AS refused FROM g WHERE n > 1")
def quota_refusals(spark, d):
    return observability.over_quota(samples(spark, d).select(F.col("series").alias("ns"), "ts"), 1)


# -- functions and transactions


@query("function_call", "SELECT event_id, lpad(event_type, 12, '.') AS padded, translate(event_type, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS toggled FROM events")
def function_call(spark, d):
    import string

    f = scripting.Functions()
    f.load("text", {"leftpad": lambda c: F.lpad(c, 12, "."), "toggle": lambda c: F.translate(c, string.ascii_letters, string.ascii_letters.swapcase())}, read_only=("leftpad", "toggle"))
    return read(spark, d, "events").select("event_id", f.call("leftpad", F.col("event_type")).alias("padded"), f.call("toggle", F.col("event_type"), read_only=True).alias("toggled"))


@query("transaction_exec", "SELECT user_id AS tx, max(event_id) % 2 = 0 AS done FROM events GROUP BY 1")
def transaction_exec(spark, d):
    e = read(spark, d, "events")
    log = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("val"))
    last = log.groupBy("key").agg(F.max("version").alias("version"))
    watches = last.select(F.col("key").alias("tx"), "key", F.when(F.col("version") % 2 == 0, F.col("version")).otherwise(0).alias("version"))
    batch = last.select(F.col("key").alias("tx"), "key", (F.col("version") + 1).alias("version"), F.lit("new").alias("val"))
    return scripting.execute(log, batch, watches)[1]
