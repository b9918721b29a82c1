"""Publish and subscribe: subscriptions (client, kind, pattern) against messages (channel, …)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.exprs import glob, glob_regex


def deliver(messages: DataFrame, subscriptions: list[tuple[str, str, str]]) -> DataFrame:
    """Each message once per subscription that it reaches: exact channels by a join, patterns (a stated list) by expression.

    Kinds: channel, pattern, shard; messages with ``sharded`` true reach shard subscriptions only."""
    spark = messages.sparkSession
    exact = [(c, k == "shard", p) for c, k, p in subscriptions if k != "pattern"]
    subs = spark.createDataFrame(exact, "client string, sharded boolean, channel string")
    msgs = messages if "sharded" in messages.columns else messages.withColumn("sharded", F.lit(False))
    out = msgs.join(F.broadcast(subs), ["channel", "sharded"]).withColumn("via", F.col("channel"))  # as long as the argument
    patterns = [(c, p) for c, k, p in subscriptions if k == "pattern"]
    if patterns:
        hits = F.array_compact(F.array(*[F.when(glob(F.col("channel"), p), F.struct(F.lit(c).alias("client"), F.lit(p).alias("via"))) for c, p in patterns]))
        some = msgs.where(~F.col("sharded")).withColumn("_h", F.explode(hits)).select(*msgs.columns, F.col("_h.client").alias("client"), F.col("_h.via").alias("via"))
        out = out.unionByName(some)
    return out


def deliver_all(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """The same with a table of subscriptions (client, kind, pattern) of any length.

    Channels are joined as they are. A pattern is joined by its literal head, the characters before its first wildcard: a message
    is looked up once for each length of head that there is, and only then matched. A head of length 0 meets all messages, as
    such a pattern may match any."""
    msgs = messages if "sharded" in messages.columns else messages.withColumn("sharded", F.lit(False))
    exact = subscriptions.where("kind <> 'pattern'").select("client", (F.col("kind") == "shard").alias("sharded"), F.col("pattern").alias("channel"))
    out = msgs.join(exact, ["channel", "sharded"]).withColumn("via", F.col("channel"))
    to_regex = F.udf(glob_regex, "string")  # of each distinct pattern, once
    patterns = subscriptions.where("kind = 'pattern'").select("client", F.col("pattern").alias("via"))
    each = patterns.select("via").distinct().select("via", F.regexp_extract("via", r"^[^*?\[\\]*", 0).alias("_head"), to_regex("via").alias("_re")).withColumn("_len", F.length("_head"))
    lengths = sorted(r[0] for r in each.select("_len").distinct().collect())  # a number for each length of head
    if not lengths:
        return out
    heads = F.explode(F.array(*[F.struct(F.lit(n).alias("_len"), F.substring("channel", 1, n).alias("_head")) for n in lengths])).alias("_h")
    looked = msgs.where(~F.col("sharded")).select(*msgs.columns, heads).select(*msgs.columns, "_h._len", "_h._head")
    hits = looked.join(each, ["_len", "_head"]).where(F.expr("channel rlike _re")).join(patterns, "via")
    return out.unionByName(hits.select(*out.columns))


def deliver_counts(messages: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(client, channel, via, n): how many messages each subscription gets, by ``deliver_all`` of one row per channel, which carries
    its number of messages. So no message meets its subscribers one by one, and rows grow with channels and subscriptions only."""
    keys = ["channel", *(["sharded"] if "sharded" in messages.columns else [])]
    counted = messages.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return deliver_all(counted, subscriptions).groupBy("client", "channel", "via").agg(F.sum("_n").alias("n"))


def unsubscribe(subscriptions: DataFrame, gone: DataFrame) -> DataFrame:
    """Subscriptions without those named by ``gone`` (client, kind, pattern); a null pattern stands for all of that kind."""
    named = subscriptions.join(gone.where("pattern is not null"), ["client", "kind", "pattern"], "left_anti")
    return named.join(gone.where("pattern is null").select("client", "kind"), ["client", "kind"], "left_anti").select(*subscriptions.columns)


def invalidations(access: DataFrame, prefixes: DataFrame | None = None, no_loop: bool = False) -> DataFrame:
    """(client, key, ts) of the messages that tell clients to forget what they read: rows of ``access`` are (client, key, ts, write).

    The first write of a key after a client read it tells that client, once; after that it must read again to be told.
    Clients that named ``prefixes`` (client, prefix) are told of every write of a key that begins with one. With ``no_loop``
    a client is not told of its own writes."""
    w = Window.partitionBy("key").orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, -1)  # what comes later, summed up once
    at = F.struct("ts", F.col("client").alias("writer"))
    told = access.withColumn("_w", F.min(F.when(F.col("write"), at)).over(w)).where(~F.col("write") & F.col("_w").isNotNull())
    out = told.select("client", "key", F.col("_w.ts").alias("ts"), F.col("_w.writer").alias("_by"))
    if prefixes is not None:
        # Keys are looked up by their beginnings of the lengths that prefixes have.
        lengths = sorted(r[0] for r in prefixes.select(F.length("prefix")).distinct().collect())
        writes = access.where("write").select(F.col("client").alias("_by"), "key", "ts", F.explode(F.array_distinct(F.array(*[F.substring("key", 1, n) for n in lengths]))).alias("prefix"))
        out = out.unionByName(writes.join(prefixes, "prefix").select("client", "key", "ts", "_by"))
    return (out.where(F.col("client") != F.col("_by")) if no_loop else out).select("client", "key", "ts").distinct()


def numsub(subscriptions: DataFrame, kind: str = "channel") -> DataFrame:
    """Subscribers of each channel (``shard``: of each shard channel)."""
    return subscriptions.where(F.col("kind") == kind).groupBy(F.col("pattern").alias("channel")).agg(F.countDistinct("client").alias("n"))


def numpat(subscriptions: DataFrame) -> DataFrame:
    return subscriptions.where("kind = 'pattern'").agg(F.countDistinct("pattern").alias("n"))


def channels(subscriptions: DataFrame, pattern: str = "*", kind: str = "channel") -> DataFrame:
    return subscriptions.where(F.col("kind") == kind).where(glob(F.col("pattern"), pattern)).select(F.col("pattern").alias("channel")).distinct()


def keyspace_events(log: DataFrame) -> DataFrame:
    """The two channels that each change (db, key, event) is announced on."""
    both = F.explode(F.array(F.struct(F.concat(F.lit("__keyspace@"), F.col("db").cast("string"), F.lit("__:"), F.col("key")).alias("channel"), F.col("event").alias("message")), F.struct(F.concat(F.lit("__keyevent@"), F.col("db").cast("string"), F.lit("__:"), F.col("event")).alias("channel"), F.col("key").alias("message"))))
    return log.select("*", both.alias("_b")).select(*log.columns, "_b.channel", "_b.message")
