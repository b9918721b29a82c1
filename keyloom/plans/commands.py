"""Queries of the commands that have no other query: deletions, stores, paging, groups, configuration, scripts, profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.exprs import hamming
from keyloom.operators import bitmaps, geo, hashes, keyspace, lists, observability, pubsub, scripting, sets, sketches, streams, strings, timeseries, vectors, zsets
from keyloom.plans.base import DAYS, FIELDS, HISTORY, NAMES, POINTS, SAMPLES, SPEND, STREAM, USERS, days, distance_sql, fields, history, names, points, samples, spend, stream, users
from keyloom.plans.registry import query
from keyloom.sources.tables import dump, keyspace as whole_space, read, restore


def _named(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("val"))


def _owing(spark, d):
    return read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("key"))


# -- strings and keys


@query("string_getdel", "SELECT c_custkey AS key, c_name AS val, c_acctbal < 0 AS taken FROM customer")
def string_getdel(spark, d):
    taken, left = keyspace.take(_named(spark, d), _owing(spark, d), ["key"])
    return taken.withColumn("taken", F.lit(True)).unionByName(left.withColumn("taken", F.lit(False)))


@query("string_delifeq", "SELECT s_suppkey AS key, s_name AS val FROM supplier WHERE NOT (s_suppkey = 3 AND s_name = 'Supplier#000000003')")
def string_delifeq(spark, d):
    kv = read(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("val"))
    return strings.delifeq(strings.delifeq(kv, 3, "Supplier#000000003"), 4, "another value")


@query("string_msetnx", "SELECT c_custkey AS key, c_name AS val FROM customer UNION ALL SELECT -1 - s_suppkey, s_name FROM supplier")
def string_msetnx(spark, d):
    kv, s = _named(spark, d), read(spark, d, "supplier")
    both = strings.msetnx(kv, s.select((-1 - F.col("s_suppkey")).alias("key"), F.col("s_name").alias("val")))
    return strings.msetnx(both, s.select("s_suppkey", F.lit("refused").alias("val")).withColumnRenamed("s_suppkey", "key"))


@query("string_setex", "SELECT c_custkey AS key, CASE WHEN c_acctbal < 0 THEN 'due' ELSE c_name END AS val, CASE WHEN c_acctbal < 0 THEN 1060000 ELSE c_custkey * 10 END AS expire_ms FROM customer")
def string_setex(spark, d):
    kv = _named(spark, d).withColumn("expire_ms", F.col("key") * 10)
    return strings.setex(kv, _owing(spark, d).withColumn("val", F.lit("due")), 1_000_000, 60_000)


@query("string_incrbyfloat", "SELECT l_returnflag || l_linestatus AS key, round(sum(l_quantity * 0.25), 2) AS val FROM lineitem GROUP BY 1")
def string_incrbyfloat(spark, d):
    deltas = read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("key"), (F.col("l_quantity") * 0.25).alias("delta"))
    return strings.incrbyfloat(deltas).withColumn("val", F.round("val", 2))


@query("keys_del", "SELECT c_custkey AS key, c_name AS val FROM customer WHERE NOT c_acctbal < 0")
def keys_del(spark, d):
    return keyspace.delete(_named(spark, d), _owing(spark, d))


SPACE = "space AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 10 END AS expire_ms, c_custkey * 7 AS access_ms, c_acctbal < 0 AS owing FROM customer)"


def _space(spark, d):
    return read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 10).alias("expire_ms"), (F.col("c_custkey") * 7).alias("access_ms"))


@query("keys_persist", f"WITH {SPACE} SELECT key, CASE WHEN NOT owing THEN expire_ms END AS expire_ms, access_ms FROM space")
def keys_persist(spark, d):
    return keyspace.persist(_space(spark, d), _owing(spark, d))


@query("keys_touch", f"WITH {SPACE} SELECT key, expire_ms, CASE WHEN owing THEN 999 ELSE access_ms END AS access_ms FROM space")
def keys_touch(spark, d):
    return keyspace.touch(_space(spark, d), _owing(spark, d), 999)


@query("keys_idle", f"WITH {SPACE} SELECT key, expire_ms, access_ms, (100000000 - access_ms) // 1000 AS idle_s FROM space")
def keys_idle(spark, d):
    return keyspace.idle_times(_space(spark, d), 100_000_000)


@query("keys_type", "SELECT 'c' || c_custkey AS key, 'string' AS type, CAST(NULL AS BIGINT) AS expire_ms FROM customer UNION ALL SELECT DISTINCT 'u' || user_id, 'list', CAST(NULL AS BIGINT) FROM events UNION ALL SELECT DISTINCT c_mktsegment, 'zset', CAST(NULL AS BIGINT) FROM customer JOIN orders ON o_custkey = c_custkey")
def keys_type(spark, d):
    text = lambda t, p: t.withColumn("key", F.concat(F.lit(p), F.col("key").cast("string")))
    return whole_space(string=text(_named(spark, d), "c"), list=text(history(spark, d), "u"), zset=spend(spark, d))


@query("keys_dbsize", "SELECT 'string' AS type, (SELECT count(*) FROM customer WHERE c_custkey % 4 = 0 OR c_custkey * 10 >= 500) AS keys")
def keys_dbsize(spark, d):
    return keyspace.dbsize(_space(spark, d).withColumn("type", F.lit("string")), 500)


@query("keys_random", "SELECT 1 AS one")
def keys_random(spark, d):
    return keyspace.random_key(_named(spark, d), seed=3).select(F.lit(1).alias("one"))


@query("keys_encoding", "WITH s AS (SELECT event_type AS key, count(DISTINCT user_id) AS n FROM events GROUP BY 1) SELECT key, n, CASE WHEN n <= 128 THEN 'listpack' ELSE 'hashtable' END AS encoding FROM s")
def keys_encoding(spark, d):
    s = read(spark, d, "events").groupBy(F.col("event_type").alias("key")).agg(F.countDistinct("user_id").alias("n"), F.max(F.length(F.col("user_id").cast("string"))).alias("longest"))
    return s.select("key", "n", keyspace.encoding("set", F.col("n"), F.col("longest")).alias("encoding"))


@query("keys_renamenx", f"WITH {USERS}, {DAYS} SELECT CASE WHEN key = a THEN 'new' ELSE key END AS key, member FROM users, days")
def keys_renamenx(spark, d):
    a, b, _ = days(spark, d)
    return keyspace.rename(keyspace.rename(users(spark, d), a, "new", nx=True), "new", b, nx=True)


@query("keys_move", "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 3 ELSE 0 END AS db, o_orderpriority AS key, o_orderkey AS val FROM orders")
def keys_move(spark, d):
    t = read(spark, d, "orders").select(F.lit(0).alias("db"), F.col("o_orderpriority").alias("key"), F.col("o_orderkey").alias("val"))
    return keyspace.move(keyspace.move(t, "1-URGENT", 0, 3), "no such key", 0, 3)


@query("keys_dump_restore", "SELECT c_custkey AS key, c_name, c_acctbal, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def keys_dump_restore(spark, d):
    t = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_acctbal", F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    return restore(dump(t), "c_name string, c_acctbal double, c_mktsegment string")


#: CRC-16 bit by bit over the bytes of an ASCII string without braces.
CRC = "list_reduce(list_prepend(0, list_transform(range(0, 8 * length({0})), lambda i: (ascii(substr({0}, CAST(i // 8 + 1 AS BIGINT), 1)) >> CAST(7 - i % 8 AS INTEGER)) & 1)), lambda c, b: xor((c << 1) & 65535, xor((c >> 15) & 1, b) * 4129))"
SLOT = f"CAST(({CRC}) % 16384 AS INTEGER)"


@query("keys_slots", f"SELECT c_name, {SLOT.format('c_name')} AS slot FROM customer")
def keys_slots(spark, d):
    from keyloom.functions.exprs import key_slot

    return read(spark, d, "customer").select("c_name", key_slot(F.col("c_name")).alias("slot"))


@query("keys_slot_stats", f"SELECT {SLOT.format('c_name')} AS slot, count(*) AS key_count, CAST(sum(c_custkey) AS BIGINT) AS reads FROM customer GROUP BY 1 ORDER BY reads DESC, slot LIMIT 20")
def keys_slot_stats(spark, d):
    return keyspace.slot_stats(read(spark, d, "customer").select(F.col("c_name").alias("key"), F.col("c_custkey").alias("reads")), "reads", 20)


@query("keys_profile", "WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'list' ELSE 'set' END AS type, user_id AS key, length(event_type) AS size, CASE WHEN user_id % 3 = 0 THEN user_id * 10 END AS expire_ms FROM events), k AS (SELECT type, key, count(*) AS n, sum(size) AS bytes, max(size) AS largest, max(expire_ms) AS expire_ms FROM e GROUP BY 1, 2) SELECT type, count(*) AS keys, CAST(sum(n) AS BIGINT) AS elements, CAST(sum(length(CAST(key AS VARCHAR))) AS BIGINT) AS key_bytes, CAST(sum(bytes) AS BIGINT) AS element_bytes, max(largest) AS largest_element, max(n) AS most_elements, count(expire_ms) AS with_time, count(*) FILTER (WHERE expire_ms < 300) AS expired FROM k GROUP BY type")
def keys_profile(spark, d):
    e = read(spark, d, "events").select(F.when(F.col("user_id") % 2 == 0, "list").otherwise("set").alias("type"), F.col("user_id").alias("key"), F.octet_length("event_type").cast("long").alias("size"), F.when(F.col("user_id") % 3 == 0, F.col("user_id") * 10).alias("expire_ms"))
    return keyspace.profile(e, 300)


# -- lists, sets, ordered sets, hashes


@query("list_move", f"WITH {HISTORY}, e AS (SELECT min(user_id) AS a, max(user_id) AS b FROM events), t AS (SELECT key, pos, val FROM hist, e WHERE NOT (key = a AND idx = len - 1) UNION ALL SELECT b, -1, val FROM hist, e WHERE key = a AND idx = len - 1) SELECT key, val, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx FROM t")
def list_move(spark, d):
    r = read(spark, d, "events").agg(F.min("user_id").alias("a"), F.max("user_id").alias("b")).first()
    return lists.indexed(lists.lmove(history(spark, d), r.a, r.b)).select("key", "val", "idx")


@query("list_mpop", f"WITH {HISTORY} SELECT key, pos, val FROM hist WHERE key = (SELECT min(user_id) FROM events) AND idx >= len - 3")
def list_mpop(spark, d):
    a = read(spark, d, "events").agg(F.min("user_id")).first()[0]
    return lists.lmpop(history(spark, d), [-5, a], 3, tail=True)


@query("list_serve", "WITH p AS (SELECT event_type AS key, event_id AS val, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS i FROM events), c AS (SELECT event_type AS key, user_id AS client, event_id AS ord FROM events WHERE value < 10), w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord) AS i FROM c) SELECT w.key, client, ord, val FROM w LEFT JOIN p ON p.key = w.key AND p.i = w.i")
def list_serve(spark, d):
    e = read(spark, d, "events")
    queue = e.select(F.col("event_type").alias("key"), F.col("event_id").alias("pos"), F.col("event_id").alias("val"))
    waiters = e.where("value < 10").select(F.col("event_type").alias("key"), F.col("user_id").alias("client"), F.col("event_id").alias("ord"))
    return lists.serve(queue, waiters)


@query("set_members", f"WITH {USERS}, {DAYS} SELECT member FROM users, days WHERE key = a")
def set_members(spark, d):
    return sets.smembers(users(spark, d), days(spark, d)[0])


@query("set_store", f"WITH {USERS}, {DAYS}, i AS (SELECT member FROM users, days WHERE key IN (a, b) GROUP BY member HAVING count(*) = 2) SELECT key, member FROM users, days WHERE key <> b UNION ALL SELECT b, member FROM i, days")
def set_store(spark, d):
    a, b, _ = days(spark, d)
    s = users(spark, d)
    return sets.put(s, sets.sinter(s, [a, b]), b)


@query("set_rand_sizes", f"WITH {USERS} SELECT key, least(count(*), 3) AS n FROM users GROUP BY key")
def set_rand_sizes(spark, d):
    return sets.srandmember(users(spark, d), 3, seed=2).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("set_scan", f"WITH {USERS}, {DAYS} SELECT key, member FROM users, days WHERE key = a AND member > 2 ORDER BY member LIMIT 10")
def set_scan(spark, d):
    return keyspace.scan_members(users(spark, d), days(spark, d)[0], after=2)


@query("zset_rem", f"WITH {SPEND} SELECT key, member, score FROM spend WHERE member NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def zset_rem(spark, d):
    z = spend(spark, d)
    gone = read(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("member"))
    return zsets.zrem(z, gone)


@query("zset_remrangebylex", f"WITH {NAMES} SELECT key, member FROM names WHERE NOT (member >= 'Supplier#000000003' AND member < 'Supplier#00000006')")
def zset_remrangebylex(spark, d):
    return zsets.zremrangebylex(names(spark, d), "[Supplier#000000003", "(Supplier#00000006").select("key", "member")


@query("zset_revrangebylex", f"WITH {NAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) AS i FROM names) SELECT key, member FROM r WHERE i = 2")
def zset_revrangebylex(spark, d):
    return zsets.zrangebylex(names(spark, d), offset=1, count=1, rev=True).select("key", "member")


@query("zset_scan", f"WITH {SPEND} SELECT key, member, score FROM spend WHERE key = 'BUILDING' AND member > 20 ORDER BY member LIMIT 15")
def zset_scan(spark, d):
    return keyspace.scan_members(spend(spark, d), "BUILDING", after=20, count=15)


@query("zset_rand_sizes", f"WITH {SPEND} SELECT key, least(count(*), 4) AS n, CAST(7 AS BIGINT) AS drawn FROM spend GROUP BY key")
def zset_rand_sizes(spark, d):
    z = spend(spark, d)
    few = zsets.zrandmember(z, 4, seed=5).groupBy("key").agg(F.countDistinct("member").alias("n"))
    return few.join(zsets.zrandmember(z, -7, seed=5).groupBy("key").agg(F.count(F.lit(1)).alias("drawn")), "key")


@query("zset_add_ordered", "SELECT event_type AS key, user_id AS member, max_by(CAST(round(value * 100) AS BIGINT), event_id) AS score, true AS added, true AS changed FROM events GROUP BY 1, 2")
def zset_add_ordered(spark, d):
    new = samples(spark, d).select(F.col("series").alias("key"), F.col("user_id").alias("member"), F.col("value").alias("score"), "event_id")
    return zsets.zadd(new.drop("event_id").limit(0), new, order="event_id")


@query("hash_getall", f"WITH {FIELDS} SELECT key, string_agg(field || '=' || val, ',' ORDER BY field) AS text FROM fields GROUP BY key")
def hash_getall(spark, d):
    h = hashes.hgetall(fields(spark, d))
    return h.select("key", F.array_join(F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("text"))


OWN = "own AS (SELECT c_custkey AS key, f AS field FROM customer, (VALUES ('c_nationkey'), ('nothing')) t(f) WHERE c_acctbal < 0)"


def _own(spark, d):
    return _owing(spark, d).select("key", F.explode(F.array(F.lit("c_nationkey"), F.lit("nothing"))).alias("field"))


@query("hash_setex", f"WITH {FIELDS}, {OWN} SELECT coalesce(f.key, o.key) AS key, coalesce(f.field, o.field) AS field, CASE WHEN o.key IS NULL THEN val ELSE 'x' END AS val, CASE WHEN o.key IS NULL THEN field_expire_ms ELSE 1500000 END AS field_expire_ms FROM fields f FULL JOIN own o ON f.key = o.key AND f.field = o.field")
def hash_setex(spark, d):
    return hashes.hsetex(fields(spark, d), _own(spark, d).withColumn("val", F.lit("x")), 1_500_000)


@query("hash_setex_fxx", f"WITH {FIELDS} SELECT key, field, val, field_expire_ms FROM fields")
def hash_setex_fxx(spark, d):
    return hashes.hsetex(fields(spark, d), _own(spark, d).withColumn("val", F.lit("x")), 1_500_000, all_old=True)


@query("hash_getdel", f"WITH {FIELDS}, {OWN} SELECT key, field, val FROM fields JOIN own USING (key, field)")
def hash_getdel(spark, d):
    return keyspace.take(fields(spark, d), _own(spark, d), ["key", "field"])[0].select("key", "field", "val")


@query("hash_rand_sizes", f"WITH {FIELDS} SELECT key, CAST(2 AS BIGINT) AS n FROM fields GROUP BY key")
def hash_rand_sizes(spark, d):
    return hashes.hrandfield(fields(spark, d), 2, seed=1).groupBy("key").agg(F.countDistinct("field").alias("n"))


@query("hash_scan", f"WITH {FIELDS} SELECT field, val FROM fields WHERE key = 5 AND field LIKE 'c_n%' ORDER BY field LIMIT 10")
def hash_scan(spark, d):
    return keyspace.scan_members(fields(spark, d), 5, "field", match="c_n*").select("field", "val")


@query("hash_incrbyfloat", "SELECT l_returnflag AS key, l_linestatus AS field, round(sum(l_quantity * 0.5), 2) AS val FROM lineitem GROUP BY 1, 2")
def hash_incrbyfloat(spark, d):
    deltas = read(spark, d, "lineitem").select(F.col("l_returnflag").alias("key"), F.col("l_linestatus").alias("field"), (F.col("l_quantity") * 0.5).alias("delta"))
    return hashes.hincrby(deltas, "double").withColumn("val", F.round("val", 2))


# -- streams and groups

PEL = f"{STREAM}, p AS (SELECT key, 'g' AS grp, ms, seq, event_id, CASE event_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS consumer, CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 5000 END AS delivery_ms FROM stream WHERE event_id % 5 <> 0)"


def _pending(spark, d):
    s = stream(spark, d)
    who = F.when(F.col("event_id") % 3 == 0, "x").when(F.col("event_id") % 3 == 1, "y").otherwise("z")
    when = F.when(F.col("event_id") % 2 == 0, 1000).otherwise(5000).cast("long")
    return s, s.where("event_id % 5 <> 0").select("key", F.lit("g").alias("grp"), "ms", "seq", who.alias("consumer"), F.lit(1).alias("delivery_count"), when.alias("delivery_ms"))


@query("group_own", f"WITH {PEL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM p WHERE consumer = 'x') SELECT key, grp, ms, seq, CASE WHEN event_id % 7 <> 0 THEN event_id END AS event_id FROM r WHERE i <= 50")
def group_own(spark, d):
    s, p = _pending(spark, d)
    left = streams.xdel(s, s.where("event_id % 7 = 0"))
    return streams.xreadgroup_own(left, p, "x", count=50).select("key", "grp", "ms", "seq", "event_id")


@query("group_read_count", f"WITH {STREAM}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) - 1 AS i FROM stream) SELECT key, ms, seq, 'g' AS grp, CASE i % 2 WHEN 0 THEN 'x' ELSE 'y' END AS consumer FROM r WHERE i < 9")
def group_read_count(spark, d):
    s = stream(spark, d)
    zero = F.lit(0).cast("long")
    g = s.select("key").distinct().select("key", F.lit("g").alias("grp"), zero.alias("last_ms"), zero.alias("last_seq"), zero.alias("entries_read"))
    return streams.xreadgroup(s, g, ["x", "y"], count=9)[0].select("key", "ms", "seq", "grp", "consumer")


MID = "m AS (SELECT min(epoch_us(ts) // 1000) + (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) // 2 AS mid FROM events)"


def _mid(spark, d) -> int:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    r = read(spark, d, "events").agg(F.min(ms).alias("a"), F.max(ms).alias("b")).first()
    return r.a + (r.b - r.a) // 2


@query("group_pending_range", f"WITH {PEL}, {MID}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM p, m WHERE consumer = 'y' AND ms > mid AND 6000 - delivery_ms >= 2000) SELECT key, grp, ms, seq, consumer, CAST(6000 - delivery_ms AS BIGINT) AS idle FROM r WHERE i <= 12")
def group_pending_range(spark, d):
    _, p = _pending(spark, d)
    return streams.xpending_range(p, 6000, 2000, "y", 12, start=str(_mid(spark, d) + 1)).select("key", "grp", "ms", "seq", "consumer", "idle")


PAGE = f"{PEL}, s AS (SELECT *, event_id % 7 = 0 AS gone, event_id % 7 <> 0 AND 6000 - delivery_ms >= 2000 AS take, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM p), c AS (SELECT *, sum(CASE WHEN gone OR take THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY ms, seq) - CASE WHEN gone OR take THEN 1 ELSE 0 END AS before FROM s), g AS (SELECT *, i <= 200 AND before < 20 AS page FROM c)"


def _page(spark, d):
    s, p = _pending(spark, d)
    return streams.xautoclaim_page(p, streams.xdel(s, s.where("event_id % 7 = 0")), "w", 6000, 2000, count=20)


@query("group_autoclaim", f"WITH {PAGE} SELECT key, ms, seq, CASE WHEN page AND take THEN 'w' ELSE consumer END AS consumer, CASE WHEN page AND take THEN 2 ELSE 1 END AS delivery_count FROM g WHERE NOT (page AND gone)")
def group_autoclaim(spark, d):
    return _page(spark, d)[0].select("key", "ms", "seq", "consumer", "delivery_count")


@query("group_autoclaim_deleted", f"WITH {PAGE} SELECT key, ms, seq FROM g WHERE page AND gone")
def group_autoclaim_deleted(spark, d):
    return _page(spark, d)[2].select("key", "ms", "seq")


@query("group_autoclaim_cursor", f"WITH {PAGE}, n AS (SELECT key, min({{'ms': ms, 'seq': seq}}) FILTER (WHERE NOT page) AS c FROM g GROUP BY key) SELECT key, coalesce(c.ms, 0) AS ms, coalesce(c.seq, 0) AS seq FROM n")
def group_autoclaim_cursor(spark, d):
    return _page(spark, d)[3].select("key", "ms", "seq")


@query("group_consumers", f"WITH {PEL} SELECT key, consumer, count(*) AS pending, CAST(6000 - max(delivery_ms) AS BIGINT) AS idle FROM p GROUP BY 1, 2 UNION ALL SELECT DISTINCT key, 'new', 0, 900 FROM p")
def group_consumers(spark, d):
    _, p = _pending(spark, d)
    named = p.select("key", "grp").distinct().select("key", "grp", F.lit("new").alias("consumer"), F.lit(5100).cast("long").alias("seen_ms"))
    return streams.xinfo_consumers(p, 6000, named).select("key", "consumer", "pending", "idle")


@query("group_delconsumer", f"WITH {PEL} SELECT key, ms, seq, consumer FROM p WHERE NOT (key = (SELECT min(event_type) FROM events) AND consumer = 'z')")
def group_delconsumer(spark, d):
    _, p = _pending(spark, d)
    return streams.xgroup_delconsumer(p, read(spark, d, "events").agg(F.min("event_type")).first()[0], "g", "z").select("key", "ms", "seq", "consumer")


@query("group_create", "WITH s AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = (SELECT min(event_type) FROM events)) SELECT key, 'late' AS grp, max(ms) AS last_ms, count(*) AS entries_read FROM s GROUP BY key UNION ALL SELECT DISTINCT key, 'set', 5, 2 FROM s")
def group_create(spark, d):
    s = stream(spark, d)
    key = read(spark, d, "events").agg(F.min("event_type")).first()[0]
    none = spark.createDataFrame([], "key string, grp string, last_ms long, last_seq long, entries_read long")
    three = none
    for name, at in (("late", "$"), ("set", "0"), ("gone", "0")):
        three = streams.xgroup_create(three, s, key, name, at)
    left, _ = streams.xgroup_destroy(streams.xgroup_setid(three, key, "set", "5-1", 2), s.withColumns({"grp": F.lit("g")}), key, "gone")
    return left.select("key", "grp", "last_ms", "entries_read")


def _deleted(spark, d):
    """Streams of which every tenth entry in the first half was deleted, and the first hundred were trimmed."""
    s, at = stream(spark, d), _mid(spark, d)
    gone = s.where(F.col("ms") < at).where("event_id % 10 = 0")
    left = streams.xdel(s, gone)
    return left, gone, s


HALF = f"{STREAM}, {MID}, gone AS (SELECT stream.* FROM stream, m WHERE ms < mid AND event_id % 10 = 0), kept AS (SELECT * FROM stream ANTI JOIN gone USING (key, ms, seq))"


@query("stream_state", f"WITH {HALF}, a AS (SELECT key, min({{'ms': ms, 'seq': seq}}) AS f, count(*) AS length FROM kept GROUP BY key), b AS (SELECT key, max({{'ms': ms, 'seq': seq}}) AS l, count(*) AS n FROM stream GROUP BY key), c AS (SELECT key, max({{'ms': ms, 'seq': seq}}) AS d FROM gone GROUP BY key) SELECT b.key, length, f.ms AS first_ms, f.seq AS first_seq, l.ms AS last_ms, l.seq AS last_seq, d.ms AS max_deleted_ms, d.seq AS max_deleted_seq, n AS entries_added FROM b LEFT JOIN a USING (key) LEFT JOIN c USING (key)")
def stream_state(spark, d):
    left, gone, _ = _deleted(spark, d)
    return streams.xstate(left, gone)


@query("stream_setid", "SELECT event_type AS key, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 9000000000000 ELSE max(epoch_us(ts) // 1000) END AS last_ms, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1000000 ELSE count(*) END AS entries_added FROM events GROUP BY 1")
def stream_setid(spark, d):
    key = read(spark, d, "events").agg(F.min("event_type")).first()[0]
    left, gone = streams.xtrim_split(stream(spark, d), 1_000_000)  # XSETID refuses a counter below a stream's length; what was added stays counted
    return streams.xsetid(streams.xstate(left, trimmed=gone), key, "9000000000000-0", 1_000_000).select("key", "last_ms", "entries_added")


LAGS = f"{HALF}, d AS (SELECT key, max({{'ms': ms, 'seq': seq}}) AS del FROM gone GROUP BY key), n AS (SELECT key, count(*) AS added FROM stream GROUP BY key)"


@query("group_lag_deleted", f"WITH {LAGS} SELECT key, 'start' AS grp, CASE WHEN del IS NULL THEN added END AS lag FROM n LEFT JOIN d USING (key) UNION ALL SELECT key, 'half', count(*) FILTER (WHERE ms > mid) FROM stream, m GROUP BY key UNION ALL SELECT key, 'end', 0 FROM n")
def group_lag_deleted(spark, d):
    left, gone, s = _deleted(spark, d)
    at, zero = _mid(spark, d), F.lit(0).cast("long")
    read_ = s.groupBy("key").agg(F.count_if(F.col("ms") <= at).alias("half"), F.count(F.lit(1)).alias("all"), F.max(F.struct("ms", "seq")).alias("l"))
    g = [
        read_.select("key", F.lit("start").alias("grp"), F.lit(1).cast("long").alias("last_ms"), zero.alias("last_seq"), zero.alias("entries_read")),
        read_.select("key", F.lit("half").alias("grp"), F.lit(at).alias("last_ms"), F.lit(1 << 62).alias("last_seq"), F.col("half").alias("entries_read")),
        read_.select("key", F.lit("end").alias("grp"), F.col("l.ms").alias("last_ms"), F.col("l.seq").alias("last_seq"), F.lit(None).cast("long").alias("entries_read")),
    ]
    none = spark.createDataFrame([], "key string, grp string, ms long, seq long, consumer string")
    return streams.xinfo_groups(left, g[0].unionByName(g[1]).unionByName(g[2]), none, streams.xstate(left, gone)).select("key", "grp", "lag")


@query("stream_backpressure_info", "SELECT event_type AS stream, least(count(*), 40) AS done, count(*) - least(count(*), 40) AS refused, least(count(*), 40) / 40.0::DOUBLE AS ratio FROM events GROUP BY 1")
def stream_backpressure_info(spark, d):
    conf = streams.backpressure_config(spark.createDataFrame([], "stream string, strategy string, max_pending long, sample_rate long"), "s", "DROP", 10)
    row = streams.backpressure_config(conf, "s", "BLOCK", 40).first()
    ops = read(spark, d, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("ord"), F.lit("add").alias("op"), F.lit(1).alias("n"))
    return streams.backpressure_info(streams.backpressure(ops, row.strategy, row.max_pending), row.max_pending).select("stream", "done", "refused", "ratio")


# -- places, bits, sketches, vectors, series


@query("geo_by_member", f"WITH {POINTS}, c AS (SELECT lon AS x, lat AS y FROM points WHERE member = 7) SELECT member, round({distance_sql('x', 'y')} / 1000, 3) AS dist FROM points, c WHERE {distance_sql('x', 'y')} <= 2500000")
def geo_by_member(spark, d):
    return geo.geosearch_by_member(points(spark, d), "customers", 7, radius=2500, unit="km").select("member", F.round("dist", 3).alias("dist"))


@query("geo_store", f"WITH {POINTS} SELECT 'near' AS key, member, round({distance_sql('10.0', '50.0')}, 2) AS score FROM points WHERE {distance_sql('10.0', '50.0')} <= 1500000")
def geo_store(spark, d):
    found = geo.geosearch(points(spark, d), 10.0, 50.0, radius=1_500_000)
    return geo.geosearch_store(found, "near", store_dist=True).withColumn("score", F.round("score", 2))


GRID = "(y + 0.5) / 67108864 * (2 * 85.05112878) - 85.05112878"
TEXT = "0123456789bcdefghjkmnpqrstuvwxyz"


@query("geo_hash", f"WITH {POINTS}, g AS (SELECT member, CAST(floor((lat + 85.05112878) / (2 * 85.05112878) * 67108864) AS BIGINT) AS y, CAST(floor((lon + 180.0) / 360.0 * 67108864) AS BIGINT) AS x FROM points), w AS (SELECT member, x, CAST(floor(({GRID} + 90.0) / 180.0 * 67108864) AS BIGINT) AS y FROM g), b AS (SELECT member, CAST(list_sum(list_transform(range(0, 26), lambda i: (((y >> i) & 1) << (2 * i)) + (((x >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS c FROM w) SELECT member, array_to_string(list_transform(range(0, 10), lambda i: substr('{TEXT}', CAST(((c >> CAST(47 - 5 * i AS INTEGER)) & 31) + 1 AS BIGINT), 1)), '') || '0' AS hash FROM b")
def geo_hash(spark, d):
    return geo.geohash(geo.geoadd(points(spark, d))).select("member", "hash")


@query("bit_set", "SELECT event_type AS key, user_id AS pos FROM events GROUP BY 1, 2 HAVING user_id % 3 <> 0 UNION ALL SELECT 'new', c_custkey FROM customer")
def bit_set(spark, d):
    bits = read(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("pos")).distinct()
    off = bits.where("pos % 3 = 0").withColumn("bit", F.lit(0))
    on = read(spark, d, "customer").select(F.lit("new").alias("key"), F.col("c_custkey").alias("pos"), F.lit(1).alias("bit"))
    return bitmaps.setbit(bits, off.unionByName(on))


HASHED = "hashed AS (SELECT event_type AS key, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM events)"
REGISTERS = f"{HASHED}, r AS (SELECT key, CAST(h & 16383 AS INTEGER) AS reg, (h >> 14) | (CAST(1 AS BIGINT) << 50) AS rest FROM hashed), regs AS (SELECT key, reg, max(bit_count((rest & -rest) - 1) + 1) AS rank FROM r GROUP BY 1, 2)"
#: The estimate: a sum over registers, with sigma for the empty ones; none is full here, so tau is 0.
ESTIMATE = "CAST(round(0.721347520444481703680 * 16384.0 * 16384.0 / (s + 16384.0 * (e + list_sum(list_transform(range(1, 41), lambda k: pow(e, pow(2, k)) * pow(2, k - 1)))))) AS BIGINT)"


def _registers(spark, d):
    h = F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    return sketches.registers(read(spark, d, "events").select(F.col("event_type").alias("key"), h.alias("h")), hashed=F.col("h"))


@query("hll_count", f"WITH {REGISTERS}, t AS (SELECT key, sum(pow(0.5::DOUBLE, rank)) AS s, (16384 - count(*)) / 16384.0::DOUBLE AS e FROM regs GROUP BY key) SELECT key, {ESTIMATE} AS estimate FROM t")
def hll_count(spark, d):
    return sketches.estimate(_registers(spark, d))


@query("hll_merge", f"WITH {REGISTERS}, a AS (SELECT reg, max(rank) AS rank FROM regs GROUP BY reg), t AS (SELECT 'all' AS key, sum(pow(0.5::DOUBLE, rank)) AS s, (16384 - count(*)) / 16384.0::DOUBLE AS e FROM a) SELECT key, {ESTIMATE} AS estimate FROM t")
def hll_merge(spark, d):
    return sketches.estimate(sketches.merge(_registers(spark, d), "all"))


BLOOM = "h AS (SELECT DISTINCT user_id, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM events), set_ AS (SELECT DISTINCT ((h & 1073741823) + ((h >> 30) | 1) * i) % 20480 AS pos FROM h, range(0, 5) t(i) WHERE user_id % 2 = 0), p AS (SELECT user_id, ((h & 1073741823) + ((h >> 30) | 1) * i) % 20480 AS pos FROM h, range(0, 5) t(i))"


@query("bloom_check", f"WITH {BLOOM} SELECT user_id, bool_and(pos IN (SELECT pos FROM set_)) AS maybe FROM p GROUP BY 1")
def bloom_check(spark, d):
    h = F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    users_ = read(spark, d, "events").select(F.lit("f").alias("key"), "user_id", h.alias("h")).distinct()
    made = sketches.bloom_add(users_.where("user_id % 2 = 0"), 20_480, 5, F.col("h"))
    return sketches.bloom_check(made, users_, 20_480, 5, F.col("h")).select("user_id", "maybe")


V = "v AS (SELECT vec_id AS ext_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("ext_id"), "embedding", F.lit(False).alias("deleted"))


@query("vector_batch_deleted", f"WITH {V}, b AS (SELECT ext_id AS query_id, e AS qe FROM v WHERE ext_id % 50 = 0), s AS (SELECT query_id, ext_id, list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, b WHERE ext_id NOT IN (0, 50, 100)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ext_id) AS rank FROM s) SELECT query_id, ext_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 4")
def vector_batch_deleted(spark, d):
    v = vectors.vdel(_vectors(spark, d), [0, 50, 100])
    q = v.where("ext_id % 50 = 0").select(F.col("ext_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.vsearch_batch(v, q, 4, "L2").select("query_id", "ext_id", "rank")


@query("vector_cells")
def vector_cells(spark, d):
    v = _vectors(spark, d)
    q = v.where("ext_id % 50 = 0").select(F.col("ext_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.vsearch_cells(v, q, vectors.cells_fit(v), 5).select("query_id", "ext_id", "rank")


@query("vector_add", "SELECT vec_id AS ext_id, false AS deleted, len(embedding) AS dim FROM embeddings UNION ALL SELECT vec_id + 1000000, false, len(embedding) FROM embeddings".replace("len(embedding)", "CAST(len(embedding) AS INTEGER)"))
def vector_add(spark, d):
    v = _vectors(spark, d)
    more = v.select((F.col("ext_id") + 1_000_000).alias("ext_id"), "embedding")
    return vectors.vadd(v, more, 64).select("ext_id", "deleted", F.size("embedding").alias("dim"))


Q8 = "q AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CAST(trunc(greatest(-1, least(1, x)) * 127) AS BIGINT)) AS q8 FROM embeddings)"


@query("vector_int8_dot", f"WITH {Q8} SELECT vec_id AS ext_id, CAST(list_sum(list_transform(list_zip(q8, (SELECT q8 FROM q WHERE vec_id = 0)), lambda p: p[1] * p[2])) AS BIGINT) AS dot FROM q")
def vector_int8_dot(spark, d):
    q = vectors.quantized(_vectors(spark, d))
    probe = q.where("ext_id = 0").first().q8
    return q.select("ext_id", vectors.int8_dot(F.col("q8"), F.array(*map(F.lit, probe))).alias("dot"))


@query("vector_hamming", "WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x > 0 AS INTEGER)) AS s FROM embeddings) SELECT vec_id AS ext_id, CAST(list_sum(list_transform(list_zip(s, (SELECT s FROM b WHERE vec_id = 0)), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS INTEGER) AS distance FROM b")
def vector_hamming(spark, d):
    b = _vectors(spark, d).select("ext_id", F.transform("embedding", lambda x: (x > 0).cast("int")).alias("s"))
    probe = b.where("ext_id = 0").first().s
    return b.select("ext_id", hamming(F.col("s"), F.array(*map(F.lit, probe))).alias("distance"))


@query("ts_del", f"WITH {SAMPLES} SELECT series, ts, value FROM samples WHERE NOT (series = (SELECT min(event_type) FROM events) AND ts <= (SELECT min(epoch_us(ts) // 1000) + (max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000)) // 2 FROM events))")
def ts_del(spark, d):
    first = read(spark, d, "events").agg(F.min("event_type")).first()[0]
    return timeseries.ts_del(samples(spark, d), first, end=_mid(spark, d)).select("series", "ts", "value")


@query("ts_add", f"WITH {SAMPLES} SELECT series, ts, value FROM samples UNION ALL SELECT series, max(ts) + 1, 5 FROM samples GROUP BY series")
def ts_add(spark, d):
    s = samples(spark, d)
    return timeseries.ts_add(s, s.groupBy("series").agg((F.max("ts") + 1).alias("ts")).withColumn("value", F.lit(5).cast("long")))


@query("ts_delta", "SELECT user_id AS series, event_id AS ts, round(value, 2) AS value FROM events")
def ts_delta(spark, d):
    s = read(spark, d, "events").select(F.col("user_id").alias("series"), F.col("event_id").alias("ts"), F.round("value", 2).alias("value"))
    return timeseries.delta_decode(timeseries.delta_encode(s, 0.01), 0.01).select("series", "ts", F.round("value", 2).alias("value"))


# -- pub/sub, tracking, scripts, reports

SUBS = "subs AS (SELECT c_custkey AS client, CASE c_custkey % 4 WHEN 0 THEN 'shard' WHEN 1 THEN 'pattern' ELSE 'channel' END AS kind, CASE c_custkey % 4 WHEN 1 THEN CASE WHEN c_custkey % 8 = 1 THEN '*' ELSE '' END || 'src' || c_custkey % 20 || CASE WHEN c_custkey % 3 = 0 THEN '?' ELSE '' END ELSE 'src' || c_custkey % 20 END AS pattern FROM customer)"


def _subs(spark, d):
    k = F.col("c_custkey")
    name = F.concat(F.lit("src"), (k % 20).cast("string"))
    pattern = F.concat(F.when(k % 8 == 1, "*").otherwise(""), name, F.when(k % 3 == 0, "?").otherwise(""))
    kind = F.when(k % 4 == 0, "shard").when(k % 4 == 1, "pattern").otherwise("channel")
    return read(spark, d, "customer").select(k.alias("client"), kind.alias("kind"), F.when(kind == "pattern", pattern).otherwise(name).alias("pattern"))


@query("pubsub_deliver_all", f"WITH {SUBS} SELECT client, source AS channel, pattern AS via, count(*) AS n FROM documents JOIN subs ON kind = 'channel' AND source = pattern OR kind = 'pattern' AND regexp_full_match(source, replace(replace(pattern, '*', '.*'), '?', '.')) GROUP BY 1, 2, 3")
def pubsub_deliver_all(spark, d):
    messages = read(spark, d, "documents").select(F.col("source").alias("channel"), "doc_id")
    return pubsub.deliver_counts(messages, _subs(spark, d))


@query("pubsub_channels", f"WITH {SUBS} SELECT DISTINCT pattern AS channel FROM subs WHERE kind = 'channel' AND pattern LIKE 'src1%'")
def pubsub_channels(spark, d):
    return pubsub.channels(_subs(spark, d), "src1*")


@query("pubsub_shardchannels", f"WITH {SUBS} SELECT DISTINCT pattern AS channel FROM subs WHERE kind = 'shard'")
def pubsub_shardchannels(spark, d):
    return pubsub.channels(_subs(spark, d), kind="shard")


@query("pubsub_shardnumsub", f"WITH {SUBS} SELECT pattern AS channel, count(DISTINCT client) AS n FROM subs WHERE kind = 'shard' GROUP BY 1")
def pubsub_shardnumsub(spark, d):
    return pubsub.numsub(_subs(spark, d), "shard")


@query("pubsub_numpat", f"WITH {SUBS} SELECT count(DISTINCT pattern) AS n FROM subs WHERE kind = 'pattern'")
def pubsub_numpat(spark, d):
    return pubsub.numpat(_subs(spark, d))


@query("pubsub_unsubscribe", f"WITH {SUBS} SELECT * FROM subs WHERE NOT (client % 5 = 0 OR kind = 'channel' AND client % 7 = 0)")
def pubsub_unsubscribe(spark, d):
    s = _subs(spark, d)
    whole = s.where("client % 5 = 0").select("client", "kind", F.lit(None).cast("string").alias("pattern"))
    return pubsub.unsubscribe(s, whole.unionByName(s.where("kind = 'channel' AND client % 7 = 0")))


ACCESS = "access AS (SELECT user_id AS client, event_type AS key, event_id AS ts, event_id % 4 = 0 AS write FROM events)"


def _access(spark, d):
    return read(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_type").alias("key"), F.col("event_id").alias("ts"), (F.col("event_id") % 4 == 0).alias("write"))


@query("tracking_invalidations", f"WITH {ACCESS}, n AS (SELECT *, min(CASE WHEN write THEN ts END) OVER (PARTITION BY key ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS told FROM access), o AS (SELECT DISTINCT client, key, told AS ts FROM n WHERE NOT write AND told IS NOT NULL) SELECT o.* FROM o JOIN access a ON a.key = o.key AND a.ts = o.ts WHERE a.client <> o.client")
def tracking_invalidations(spark, d):
    return pubsub.invalidations(_access(spark, d), no_loop=True)


@query("tracking_prefixes", f"WITH {ACCESS} SELECT CAST(-1 AS BIGINT) AS client, key, ts FROM access WHERE write AND key LIKE 'c%' UNION ALL SELECT -2, key, ts FROM access WHERE write")
def tracking_prefixes(spark, d):
    named = spark.createDataFrame([(-1, "c"), (-2, "")], "client long, prefix string")
    return pubsub.invalidations(_access(spark, d), named).where("client < 0")


@query("script_evalsha", "SELECT event_id, CASE WHEN value > 50 THEN 'high ' || event_type ELSE 'low' END AS result FROM events")
def script_evalsha(spark, d):
    s = scripting.Scripts()
    sha = s.load("CASE WHEN value > argv1 THEN concat(argv2, event_type) ELSE 'low' END")
    assert s.exists(sha, "0" * 40) == [1, 0] and s.show(sha).startswith("CASE")
    return s.evalsha(read(spark, d, "events"), sha, [50, "high "]).select("event_id", "result")


@query("function_restore", "SELECT event_id, CAST(user_id * 2 + 1 AS BIGINT) AS odd FROM events")
def function_restore(spark, d):
    f, g = scripting.Functions(), scripting.Functions()
    f.load("numbers", {"odd": scripting.SqlFunction("user_id * 2 + 1")}, read_only=("odd",))
    g.restore(f.dump())
    return read(spark, d, "events").select("event_id", g.call("odd", read_only=True).alias("odd"))


@query("transaction_discard", "SELECT user_id AS key, max(event_id) AS version FROM events GROUP BY 1")
def transaction_discard(spark, d):
    log = read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("val"))
    queued = log.select(F.lit(1).alias("tx"), "key", (F.col("version") + 1_000_000_000).alias("version"), "val")
    watches = log.select(F.lit(1).alias("tx"), "key", F.lit(-1).cast("long").alias("version")).limit(1)  # no longer so: nothing goes in
    return scripting.execute(log, queued, watches)[0].groupBy("key").agg(F.max("version").alias("version"))


MS = "s AS (SELECT event_type AS event, event_id AS ts, CAST(round(value * 100) AS BIGINT) AS ms FROM events)"


def _latency(spark, d):
    return samples(spark, d).select(F.col("series").alias("event"), F.col("event_id").alias("ts"), F.col("value").alias("ms"))


@query("latency_percentiles", f"WITH {MS} SELECT event, quantile_cont(ms, 0.5) AS p50, quantile_cont(ms, 0.99) AS p99 FROM s GROUP BY event")
def latency_percentiles(spark, d):
    return observability.percentiles(_latency(spark, d), [0.5, 0.99])


@query("latency_latest", f"WITH {MS} SELECT event, max(ts) AS ts, max_by(ms, ts) AS last_ms, max(ms) AS max_ms FROM s GROUP BY event")
def latency_latest(spark, d):
    return observability.latency_latest(_latency(spark, d))


@query("latency_history", f"WITH {MS} SELECT event, ts, ms FROM s WHERE event = (SELECT max(event) FROM s) ORDER BY ts DESC LIMIT 160")
def latency_history(spark, d):
    return observability.latency_history(_latency(spark, d), read(spark, d, "events").agg(F.max("event_type")).first()[0])


TICKS = f"{SAMPLES}, t AS (SELECT series AS key, ts // 3600000 AS tick, count(*) AS n, avg(value) AS mean FROM samples GROUP BY 1, 2)"


def _ticks(spark, d):
    return observability.per_tick(samples(spark, d).withColumnRenamed("series", "key"), 3_600_000, ["key"])


@query("anomaly_growth", f"WITH {TICKS}, b AS (SELECT *, row_number() OVER w AS age, first_value(mean) OVER (PARTITION BY key ORDER BY tick ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS old FROM t WINDOW w AS (PARTITION BY key ORDER BY tick)) SELECT key, tick, n FROM b WHERE age > 40 AND mean > old * 1.5")
def anomaly_growth(spark, d):
    return observability.growth_alerts(_ticks(spark, d), share=0.5, warm_up=40).select("key", "tick", "n")


@query("anomaly_errors", f"WITH e AS (SELECT (epoch_us(ts) // 1000) // 3600000 AS tick, count(*) AS n, count(*) FILTER (WHERE value < 5) AS errors FROM events GROUP BY 1) SELECT tick, n, errors, CASE WHEN errors / n > 0.2 THEN 'CRITICAL' ELSE 'WARNING' END AS severity FROM e WHERE errors / n > 0.05")
def anomaly_errors(spark, d):
    e = read(spark, d, "events").withColumn("tick", F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 3_600_000).cast("long"))
    return observability.error_alerts(e.groupBy("tick").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 5).alias("errors")))


@query("anomaly_evictions", f"WITH {TICKS} SELECT key, tick, n, 'WARNING' AS severity FROM t WHERE n > 3")
def anomaly_evictions(spark, d):
    return observability.eviction_storms(_ticks(spark, d), 3).select("key", "tick", "n", "severity")


@query("anomaly_connections", f"WITH {TICKS}, b AS (SELECT *, row_number() OVER w AS age, avg(n) OVER (PARTITION BY key ORDER BY tick ROWS BETWEEN 299 PRECEDING AND CURRENT ROW) AS base FROM t WINDOW w AS (PARTITION BY key ORDER BY tick)) SELECT key, tick, n, 'WARNING' AS severity FROM b WHERE age > 30 AND n > base * 1.8")
def anomaly_connections(spark, d):
    return observability.connection_surges(_ticks(spark, d), factor=1.8).select("key", "tick", "n", "severity")


@query("quota_memory", "WITH u AS (SELECT c_mktsegment AS ns, sum(c_nationkey) AS bytes, count(*) AS keys FROM customer GROUP BY 1) SELECT ns, CAST(bytes AS BIGINT) AS bytes, keys, CASE WHEN ns IN ('AUTOMOBILE', 'BUILDING') THEN 'memory' ELSE 'keys' END AS refused FROM u WHERE ns IN ('AUTOMOBILE', 'BUILDING') AND bytes >= 100 OR ns = 'FURNITURE' AND keys >= 5")
def quota_memory(spark, d):
    usage = read(spark, d, "customer").select(F.col("c_mktsegment").alias("ns"), F.col("c_custkey").alias("key"), F.col("c_nationkey").cast("long").alias("size"))
    limits = spark.createDataFrame([("AUTOMOBILE", 100, 0), ("BUILDING", 100, 1), ("FURNITURE", None, 5), ("MACHINERY", 0, 0)], "ns string, max_bytes long, max_keys long")
    return observability.over_memory(usage, limits)
