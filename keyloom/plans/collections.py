"""Queries of the collection families: ordered sets, sets, lists, strings, hashes and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import hashes, keyspace, lists, sets, strings, zsets
from keyloom.plans.base import DAYS, FIELDS, FLAGS, HISTORY, NAMES, SPEND, USERS, days, fields, flags, history, names, spend, users
from keyloom.plans.registry import query
from keyloom.sources.tables import fold_log, read, scan

RANKED = f"WITH {SPEND}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS up, count(*) OVER (PARTITION BY key) AS n FROM spend)"


@query("zset_rank", f"{RANKED} SELECT key, member, score, rank FROM r")
def zset_rank(spark, d):
    return zsets.zrank(spend(spark, d), rev=True)


@query("zset_top10", f"{RANKED} SELECT key, member, score, rank FROM r WHERE rank < 10")
def zset_top10(spark, d):
    return zsets.ztop(spend(spark, d), 10)


@query("zset_range_tail", f"{RANKED} SELECT key, member, score, up AS rank FROM r WHERE up BETWEEN n - 5 AND n - 2")
def zset_range_tail(spark, d):
    return zsets.zrange(spend(spark, d), -5, -2)


@query("zset_range_middle", f"{RANKED} SELECT key, member, score, up AS rank FROM r WHERE up BETWEEN 3 AND n - 4")
def zset_range_middle(spark, d):
    return zsets.zrange(spend(spark, d), 3, -4)


@query("zset_rangebyscore", f"WITH {SPEND}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS i FROM spend WHERE score > 10000000 AND score <= 90000000) SELECT key, member, score FROM r WHERE i BETWEEN 3 AND 22")
def zset_rangebyscore(spark, d):
    return zsets.zrangebyscore(spend(spark, d), "(10000000", 90000000, offset=2, count=20)


@query("zset_revrangebyscore", f"WITH {SPEND}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS i FROM spend WHERE score < 90000000) SELECT key, member, score FROM r WHERE i <= 7")
def zset_revrangebyscore(spark, d):
    return zsets.zrangebyscore(spend(spark, d), "-inf", "(90000000", count=7, rev=True)


@query("zset_count", f"WITH {SPEND} SELECT key, count(*) FILTER (WHERE score BETWEEN 20000000 AND 60000000) AS n FROM spend GROUP BY key")
def zset_count(spark, d):
    return zsets.zcount(spend(spark, d), 20000000, 60000000)


@query("zset_card", f"WITH {SPEND} SELECT key, count(*) AS card FROM spend GROUP BY key")
def zset_card(spark, d):
    return zsets.zcard(spend(spark, d))


@query("zset_lexcount", f"WITH {NAMES} SELECT key, count(*) FILTER (WHERE member >= 'Supplier#000000003' AND member < 'Supplier#00000005') AS n FROM names GROUP BY key")
def zset_lexcount(spark, d):
    return zsets.zlexcount(names(spark, d), "[Supplier#000000003", "(Supplier#00000005")


@query("zset_rangebylex", f"WITH {NAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member) AS i FROM names WHERE member > 'S') SELECT key, member FROM r WHERE i <= 2")
def zset_rangebylex(spark, d):
    return zsets.zrangebylex(names(spark, d), "(S", "+", count=2).select("key", "member")


def _fold(agg: str, having: str = "") -> str:
    return f"WITH {FLAGS}, w AS (SELECT member, score * CASE key WHEN 'A' THEN 2.0 WHEN 'N' THEN 0.5 ELSE 1.0 END AS score FROM flags WHERE key IN ('A', 'N', 'R')) SELECT member, {agg}(score) AS score FROM w GROUP BY member {having}"


@query("zset_union_sum", _fold("sum"))
def zset_union_sum(spark, d):
    return zsets.zunion(flags(spark, d), ["A", "N", "R"], [2, 0.5, 1], "SUM")


@query("zset_union_min", _fold("min"))
def zset_union_min(spark, d):
    return zsets.zunion(flags(spark, d), ["A", "N", "R"], [2, 0.5, 1], "MIN")


@query("zset_inter_max", _fold("max", "HAVING count(*) = 3"))
def zset_inter_max(spark, d):
    return zsets.zinter(flags(spark, d), ["A", "N", "R"], [2, 0.5, 1], "MAX")


@query("zset_diff", f"WITH {FLAGS} SELECT member, score FROM flags f WHERE key = 'N' AND NOT EXISTS (SELECT 1 FROM flags g WHERE g.member = f.member AND g.key IN ('A', 'R'))")
def zset_diff(spark, d):
    return zsets.zdiff(flags(spark, d), ["N", "A", "R"])


@query("zset_intercard", f"WITH {FLAGS}, m AS (SELECT member FROM flags WHERE key IN ('A', 'R') GROUP BY member HAVING count(*) = 2) SELECT least(count(*), 500) AS card FROM m")
def zset_intercard(spark, d):
    return zsets.zintercard(flags(spark, d), ["A", "R"], limit=500)


@query("zset_popmin", f"{RANKED} SELECT key, member, score FROM r WHERE up < 3")
def zset_popmin(spark, d):
    return zsets.zpop(spend(spark, d), 3)[0]


@query("zset_after_popmax", f"{RANKED} SELECT key, member, score FROM r WHERE rank >= 4")
def zset_after_popmax(spark, d):
    return zsets.zpop(spend(spark, d), 4, highest=True)[1]


@query("zset_mpop", f"{RANKED} SELECT key, member, score FROM r WHERE key = (SELECT min(key) FROM spend) AND rank < 2")
def zset_mpop(spark, d):
    z = spend(spark, d)
    return zsets.zmpop(z, ["no such segment", "AUTOMOBILE", "BUILDING"], 2, highest=True)


@query("zset_remrangebyrank", f"{RANKED} SELECT key, member, score FROM r WHERE NOT up BETWEEN 2 AND n - 3")
def zset_remrangebyrank(spark, d):
    return zsets.zremrangebyrank(spend(spark, d), 2, -3)


@query("zset_remrangebyscore", f"WITH {SPEND} SELECT * FROM spend WHERE score > 50000000")
def zset_remrangebyscore(spark, d):
    return zsets.zremrangebyscore(spend(spark, d), "-inf", 50000000)


@query("zset_mscore", f"WITH {SPEND} SELECT p.key, p.member, score FROM (SELECT c_mktsegment AS key, c_custkey AS member FROM customer UNION ALL SELECT c_mktsegment, -c_custkey FROM customer) p LEFT JOIN spend USING (key, member)")
def zset_mscore(spark, d):
    probes = read(spark, d, "customer").select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("member"))
    return zsets.zmscore(spend(spark, d), probes.unionByName(probes.withColumn("member", -F.col("member"))))


@query("zset_add_gt", f"WITH {FLAGS}, o AS (SELECT member, score AS old FROM flags WHERE key = 'A'), n AS (SELECT member, score AS new FROM flags WHERE key = 'R') SELECT 'A' AS key, member, coalesce(greatest(old, new), old, new) AS score, old IS NULL AS added, new IS NOT NULL AND (old IS NULL OR new > old) AS changed FROM o FULL JOIN n USING (member)")
def zset_add_gt(spark, d):
    z = flags(spark, d)
    return zsets.zadd(z.where("key = 'A'"), z.where("key = 'R'").withColumn("key", F.lit("A")), gt=True)


@query("zset_incrby", "SELECT o_orderpriority AS key, o_custkey AS member, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS score FROM orders GROUP BY 1, 2")
def zset_incrby(spark, d):
    return zsets.zincrby(read(spark, d, "orders").select(F.col("o_orderpriority").alias("key"), F.col("o_custkey").alias("member"), F.round(F.col("o_totalprice") * 100).cast("long").alias("delta")))


@query("zset_sumrange", f"WITH {SPEND} SELECT key, CAST(sum(score) FILTER (WHERE score < 40000000) AS BIGINT) AS total FROM spend GROUP BY key")
def zset_sumrange(spark, d):
    return zsets.zsum_range(spend(spark, d), "-inf", "(40000000")


@query("zset_store", f"{RANKED} SELECT 'best' AS key, member, score, rank FROM r WHERE rank < 3")
def zset_store(spark, d):
    return zsets.store(zsets.ztop(spend(spark, d), 3), "best")


# -- sets


@query("set_union", f"WITH {USERS}, {DAYS} SELECT DISTINCT member FROM users, days WHERE key IN (a, b)")
def set_union(spark, d):
    return sets.sunion(users(spark, d), list(days(spark, d)))


@query("set_inter", f"WITH {USERS}, {DAYS} SELECT member FROM users, days WHERE key IN (a, b) GROUP BY member HAVING count(*) = 2")
def set_inter(spark, d):
    return sets.sinter(users(spark, d), list(days(spark, d)[:2]))


@query("set_diff", f"WITH {USERS}, {DAYS} SELECT member FROM users, days WHERE key = a EXCEPT SELECT member FROM users, days WHERE key = b")
def set_diff(spark, d):
    return sets.sdiff(users(spark, d), list(days(spark, d)))


@query("set_card", f"WITH {USERS} SELECT key, count(*) AS card FROM users GROUP BY key")
def set_card(spark, d):
    return sets.scard(users(spark, d))


@query("set_intercard", f"WITH {USERS}, {DAYS}, m AS (SELECT member FROM users, days WHERE key IN (a, b) GROUP BY member HAVING count(*) = 2) SELECT count(*) AS card FROM m")
def set_intercard(spark, d):
    return sets.sintercard(users(spark, d), list(days(spark, d)[:2]))


@query("set_mismember", f"WITH {USERS}, p AS (SELECT DISTINCT event_type || '/' || strftime(ts, '%Y-%m-%d') AS key, user_id + 1 AS member FROM events) SELECT key, member, CAST(EXISTS (SELECT 1 FROM users u WHERE u.key = p.key AND u.member = p.member) AS INTEGER) AS is_member FROM p")
def set_mismember(spark, d):
    s = users(spark, d)
    return sets.smismember(s, s.withColumn("member", F.col("member") + 1))


@query("set_add_rem", f"WITH {USERS} SELECT key, member FROM users WHERE member % 3 <> 0 UNION SELECT 'extra', c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def set_add_rem(spark, d):
    s = sets.sadd(users(spark, d), read(spark, d, "customer").select(F.lit("extra").alias("key"), F.col("c_custkey").alias("member")))
    return sets.srem(s, s.where("member % 3 = 0"))


@query("set_move", f"WITH {USERS}, {DAYS} SELECT DISTINCT CASE WHEN key = a AND member = (SELECT min(user_id) FROM events) THEN b ELSE key END AS key, member FROM users, days")
def set_move(spark, d):
    a, b, _ = days(spark, d)
    return sets.smove(users(spark, d), a, b, read(spark, d, "events").agg(F.min("user_id")).first()[0])


@query("set_pop_sizes", f"WITH {USERS} SELECT key, least(count(*), 5) AS popped FROM users GROUP BY key")
def set_pop_sizes(spark, d):
    return sets.spop(users(spark, d), 5, seed=1)[0].groupBy("key").agg(F.count(F.lit(1)).alias("popped"))


# -- lists


@query("list_len", f"WITH {HISTORY} SELECT key, count(*) AS len FROM hist GROUP BY key")
def list_len(spark, d):
    return lists.llen(history(spark, d))


@query("list_range_head", f"WITH {HISTORY} SELECT key, pos, val, idx FROM hist WHERE idx BETWEEN 1 AND 4")
def list_range_head(spark, d):
    return lists.lrange(history(spark, d), 1, 4)


@query("list_range_tail", f"WITH {HISTORY} SELECT key, pos, val, idx FROM hist WHERE idx >= len - 3")
def list_range_tail(spark, d):
    return lists.lrange(history(spark, d), -3, -1)


@query("list_index", f"WITH {HISTORY} SELECT key, pos, val FROM hist WHERE idx = len - 2")
def list_index(spark, d):
    return lists.lindex(history(spark, d), -2)


@query("list_pos", f"WITH {HISTORY}, m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS i FROM hist WHERE val = (SELECT min(event_type) FROM events)) SELECT key, idx FROM m WHERE i BETWEEN 2 AND 4")
def list_pos(spark, d):
    x = read(spark, d, "events").agg(F.min("event_type")).first()[0]
    return lists.lpos(history(spark, d), x, rank=-2, count=3)


@query("list_rem", f"WITH {HISTORY}, m AS (SELECT *, row_number() OVER (PARTITION BY key, val ORDER BY pos DESC) AS i FROM hist) SELECT key, pos, val FROM m WHERE NOT (val = (SELECT min(event_type) FROM events) AND i <= 2)")
def list_rem(spark, d):
    x = read(spark, d, "events").agg(F.min("event_type")).first()[0]
    return lists.lrem(history(spark, d), -2, x)


@query("list_trim", f"WITH {HISTORY} SELECT key, pos, val FROM hist WHERE idx BETWEEN 2 AND len - 3")
def list_trim(spark, d):
    return lists.ltrim(history(spark, d), 2, -3)


@query("list_pop_rest", f"WITH {HISTORY} SELECT key, pos, val FROM hist WHERE idx >= 5")
def list_pop_rest(spark, d):
    return lists.lpop(history(spark, d), 5)[1]


@query("list_push", f"WITH {HISTORY}, a AS (SELECT key, pos + 0.0::DOUBLE AS pos, val FROM hist UNION ALL SELECT key, max(pos) + i, 'new' || i FROM hist, range(1, 3) t(i) GROUP BY key, i) SELECT key, val, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx FROM a")
def list_push(spark, d):
    h = history(spark, d)
    new = h.select("key").distinct().select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("ord")).withColumn("val", F.concat(F.lit("new"), "ord"))
    return lists.indexed(lists.lpush(h, new, tail=True)).select("key", "val", "idx")


@query("list_insert", f"WITH {HISTORY}, p AS (SELECT key, min(pos) AS spot FROM hist WHERE val = (SELECT max(event_type) FROM events) GROUP BY key), a AS (SELECT key, pos::DOUBLE AS pos, val FROM hist UNION ALL SELECT key, spot - 0.25, 'here' FROM p) SELECT key, val, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx FROM a")
def list_insert(spark, d):
    x = read(spark, d, "events").agg(F.max("event_type")).first()[0]
    return lists.indexed(lists.linsert(history(spark, d), x, "here")).select("key", "val", "idx")


@query("list_set", f"WITH {HISTORY} SELECT key, pos, CASE WHEN idx = len - 1 THEN 'last' ELSE val END AS val FROM hist")
def list_set(spark, d):
    return lists.lset(history(spark, d), -1, "last")


# -- strings


@query("string_incrby", "SELECT user_id AS key, CAST(sum(event_id % 7 - 3) AS BIGINT) AS val FROM events GROUP BY 1")
def string_incrby(spark, d):
    return strings.incrby(read(spark, d, "events").select(F.col("user_id").alias("key"), (F.col("event_id") % 7 - 3).alias("delta")))


APPENDED = "kv AS (SELECT o_custkey AS key, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS val FROM orders GROUP BY 1)"


def _appended(spark, d):
    return strings.append(read(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("val")))


@query("string_append", f"WITH {APPENDED} SELECT key, val FROM kv")
def string_append(spark, d):
    return _appended(spark, d)


@query("string_getrange", f"WITH {APPENDED} SELECT key, val, substr(val, greatest(length(val) - 4, 0) + 1, greatest(0, length(val) - 1 - greatest(length(val) - 4, 0))) AS piece FROM kv")
def string_getrange(spark, d):
    return strings.getrange(_appended(spark, d), -4, -2)


@query("string_setrange", f"WITH {APPENDED} SELECT key, rpad(substr(val, 1, 3), 3, chr(0)) || 'xyz' || substr(val, 7) AS val FROM kv WHERE length(val) >= 3")
def string_setrange(spark, d):
    return strings.setrange(_appended(spark, d).where("length(val) >= 3"), 3, "xyz")


@query("string_strlen", "SELECT doc_id AS key, CAST(coalesce(strlen(text), 0) AS BIGINT) AS length FROM documents")
def string_strlen(spark, d):
    return strings.strlen(read(spark, d, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("val"))).drop("val")


@query("string_getset", "SELECT user_id AS key, event_id AS version, event_type AS val, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS old FROM events")
def string_getset(spark, d):
    return strings.getset(read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("val")))


@query("string_set_nx", "SELECT coalesce(o.c_custkey, n.k) AS key, coalesce(c_name, 'n' || k) AS val, c_name AS old FROM customer o FULL JOIN (SELECT c_custkey * 2 AS k FROM customer) n ON o.c_custkey = n.k")
def string_set_nx(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("val"))
    new = c.select((F.col("key") * 2).alias("key")).withColumn("val", F.concat(F.lit("n"), "key"))
    return strings.set_(c, new, nx=True)


@query("string_mget", "SELECT pos, k AS key, c_name AS val FROM (SELECT o_orderkey AS pos, o_custkey * 2 AS k FROM orders) LEFT JOIN customer ON c_custkey = k")
def string_mget(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("val"))
    return strings.mget(c, read(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") * 2).alias("key")))


@query("string_fold", "SELECT user_id AS key, max_by(event_type, event_id) AS val FROM events GROUP BY 1 HAVING max_by(event_type, event_id) <> (SELECT min(event_type) FROM events)")
def string_fold(spark, d):
    e = read(spark, d, "events")
    gone = e.agg(F.min("event_type")).first()[0]
    return fold_log(e.select(F.col("user_id").alias("key"), F.col("event_id").alias("version"), F.col("event_type").alias("val"), (F.col("event_type") == gone).alias("deleted")), ["key"], deleted="deleted")


@query("string_lcs")
def string_lcs(spark, d):
    s = read(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("a"))
    p = read(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("b"))
    return strings.lcs(s.join(p, "k"), min_match_len=1)


# -- hashes


@query("hash_len_live", f"WITH {FIELDS} SELECT key, count(*) AS len FROM fields WHERE field_expire_ms IS NULL OR field_expire_ms >= 1000000 GROUP BY key")
def hash_len_live(spark, d):
    return hashes.hlen(hashes.live_fields(fields(spark, d), 1_000_000))


PROBES = "probes AS (SELECT c_custkey AS key, f AS field FROM customer, (VALUES ('c_nationkey'), ('c_mktsegment'), ('nothing')) t(f))"


def _probes(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    return c.select("key", F.explode(F.array(*map(F.lit, ["c_nationkey", "c_mktsegment", "nothing"]))).alias("field"))


@query("hash_mget", f"WITH {FIELDS}, {PROBES} SELECT key, field, val FROM probes LEFT JOIN fields USING (key, field)")
def hash_mget(spark, d):
    return hashes.hmget(fields(spark, d), _probes(spark, d))


@query("hash_strlen", f"WITH {FIELDS} SELECT key, field, CAST(strlen(val) AS BIGINT) AS length FROM fields")
def hash_strlen(spark, d):
    return hashes.hstrlen(fields(spark, d)).select("key", "field", "length")


@query("hash_expire_gt", f"WITH {FIELDS}, {PROBES} SELECT key, field, CASE WHEN val IS NULL THEN -2 WHEN field_expire_ms IS NULL OR field_expire_ms >= 1000500 THEN 0 ELSE 1 END AS code, CASE WHEN val IS NULL THEN NULL WHEN field_expire_ms IS NULL OR field_expire_ms >= 1000500 THEN field_expire_ms ELSE 1000500 END AS field_expire_ms FROM probes LEFT JOIN fields USING (key, field)")
def hash_expire_gt(spark, d):
    return hashes.hexpire(fields(spark, d), _probes(spark, d), 999_000, 1_000_500, "GT")


@query("hash_ttl", f"WITH {FIELDS}, {PROBES} SELECT key, field, CAST(CASE WHEN val IS NULL THEN -2 WHEN field_expire_ms IS NULL THEN -1 ELSE (field_expire_ms - 1000000 + 500) // 1000 END AS BIGINT) AS ttl FROM probes LEFT JOIN (SELECT * FROM fields WHERE field_expire_ms IS NULL OR field_expire_ms >= 1000000) USING (key, field)")
def hash_ttl(spark, d):
    return hashes.httl(fields(spark, d), _probes(spark, d), 1_000_000)


@query("hash_persist", f"WITH {FIELDS}, {PROBES} SELECT key, field, CASE WHEN val IS NULL THEN -2 WHEN field_expire_ms IS NULL THEN -1 ELSE 1 END AS code FROM probes LEFT JOIN fields USING (key, field)")
def hash_persist(spark, d):
    return hashes.hpersist(fields(spark, d), _probes(spark, d))


@query("hash_del", f"WITH {FIELDS}, {PROBES} SELECT f.key, f.field, f.val FROM fields f ANTI JOIN probes USING (key, field)")
def hash_del(spark, d):
    return hashes.hdel(fields(spark, d), _probes(spark, d)).select("key", "field", "val")


@query("hash_set", f"WITH {FIELDS}, {PROBES} SELECT key, field, CASE WHEN p.key IS NULL THEN val ELSE 'new' END AS val, CASE WHEN p.key IS NULL THEN field_expire_ms END AS field_expire_ms, f.key IS NULL AS added FROM fields f FULL JOIN (SELECT key, field, key AS k FROM probes) p USING (key, field)")
def hash_set(spark, d):
    return hashes.hset(fields(spark, d), _probes(spark, d).withColumn("val", F.lit("new")))


@query("hash_incrby", "SELECT user_id AS key, event_type AS field, CAST(sum(event_id % 11) AS BIGINT) AS val FROM events GROUP BY 1, 2")
def hash_incrby(spark, d):
    return hashes.hincrby(read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), (F.col("event_id") % 11).alias("delta")))


# -- keys


def _space(spark, d):
    c = read(spark, d, "customer")
    return c.select(F.col("c_name").alias("key"), F.lit("hash").alias("type"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_custkey") * 10).alias("expire_ms"))


SPACE = "space AS (SELECT c_name AS key, 'hash' AS type, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey * 10 END AS expire_ms FROM customer)"


@query("keys_glob", f"WITH {SPACE} SELECT * FROM space WHERE regexp_full_match(key, 'C.*0[2-5][^7]') AND (expire_ms IS NULL OR expire_ms >= 500)")
def keys_glob(spark, d):
    return keyspace.keys(_space(spark, d), "C*0[5-2][^7]", now_ms=500)


@query("keys_scan", f"WITH {SPACE} SELECT * FROM space WHERE key LIKE '%1%' AND key > 'Customer#000000005' ORDER BY key LIMIT 25")
def keys_scan(spark, d):
    return scan(_space(spark, d), after="Customer#000000005", match="*1*", count=25, type_="hash")


@query("keys_ttl", f"WITH {SPACE}, p AS (SELECT c_name AS key FROM customer UNION ALL SELECT 'absent') SELECT key, CAST(CASE WHEN type IS NULL THEN -2 WHEN expire_ms IS NULL THEN -1 ELSE (expire_ms - 600 + 500) // 1000 END AS BIGINT) AS ttl FROM p LEFT JOIN (SELECT * FROM space WHERE expire_ms IS NULL OR expire_ms >= 600) USING (key)")
def keys_ttl(spark, d):
    probes = read(spark, d, "customer").select(F.col("c_name").alias("key")).unionByName(spark.range(1).select(F.lit("absent").alias("key")))
    return keyspace.ttl(_space(spark, d), probes, 600)


@query("keys_expire_lt", f"WITH {SPACE}, p AS (SELECT c_name AS key FROM customer) SELECT key, CAST(expire_ms IS NULL OR 700 < expire_ms AS INTEGER) AS code, false AS deleted, CASE WHEN expire_ms IS NULL OR 700 < expire_ms THEN 700 ELSE expire_ms END AS expire_ms FROM p JOIN space USING (key)")
def keys_expire_lt(spark, d):
    probes = read(spark, d, "customer").select(F.col("c_name").alias("key"))
    return keyspace.expire(_space(spark, d), probes, 100, 700, "LT")


@query("keys_exists", "SELECT count(*) AS n FROM (SELECT c_custkey * 2 AS k FROM customer UNION ALL SELECT c_custkey * 2 FROM customer) JOIN customer ON c_custkey = k")
def keys_exists(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"))
    twice = c.select((F.col("key") * 2).alias("key"))
    return keyspace.exists(c, twice.unionByName(twice))


@query("keys_big", "SELECT event_type AS type, count(*) AS keys, CAST(sum(n) AS BIGINT) AS total, max(n) AS biggest, round(avg(n), 6) AS average, min(user_id) FILTER (WHERE n = m) AS biggest_key FROM (SELECT *, max(n) OVER (PARTITION BY event_type) AS m FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2)) GROUP BY 1")
def keys_big(spark, d):
    sizes = read(spark, d, "events").groupBy(F.col("event_type").alias("type"), F.col("user_id").alias("key")).agg(F.count(F.lit(1)).alias("size"))
    return keyspace.big_keys(sizes).withColumn("average", F.round("average", 6))


@query("keys_hot", "SELECT user_id AS key, count(*) AS freq FROM events GROUP BY 1 ORDER BY freq DESC, key LIMIT 16")
def keys_hot(spark, d):
    return keyspace.hot_keys(read(spark, d, "events").select(F.col("user_id").alias("key")), 16)


@query("keys_next", "WITH f AS (SELECT event_type AS key, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS next_key FROM events), p AS (SELECT key, next_key, count(*) AS n FROM f WHERE next_key IS NOT NULL GROUP BY 1, 2) SELECT key, next_key, n, round(n / sum(n) OVER (PARTITION BY key), 9) AS p FROM p")
def keys_next(spark, d):
    access = read(spark, d, "events").select(F.col("user_id").alias("client"), F.col("event_id").alias("ts"), F.col("event_type").alias("key"))
    return keyspace.access_order(access).withColumn("p", F.round("p", 9))


@query("keys_evict", f"SELECT c_name AS key, expire_ms FROM customer JOIN (WITH {SPACE} SELECT * FROM space) s ON s.key = c_name WHERE expire_ms IS NOT NULL ORDER BY expire_ms, c_name LIMIT 20")
def keys_evict(spark, d):
    return keyspace.evict(_space(spark, d).drop("type"), "volatile-ttl", 20)


@query("keys_copy_rename", f"WITH {USERS}, {DAYS} SELECT CASE WHEN key = a THEN 'renamed' ELSE key END AS key, member FROM users, days UNION ALL SELECT 'copied', member FROM users, days WHERE key = a")
def keys_copy_rename(spark, d):
    a, _, _ = days(spark, d)
    return keyspace.rename(keyspace.copy(users(spark, d), a, "copied"), a, "renamed")


@query("sort_by_get", "SELECT o_orderkey AS val, c_name AS name, o_orderpriority AS priority FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY c_acctbal DESC, o_orderkey DESC LIMIT 40 OFFSET 10")
def sort_by_get(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    both = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    by = both.select(F.col("o_orderkey").alias("val"), F.col("c_acctbal").alias("out"))
    gets = {"name": both.select(F.col("o_orderkey").alias("val"), F.col("c_name").alias("out")), "priority": o.select(F.col("o_orderkey").alias("val"), F.col("o_orderpriority").alias("out"))}
    return keyspace.sort(o.select(F.col("o_orderkey").alias("val")), by, gets, desc=True, offset=10, count=40)


@query("sort_alpha", "SELECT p_name AS val FROM part ORDER BY p_name LIMIT 30")
def sort_alpha(spark, d):
    return keyspace.sort(read(spark, d, "part").select(F.col("p_name").alias("val")), alpha=True, count=30)
