"""Small cases of the operators, with the results that the data model defines."""

import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keyloom.functions import exprs as X
from keyloom.operators import bitmaps, crdt, geo, hashes, keyspace, lists, sets, sketches, streams, strings, timeseries, vectors, zsets
from keyloom.sources import tables


def vals(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def z(spark):
    rows = [("zseta", "a", 1.0), ("zseta", "b", 2.0), ("zseta", "c", 3.0), ("zsetb", "b", 1.0), ("zsetb", "c", 2.0), ("zsetb", "d", 3.0), ("zsetd", "1", 1.0), ("zsetd", "2", 2.0), ("zsetd", "3", 3.0), ("zsetf", "1", 1.0), ("zsetf", "3", 3.0), ("zsetf", "4", 4.0)]
    return spark.createDataFrame(rows, "key string, member string, score double").cache()


def test_zset_algebra(z):
    assert vals(zsets.zunion(z, ["zseta", "zsetb"]), "score", "member") == [(1, "a"), (3, "b"), (3, "d"), (5, "c")]
    assert vals(zsets.zunion(z, ["zsetd", "zsetf"]), "score", "member") == [(2, "1"), (2, "2"), (4, "4"), (6, "3")]
    assert vals(zsets.zinter(z, ["zsetd", "zsetf"]), "member", "score") == [("1", 2), ("3", 6)]
    assert vals(zsets.zdiff(z, ["zsetd", "zsetf"]), "member", "score") == [("2", 2)]
    assert zsets.zintercard(z, ["zsetd", "zsetf"]).first().card == 2 and zsets.zintercard(z, ["zsetd", "zsetf"], 1).first().card == 1


def test_infinite_weights_count_as_zero(spark):
    df = spark.createDataFrame([("a", "m", math.inf), ("b", "m", -math.inf), ("a", "n", 0.0)], "key string, member string, score double")
    assert vals(zsets.zunion(df, ["a", "b"]), "member", "score") == [("m", 0.0), ("n", 0.0)]
    assert vals(zsets.zunion(df, ["a"], [math.inf]), "member", "score") == [("m", math.inf), ("n", 0.0)]


def test_zadd_conditions(spark, z):
    old = z.where("key = 'zseta'")
    new = spark.createDataFrame([("zseta", "a", 5.0), ("zseta", "b", 0.0), ("zseta", "x", 1.0), ("zseta", "c", float("nan"))], "key string, member string, score double")
    get = lambda **o: {r.member: r.score for r in zsets.zadd(old, new, **o).collect()}
    assert get() == {"a": 5, "b": 0, "c": 3, "x": 1}
    assert get(nx=True) == {"a": 1, "b": 2, "c": 3, "x": 1}
    assert get(xx=True) == {"a": 5, "b": 0, "c": 3}
    assert get(gt=True) == {"a": 5, "b": 2, "c": 3, "x": 1} and get(lt=True) == {"a": 1, "b": 0, "c": 3, "x": 1}
    assert get(incr=True) == {"a": 6, "b": 2, "c": 3, "x": 1}


@pytest.mark.parametrize("rev", [False, True])
def test_zrange_equals_slices(spark, rev):
    rnd = random.Random(1)
    items = [(f"m{i:02}", float(rnd.randrange(4))) for i in range(9)]
    df = spark.createDataFrame([("k", *i) for i in items], "key string, member string, score double")
    order = [m for m, _ in sorted(items, key=lambda x: (x[1], x[0]), reverse=rev)]
    for start, stop in [(0, 3), (2, -2), (-4, -1), (-20, -8), (5, 2), (-3, 20), (3, 100)]:
        n = len(order)
        a, b = max(0, start + n if start < 0 else start), min(n - 1, stop + n if stop < 0 else stop)
        got = [r.member for r in zsets.zrange(df, start, stop, rev).orderBy("rank").collect()]
        assert got == order[a : b + 1], (start, stop)
    assert zsets.zrandmember(df, -20).count() == 20 and zsets.zrandmember(df, 4).distinct().count() == 4


def test_range_syntax(spark):
    df = spark.createDataFrame([(float(i), c) for i, c in enumerate("abcde")], "s double, m string")
    assert [r.m for r in df.where(X.score_range(F.col("s"), "(1", "3")).collect()] == ["c", "d"]
    assert df.where(X.score_range(F.col("s"))).count() == 5
    assert [r.m for r in df.where(X.lex_range(F.col("m"), "(a", "[c")).collect()] == ["b", "c"]
    assert df.where(X.lex_range(F.col("m"), "+", "-")).count() == 0
    with pytest.raises(ValueError):
        X.lex_range(F.col("m"), "a", "b")


def brute_glob(p, s):
    if not p:
        return not s
    if p[0] == "*":
        return any(brute_glob(p[1:], s[i:]) for i in range(len(s) + 1))
    if not s:
        return False
    if p[0] == "?":
        return brute_glob(p[1:], s[1:])
    if p[0] == "\\" and len(p) > 1:
        return p[1] == s[0] and brute_glob(p[2:], s[1:])
    return p[0] == s[0] and brute_glob(p[1:], s[1:])


def test_globs(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choices("ab*.[", k=rnd.randrange(5))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for p in ["*", "a*", "?b*", "\\*a", "*.*", "a", "", "*a*b*", "\\[?"]:
        assert sorted(r.w for r in df.where(X.glob(F.col("w"), p)).collect()) == sorted(w for w in words if brute_glob(p, w)), p
    one = spark.createDataFrame([("b",), ("]",), ("^",), ("-",)], "w string")
    pick = lambda p: sorted(r.w for r in one.where(X.glob(F.col("w"), p)).collect())
    assert pick("[a-c]") == ["b"] and pick("[c-a]") == ["b"] and pick("[^b]") == ["-", "]", "^"] and pick("[\\]]") == ["]"]


def test_slots(spark):
    df = spark.createDataFrame([("123456789",), ("{user1000}.following",), ("{user1000}.followers",), ("foo{}{bar}",), ("foo{{bar}}zap",), ("",)], "k string")
    got = {r.k: r.s for r in df.select("k", X.key_slot(F.col("k")).alias("s")).collect()}

    def crc(b):
        x = 0
        for c in b:
            x ^= c << 8
            for _ in range(8):
                x = (x << 1 ^ 0x1021 if x & 0x8000 else x << 1) & 0xFFFF
        return x % 16384

    assert got["123456789"] == 0x31C3 % 16384 and got[""] == 0
    assert got["{user1000}.following"] == got["{user1000}.followers"] == crc(b"user1000")
    assert got["foo{}{bar}"] == crc(b"foo{}{bar}") and got["foo{{bar}}zap"] == crc(b"{bar")


def test_sets(spark):
    s = spark.createDataFrame([("a", 1), ("a", 2), ("b", 2), ("b", 3)], "key string, member long")
    assert vals(sets.sinter(s, ["a", "b"]), "member") == [(2,)] and vals(sets.sdiff(s, ["a", "b"]), "member") == [(1,)]
    assert sets.sinter(s, ["a", "none"]).count() == 0 and sets.sunion(s, ["a", "b"]).count() == 3
    assert vals(sets.smove(s, "a", "b", 2), "key", "member") == [("a", 1), ("b", 2), ("b", 3)]
    popped, kept = sets.spop(s, 1)
    assert popped.count() == 2 and kept.count() == 2


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame([("k", i, v) for i, v in enumerate("abcabca")], "key string, pos long, val string").cache()


def text(df):
    return "".join(r.val for r in df.orderBy("pos").collect())


def test_lists(spark, abc):
    assert text(lists.ltrim(abc, 1, -2)) == "bcabc" and text(lists.lrem(abc, -2, "a")) == "abcbc" and text(lists.lrem(abc, 0, "a")) == "bcbc"
    assert [r.idx for r in lists.lpos(abc, "a", rank=2).collect()] == [3] and [r.idx for r in lists.lpos(abc, "a", rank=-1, count=0).orderBy("idx").collect()] == [0, 3, 6]
    assert lists.lpos(abc, "a", rank=2, maxlen=3).count() == 0
    assert text(lists.linsert(abc, "b", "X")) == "aXbcabca" and text(lists.linsert(abc, "b", "X", before=False)) == "abXcabca" and text(lists.linsert(abc, "q", "X")) == "abcabca"
    popped, kept = lists.lpop(abc, 2, tail=True)
    assert text(popped) == "ca" and text(kept) == "abcab"
    new = spark.createDataFrame([("k", 1, "x"), ("k", 2, "y"), ("z", 1, "q")], "key string, ord long, val string")
    assert text(lists.lpush(abc, new).where("key = 'k'")) == "yxabcabca" and text(lists.lpush(abc, new, tail=True).where("key = 'k'")) == "abcabcaxy"
    assert lists.lpush(abc, new, only_existing=True).where("key = 'z'").count() == 0
    assert text(lists.lmove(abc, "k", "k")) == "aabcabc" and text(lists.lmpop(abc, ["none", "k"], 2)) == "ab"
    with pytest.raises(Exception, match="index out of range"):
        lists.lset(abc, 99, "x").collect()


def test_strings(spark):
    kv = spark.createDataFrame([("k", "hello")], "key string, val string")
    piece = lambda a, b: strings.getrange(kv, a, b).first().piece
    assert [piece(0, 1), piece(-3, -1), piece(3, 1), piece(0, 100), piece(-100, 0)] == ["he", "llo", "", "hello", "h"]
    assert strings.setrange(kv, 7, "x").first().val == "hello\0\0x" and strings.setrange(kv, 1, "EL").first().val == "hELlo"
    new = spark.createDataFrame([("k", "new"), ("j", "other")], "key string, val string")
    assert strings.msetnx(kv, new).count() == 1 and strings.msetnx(kv, new.where("key = 'j'")).count() == 2
    assert vals(strings.set_(kv, new, if_equal="hello").where("key = 'k'"), "val") == [("new",)]
    assert strings.delifeq(kv, "k", "hello").count() == 0
    with pytest.raises(Exception, match="OVERFLOW|overflow"):
        strings.incrby(spark.createDataFrame([("a", (1 << 63) - 1), ("a", 1)], "key string, delta long")).collect()


def test_lcs(spark):
    a, b = "rnordr", "ronrdro"
    got = strings.lcs(spark.createDataFrame([("ohmytext", "mynewtext"), (a, b), (None, "x")], "a string, b string"), min_match_len=2).collect()
    assert got[0].lcs == "mytext" and got[0].lcs_len == 6 and [tuple(m) for m in got[0].matches] == [(4, 7, 5, 8, 4), (2, 3, 0, 1, 2)]
    assert got[2].lcs is None
    rnd = random.Random(5)
    for _ in range(200):
        x, y = ("".join(rnd.choices("abc", k=rnd.randrange(9))) for _ in range(2))
        s, ranges = strings.lcs_table(x, y)
        assert s == "".join(x[p : q + 1] for p, q, _, _, _ in reversed(ranges)) == "".join(y[p : q + 1] for _, _, p, q, _ in reversed(ranges))


def test_times(spark):
    space = spark.createDataFrame([("live", 2000), ("edge", 1000), ("past", 999), ("ever", None)], "key string, expire_ms long")
    probes = spark.createDataFrame([(k,) for k in ("live", "edge", "past", "ever", "none")], "key string")
    assert vals(keyspace.ttl(space, probes, 1000), "key", "ttl") == [("edge", 0), ("ever", -1), ("live", 1), ("none", -2), ("past", -2)]
    code = lambda flag, t=3000: {r.key: r.code for r in keyspace.expire(space, probes, 1000, t, flag).collect()}
    assert code("NX") == {"live": 0, "edge": 0, "past": 0, "ever": 1, "none": 0} and code("GT", 1500)["ever"] == 0 and code("LT", 1500)["ever"] == 1
    assert vals(keyspace.persist(space, probes.where("key = 'live'")).where("key = 'live'"), "expire_ms") == [(None,)]
    h = space.select(F.lit("h").alias("key"), F.col("key").alias("field"), F.lit("v").alias("val"), F.col("expire_ms").alias("field_expire_ms"))
    fp = probes.select(F.lit("h").alias("key"), F.col("key").alias("field"))
    assert {r.field: r.code for r in hashes.hexpire(h, fp, 1000, 500).collect()} == {"live": 2, "edge": 2, "past": 2, "ever": 2, "none": -2}
    assert {r.field: r.code for r in hashes.hexpire(h, fp, 1000, 1500, "XX").collect()} == {"live": 1, "edge": 1, "past": 1, "ever": 0, "none": -2}


def test_sort(spark):
    el = spark.createDataFrame([("10",), ("9",), ("x",)], "val string")
    w = spark.createDataFrame([("10", "3"), ("9", "20")], "val string, out string")
    assert [r.val for r in keyspace.sort(el.where("val <> 'x'")).collect()] == ["9", "10"]
    assert [r.val for r in keyspace.sort(el, alpha=True, desc=True).collect()] == ["x", "9", "10"]
    assert [(r.val, r.got) for r in keyspace.sort(el, by=w, gets={"got": w}).collect()] == [("x", None), ("10", "3"), ("9", "20")]
    with pytest.raises(Exception, match="not a number"):
        keyspace.sort(el).collect()


def test_streams_match_a_linear_scan(spark):
    rnd = random.Random(3)
    ids = sorted({(rnd.randrange(30), rnd.randrange(4)) for _ in range(60)})
    s = spark.createDataFrame([("s", a, b, i) for i, (a, b) in enumerate(ids)], "key string, ms long, seq long, v long").cache()
    for _ in range(12):
        a, b = (rnd.randrange(30), rnd.randrange(4)), (rnd.randrange(30), rnd.randrange(4))
        start, end = rnd.choice([f"{a[0]}-{a[1]}", f"({a[0]}-{a[1]}", f"{a[0]}", "-"]), rnd.choice([f"{b[0]}-{b[1]}", f"({b[0]}-{b[1]}", f"{b[0]}", "+"])
        (lo, lo_open), (hi, hi_open) = streams.parse_id(start), streams.parse_id(end, True)
        want = [i for i in ids if (i > lo or not lo_open and i == lo) and (i < hi or not hi_open and i == hi)]
        assert vals(streams.xrange(s, start, end), "ms", "seq") == want, (start, end)
        assert vals(streams.xrange(s, start, end, count=3, rev=True), "ms", "seq") == want[-3:]
    with pytest.raises(Exception, match="not above"):
        streams.xadd(s, s.limit(1)).collect()
    idle = s.select("key", F.lit("g").alias("grp"), "ms", "seq", F.lit("a").alias("consumer"), F.lit(1).alias("delivery_count"), (F.col("v") * 10).alias("delivery_ms"))
    claimed = streams.xautoclaim(idle, streams.xdel(s, s.where("v = 0")), "b", 200, 150, count=3)
    assert [r.delivery_ms for r in claimed.where("consumer = 'b'").collect()] == [200] * 3 and claimed.count() == len(ids) - 1


@pytest.mark.parametrize("strategy", ["BLOCK", "DROP", "SAMPLE", "EVICT_OLD"])
def test_backpressure(spark, strategy):
    ops = [("s", i, "ack" if i % 17 == 16 else "add", 3) for i in range(80)]
    got = [(r.result, r.pending) for r in streams.backpressure(spark.createDataFrame(ops, "stream string, ord long, op string, n long"), strategy, 5, 4).orderBy("ord").collect()]
    pending, seen, want = 0, 0, []
    for _, _, op, n in ops:
        r = 0
        if op == "ack":
            pending = max(0, pending - n)
        elif pending < 5:
            pending += 1
        elif strategy == "SAMPLE":
            seen += 1
            r, pending = (2, pending) if seen % 4 else (0, pending + 1)
        elif strategy != "EVICT_OLD":
            r = {"DROP": 1, "BLOCK": -1}[strategy]
        want.append((r, pending))
    assert got == want


@pytest.mark.parametrize("strategy", ["BLOCK", "DROP", "EVICT_OLD"])
def test_backpressure_over_stretches(spark, monkeypatch, strategy):
    """Two streams, one of them null, in stretches of seven rows, with repeated places in the log and a null count."""
    monkeypatch.setattr(streams, "_STRETCH", 7)
    rnd = random.Random(5)
    ops = [(s, i // 2, rnd.choice(["ack", "add", "add"]), rnd.choice([None, 0, 1, 4, 50])) for s in (None, "s") for i in range(300)]
    log = spark.createDataFrame(ops, "stream string, ord long, op string, n long")
    got = [(r.stream, r.ord, r.result, r.pending) for r in streams.backpressure(log.repartition(5), strategy, 6).collect()]
    want = []
    for s in (None, "s"):
        pending = 0
        for _, i, op, n in sorted(((s, i, op, n or 0) for t, i, op, n in ops if t == s), key=lambda x: x[1:]):
            r = 0
            if op == "ack":
                pending = max(0, pending - n)
            elif pending < 6:
                pending += 1
            elif strategy != "EVICT_OLD":
                r = {"DROP": 1, "BLOCK": -1}[strategy]
            want.append((s, i, r, pending))
    key = lambda x: (x[0] or "", *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert streams.backpressure(log.limit(0), strategy, 6).count() == 0
    full = [(r.result, r.pending) for r in streams.backpressure(log.where("op = 'add'"), strategy, 0).collect()]
    assert set(full) == {(0 if strategy == "EVICT_OLD" else {"DROP": 1, "BLOCK": -1}[strategy], 0)}


def test_geo(spark):
    p = spark.createDataFrame([("Sicily", "Palermo", 13.361389, 38.115556), ("Sicily", "Catania", 15.087269, 37.502669), ("ny", "lic market", -73.9454966, 40.747533)], "key string, member string, lon double, lat double").cache()
    d = geo.geodist(geo.stored(p), spark.createDataFrame([("Sicily", "Palermo", "Catania"), ("Sicily", "Palermo", "none")], "key string, member1 string, member2 string"), "km").collect()
    assert sorted((r.dist is not None, round(r.dist or 0, 4)) for r in d) == [(False, 0), (True, 166.2742)]
    assert {r.member: r.hash for r in geo.geohash(geo.geoadd(p)).collect()}["Palermo"] == "sqc8b49rny0"
    assert {r.member: r.score for r in geo.geoadd(p).collect()}["Catania"] == 3479447370796909
    pos = {r.member: (r.lon, r.lat) for r in geo.geopos(geo.geoadd(p).drop("lon", "lat")).collect()}["Palermo"]
    assert abs(pos[0] - 13.361389) < 1e-5 and abs(pos[1] - 38.115556) < 1e-5
    assert vals(geo.geosearch(p, 15, 37, radius=200, unit="km"), "member") == [("Catania",), ("Palermo",)] and vals(geo.geosearch_by_member(p, "Sicily", "Palermo", radius=10, unit="km"), "member") == [("Palermo",)]
    with pytest.raises(Exception, match="invalid longitude"):
        geo.geoadd(spark.createDataFrame([("k", "m", 200.0, 0.0)], p.schema)).collect()


def test_geosearch_matches_brute_force(spark):
    rnd = random.Random(4)
    pts = [("k", f"m{i}", rnd.uniform(-180, 180), rnd.uniform(-85, 85)) for i in range(400)]
    df = spark.createDataFrame(pts, "key string, member string, lon double, lat double").cache()

    def dist(x1, y1, x2, y2):
        u, v = math.sin((math.radians(y2) - math.radians(y1)) / 2), math.sin((math.radians(x2) - math.radians(x1)) / 2)
        return 2 * X.EARTH_RADIUS * math.asin(math.sqrt(u * u + math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * v * v))

    for _ in range(6):
        x, y, r = rnd.uniform(-180, 180), rnd.uniform(-85, 85), rnd.uniform(1e5, 6e6)
        assert vals(geo.geosearch(df, x, y, radius=r), "member") == sorted((m,) for _, m, a, b in pts if dist(x, y, a, b) <= r)
        w, h = rnd.uniform(1e5, 6e6), rnd.uniform(1e5, 6e6)
        inside = [(m,) for _, m, a, b in pts if X.EARTH_RADIUS * abs(math.radians(b) - math.radians(y)) <= h / 2 and dist(x, b, a, b) <= w / 2]
        assert vals(geo.geosearch(df, x, y, box=(w, h)), "member") == sorted(inside)


def test_bit_fields(spark):
    rnd = random.Random(6)
    values = [bytes(rnd.randrange(256) for _ in range(rnd.randrange(12))) for _ in range(20)]
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "i int, v binary").cache()

    def brute(v, kind, at):
        n = int(kind[1:])
        bits = "".join(f"{b:08b}" for b in v).ljust(at + n, "0")[at : at + n]
        x = int(bits, 2)
        return x - (1 << n) if kind[0] == "i" and bits[0] == "1" else x

    for kind, at in [("u1", 3), ("u8", 0), ("i8", 4), ("u16", 13), ("i32", 7), ("i33", 1), ("u63", 5), ("i64", 8), ("i63", 2), ("i5", 90)]:
        got = {r.i: r.x for r in df.select("i", bitmaps.bitfield_get(F.col("v"), kind, at).alias("x")).collect()}
        assert got == {i: brute(v, kind, at) for i, v in enumerate(values)}, kind
    put = df.select("i", bitmaps.bitfield_set(F.col("v"), "i9", 11, F.lit(-77)).alias("v"))
    assert {r.x for r in put.select(bitmaps.bitfield_get(F.col("v"), "i9", 11).alias("x")).collect()} == {-77}
    assert {r.i: r.n for r in df.select("i", bitmaps.count_bytes(F.col("v")).alias("n")).collect()} == {i: sum(bin(b).count("1") for b in v) for i, v in enumerate(values)}
    add = lambda a, b, o, k="i8": spark.range(1).select(bitmaps.bounded_add(F.lit(a), F.lit(b), k, o).alias("x")).first().x
    assert [add(100, 100, o) for o in ("WRAP", "SAT", "FAIL")] == [-56, 127, None] and add(250, 10, "WRAP", "u8") == 4 and add(-100, -100, "SAT") == -128
    b = spark.createDataFrame([("k", 0), ("k", 1), ("k", 3)], "key string, pos long")
    assert bitmaps.bitpos(b, 0).first().pos == 2 and bitmaps.bitpos(b, 0, 2).first().pos == -1


@pytest.mark.parametrize("n", [1, 100, 5000, 60_000])
def test_distinct_estimates(spark, n):
    df = spark.range(n).select(F.lit("k").alias("key"), F.col("id").cast("string").alias("member"))
    got = sketches.estimate(sketches.registers(df)).first().estimate
    assert abs(got - n) <= max(1, 0.03 * n)
    assert sketches.estimate(sketches.merge(sketches.registers(df.unionByName(df)))).first().estimate == got


def test_vectors(spark):
    v = spark.createDataFrame([(i, [float(i == j) for j in range(4)], False) for i in range(4)] + [(4, [0.5, 0.5, 0.0, 0.0], False), (5, [1.0, 0.0, 0.0, 0.0], True)], "ext_id long, embedding array<float>, deleted boolean")
    assert [(r.ext_id, round(r.distance, 6)) for r in vectors.vsearch(v, [1, 0, 0, 0], 3, "L2").collect()] == [(0, 0.0), (4, 0.5), (1, 2.0)]
    assert vectors.vsearch(v, [0, 0, 0, 0], 1).first().distance == 1.0
    assert vectors.vdel(v, [0]).where("deleted").count() == 2 and vectors.vinfo(v).first().live == 5
    a, b = spark.createDataFrame([(1, 0), (2, 1)], "doc_id long, pos long"), spark.createDataFrame([(2, 0)], "doc_id long, pos long")
    assert {r.doc_id: round(r.score, 9) for r in vectors.rank_fusion(a, b).collect()} == {1: round(1 / 60, 9), 2: round(1 / 61 + 1 / 60, 9)}
    h = spark.createDataFrame([([1, 2], [3, 2])], "a array<int>, b array<int>").select(X.hamming(F.col("a"), F.col("b")).alias("h"))
    assert h.first().h == 1


def test_replicas_converge(spark):
    rnd = random.Random(7)
    ops = spark.createDataFrame([("k", i % 3, rnd.randrange(-5, 9), i) for i in range(60)], "key string, node long, delta long, ts long")
    state = crdt.pncounter_state(ops)
    parts = [crdt.pncounter_state(ops.where(F.col("node") == n)) for n in range(3)]
    total = sum(r.delta for r in ops.collect())
    for merged in (crdt.pncounter_merge(*parts), crdt.pncounter_merge(*reversed(parts)), crdt.pncounter_merge(state, parts[0], state)):
        assert crdt.pncounter_value(merged).first().value == total
    g = crdt.gcounter_merge(spark.createDataFrame([("k", 0, 5)], "key string, node long, v long"), spark.createDataFrame([("k", 1, 3)], "key string, node long, v long"))
    assert crdt.gcounter_value(crdt.gcounter_merge(g, g)).first().value == 8
    with pytest.raises(Exception, match="cannot shrink"):
        crdt.gcounter_state(ops).collect()
    o = spark.createDataFrame([("k", "x", 1, 0, False), ("k", "x", 2, 0, False), ("k", "y", 3, 1, False)], "key string, value string, tag long, origin long, removed boolean")
    gone = crdt.orset_remove(o.where("tag = 1"), o.select("key", "value"))
    assert vals(crdt.orset_members(crdt.orset_merge(o, gone)), "value") == [("x",), ("y",)]


def test_series(spark):
    s = spark.createDataFrame([("a", t, v) for t, v in [(1, 1.5), (2, -2.25), (9, 4.0)]], "series string, ts long, value double")
    only = s.select("series").distinct()
    assert [timeseries.ts_aggregate(s, 1, 2, k, only).first().value for k in ("AVG", "SUM", "MIN", "MAX", "COUNT")] == [-0.375, -0.75, -2.25, 1.5, 2.0]
    assert timeseries.ts_aggregate(s, 100, 200, "AVG", only).first().value == 0.0
    back = timeseries.delta_decode(timeseries.delta_encode(s).drop("value"))
    assert [round(r.value, 6) for r in back.orderBy("ts").collect()] == [1.5, -2.25, 4.0]
    assert timeseries.ts_retain(s, 5).count() == 1


def test_tables(spark, tmp_path):
    log = spark.createDataFrame([("a", 1, "x", False), ("a", 2, "y", False), ("b", 1, "z", False), ("b", 3, None, True)], "key string, version long, val string, gone boolean")
    assert vals(tables.fold_log(log, ["key"], deleted="gone"), "key", "val") == [("a", "y")]
    tables.append_log(log, str(tmp_path / "log"))
    tables.append_log(log.limit(1), str(tmp_path / "log"))
    assert tables.load_snapshot(spark, str(tmp_path / "log")).count() == 5
    tables.save_snapshot(log, str(tmp_path / "snap"), ["key"])
    assert tables.load_snapshot(spark, str(tmp_path / "snap")).count() == 4
    dumped = tables.dump(log.select("key", "version", "val"))
    assert tables.restore(dumped, "version long, val string").count() == 4
    assert tables.restore(dumped.withColumn("payload", F.concat("payload", F.lit(" "))), "version long, val string").count() == 0
    space = tables.keyspace(string=log, list=spark.createDataFrame([("l", 5)], "key string, expire_ms long"))
    assert vals(space, "key", "type") == [("a", "string"), ("b", "string"), ("l", "list")]
    page = tables.scan(space, count=2)
    assert [r.key for r in tables.scan(space, after=page.collect()[-1].key).collect()] == ["l"]


def test_functions_and_transactions(spark):
    from keyloom.operators import scripting

    f = scripting.Functions()
    f.load("lib", {"twice": lambda c: c * 2, "slow": scripting.pandas_function("long")(plus_one)}, read_only=("twice",))
    row = spark.range(3).select(f.call("twice", F.col("id")).alias("a"), f.call("slow", F.col("id")).alias("b")).collect()
    assert [tuple(r) for r in row] == [(0, 1), (2, 2), (4, 3)] and f.list("l*") == [("lib", "slow", False), ("lib", "twice", True)]
    for bad in (lambda: f.load("lib", {}), lambda: f.load("other", {"twice": None}), lambda: f.call("none"), lambda: f.call("slow", F.col("id"), read_only=True), lambda: f.delete("none")):
        with pytest.raises(ValueError):
            bad()
    log = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "key string, version long, val string")
    batch = spark.createDataFrame([(1, "a", 2, "n"), (2, "b", 6, "n"), (3, "c", 1, "n")], "tx long, key string, version long, val string")
    watches = spark.createDataFrame([(1, "a", 1), (2, "b", 4), (3, "c", None)], "tx long, key string, version long")
    after, outcome = scripting.execute(log, batch, watches)
    assert vals(outcome, "tx", "done") == [(1, True), (2, False), (3, True)] and after.count() == 4


def plus_one(s: pd.Series) -> pd.Series:
    return s + 1


def test_small_operators(spark):
    s = spark.createDataFrame([("s", 5, 0), ("s", 7, 1)], "key string, ms long, seq long")
    g = spark.createDataFrame([], "key string, grp string, last_ms long, last_seq long, entries_read long")
    g = streams.xgroup_create(g, s, "s", "g")
    assert vals(g, "last_ms", "last_seq", "entries_read") == [(7, 1, 2)]
    assert vals(streams.xgroup_setid(g, "s", "g", "5-0"), "last_ms", "last_seq") == [(5, 0)]
    with pytest.raises(ValueError):
        streams.xgroup_create(g, s, "s", "g", "0")
    p = spark.createDataFrame([("s", "g", 5, 0, "c")], "key string, grp string, ms long, seq long, consumer string")
    assert streams.xgroup_delconsumer(p, "s", "g", "c").count() == 0 and [d.count() for d in streams.xgroup_destroy(g, p, "s", "g")] == [0, 0]
    kv = spark.createDataFrame([("a", "x", None), ("b", "y", 9)], "key string, val string, expire_ms long")
    assert vals(strings.setex(kv, kv.where("key = 'a'"), 100, 50), "key", "expire_ms") == [("a", 150), ("b", 9)]
    got, left = keyspace.take(kv, kv.where("key = 'a'"), ["key"])
    assert got.count() == 1 and left.count() == 1
    h = spark.createDataFrame([("h", f"f{i}") for i in range(9)], "key string, member string")
    assert [r.member for r in keyspace.scan_members(h, "h", after="f2", match="f[3-5]", count=2).collect()] == ["f3", "f4"]
    space = kv.select("key", F.lit("string").alias("type"), "expire_ms", F.lit(0).cast("long").alias("access_ms"))
    assert keyspace.dbsize(space, 10).first()["keys"] == 1 and keyspace.random_key(space).count() == 1
    assert vals(keyspace.touch(space, space.where("key = 'a'"), 5), "key", "access_ms") == [("a", 5), ("b", 0)]
    assert spark.range(1).select(keyspace.encoding("zset", F.lit(200), F.lit(3)).alias("e")).first().e == "skiplist"


def test_vector_batch_keeps_least_ids_of_equal_distances(spark):
    v = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20, 0, -1)], "ext_id long, embedding array<double>").coalesce(1)
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, q array<double>")
    got = vectors.vsearch_batch(v, q, 3, "L2").orderBy("rank").collect()
    assert [r.ext_id for r in got] == [1, 2, 3]


def test_rename_needs_a_source_and_nx_a_free_name(spark):
    t = spark.createDataFrame([("a", 1), ("b", 2)], "key string, member int")
    with pytest.raises(ValueError, match="no such key"):
        keyspace.rename(t, "absent", "b")
    assert vals(keyspace.rename(t, "a", "b", nx=True), "key", "member") == [("a", 1), ("b", 2)]
    assert vals(keyspace.rename(t, "a", "b"), "key", "member") == [("b", 1)] and vals(keyspace.rename(t, "a", "c", nx=True), "key", "member") == [("b", 2), ("c", 1)]


def test_zadd_settles_several_rows_of_a_member(spark, z):
    new = spark.createDataFrame([("zseta", "m", 5.0, 1), ("zseta", "m", 4.0, 2)], "key string, member string, score double, at int")
    assert ("zseta", "m", 4.0) in vals(zsets.zadd(z, new, order="at"), "key", "member", "score")
    with pytest.raises(Exception, match="several rows"):
        zsets.zadd(z, new).collect()


def test_lag_with_deletions(spark):
    """Entries 1 to 5: what was read is deleted, then something ahead, then all."""
    ids = lambda *n: spark.createDataFrame([("s", i, 0) for i in n], "key string, ms long, seq long")
    none = spark.createDataFrame([], "key string, grp string, ms long, seq long, consumer string")

    def lag(kept, gone, last, read, trimmed=()):
        g = spark.createDataFrame([("s", "g", last, 0, read)], "key string, grp string, last_ms long, last_seq long, entries_read long")
        state = streams.xstate(ids(*kept), ids(*gone), ids(*trimmed))
        return streams.xinfo_groups(ids(*kept), g, none, state).first().lag

    assert lag([3, 4, 5], [1, 2], 2, 2) is None or lag([3, 4, 5], [1, 2], 2, 2) == 3
    assert lag([1, 2, 3, 4, 5], [], 2, 2) == 3 and lag([1, 2, 4, 5], [3], 2, 2) is None and lag([1, 2, 4, 5], [3], 4, 4) == 1
    assert lag([], [1, 2, 3, 4, 5], 5, 5) == 0 and lag([1, 2, 3], [4, 5], 5, None) == 0 and lag([4, 5], [], 0, None, [1, 2, 3]) == 2
    assert lag([4, 5], [], 4, None, [1, 2, 3]) == 1 and lag([1, 2, 3], [], 2, None) is None


def test_cells_find_nine_of_ten_neighbours(spark):
    v = tables.read(spark, "/root/testdata/sf0.01", "embeddings").select(F.col("vec_id").alias("ext_id"), "embedding", F.lit(False).alias("deleted"))
    q = v.where("ext_id % 50 = 0").select(F.col("ext_id").alias("query_id"), F.col("embedding").alias("q"))
    exact = set(vals(vectors.vsearch_batch(v, q, 5), "query_id", "ext_id"))
    got = set(vals(vectors.vsearch_cells(v, q, vectors.cells_fit(v), 5), "query_id", "ext_id"))
    assert len(exact & got) >= 0.9 * len(exact) and len(exact) == 5 * q.count()


def test_batch_search_leaves_out_nulls_and_other_dimensions(spark):
    rows = [("a", [1.0, 0.0], False), ("b", [0.0, 1.0], True), ("c", None, False), ("d", [1.0, 1.0, 1.0], False), ("e", [0.5, 0.5], None)]
    v = spark.createDataFrame(rows, "ext_id string, embedding array<float>, deleted boolean")
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 0.0])], "query_id long, q array<double>")
    assert vals(vectors.vsearch_batch(v, q, 5, "L2"), "query_id", "ext_id", "rank") == [(1, "a", 2), (1, "e", 1), (2, "a", 1), (2, "e", 2)]
    assert vectors.vsearch_batch(v, q.limit(0), 5).count() == 0
    assert vals(vectors.vsearch_batch(v, q, 1, "L2", block_bytes=16), "query_id", "ext_id") == [(1, "e"), (2, "a")]


def test_long_texts_have_a_common_subsequence():
    rnd = random.Random(5)
    a = "".join(rnd.choices("abcd", k=3000))
    b = "".join(c for c in a if rnd.random() < 0.9)
    text, ranges = strings.lcs_table(a, b)
    assert text == b and sum(r[4] for r in ranges) == len(b)


def test_percentile_sketches_and_scripts(spark):
    from keyloom.operators import observability, scripting

    s = spark.createDataFrame([("e", i) for i in range(1001)], "event string, ms long")
    assert observability.percentiles(s, [0.5, 0.999]).first().asDict() == {"event": "e", "p50": 500.0, "p99_9": 999.0}
    assert abs(observability.percentiles(s, [0.5], exact=False).first().p50 - 500) <= 1
    f = scripting.Functions()
    f.load("l", {"f": scripting.SqlFunction("ms + 1")})
    dumped = f.dump()
    with pytest.raises(ValueError):
        f.restore(dumped)
    f.restore(dumped, "REPLACE")
    f.restore(dumped, "FLUSH")
    assert f.stats() == {"libraries": 1, "functions": 1}
    scripts = scripting.Scripts()
    with pytest.raises(ValueError):
        scripts.evalsha(s, "0" * 40)
    assert "Project" in scripts.debug(s, "ms * argv1", [2]) and scripts.exists(scripts.digest("ms * argv1")) == [1]
    scripts.flush()
    assert scripts.exists(scripts.digest("ms * argv1")) == [0]
    scripting.kill(spark, "no such group")


@pytest.mark.parametrize("desc", [False, True])
def test_numbers_within_keys(spark, desc):
    from keyloom.functions.ranks import numbered

    rnd = random.Random(7)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([0.0, 1.5, -3.0, 1e12, math.inf, -math.inf, rnd.random()]), i) for i in range(500)]
    got = numbered(spark.createDataFrame(rows, "key string, x double, m long"), ["key"], "x", ["m"], desc, "idx", "n").collect()
    for k in ("a", "b", None):
        want = sorted((r[1:] for r in rows if r[0] == k), reverse=desc)
        mine = sorted((r for r in got if r.key == k), key=lambda r: r.idx)
        assert [(r.x, r.m) for r in mine] == want and [r.idx for r in mine] == [*range(len(want))] and {r.n for r in mine} == {len(want)}
    one = spark.createDataFrame([("a", 5.0, 1)], "key string, x double, m long")
    assert numbered(one, ["key"], "x").first().idx == 0 and numbered(one.limit(0), ["key"], "x").count() == 0


@pytest.mark.parametrize("desc", [False, True])
def test_neighbours_and_sums_over_buckets(spark, desc):
    """A hot key, a null key, nulls, ties, infinities and what is not a number as places, and null values."""
    from pyspark.sql import Window

    from keyloom.functions.ranks import beside, running

    rnd = random.Random(3)
    places = [None, float("inf"), float("-inf"), float("nan"), 1e300, *[rnd.random() * 10 for _ in range(40)]]
    rows = [(rnd.choice(["hot", "hot", "hot", None, "few"]), rnd.choice(places), i, rnd.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "key string, x double, m long, v long").repartition(5)
    w = Window.partitionBy("key").orderBy(*([F.col("x").desc(), F.col("m").desc()] if desc else ["x", "m"]))
    want = vals(df.withColumn("o", F.lag("v").over(w)).select("m", F.coalesce("o", F.lit(-1)).alias("o")), "m", "o")
    got = beside(df, ["key"], "x", "v", "o", ["m"], desc)
    assert got.columns == ["key", "x", "m", "v", "o"] and vals(got.select("m", F.coalesce("o", F.lit(-1)).alias("o")), "m", "o") == want
    sums = running(df, ["key"], "x", F.col("v") * 2, "o", ["m"])
    upto = Window.partitionBy("key").orderBy("x", "m").rowsBetween(Window.unboundedPreceding, 0)
    want = vals(df.select("m", F.coalesce(F.sum(F.col("v") * 2).over(upto), F.lit(-1)).alias("o")), "m", "o")
    assert vals(sums.select("m", F.coalesce("o", F.lit(-1)).alias("o")), "m", "o") == want
    assert beside(df.limit(0), ["key"], "x", "v", "o").count() == 0 and running(df.limit(0), ["key"], "x", F.col("v"), "o").count() == 0
