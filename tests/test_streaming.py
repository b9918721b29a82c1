from pyspark.sql import functions as F

from keyloom.streaming import jobs


def files(spark, tmp_path, schema):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.orderBy("event_id").repartitionByRange(3, "event_id").write.parquet(str(tmp_path / "in"))
    return e, jobs.source(spark, str(tmp_path / "in"), schema)


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def test_windows_match_batch(spark, tmp_path):
    e, s = files(spark, tmp_path, SCHEMA)
    got = jobs.run_once(jobs.counts(s, "1 day", late="100 days"), "windowed", str(tmp_path / "c"), mode="complete")
    want = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    assert sorted(map(tuple, got.select("start", "event_type", "n").collect())) == sorted(map(tuple, want.collect()))


def test_consumer_group_gives_each_entry_once(spark, tmp_path):
    e, s = files(spark, tmp_path, SCHEMA)
    out = jobs.run_once(jobs.consumer_group(s, ["x", "y"]), "grouped", str(tmp_path / "c")).collect()
    assert sorted(r.event_id for r in out) == sorted(r.event_id for r in e.collect())
    for kind in {r.event_type for r in out}:
        rows = sorted((r for r in out if r.event_type == kind), key=lambda r: r.entries_read)
        assert [r.entries_read for r in rows] == [*range(1, len(rows) + 1)] and [r.consumer for r in rows] == ["xy"[i % 2] for i in range(len(rows))]


def test_patterns_and_sessions(spark, tmp_path):
    e, s = files(spark, tmp_path, SCHEMA)
    got = jobs.run_once(jobs.subscribed(s, ["c*", "view"], "event_type"), "matched", str(tmp_path / "c"))
    assert got.count() == e.where("event_type LIKE 'c%' OR event_type = 'view'").count()
    held = jobs.run_once(jobs.sessions(s, "30 minutes", "0 seconds"), "sessions", str(tmp_path / "d"))
    assert held.count() > 0 and held.agg(F.sum("n")).first()[0] <= e.count()


def test_blocking_pops_wait_in_turn(spark, tmp_path):
    kind = "key string, ord long, kind string, who string, val string, score double, until long"
    rows = [("a", 1, "pop", "c1", None, None, None), ("a", 2, "pop", "c2", None, None, 3), ("a", 3, "pop", "c3", None, None, None), ("b", 1, "push", None, "x", 2.0, None), ("b", 2, "push", None, "y", 1.0, None)]
    more = [("a", 5, "push", None, "p", 1.0, None), ("a", 6, "push", None, "q", 1.0, None), ("a", 7, "push", None, "r", 1.0, None), ("b", 3, "pop", "d", None, None, None), ("b", 4, "pop", "e", None, None, None), ("b", 5, "pop", "f", None, None, None)]
    for i, part in enumerate((rows, more)):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    wants = {"head": {("b", "d", "x"), ("b", "e", "y")}, "tail": {("b", "d", "y"), ("b", "e", "x")}, "min": {("b", "d", "y"), ("b", "e", "x")}, "max": {("b", "d", "x"), ("b", "e", "y")}}
    for order, want in wants.items():
        s = jobs.source(spark, str(tmp_path / "in"), kind)
        got = jobs.run_once(jobs.blocking_pops(s, order), f"pops_{order}", str(tmp_path / order)).collect()
        assert {(r.key, r.who, r.val) for r in got} == want | {("a", "c1", "p"), ("a", "c2", None), ("a", "c3", "q")}, order


def test_streamed_backpressure_equals_the_batch_one(spark, tmp_path):
    from keyloom.operators import streams

    ops = [("s", i, "ack" if i % 7 == 3 else "add", 2) for i in range(60)] + [("t", i, "add", 1) for i in range(9)]
    kind = "stream string, ord long, op string, n long"
    for low in (0, 20, 40):  # one file after another, as files are read by age
        spark.createDataFrame([o for o in ops if low <= o[1] < low + 20], kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    df = spark.createDataFrame(ops, kind)
    for strategy in ("BLOCK", "DROP", "EVICT_OLD"):
        got = jobs.run_once(jobs.backpressure(jobs.source(spark, str(tmp_path / "in"), kind), strategy, 5), f"credit_{strategy}".lower(), str(tmp_path / strategy))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, streams.backpressure(df, strategy, 5).select("stream", "ord", "result", "pending").collect()))
