"""Cases that show in small how a query grows."""

import math
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.operators import pubsub, streams, vectors
from keyloom.plans import registry


def rows_of_joins(df):
    """The most rows that a join made as the query ran."""
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == "AdaptiveSparkPlan":
            todo.append(node.finalPhysicalPlan())
        elif node.nodeName().endswith("QueryStage"):
            todo.append(node.plan())
        if "Join" in node.nodeName():
            most = max(most, node.metrics().get("numOutputRows").get().value())
        todo.extend(node.children().apply(i) for i in range(node.children().size()))
    return most


def tables_of_messages(spark, path, docs, customers):
    spark.range(docs).select(F.col("id").alias("doc_id"), F.lit("src1").alias("source")).write.parquet(f"{path}/documents.parquet")
    spark.range(customers).select(F.col("id").alias("c_custkey")).write.parquet(f"{path}/customer.parquet")
    return str(path)


def test_deliveries_are_counted_without_pairing_messages_and_clients(spark, tmp_path):
    d = tables_of_messages(spark, tmp_path, 5_000, 1_000)
    df = registry.queries()["pubsub_deliver_all"](spark, d)
    got = df.collect()
    assert {r.n for r in got} == {5_000} and len(got) > 30
    assert 0 < rows_of_joins(df) <= 1_000


def test_heads_of_any_number_of_lengths_are_looked_up(spark):
    subs = spark.createDataFrame([(i, "pattern", "x" * i + "*") for i in range(300)], "client long, kind string, pattern string")
    messages = spark.createDataFrame([("x" * 400,)], "channel string")
    assert pubsub.deliver_all(messages, subs).count() == 300


def test_deliver_counts_keeps_repeated_subscriptions_and_shards(spark):
    subs = spark.createDataFrame([("a", "channel", "c"), ("a", "channel", "c"), ("b", "shard", "c"), ("b", "pattern", "?")], "client string, kind string, pattern string")
    messages = spark.createDataFrame([("c", False), ("c", False), ("c", True), (None, False)], "channel string, sharded boolean")
    got = {(r.client, r.via): r.n for r in pubsub.deliver_counts(messages, subs).collect()}
    assert got == {("a", "c"): 4, ("b", "c"): 1, ("b", "?"): 2}


def test_setid_of_a_stream_longer_than_its_counter(spark, tmp_path):
    n = 1_000_100
    rows = spark.range(n + 3).select(F.when(F.col("id") < n, "a").otherwise("b").alias("event_type"), F.timestamp_millis(F.col("id") % 50_000).alias("ts"), F.col("id").alias("event_id"), F.lit(1).alias("user_id"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = registry.queries()["stream_setid"](spark, str(tmp_path)).collect()
    assert {r.key: (r.last_ms, r.entries_added) for r in got} == {"a": (9_000_000_000_000, 1_000_000), "b": ((n + 2) % 50_000, 3)}


def test_setid_still_refuses_a_counter_below_the_length(spark):
    s = spark.createDataFrame([("a", i, 0) for i in range(5)], "key string, ms long, seq long")
    left, gone = streams.xtrim_split(s, 3)
    assert sorted(r.ms for r in left.collect()) == [2, 3, 4] and sorted(r.ms for r in gone.collect()) == [0, 1]
    r = streams.xsetid(streams.xstate(left, trimmed=gone), "a", "9-0", 3).first()
    assert (r.length, r.last_ms, r.entries_added) == (3, 9, 3)
    with pytest.raises(Exception, match="smaller than what the stream has"):
        streams.xsetid(streams.xstate(s), "a", "9-0", 3).collect()


def test_cell_search_makes_no_row_of_a_pair(spark):
    df = registry.queries()["vector_cells"](spark, "/root/testdata/sf0.001")
    assert df.count() == 5 * 10 and rows_of_joins(df) == 0 and "Join" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_cell_search_is_exact_within_what_it_probes(spark):
    rng = random.Random(5)
    data = {i: [rng.gauss(0, 1) for _ in range(6)] for i in range(400)}
    v = spark.createDataFrame(list(data.items()), "ext_id long, embedding array<double>").repartition(3)
    q = v.where("ext_id % 40 = 0").select(F.col("ext_id").alias("query_id"), F.col("embedding").alias("q"))
    centres = vectors.cells_fit(v, cells=8)
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    near = lambda x, n: sorted(range(8), key=lambda c: -dot(x, centres[c]))[:n]
    expected = set()
    for i in range(0, 400, 40):
        ask = [j for j in data if near(data[j], 1)[0] in near(data[i], 3)]
        ask.sort(key=lambda j: (1 - dot(data[i], data[j]) / math.sqrt(dot(data[i], data[i]) * dot(data[j], data[j])), j))
        expected |= {(i, j, r + 1) for r, j in enumerate(ask[:4])}
    for block in (16, 16 << 20):
        assert {tuple(r) for r in vectors.vsearch_cells(v, q, centres, 4, 3, block).select("query_id", "ext_id", "rank").collect()} == expected


def peak_of_a_batch(spark, monkeypatch, metric):
    """MB that a task of a batch search allocates at most for 10,000 vectors and 2,000 queries."""
    v = spark.range(1).select(F.col("id").alias("ext_id"), F.array([F.rand(i) for i in range(8)]).alias("embedding"))
    q = spark.range(2_000).select(F.col("id").alias("query_id"), F.array([F.rand(i + 8) for i in range(8)]).alias("q"))
    tasks, real = [], type(v).mapInArrow
    monkeypatch.setattr(type(v), "mapInArrow", lambda self, f, *a, **b: tasks.append(f) or real(self, f, *a, **b))
    vectors.vsearch_batch(v, q, 5, metric)
    rng = random.Random(1)
    flat = pa.array([rng.gauss(0, 1) for _ in range(80_000)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(10_000), pa.int64()), pa.ListArray.from_arrays(pa.array(range(0, 80_001, 8), pa.int32()), flat)], ["ext_id", "embedding"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in tasks[0](iter([batch]))) == 10_000
        return tracemalloc.get_traced_memory()[1] >> 20
    finally:
        tracemalloc.stop()


def test_batch_search_holds_no_distances_of_a_whole_batch(spark, monkeypatch):
    assert peak_of_a_batch(spark, monkeypatch, "COSINE") < 60


@pytest.mark.parametrize("metric", ["COSINE", "L2", "IP"])
def test_batch_search_of_odd_vectors_and_ids(spark, metric):
    rng = random.Random(3)
    data = [[float(rng.randint(-1, 1)) for _ in range(3)] for _ in range(3_000)]  # 27 kinds, zero among them
    rows = [(None if i == 7 else f"n{i:04}", x) for i, x in enumerate(data)] + [("zz", [math.nan, 0.0, 1.0]), ("zy", [math.inf, 0.0, 1.0])]
    v = spark.createDataFrame(rows, "ext_id string, embedding array<double>").repartition(3)
    asked = [data[0], [0.0, 0.0, 0.0], [0.3, -0.2, 0.9], data[7]]
    q = spark.createDataFrame(list(enumerate(asked)), "query_id long, q array<double>")

    def far(a, b):
        inner, both = sum(x * y for x, y in zip(a, b, strict=True)), math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        if metric == "COSINE":
            return 1.0 if both < 1e-12 else 1 - max(-1, min(1, inner / both))
        return sum((x - y) ** 2 for x, y in zip(a, b, strict=True)) if metric == "L2" else 1 - inner

    expected = set()
    for i, x in enumerate(asked):
        order = sorted((far(y, x), n is not None, n) for n, y in rows if all(map(math.isfinite, y)))
        if not (metric == "IP" and (x[0] > 0 or x[0] < 0)):  # an infinite number would be nearest of all
            expected |= {(i, n, r + 1) for r, (_, _, n) in enumerate(order[:6])}
    got = {tuple(r) for r in vectors.vsearch_batch(v, q, 6, metric).select("query_id", "ext_id", "rank").collect()}
    assert len(got) == 24 and expected <= got


def test_batch_search_by_l2_holds_no_distances_of_a_whole_batch(spark, monkeypatch):
    assert peak_of_a_batch(spark, monkeypatch, "L2") < 60


def test_batch_search_by_l2_tells_copies_and_deleted_apart_by_id(spark):
    """Copies far from zero are at distance 0 exactly, wherever they stand in a product."""
    rng = random.Random(9)
    kinds = [[1e4 + rng.random() for _ in range(7)] for _ in range(40)]
    v = spark.createDataFrame([(i, kinds[i * 7 % 40], False) for i in range(2_000)], "ext_id long, embedding array<double>, deleted boolean").repartition(3)
    q = v.where("ext_id < 40").select(F.col("ext_id").alias("query_id"), F.col("embedding").alias("q"))
    got = vectors.vsearch_batch(vectors.vdel(v, [0, 40, 41]), q, 4, "L2").collect()
    expected = {(j, i, r + 1) for j in range(40) for r, i in enumerate([i for i in range(j, 400, 40) if i not in (0, 40, 41)][:4])}
    assert {(r.query_id, r.ext_id, r["rank"]) for r in got} == expected and {r.distance for r in got} == {0.0}
