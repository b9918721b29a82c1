"""Streaming queries over event streams with a TIMESTAMP column ``ts`` (cast TIMESTAMP_NTZ first)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.exprs import glob


def source(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """A stream of Parquet files. ``max_files`` a trigger is the backpressure: what has not been read waits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", key: str = "event_type") -> DataFrame:
    """Counts and sums per key and window; rows later than ``late`` are left out."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = events.withWatermark("ts", late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def subscribed(messages: DataFrame, patterns: list[str], channel: str = "channel") -> DataFrame:
    """Messages on channels that match any of the patterns: no state."""
    test = F.lit(False)
    for p in patterns:
        test = test | glob(F.col(channel), p)
    return messages.where(test)


def consumer_group(events: DataFrame, consumers: list[str], key: str = "event_type") -> DataFrame:
    """Each new entry goes to one consumer in turn, per stream. The state is the number of entries read, so a restart goes on
    where the last checkpoint ended. Entries: (key, event_id); those of a micro-batch are dealt in the order they come in, by
    Arrow batch, so that a key's batch need not fit in memory."""
    import pandas as pd

    def deal(k, batches, state):
        read = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values("event_id")
            n = len(rows)
            yield pd.DataFrame({key: [k[0]] * n, "event_id": rows["event_id"].to_numpy(), "consumer": [consumers[(read + i) % len(consumers)] for i in range(n)], "entries_read": range(read + 1, read + n + 1)})
            read += n
        state.update((read,))

    return events.select(key, "event_id").groupBy(key).applyInPandasWithState(deal, f"{key} string, event_id long, consumer string, entries_read long", "entries_read long", "append", "NoTimeout")


def blocking_pops(events: DataFrame, order: str = "head") -> DataFrame:
    """Pops that wait: rows (key, ord, kind, who, val, score, until) are pushes (``push``) and requests (``pop`` of a client ``who``).

    A request takes what is there, else it waits, first come, first served, until a push comes or its time is over: ``until`` is the
    greatest ``ord`` it waits for (null: for ever). Lists are popped at their ``head`` or ``tail``; ordered sets at ``min`` or ``max``
    of (score, val). One row comes out per request: (key, who, ord of the request, val, score), with a null val for one whose
    time is over, which shows at the next event of the key. Both queues of a key are its state."""
    import heapq
    import json

    import pandas as pd

    if order not in ("head", "tail", "min", "max"):
        raise ValueError(order)

    def run(k, batches, state):
        held, waiting = json.loads(state.get[0]) if state.exists else ([], [])
        sign = -1 if order == "max" else 1
        out = []

        def give(who, asked):
            if order in ("min", "max"):
                score, val = heapq.heappop(held)
                out.append((k[0], who, asked, val, sign * score))
            else:
                val, score = held.pop(0 if order == "head" else -1)
                out.append((k[0], who, asked, val, score))

        rows = pd.concat(list(batches)).sort_values("ord")
        for r in rows.itertuples(index=False):
            late = [w for w in waiting if w[2] is not None and w[2] < r.ord]
            out.extend((k[0], w[0], w[1], None, None) for w in late)
            waiting[:] = [w for w in waiting if w not in late]
            if r.kind == "push":
                item = [sign * float(r.score), r.val] if order in ("min", "max") else [r.val, None if pd.isna(r.score) else float(r.score)]
                heapq.heappush(held, item) if order in ("min", "max") else held.append(item)
                if waiting:
                    who, asked, _ = waiting.pop(0)
                    give(who, asked)
            elif held:
                give(r.who, int(r.ord))
            else:
                waiting.append([r.who, int(r.ord), None if pd.isna(r.until) else int(r.until)])
        state.update((json.dumps([held, waiting]),))
        yield pd.DataFrame(out, columns=["key", "who", "ord", "val", "score"])

    rows = events.select("key", "ord", "kind", "who", "val", "score", "until")
    return rows.groupBy("key").applyInPandasWithState(run, "key string, who string, ord long, val string, score double", "queues string", "append", "NoTimeout")


def backpressure(ops: DataFrame, strategy: str, max_pending: int) -> DataFrame:
    """The credit counter of ``operators.streams.backpressure`` on a stream of (stream, ord, op, n): (stream, ord, result, pending).
    The state of a stream is one number."""
    import pandas as pd

    if strategy not in ("BLOCK", "DROP", "EVICT_OLD"):
        raise ValueError(strategy)
    refused = {"BLOCK": -1, "DROP": 1, "EVICT_OLD": 0}[strategy]

    def run(k, batches, state):
        pending = state.get[0] if state.exists else 0
        for rows in batches:
            rows = rows.sort_values("ord")
            result, after = [], []
            for op, n in zip(rows["op"], rows["n"], strict=True):
                full = op == "add" and pending >= max_pending
                pending = max(0, pending - int(n)) if op == "ack" else pending + (not full)
                result.append(refused if full else 0)
                after.append(pending)
            yield pd.DataFrame({"stream": [k[0]] * len(rows), "ord": rows["ord"].to_numpy(), "result": result, "pending": after})
        state.update((int(pending),))

    return ops.select("stream", "ord", "op", "n").groupBy("stream").applyInPandasWithState(run, "stream string, ord long, result int, pending long", "pending long", "append", "NoTimeout")


def run_once(df: DataFrame, name: str, checkpoint: str, mode: str = "append"):
    """Read all there is into a table in memory, for tests and small jobs."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)
