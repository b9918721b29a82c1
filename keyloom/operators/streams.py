"""Append-only streams: rows (key, ms, seq, …) in the order of (ms, seq), with groups, consumers and pending entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.ranks import numbered

Id = tuple[int, int]
FIRST, LAST = (0, 0), ((1 << 63) - 1, (1 << 63) - 1)


def parse_id(text: str, end: bool = False) -> tuple[Id, bool]:
    """((ms, seq), exclusive) of ``-``, ``+``, ``ms``, ``ms-seq``, with ``(`` before an exclusive bound."""
    open_ = text.startswith("(")
    t = text[open_:]
    if t in "-+":
        return (FIRST if t == "-" else LAST), open_
    ms, _, seq = t.partition("-")
    return (int(ms), int(seq) if seq else LAST[1] if end else 0), open_


def _after(i: Id, inclusive: bool) -> Column:
    ms, seq = F.col("ms"), F.col("seq")
    return (ms > i[0]) | ((ms == i[0]) & (seq >= i[1] if inclusive else seq > i[1]))


def _before(i: Id, inclusive: bool) -> Column:
    ms, seq = F.col("ms"), F.col("seq")
    return (ms < i[0]) | ((ms == i[0]) & (seq <= i[1] if inclusive else seq < i[1]))


def assign_ids(rows: DataFrame, ms: str = "ms", order: str = "ord") -> DataFrame:
    """``seq`` within each millisecond of a stream, in the order of a column."""
    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("key", ms).orderBy(order)) - 1).cast("long"))


def xadd(stream: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` (key, ms, seq, …) appended. Ids not above the stream's last one are an error."""
    last = stream.groupBy("key").agg(F.max(F.struct("ms", "seq")).alias("_l"))
    late = F.struct("ms", "seq") <= F.col("_l")
    checked = new.join(last, "key", "left").withColumn("ms", F.when(F.coalesce(late, F.lit(False)), F.raise_error(F.lit("the id is not above the last one")).cast("long")).otherwise(F.col("ms"))).drop("_l")
    return stream.unionByName(checked)


def xlen(stream: DataFrame) -> DataFrame:
    return stream.groupBy("key").agg(F.count(F.lit(1)).alias("len"))


def xrange(stream: DataFrame, start: str = "-", end: str = "+", count: int | None = None, rev: bool = False) -> DataFrame:
    """Entries between two ids, the first ``count`` of each stream from the start (``rev``: from the end)."""
    (a, a_open), (b, b_open) = parse_id(start), parse_id(end, True)
    # The plain bound on ms reaches the Parquet scan.
    rows = stream.where(F.col("ms").between(a[0], b[0]) & _after(a, not a_open) & _before(b, not b_open))
    if count is None:
        return rows
    order = [F.col("ms").desc(), F.col("seq").desc()] if rev else ["ms", "seq"]
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where(F.col("_r") <= count).drop("_r")


def xread(stream: DataFrame, after: DataFrame, count: int | None = None) -> DataFrame:
    """Entries above each stream's own id: ``after`` has (key, last_ms, last_seq)."""
    rows = stream.join(after, "key").where((F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))).drop("last_ms", "last_seq")
    if count is None:
        return rows
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("ms", "seq"))).where(F.col("_r") <= count).drop("_r")


def xdel(stream: DataFrame, ids: DataFrame) -> DataFrame:
    return stream.join(ids.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_anti")


def xtrim(stream: DataFrame, maxlen: int | None = None, minid: str | None = None) -> DataFrame:
    if minid is not None:
        return stream.where(_after(parse_id(minid)[0], True))
    w = Window.partitionBy("key").orderBy(F.col("ms").desc(), F.col("seq").desc())
    return stream.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= maxlen).drop("_r")


def xtrim_split(stream: DataFrame, maxlen: int) -> tuple[DataFrame, DataFrame]:
    """(left, gone): the newest ``maxlen`` entries of each stream, and those that trimming to it takes away. For any ``maxlen``: places
    are counted by buckets, not by one task for a stream."""
    placed = numbered(stream, ["key"], "ms", ["seq"], desc=True, out="_r")
    return placed.where(F.col("_r") < maxlen).drop("_r"), placed.where(F.col("_r") >= maxlen).drop("_r")


def xinfo_stream(stream: DataFrame) -> DataFrame:
    ids = F.struct("ms", "seq")
    g = stream.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(ids).alias("f"), F.max(ids).alias("l"))
    return g.select("key", "length", F.col("f.ms").alias("first_ms"), F.col("f.seq").alias("first_seq"), F.col("l.ms").alias("last_ms"), F.col("l.seq").alias("last_seq"))


def _id(ms: str, seq: str) -> Column:
    return F.struct(F.col(ms).alias("ms"), F.col(seq).alias("seq"))


def xstate(stream: DataFrame, deleted: DataFrame | None = None, trimmed: DataFrame | None = None) -> DataFrame:
    """Each stream's own record: length, first and last entry, the last id it ever had, the greatest id that was deleted, and how
    many entries were ever added. ``deleted`` and ``trimmed`` are ids (key, ms, seq) that are no longer in ``stream``; only
    deletions leave a mark. Ids are null where there is none."""
    parts = [stream.select("key", "ms", "seq", F.lit(0).alias("_k"))]
    parts += [t.select("key", "ms", "seq", F.lit(k).alias("_k")) for t, k in ((deleted, 1), (trimmed, 2)) if t is not None]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    i, here = F.struct("ms", "seq"), F.col("_k") == 0
    g = rows.groupBy("key").agg(
        F.count_if(here).alias("length"),
        F.min(F.when(here, i)).alias("f"),
        F.max(i).alias("l"),
        F.max(F.when(F.col("_k") == 1, i)).alias("d"),
        F.count(F.lit(1)).alias("entries_added"),
    )
    return g.select("key", "length", *[F.col(f"{c}.{p}").alias(f"{n}_{p}") for c, n in (("f", "first"), ("l", "last"), ("d", "max_deleted")) for p in ("ms", "seq")], "entries_added")


def xsetid(state: DataFrame, key: str, id_: str, entries_added: int | None = None, max_deleted: str | None = None) -> DataFrame:
    """Records with a stream's last id set, and with it, if given, its counter and greatest deleted id. An id below what the stream
    has, or a counter below its length, is an error when the row is read."""
    (ms, seq), _ = parse_id(id_)
    put = lambda c, v: F.when(F.col("key") == key, v).otherwise(F.col(c))
    new = F.struct(F.lit(ms).cast("long").alias("ms"), F.lit(seq).cast("long").alias("seq"))
    low = F.col("length").cast("boolean") & (new < _id("last_ms", "last_seq")) | (F.coalesce(new < _id("max_deleted_ms", "max_deleted_seq"), F.lit(False)))
    few = F.lit(entries_added) < F.col("length") if entries_added is not None else F.lit(False)
    wrong = F.raise_error(F.lit("the id or the counter is smaller than what the stream has")).cast("long")
    out = state.withColumns({"last_ms": put("last_ms", F.when(low | few, wrong).otherwise(F.lit(ms).cast("long"))), "last_seq": put("last_seq", F.lit(seq).cast("long"))})
    if entries_added is not None:
        out = out.withColumn("entries_added", put("entries_added", F.lit(entries_added).cast("long")))
    if max_deleted is not None:
        (a, b), _ = parse_id(max_deleted)
        out = out.withColumns({"max_deleted_ms": put("max_deleted_ms", F.lit(a).cast("long")), "max_deleted_seq": put("max_deleted_seq", F.lit(b).cast("long"))})
    return out


def xreadgroup(stream: DataFrame, groups: DataFrame, consumers: list[str], noack: bool = False, count: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(delivered, pending, groups) after each group reads all that is new, or the first ``count`` of it, dealt to the consumers
    in turn.

    ``groups``: (key, grp, last_ms, last_seq, entries_read). Each entry goes to one consumer of each group.
    """
    rows = stream.join(groups.select("key", "grp", "last_ms", "last_seq"), "key").where((F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))).drop("last_ms", "last_seq")
    dealt = numbered(rows, ["key", "grp"], "ms", ["seq"], out="_i")
    dealt = dealt if count is None else dealt.where(F.col("_i") < count)
    delivered = dealt.withColumn("consumer", F.element_at(F.array(*map(F.lit, consumers)), (F.col("_i") % len(consumers) + 1).cast("int"))).drop("_i")
    pending = delivered.select("key", "grp", "ms", "seq", "consumer", F.lit(1).alias("delivery_count"))
    read = delivered.groupBy("key", "grp").agg(F.max(F.struct("ms", "seq")).alias("_l"), F.count(F.lit(1)).alias("_n"))
    after = groups.join(read, ["key", "grp"], "left").select("key", "grp", F.coalesce("_l.ms", "last_ms").alias("last_ms"), F.coalesce("_l.seq", "last_seq").alias("last_seq"), (F.col("entries_read") + F.coalesce("_n", F.lit(0))).alias("entries_read"))
    return delivered, pending.limit(0) if noack else pending, after


def xreadgroup_own(stream: DataFrame, pending: DataFrame, consumer: str, after: str = "0", count: int | None = None) -> DataFrame:
    """A consumer's own pending entries above an id, with the stream's columns (null where the entry was deleted)."""
    (ms, seq), _ = parse_id(after)
    mine = pending.where(F.col("consumer") == consumer).where(_after((ms, seq), False)).select("key", "grp", "ms", "seq")
    if count is not None:
        mine = mine.withColumn("_r", F.row_number().over(Window.partitionBy("key", "grp").orderBy("ms", "seq"))).where(F.col("_r") <= count).drop("_r")
    return mine.join(stream, ["key", "ms", "seq"], "left")


def xack(pending: DataFrame, acks: DataFrame) -> DataFrame:
    return pending.join(acks.select("key", "grp", "ms", "seq"), ["key", "grp", "ms", "seq"], "left_anti")


def xpending(pending: DataFrame) -> DataFrame:
    """Per group: entries, least and greatest id; and per consumer counts as a map."""
    per = pending.groupBy("key", "grp", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("ms", "seq")).alias("lo"), F.max(F.struct("ms", "seq")).alias("hi"))
    return per.groupBy("key", "grp").agg(F.sum("n").alias("pending"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count(F.lit(1)).alias("consumers")).select("key", "grp", "pending", F.col("lo.ms").alias("min_ms"), F.col("lo.seq").alias("min_seq"), F.col("hi.ms").alias("max_ms"), F.col("hi.seq").alias("max_seq"), "consumers")


def xpending_range(pending: DataFrame, now_ms: int, min_idle: int = 0, consumer: str | None = None, count: int = 10, start: str = "-", end: str = "+") -> DataFrame:
    """The first ``count`` pending entries of each group between two ids, idle long enough."""
    (a, a_open), (b, b_open) = parse_id(start), parse_id(end, True)
    rows = pending.where(_after(a, not a_open) & _before(b, not b_open)).where(F.lit(now_ms) - F.col("delivery_ms") >= min_idle)
    rows = rows if consumer is None else rows.where(F.col("consumer") == consumer)
    return rows.withColumn("idle", F.lit(now_ms) - F.col("delivery_ms")).withColumn("_r", F.row_number().over(Window.partitionBy("key", "grp").orderBy("ms", "seq"))).where(F.col("_r") <= count).drop("_r")


def xclaim(pending: DataFrame, consumer: str, now_ms: int, min_idle: int, ids: DataFrame | None = None, justid: bool = False) -> DataFrame:
    """The pending entries with those idle long enough (and in ``ids``, if given) given to a consumer."""
    named = F.lit(True)
    if ids is not None:
        pending = pending.join(ids.select("key", "grp", "ms", "seq", F.lit(True).alias("_c")).distinct(), ["key", "grp", "ms", "seq"], "left")
        named = F.coalesce("_c", F.lit(False))
    take = named & (F.lit(now_ms) - F.col("delivery_ms") >= min_idle)
    out = pending.withColumns({"consumer": F.when(take, F.lit(consumer)).otherwise(F.col("consumer")), "delivery_count": F.col("delivery_count") + F.when(take & F.lit(not justid), 1).otherwise(0), "delivery_ms": F.when(take, F.lit(now_ms).cast("long")).otherwise(F.col("delivery_ms"))})
    return out.drop("_c")


def xautoclaim(pending: DataFrame, stream: DataFrame, consumer: str, now_ms: int, min_idle: int, count: int = 100) -> DataFrame:
    """The first ``count`` idle entries of each group that are still in the stream, given to a consumer."""
    there = pending.join(stream.select("key", "ms", "seq"), ["key", "ms", "seq"], "left_semi")
    idle = there.where(F.lit(now_ms) - F.col("delivery_ms") >= min_idle)
    pick = idle.withColumn("_r", F.row_number().over(Window.partitionBy("key", "grp").orderBy("ms", "seq"))).where(F.col("_r") <= count)
    return xclaim(there, consumer, now_ms, min_idle, pick)


def xautoclaim_page(pending: DataFrame, stream: DataFrame, consumer: str, now_ms: int, min_idle: int, start: str = "0", count: int = 100) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pending afterwards, claimed, deleted ids, cursors) of one page of each group's pending entries from an id on.

    A page ends after ``count`` entries that were claimed or found deleted, or ten times as many looked at. Deleted ones leave
    the pending list. The cursor (key, grp, ms, seq) is the next entry to look at, 0-0 after the last."""
    (ms, seq), _ = parse_id(start)
    there = stream.select("key", "ms", "seq", F.lit(True).alias("_in"))
    w = Window.partitionBy("key", "grp").orderBy("ms", "seq")
    seen = pending.where(_after((ms, seq), True)).join(there, ["key", "ms", "seq"], "left")
    gone, idle = F.col("_in").isNull(), F.lit(now_ms) - F.col("delivery_ms") >= min_idle
    taken = F.when(gone | idle, 1).otherwise(0)
    at = seen.withColumns({"_gone": gone, "_take": ~gone & idle, "_at": F.row_number().over(w), "_before": F.sum(taken).over(w) - taken})
    page = at.withColumn("_page", (F.col("_at") <= 10 * count) & (F.col("_before") < count)).drop("_in", "_at", "_before")
    deleted = page.where("_page AND _gone").select("key", "grp", "ms", "seq")
    pick = page.where("_page AND _take").select("key", "grp", "ms", "seq")
    after = xclaim(xack(pending, deleted), consumer, now_ms, min_idle, pick)
    claimed = after.join(pick, ["key", "grp", "ms", "seq"], "left_semi")
    nexts = page.groupBy("key", "grp").agg(F.min(F.when(~F.col("_page"), F.struct("ms", "seq"))).alias("c"))
    zero = F.lit(0).cast("long")
    return after, claimed, deleted, nexts.select("key", "grp", F.coalesce("c.ms", zero).alias("ms"), F.coalesce("c.seq", zero).alias("seq"))


def group_lag() -> Column:
    """Entries that a group has yet to read, from its own and its stream's record; null where deletions make it unknown."""
    at, first, last, gone = _id("last_ms", "last_seq"), _id("_first_ms", "_first_seq"), _id("_end_ms", "_end_seq"), _id("_gone_ms", "_gone_seq")
    marked = F.col("_gone_ms").isNotNull()
    whole = ~marked | F.coalesce(gone < first, F.lit(False))  # no deletion between the first entry and the last
    ahead = (F.col("_length") > 0) & marked & (at <= gone)
    nowhere = (F.col("last_ms") == 0) & (F.col("last_seq") == 0)
    none = F.lit(None).cast("long")
    return (
        F.when(F.coalesce("_added", F.lit(0)) == 0, F.lit(0).cast("long"))
        .when(F.col("entries_read").isNotNull() & ~ahead, F.col("_added") - F.col("entries_read"))
        .when((F.col("_length") == 0) & (at <= last), F.lit(0).cast("long"))
        .when(~nowhere & marked & (at < gone), none)
        .when(at == last, F.lit(0).cast("long"))
        .when(at > last, none)
        .when(whole & (at < first), F.col("_length"))
        .when(whole & (at == first), F.col("_length") - 1)
        .otherwise(none)
    )


def xinfo_groups(stream: DataFrame, groups: DataFrame, pending: DataFrame, state: DataFrame | None = None, consumers: DataFrame | None = None) -> DataFrame:
    """Per group: consumers, pending entries, last id and the lag behind the stream. ``state`` are the streams' records (``xstate``),
    without which nothing is taken to be deleted; ``consumers`` (key, grp, consumer) also counts those without entries."""
    s = (xstate(stream) if state is None else state).select("key", F.col("length").alias("_length"), F.col("first_ms").alias("_first_ms"), F.col("first_seq").alias("_first_seq"), F.col("last_ms").alias("_end_ms"), F.col("last_seq").alias("_end_seq"), F.col("max_deleted_ms").alias("_gone_ms"), F.col("max_deleted_seq").alias("_gone_seq"), F.col("entries_added").alias("_added"))
    named = pending.select("key", "grp", "consumer", F.lit(1).alias("_p"))
    if consumers is not None:
        named = named.unionByName(consumers.select("key", "grp", "consumer", F.lit(None).cast("int").alias("_p")))
    per = named.groupBy("key", "grp").agg(F.countDistinct("consumer").alias("consumers"), F.count("_p").alias("pending"))
    g = groups.join(s, "key", "left").join(per, ["key", "grp"], "left")
    return g.select("key", "grp", F.coalesce("consumers", F.lit(0)).alias("consumers"), F.coalesce("pending", F.lit(0)).alias("pending"), "last_ms", "last_seq", "entries_read", group_lag().alias("lag"))


def xinfo_consumers(pending: DataFrame, now_ms: int, consumers: DataFrame | None = None) -> DataFrame:
    """Per consumer: pending entries and the time since it was last seen. ``consumers`` (key, grp, consumer, seen_ms) adds those
    without entries."""
    rows = pending.select("key", "grp", "consumer", F.lit(1).alias("_p"), F.col("delivery_ms").alias("_t"))
    if consumers is not None:
        rows = rows.unionByName(consumers.select("key", "grp", "consumer", F.lit(None).cast("int").alias("_p"), F.col("seen_ms").alias("_t")))
    return rows.groupBy("key", "grp", "consumer").agg(F.count("_p").alias("pending"), (F.lit(now_ms) - F.max("_t")).alias("idle"))


def xgroup_createconsumer(consumers: DataFrame, key: str, grp: str, consumer: str, now_ms: int) -> tuple[DataFrame, int]:
    """(consumers (key, grp, consumer, seen_ms) with a new one, 1), or as they were and 0 if it is there."""
    at = (F.col("key") == key) & (F.col("grp") == grp) & (F.col("consumer") == consumer)
    if not consumers.where(at).isEmpty():
        return consumers, 0
    new = consumers.sparkSession.createDataFrame([(key, grp, consumer, now_ms)], "key string, grp string, consumer string, seen_ms long")
    return consumers.unionByName(new), 1


_STRETCH = 1 << 16


def backpressure(ops: DataFrame, strategy: str, max_pending: int, sample_rate: int = 10) -> DataFrame:
    """The credit counter over a log (stream, ord, op = add or ack, n): ``result`` 0 taken, 1 dropped, 2 sampled out, -1 no credit,
    and ``pending`` afterwards. Rows of one ``ord`` go by op, then n; a null n is 0, a null stream is a stream.

    A step adds one up to the limit or takes some down to nothing, and steps in a row are again a sum between two bounds. So a
    stream is cut in stretches of 65,536 rows: each is summed up in its own task, one row a stretch gives the counts that the
    stretches begin with, and each is walked in its own task. With SAMPLE a step also depends on how many found no room before,
    which has no such sum, so there a stream is one task, in batches."""
    import pyarrow as pa

    if strategy not in ("BLOCK", "DROP", "SAMPLE", "EVICT_OLD"):
        raise ValueError(strategy)
    most = max(max_pending, 0)
    kinds = "stream string, _c long, _first boolean, _i long, ord long, op string, n long"

    def lists(batch, *columns):
        return zip(*[batch.column(c).to_pylist() for c in columns], strict=True)

    def summed(batches):
        """Each stretch as (sum, what it makes of 0, what it makes of the limit)."""
        at, out = (), []
        for batch in batches:
            for stream, c, op, n in lists(batch, 0, 1, 5, 6):
                if (stream, c) != at:
                    at = stream, c
                    out.append([stream, c, 0, 0, most])
                now = out[-1]
                if op == "ack":
                    now[2:] = now[2] - n, max(now[3] - n, 0), max(now[4] - n, 0)
                else:
                    now[2:] = now[2] + 1, min(now[3] + 1, most), min(now[4] + 1, most)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string() if i == 0 else pa.int64()) for i, x in enumerate(zip(*out, strict=True))], ["stream", "_c", "total", "low", "high"])

    def begun(batches):
        """A row for each stretch, with the count it begins with, to stand before its others."""
        at, pending = (), 0
        for batch in batches:
            out = []
            for stream, c, total, low, high in lists(batch, 0, 1, 2, 3, 4):
                if (stream,) != at:
                    at, pending = (stream,), 0
                out.append((stream, c, pending))
                pending = min(high, max(low, pending + total))
            if out:
                stream, c, n = zip(*out, strict=True)
                none = pa.nulls(len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(stream, pa.string()), pa.array(c, pa.int64()), pa.array([True] * len(out)), none, none, pa.nulls(len(out), pa.string()), pa.array(n, pa.int64())], ["stream", "_c", "_first", "_i", "ord", "op", "n"])

    def walk(batches):
        at, pending, seen = (), 0, 0
        for batch in batches:
            out = []
            for stream, c, first, order, op, n in lists(batch, 0, 1, 2, 4, 5, 6):
                if (stream, c) != at:
                    at, pending, seen = (stream, c), 0, 0
                if first:
                    pending = n
                    continue
                r = 0
                if op == "ack":
                    pending -= min(n, pending)
                elif pending < max_pending:
                    pending += 1
                elif strategy == "EVICT_OLD":
                    pass  # one goes, one comes
                elif strategy == "SAMPLE":
                    seen += 1
                    if seen % sample_rate:
                        r = 2
                    else:
                        pending += 1
                else:
                    r = 1 if strategy == "DROP" else -1
                out.append((stream, order, r, pending))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["stream", "ord", "result", "pending"])

    def dealt(rows, *keys):
        return rows.repartition(*keys).sortWithinPartitions("stream", "_c", *([F.col("_first").desc(), "_i", "op", "n"] if "_c" in keys else []))

    log = ops.select(F.col("stream").cast("string").alias("stream"), F.col("ord").cast("long").alias("ord"), F.col("op").cast("string").alias("op"), F.greatest(F.coalesce(F.col("n").cast("long"), F.lit(0)), F.lit(0)).cast("long").alias("n"))
    if strategy == "SAMPLE":
        rows = log.select("stream", F.lit(0).cast("long").alias("_c"), F.lit(False).alias("_first"), F.col("ord").alias("_i"), "ord", "op", "n")
        return rows.repartition("stream").sortWithinPartitions("stream", "_i", "op", "n").mapInArrow(walk, "stream string, ord long, result int, pending long")
    placed = numbered(log, ["stream"], "ord", ["op", "n"], out="_i")
    rows = placed.select("stream", F.expr(f"_i div {_STRETCH}").alias("_c"), F.lit(False).alias("_first"), "_i", "ord", "op", "n")
    stretches = dealt(rows, "stream", "_c").mapInArrow(summed, "stream string, _c long, total long, low long, high long")
    firsts = dealt(stretches, "stream").mapInArrow(begun, kinds)
    return dealt(rows.unionByName(firsts), "stream", "_c").mapInArrow(walk, "stream string, ord long, result int, pending long")


def backpressure_config(settings: DataFrame, stream: str, strategy: str | None = None, max_pending: int | None = None, sample_rate: int | None = None) -> DataFrame:
    """Settings (stream, strategy, max_pending, sample_rate), one row per stream: a new stream's, or some of an old one's changed."""
    old = settings.where(F.col("stream") == stream).first()
    if old is None and (strategy is None or max_pending is None):
        raise ValueError("a new stream needs a strategy and a limit")
    if strategy not in (None, "BLOCK", "DROP", "SAMPLE", "EVICT_OLD"):
        raise ValueError(strategy)
    row = (stream, strategy or old.strategy, max_pending if max_pending is not None else old.max_pending, sample_rate or (old.sample_rate if old else 10))
    return settings.where(F.col("stream") != stream).unionByName(settings.sparkSession.createDataFrame([row], "stream string, strategy string, max_pending long, sample_rate long"))


def backpressure_info(walked: DataFrame, max_pending: int) -> DataFrame:
    """Counters of each stream from the result of ``backpressure``: what was taken, dropped, sampled out and refused, and how full
    it is at the end."""
    g = walked.groupBy("stream").agg(*[F.count_if(F.col("result") == r).alias(n) for r, n in ((0, "done"), (1, "dropped"), (2, "sampled"), (-1, "refused"))], F.max_by("pending", "ord").alias("pending"))
    return g.withColumn("ratio", F.col("pending") / F.lit(float(max_pending)))


def xgroup_create(groups: DataFrame, stream: DataFrame, key: str, grp: str, id_: str = "$", entries_read: int | None = None) -> DataFrame:
    """The groups with a new one that begins after an id, ``$`` for the stream's last. A group that exists is an error."""
    spark = groups.sparkSession
    if not groups.where((F.col("key") == key) & (F.col("grp") == grp)).isEmpty():
        raise ValueError("the group exists")
    if id_ == "$":
        last = stream.where(F.col("key") == key).agg(F.max(F.struct("ms", "seq")).alias("l"), F.count(F.lit(1)).alias("n")).first()
        ms, seq, n = (last.l.ms, last.l.seq, last.n) if last.l else (0, 0, 0)
    else:
        (ms, seq), n = parse_id(id_)[0], 0
    new = spark.createDataFrame([(key, grp, ms, seq, n if entries_read is None else entries_read)], "key string, grp string, last_ms long, last_seq long, entries_read long")
    return groups.unionByName(new)


def xgroup_setid(groups: DataFrame, key: str, grp: str, id_: str, entries_read: int = 0) -> DataFrame:
    (ms, seq), _ = parse_id(id_)
    at = (F.col("key") == key) & (F.col("grp") == grp)
    put = lambda c, v: F.when(at, F.lit(v).cast("long")).otherwise(F.col(c))
    return groups.withColumns({"last_ms": put("last_ms", ms), "last_seq": put("last_seq", seq), "entries_read": put("entries_read", entries_read)})


def xgroup_destroy(groups: DataFrame, pending: DataFrame, key: str, grp: str) -> tuple[DataFrame, DataFrame]:
    gone = (F.col("key") == key) & (F.col("grp") == grp)
    return groups.where(~gone), pending.where(~gone)


def xgroup_delconsumer(pending: DataFrame, key: str, grp: str, consumer: str) -> DataFrame:
    return pending.where(~((F.col("key") == key) & (F.col("grp") == grp) & (F.col("consumer") == consumer)))


def pending_of(pending: DataFrame, key: str, grp: str, consumer: str) -> int:
    """How many entries go with a consumer that is deleted."""
    return pending.where((F.col("key") == key) & (F.col("grp") == grp) & (F.col("consumer") == consumer)).count()
