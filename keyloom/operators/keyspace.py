"""Keys of every type: times to live, matching, copying, and SORT with its pattern joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import expire_applies, glob, key_slot, lit, live, ttl_code
from keyloom.functions.ranks import beside


def keys(space: DataFrame, pattern: str, now_ms=None) -> DataFrame:
    rows = space if now_ms is None else space.where(live(F.col("expire_ms"), now_ms))
    return rows.where(glob(F.col("key"), pattern))


def exists(space: DataFrame, probes: DataFrame) -> DataFrame:
    """The number of probes that exist; a key asked for twice counts twice."""
    return probes.join(space.select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def delete(table: DataFrame, gone: DataFrame) -> DataFrame:
    return table.join(gone.select("key"), "key", "left_anti")


def expire(space: DataFrame, probes: DataFrame, now_ms: int, expire_ms: int, flag: str | None = None) -> DataFrame:
    """Probes (key) with ``code`` (1 set or gone, 0 refused or absent), ``deleted``, and the time afterwards."""
    t = lit(expire_ms).cast("long")
    both = probes.join(space.select("key", "expire_ms", F.lit(True).alias("_o")), "key", "left")
    ok = F.col("_o").isNotNull() & expire_applies(F.col("expire_ms"), t, flag)
    out = both.withColumn("code", F.when(ok, 1).otherwise(0)).withColumn("deleted", ok & (t <= now_ms))
    return out.withColumn("expire_ms", F.when((F.col("code") == 1) & ~F.col("deleted"), t).when(F.col("code") == 0, F.col("expire_ms"))).drop("_o")


def ttl(space: DataFrame, probes: DataFrame, now_ms: int, millis: bool = False) -> DataFrame:
    both = probes.join(space.where(live(F.col("expire_ms"), now_ms)).select("key", "expire_ms", F.lit(True).alias("_o")), "key", "left")
    return both.withColumn("ttl", ttl_code(F.col("_o").isNotNull(), F.col("expire_ms"), now_ms, millis)).drop("_o", "expire_ms")


def persist(space: DataFrame, probes: DataFrame) -> DataFrame:
    """The keyspace with the times of the probes gone."""
    marked = space.join(probes.select("key", F.lit(True).alias("_p")).distinct(), "key", "left")
    return marked.withColumn("expire_ms", F.when(F.col("_p").isNull(), F.col("expire_ms"))).drop("_p")


def rename(table: DataFrame, old: str, new: str, nx: bool = False) -> DataFrame:
    """Rows under the new name; what was there goes. With ``nx`` nothing changes where the new name is taken. A source that is
    not there is an error, looked up when the plan is made."""
    if table.where(F.col("key") == old).isEmpty():
        raise ValueError("no such key")
    if old == new or nx and not table.where(F.col("key") == new).isEmpty():
        return table
    return table.where(F.col("key") != new).withColumn("key", F.when(F.col("key") == old, F.lit(new)).otherwise(F.col("key")))


def move(table: DataFrame, key: str, source: int, target: int) -> DataFrame:
    """Rows (db, key, …) of a key in another database, unless it has one of that name."""
    there = F.col("key") == key
    if table.where(there & (F.col("db") == source)).isEmpty() or not table.where(there & (F.col("db") == target)).isEmpty():
        return table
    return table.withColumn("db", F.when(there & (F.col("db") == source), F.lit(target)).otherwise(F.col("db")))


def copy(table: DataFrame, source: str, destination: str, replace: bool = False) -> DataFrame:
    new = table.where(F.col("key") == source).withColumn("key", F.lit(destination))
    if replace:
        return table.where(F.col("key") != destination).unionByName(new)
    return table.unionByName(new.join(table.where(F.col("key") == destination).select("key").distinct(), "key", "left_anti"))


def big_keys(sizes: DataFrame) -> DataFrame:
    """Per type: keys, total and average size, and the biggest key (the least name among equals); rows (key, type, size)."""
    g = sizes.groupBy("type").agg(F.count(F.lit(1)).alias("keys"), F.sum("size").alias("total"), F.max("size").alias("biggest"), F.avg("size").alias("average"), F.min(F.struct((-F.col("size")).alias("s"), F.col("key").alias("k"))).alias("_b"))
    return g.withColumn("biggest_key", F.col("_b.k")).drop("_b")


def hot_keys(access: DataFrame, n: int) -> DataFrame:
    """The ``n`` most used keys of an access log (key)."""
    return access.groupBy("key").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.col("freq").desc(), "key").limit(n)


def slot_stats(usage: DataFrame, metric: str, n: int) -> DataFrame:
    """Per slot: keys and summed metrics, the ``n`` slots with most of one; rows (key, metric columns)."""
    numbers = [c for c in usage.columns if c != "key"]
    g = usage.groupBy(key_slot(F.col("key")).alias("slot")).agg(F.count(F.lit(1)).alias("key_count"), *[F.sum(c).alias(c) for c in numbers])
    return g.orderBy(F.col(metric).desc(), "slot").limit(n)


def evict(space: DataFrame, policy: str, n: int) -> DataFrame:
    """The ``n`` keys that a policy would evict: rows (key, idle_ms, freq, expire_ms)."""
    kind, _, by = policy.partition("-")
    rows = space.where("expire_ms is not null") if kind == "volatile" else space
    order = {"lru": [F.col("idle_ms").desc()], "lfu": [F.col("freq").asc()], "ttl": [F.col("expire_ms").asc()], "random": [F.xxhash64("key")]}[by]
    return rows.orderBy(*order, "key").limit(n)


def sort(elements: DataFrame, by: DataFrame | None = None, gets: dict[str, DataFrame] | None = None, alpha: bool = False, desc: bool = False, offset: int = 0, count: int | None = None, nosort: bool = False) -> DataFrame:
    """SORT: rows (val) in the order of their own or of looked-up weights, with looked-up columns.

    ``by`` and the values of ``gets`` are tables (val, out): a pattern resolved to the key it stands for. An element
    without a weight counts as 0 (as an empty string with ``alpha``), without a got value as null. Ties are in byte order.
    """
    rows = elements
    weight = F.col("val")
    if by is not None:
        rows = rows.join(by.select("val", F.col("out").alias("_w")), "val", "left")
        weight = F.col("_w")
    text = dict(rows.dtypes)["_w" if by is not None else "val"] == "string"
    number = weight.try_cast("double") if text else weight.cast("double")
    refused = F.raise_error(F.lit("a weight is not a number")).cast("double")
    order = F.coalesce(weight.cast("string"), F.lit("")) if alpha else F.coalesce(number, F.when(weight.isNull(), F.lit(0.0)).otherwise(refused))
    for name, t in (gets or {}).items():
        rows = rows.join(t.select("val", F.col("out").alias(name)), "val", "left")
    if not nosort:
        rows = rows.orderBy(*([order.desc(), F.col("val").desc()] if desc else [order.asc(), F.col("val").asc()]))
    rows = rows.offset(offset) if offset else rows
    rows = rows.limit(count) if count is not None and count >= 0 else rows
    return rows.drop("_w")


def access_order(access: DataFrame) -> DataFrame:
    """P(next | key) over consecutive accesses of one client: rows (client, ts, key) to (key, next_key, n, p)."""
    following = beside(access, ["client"], "ts", "key", "next_key", then=["key"], desc=True).where("next_key is not null")
    pairs = following.groupBy("key", "next_key").agg(F.count(F.lit(1)).alias("n"))
    total = pairs.groupBy("key").agg(F.sum("n").alias("_t"))
    return pairs.join(total, "key").select("key", "next_key", "n", (F.col("n") / F.col("_t")).alias("p"))


def dbsize(space: DataFrame, now_ms=None) -> DataFrame:
    rows = space if now_ms is None else space.where(live(F.col("expire_ms"), now_ms))
    return rows.groupBy("type").agg(F.count(F.lit(1)).alias("keys"))


def idle_times(space: DataFrame, now_ms: int) -> DataFrame:
    """Whole seconds since each key was used: rows (key, access_ms)."""
    return space.withColumn("idle_s", F.floor((F.lit(now_ms) - F.col("access_ms")) / 1000).cast("long"))


def profile(elements: DataFrame, now_ms: int) -> DataFrame:
    """A dataset's profile by type, from one row per element (key, type, size, expire_ms): keys, elements, bytes of keys and
    elements, the largest element and the longest key, keys with times and those whose time is past."""
    per_key = elements.groupBy("type", "key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.max("expire_ms").alias("expire_ms"))
    past = F.col("expire_ms") < now_ms
    return per_key.groupBy("type").agg(
        F.count(F.lit(1)).alias("keys"),
        F.sum("n").alias("elements"),
        F.sum(F.octet_length(F.col("key").cast("string"))).cast("long").alias("key_bytes"),
        F.sum("bytes").alias("element_bytes"),
        F.max("largest").alias("largest_element"),
        F.max("n").alias("most_elements"),
        F.count("expire_ms").alias("with_time"),
        F.count_if(F.coalesce(past, F.lit(False))).alias("expired"),
    )


def random_key(space: DataFrame, seed: int = 0) -> DataFrame:
    """One key, by a seeded order; a top-1 that each task cuts first."""
    return space.orderBy(F.xxhash64(F.lit(seed), "key"), "key").limit(1)


def scan_members(table: DataFrame, key: str, column: str = "member", after=None, match: str | None = None, count: int = 10) -> DataFrame:
    """A page of one collection in the order of a column, after a value: the paging of sets, ordered sets and hashes."""
    rows = table.where(F.col("key") == key)
    rows = rows if after is None else rows.where(F.col(column) > after)
    rows = rows if match is None else rows.where(glob(F.col(column), match))
    return rows.orderBy(column).limit(count)


def take(table: DataFrame, probes: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what the probes name, what is left): reading and deleting at once."""
    return table.join(probes.select(*on), on, "left_semi"), table.join(probes.select(*on), on, "left_anti")


def touch(space: DataFrame, probes: DataFrame, now_ms: int) -> DataFrame:
    """The keyspace with the access times of the probes moved to now."""
    hit = probes.select("key", F.lit(True).alias("_t")).distinct()
    return space.join(hit, "key", "left").withColumn("access_ms", F.when(F.col("_t"), F.lit(now_ms).cast("long")).otherwise(F.col("access_ms"))).drop("_t")


def encoding(kind: str, elements, longest) -> object:
    """The compact or full form that a collection of so many elements, the longest of so many bytes, would have. Limits are fixed
    values of the data model: 128 elements and 64 bytes (512 elements for hashes)."""
    most = 512 if kind == "hash" else 128
    full = {"hash": "hashtable", "set": "hashtable", "zset": "skiplist"}[kind]
    return F.when((elements <= most) & (longest <= 64), F.lit("listpack")).otherwise(F.lit(full))
