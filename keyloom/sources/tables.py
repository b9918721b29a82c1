"""Typed tables of the data model, op-logs and their fold, snapshots, and the keyspace view.

One row per element: kv_string(key, val), kv_list(key, pos, val), kv_set(key, member), kv_zset(key, member, score),
kv_hash(key, field, val, field_expire_ms), kv_stream(key, ms, seq, fields), each with ``expire_ms`` where keys have times.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.exprs import glob, live


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_log(log: DataFrame, keys: list[str], value: str = "val", version: str = "version", deleted: str | None = None) -> DataFrame:
    """The state after an append-only log: the value of the highest version of each key, without keys whose last row deletes.

    The fold is an aggregation with partial sums on the map side, so a hot key costs a row per task."""
    row = F.struct(F.col(value).alias("v"), (F.col(deleted) if deleted else F.lit(False)).alias("d"))
    last = log.groupBy(*keys).agg(F.max_by(row, F.col(version)).alias("r"))
    return last.where(~F.col("r.d")).select(*keys, F.col("r.v").alias(value))


def live_rows(df: DataFrame, now_ms, expire: str = "expire_ms") -> DataFrame:
    return df.where(live(F.col(expire), now_ms))


def keyspace(**tables: DataFrame) -> DataFrame:
    """(key, type, expire_ms) of every key of typed tables given by type name."""
    parts = [t.select("key", F.lit(kind).alias("type"), (F.col("expire_ms") if "expire_ms" in t.columns else F.lit(None).cast("long")).alias("expire_ms")).distinct() for kind, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def save_snapshot(df: DataFrame, path: str, buckets: list[str] | None = None) -> None:
    """A point-in-time copy as Parquet, optionally partitioned."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*buckets) if buckets else w).parquet(path)


def load_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def dump(df: DataFrame, key: Column | str = "key") -> DataFrame:
    """(key, payload, crc): each row's other columns as JSON with a checksum, for ``restore``."""
    rest = [c for c in df.columns if c != key]
    payload = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return df.select("key", payload.alias("payload"), F.crc32(payload.cast("binary")).alias("crc"))


def restore(dumped: DataFrame, schema: str) -> DataFrame:
    """Rows of ``dump``; those whose checksum fails are refused."""
    good = dumped.where(F.crc32(F.col("payload").cast("binary")) == F.col("crc"))
    return good.select("key", F.from_json("payload", schema).alias("r")).select("key", "r.*")


def scan(keys: DataFrame, after: str | None = None, match: str | None = None, count: int = 10, type_: str | None = None) -> DataFrame:
    """A page of keys in key order, the page after the key ``after``: no key twice, none missed that stays."""
    if after is not None:
        keys = keys.where(F.col("key") > after)
    if match is not None:
        keys = keys.where(glob(F.col("key"), match))
    if type_ is not None:
        keys = keys.where(F.col("type") == type_)
    return keys.orderBy("key").limit(count)
