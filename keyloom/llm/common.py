"""What the operators share: batch sizes, shared tables, row keys and vectorised word hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_ROWS = 512
_made: list[tuple[SparkSession, str]] = []


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: whole texts travel in them, and some are very long.

    Only lowers the session's own limits, which count when a plan is made.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20)):
        try:
            now = int(spark.conf.get(key))
        except Exception:  # the setting is unknown to this Spark or written with a unit
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors and the driver see; set only where the session names none, as in tests."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.startswith("local["):  # one machine, as in tests
        named = tempfile.mkdtemp(prefix="keyloom-")
        atexit.register(shutil.rmtree, named, True)
    elif not named:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(named)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _drop(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _drop_all() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _drop(spark, path)
        except Exception:  # the session has ended; the cluster's own cleaning of the folder takes over
            pass


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: its lineage ends there, so a lost executor costs no recomputation
    and two readers see the same rows. The tables of a session go when it ends, or by ``release``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._keyloom_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete a table that ``written`` made and nothing reads any more."""
    path = getattr(df, "_keyloom_path", None)
    if path:
        _drop(df.sparkSession, path)
        _made[:] = [m for m in _made if m[1] != path]


def row_key(id_col: Column, text: Column) -> list[Column]:
    """Two longs that name a row by its content, so that equal rows share a key and nulls have one."""
    return [F.xxhash64(id_col, text).alias("_k1"), F.xxhash64(F.lit("row"), text, id_col).alias("_k2")]


def texts(col: pa.Array) -> list[bytes]:
    """The bytes of a binary column; null is empty."""
    return [b"" if x is None else x for x in col.to_pylist()]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- vectorised hashing of words ------------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than ASCII white space."""
    word = np.empty(len(buf) + 2, dtype=np.int8)
    word[0] = word[-1] = 0
    word[1:-1] = ~_SPACE[buf]
    step = np.diff(word)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each word, eight bytes at a time; with another seed other steps are taken from the first byte
    on, so that what collides under one does not under another."""
    n = len(starts)
    length = ends - starts
    base = _BASE + np.uint64(2 * seed * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) if seed else _BASE
    out = length.astype(np.uint64) * base
    if n == 0:
        return out
    pad = np.zeros(len(buf) + 8, dtype=np.uint8)
    pad[: len(buf)] = buf
    view = np.lib.stride_tricks.as_strided(pad.view(np.uint8), shape=(len(buf) + 1, 8), strides=(1, 1))
    live = np.arange(n)
    at = starts.copy()
    left = length.copy()
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    while len(live):
        got = np.ascontiguousarray(view[at]).view("<u8").ravel()
        short = left < 8
        if short.any():
            keep = np.where(short, full >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64), full)
            got = got & keep
        out[live] = mix((out[live] ^ got) * base + np.uint64(0x2545F4914F6CDD1D))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def rolling(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each run of ``k`` consecutive values (none if there are fewer), by doubling the run's length."""
    n = len(x) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    power = mix(x + np.uint64(seed * 0x632BE59BD9B4E019 + 1 & 0xFFFFFFFFFFFFFFFF))
    done, span, acc, bit = 0, 1, None, k
    while bit:
        if bit & 1:
            part = power[done : done + n]
            acc = part.copy() if acc is None else mix(acc * _BASE + part)
            done += span
        bit >>= 1
        if bit:
            power = mix(power[: len(power) - span] * _BASE + power[span:])
            span *= 2
    return acc
