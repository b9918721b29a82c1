"""Cardinality and frequency sketches. Registers are exact in SQL: 2**14 of them, each the greatest rank of its hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

P = 14
Q = 64 - P
M = 1 << P
ALPHA_INF = 0.721347520444481703680


def registers(members: DataFrame, member: str = "member", hashed: Column | None = None) -> DataFrame:
    """(key, reg, rank) of members' 64-bit hashes: the least 14 bits choose, the zeros after them count."""
    h = F.xxhash64(member) if hashed is None else hashed
    rest = F.shiftrightunsigned(h, P).bitwiseOR(F.lit(1 << Q))
    lowest = rest.bitwiseAND(-rest)
    rank = F.length(F.bin(lowest))
    return members.groupBy("key", h.bitwiseAND(F.lit(M - 1)).cast("int").alias("reg")).agg(F.max(rank).cast("int").alias("rank"))


def merge(regs: DataFrame, key: str | None = None) -> DataFrame:
    """The greatest rank of each register over several sketches."""
    rows = regs if key is None else regs.withColumn("key", F.lit(key))
    return rows.groupBy("key", "reg").agg(F.max("rank").alias("rank"))


def estimate(regs: DataFrame) -> DataFrame:
    """(key, estimate) from the histogram of ranks: ``alpha * m**2`` over a sum whose ends are corrected for registers that are
    empty (sigma) and full (tau)."""
    hist = regs.groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("rank") == k).alias(f"c{k}") for k in range(1, Q + 2)])
    m = float(M)
    # z = m tau(1 - c[q+1]/m); then halve and add from rank q down to 1; then m sigma(c[0]/m).
    z = m * _tau(1 - F.col(f"c{Q + 1}") / m)
    for k in range(Q, 0, -1):
        z = (z + F.col(f"c{k}")) * 0.5
    z = z + m * _sigma((M - F.col("n")) / m)
    return hist.select("key", F.round(ALPHA_INF * m * m / z).cast("long").alias("estimate"))


def _series(x: Column, step, start: Column, n: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, step, lambda a: a["z"])


def _sigma(x: Column) -> Column:
    """x + sum of x**(2**k) * 2**(k-1); infinite at 1."""
    start = F.struct(x.cast("double").alias("z"), x.cast("double").alias("x"), F.lit(1.0).alias("y"))
    out = _series(x, lambda a, _: F.struct((a["z"] + a["x"] * a["x"] * a["y"]).alias("z"), (a["x"] * a["x"]).alias("x"), (a["y"] * 2.0).alias("y")), start, 40)
    return F.when(x >= 1.0, F.lit(float("inf"))).otherwise(out)


def _tau(x: Column) -> Column:
    """(1 - x - sum of (1 - x**(2**-k))**2 * 2**-k) / 3; 0 at both ends."""
    start = F.struct((1 - x).cast("double").alias("z"), x.cast("double").alias("x"), F.lit(1.0).alias("y"))
    out = _series(x, lambda a, _: F.struct((a["z"] - (1 - F.sqrt(a["x"])) * (1 - F.sqrt(a["x"])) * a["y"] * 0.5).alias("z"), F.sqrt(a["x"]).alias("x"), (a["y"] * 0.5).alias("y")), start, 60)
    return F.when((x <= 0.0) | (x >= 1.0), F.lit(0.0)).otherwise(out / 3)


def distinct_sketch(members: DataFrame, member: str = "member") -> DataFrame:
    """The built-in sketch of the same precision, for storage and later unions."""
    return members.groupBy("key").agg(F.hll_sketch_agg(member, P).alias("sketch"))


def distinct_union(sketches: DataFrame) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


def bloom_positions(hashed: Column, bits: int, probes: int) -> Column:
    """The bits of a 60-bit hash by double hashing: its lower half, plus i times its upper half made odd."""
    low, step = hashed.bitwiseAND(F.lit((1 << 30) - 1)), F.shiftright(hashed, 30).bitwiseOR(F.lit(1))
    return F.array_distinct(F.array(*[(low + step * i) % bits for i in range(probes)]))


def bloom_size(expected: int, rate: float = 0.01) -> tuple[int, int]:
    """(bits, probes) for so many members and that share of false hits."""
    import math

    bits = max(512, math.ceil(-expected * math.log(rate) / math.log(2) ** 2 / 512) * 512)
    return bits, max(1, round(bits / max(1, expected) * math.log(2)))


def bloom_add(members: DataFrame, bits: int, probes: int, hashed: Column) -> DataFrame:
    """A Bloom filter per key as rows (key, pos) of set bits, like any bitmap: filters merge by union, and neither building
    nor reading one needs it in one place."""
    return members.select("key", F.explode(bloom_positions(hashed, bits, probes)).alias("pos")).distinct()


def bloom_check(filter_: DataFrame, probes_of: DataFrame, bits: int, probes: int, hashed: Column) -> DataFrame:
    """Rows (key, …) with ``maybe``: false means certainly not added."""
    wanted = probes_of.withColumn("_p", bloom_positions(hashed, bits, probes))
    rows = wanted.select("*", F.explode("_p").alias("pos")).join(filter_.select("key", "pos", F.lit(1).alias("_b")), ["key", "pos"], "left")
    return rows.groupBy(*probes_of.columns, "_p").agg((F.count("_b") == F.size("_p")).alias("maybe")).drop("_p")


def frequencies(members: DataFrame, member: str = "member") -> DataFrame:
    """Exact counts; ``F.count_min_sketch`` is there for what cannot be held."""
    return members.groupBy("key", member).agg(F.count(F.lit(1)).alias("n"))
