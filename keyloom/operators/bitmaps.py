"""Bitmaps as rows (key, pos) of set bits, and bit fields in binary values (most significant bit first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.ranks import numbered


def setbit(bits: DataFrame, new: DataFrame) -> DataFrame:
    """Bits after writes (key, pos, bit), one per position."""
    kept = bits.join(new.select("key", "pos"), ["key", "pos"], "left_anti")
    return kept.select("key", "pos").unionByName(new.where("bit = 1").select("key", "pos"))


def getbit(bits: DataFrame, probes: DataFrame) -> DataFrame:
    hit = bits.select("key", "pos").distinct().withColumn("_b", F.lit(1))
    return probes.join(hit, ["key", "pos"], "left").withColumn("bit", F.coalesce("_b", F.lit(0))).drop("_b")


def bitcount(bits: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Set bits between two bit positions, by distributed bitmaps: one per 32,768 positions, merged by OR."""
    rows = bits if start is None else bits.where(F.col("pos").between(start, end))
    blocks = rows.groupBy("key", F.bitmap_bucket_number("pos").alias("b")).agg(F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("pos"))).alias("n"))
    return blocks.groupBy("key").agg(F.sum("n").alias("n"))


def bitpos(bits: DataFrame, bit: int = 1, length_bits: int | None = None) -> DataFrame:
    """The first set or clear position of each key. Beyond a full value the next clear bit is at its end."""
    if bit:
        return bits.groupBy("key").agg(F.min("pos").alias("pos"))
    # Set bits from 0 without a gap: position equals rank.
    run = numbered(bits.select("key", "pos").distinct(), ["key"], "pos", out="_r")
    first = run.groupBy("key").agg(F.coalesce(F.count_if(F.col("pos") == F.col("_r")), F.lit(0)).alias("pos"))
    return first if length_bits is None else first.withColumn("pos", F.when(F.col("pos") >= length_bits, F.lit(-1)).otherwise(F.col("pos")))


def bitop(bits: DataFrame, op: str, keys: list[str], length_bits: int | None = None) -> DataFrame:
    """(pos) of AND, OR, XOR or NOT; NOT needs the length and one key."""
    rows = bits.where(F.col("key").isin(keys)).select("key", "pos").distinct()
    if op == "NOT":
        return bits.sparkSession.range(length_bits).select(F.col("id").alias("pos")).join(rows.select("pos"), "pos", "left_anti")
    n = rows.groupBy("pos").agg(F.count(F.lit(1)).alias("n"))
    test = {"AND": F.col("n") == len(set(keys)), "OR": F.lit(True), "XOR": F.col("n") % 2 == 1}[op]
    return n.where(test).select("pos")


def count_bytes(value: Column) -> Column:
    """Set bits of a binary value."""
    hexed = F.hex(value)
    return F.coalesce(F.length(F.replace(_bits(hexed), F.lit("0"), F.lit(""))), F.lit(0)).cast("long")


def _bits(hexed: Column) -> Column:
    """A string of 0 and 1 of a string of hexadecimal digits."""
    out = hexed
    for i in range(16):
        digit = f"{i:X}"
        out = F.replace(out, F.lit(digit), F.lit("abcd"[0] + f"{i:04b}".replace("0", "x").replace("1", "y")))
    return F.replace(F.translate(out, "xy", "01"), F.lit("a"), F.lit(""))


def _kind(encoding: str) -> tuple[bool, int]:
    signed, width = encoding[0] == "i", int(encoding[1:])
    if encoding[0] not in "iu" or not 1 <= width <= 63 + signed:
        raise ValueError("types are i1..i64 and u1..u63")
    return signed, width


def bitfield_get(value: Column, encoding: str, offset: int | str) -> Column:
    """An integer of some bits at a bit offset (``#n``: the n-th of its width); bits beyond the value are 0."""
    signed, width = _kind(encoding)
    at = int(offset[1:]) * width if isinstance(offset, str) and offset.startswith("#") else int(offset)
    first, last = at // 8, (at + width - 1) // 8
    hexed = F.hex(F.rpad(F.coalesce(value, F.lit(b"")), last + 1, F.lit(b"\0")))
    bits = F.substring(_bits(F.substring(hexed, first * 2 + 1, (last - first + 1) * 2)), at % 8 + 1, width)
    high = F.conv(F.substring(bits, 1, max(0, width - 32)), 2, 10) if width > 32 else F.lit("0")
    low = F.conv(F.substring(bits, max(1, width - 31), min(width, 32)), 2, 10).cast("long")
    raw = F.shiftleft(high.cast("long"), 32).bitwiseOR(low) if width > 32 else low
    if not signed or width == 64:
        return raw
    return F.when(raw >= F.lit(1 << (width - 1)), raw - F.lit(1 << width if width < 63 else (1 << 62)) - (F.lit(1 << 62) if width == 63 else F.lit(0))).otherwise(raw)


def bounded_add(old: Column, delta: Column, encoding: str, overflow: str = "WRAP") -> Column:
    """old + delta in a type, with WRAP, SAT or FAIL (null) beyond its bounds."""
    signed, width = _kind(encoding)
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    wide = old.cast("decimal(38,0)") + delta.cast("decimal(38,0)")
    a, b, m = (F.lit(str(x)).cast("decimal(38,0)") for x in (low, high, 1 << width))
    if overflow == "SAT":
        return F.least(F.greatest(wide, a), b).cast("long")
    if overflow == "FAIL":
        return F.when(wide.between(a, b), wide).cast("long")
    return (F.pmod(wide - a, m) + a).cast("long")


def bitfield_set(value: Column, encoding: str, offset: int, new: Column) -> Column:
    """The value with an integer's bits written, zero-padded if need be."""
    _, width = _kind(encoding)
    last = (offset + width - 1) // 8
    padded = F.rpad(F.coalesce(value, F.lit(b"")), last + 1, F.lit(b"\0"))
    whole = F.when(F.octet_length(F.coalesce(value, F.lit(b""))) > last + 1, value).otherwise(padded)
    bits = _bits(F.hex(whole))
    piece = F.lpad(F.substring(F.bin(new.cast("long")), -width, width), width, "0")
    neg = F.lpad(F.bin(new.cast("long")), 64, "0")
    piece = F.substring(neg, 65 - width, width)
    joined = F.concat(F.substring(bits, 1, offset), piece, F.substring(bits, F.lit(offset + width + 1), F.length(bits)))
    count = (F.length(joined) / 8).cast("int")
    byte = lambda i: F.lpad(F.conv(F.substr(joined, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), byte), ""))
