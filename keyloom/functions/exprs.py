"""Column kernels that several families share, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
#: Fixed values of the geographic kernels: metres in a unit, the sphere's radius in metres, bounds of the grid, base 32.
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "mi": 1609.34}
EARTH_RADIUS = 6372797.560856
LON_MAX, LAT_MAX, GEO_BITS = 180.0, 85.05112878, 26
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def clamp_range(length: Column, start: int, stop: int) -> tuple[Column, Column]:
    """0-based inclusive bounds of a range whose negative ends count from the tail. Empty where the first exceeds the second."""
    low = F.greatest(length + start, F.lit(0)) if start < 0 else F.lit(start)
    high = length + stop if stop < 0 else F.least(F.lit(stop), length - 1)
    return low, high


def score_range(value: Column, low="-inf", high="+inf") -> Column:
    """A score interval: numbers or strings, ``(`` before an exclusive bound, ``-inf`` and ``+inf``."""

    def bound(x) -> tuple[float, bool]:
        s = str(x)
        return float(s.lstrip("(").replace("+inf", "inf")), s.startswith("(")

    (a, open_a), (b, open_b) = bound(low), bound(high)
    return (value > a if open_a else value >= a) & (value < b if open_b else value <= b)


def lex_range(member: Column, low: str = "-", high: str = "+") -> Column:
    """A byte-wise interval: ``[x`` inclusive, ``(x`` exclusive, ``-`` and ``+`` for the ends of everything."""

    def side(spec: str, lower: bool) -> Column:
        if spec == "-":
            return F.lit(lower)
        if spec == "+":
            return F.lit(not lower)
        if spec[:1] not in "[(" or not spec:
            raise ValueError("a bound begins with [ or (, or is - or +")
        x = F.lit(spec[1:])
        if lower:
            return member > x if spec[0] == "(" else member >= x
        return member < x if spec[0] == "(" else member <= x

    return side(low, True) & side(high, False)


def glob_regex(pattern: str) -> str:
    """An anchored regular expression of a glob with ``*``, ``?``, ``[a-z]``, ``[^x]`` and backslash escapes."""
    meta = set(r"\.^$*+?{}[]|()")
    quote = lambda c: "\\" + c if c in meta else c
    out, i, n = [], 0, len(pattern)
    while i < n:
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\" and i < n:
            out.append(quote(pattern[i]))
            i += 1
        elif c == "[":
            negated = i < n and pattern[i] == "^"
            i += negated
            items = []
            while i < n and pattern[i] != "]":
                if pattern[i] == "\\" and i + 1 < n:
                    i += 1
                    items.append(re_class(pattern[i]))
                elif i + 2 < n and pattern[i + 1] == "-":
                    a, b = sorted((pattern[i], pattern[i + 2]))
                    items.append(f"{re_class(a)}-{re_class(b)}")
                    i += 2
                else:
                    items.append(re_class(pattern[i]))
                i += 1
            i += 1
            out.append(f"[{'^' * negated}{''.join(items)}]" if items else ("." if negated else "(?!)"))
        else:
            out.append(quote(c))
    return "(?s)^" + "".join(out) + "$"


def re_class(c: str) -> str:
    return "\\" + c if c in "\\]^-[&" else c


def glob(value: Column, pattern: str) -> Column:
    """Whether a string matches a glob. A pattern that is a prefix becomes ``startswith``, which reaches the Parquet scan."""
    if pattern.endswith("*") and not set(pattern[:-1]) & set("*?[\\"):
        return value.startswith(pattern[:-1]) if pattern != "*" else value.isNotNull()
    if not set(pattern) & set("*?[\\"):
        return value == pattern
    return value.rlike(glob_regex(pattern))


def live(expire_ms: Column, now_ms) -> Column:
    """A key is gone only when its time has passed."""
    return expire_ms.isNull() | (expire_ms >= lit(now_ms))


def ttl_code(exists: Column, expire_ms: Column, now_ms, millis: bool = False) -> Column:
    """-2 without the key, -1 without a time, else what is left, in seconds rounded to the nearest or in milliseconds."""
    left = F.greatest(expire_ms - lit(now_ms), F.lit(0))
    return F.when(~exists, F.lit(-2)).when(expire_ms.isNull(), F.lit(-1)).otherwise(left if millis else F.floor((left + 500) / 1000)).cast("long")


def expire_applies(old: Column, new: Column, flag: str | None) -> Column:
    """NX, XX, GT and LT conditions of setting a time; no time counts as infinite."""
    if flag is None:
        return F.lit(True)
    return {"NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (new > old), "LT": old.isNull() | (new < old)}[flag]


# -- geo


def _spread(x: Column) -> Column:
    """The low 26 bits of a long at the even places of 52."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def _squeeze(x: Column) -> Column:
    x = x.bitwiseAND(F.lit(0x5555555555555555))
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        x = x.bitwiseOR(F.shiftright(x, shift)).bitwiseAND(F.lit(mask))
    return x


def geohash_encode(lon: Column, lat: Column, lat_max: float = LAT_MAX) -> Column:
    """The 52-bit cell of a point: latitude at the even bits, longitude at the odd ones. Null outside the grid."""
    cells = 1 << GEO_BITS
    y = F.floor((lat + lat_max) / (2 * lat_max) * cells).cast("long")
    x = F.floor((lon + LON_MAX) / (2 * LON_MAX) * cells).cast("long")
    cap = lambda v: F.least(v, F.lit(cells - 1).cast("long"))
    code = _spread(cap(y)).bitwiseOR(F.shiftleft(_spread(cap(x)), 1))
    return F.when(lon.between(-LON_MAX, LON_MAX) & lat.between(-lat_max, lat_max), code)


def geohash_decode(code: Column) -> tuple[Column, Column]:
    """(longitude, latitude) of a cell's centre."""
    cells = float(1 << GEO_BITS)
    lat = (_squeeze(code).cast("double") + 0.5) / cells * (2 * LAT_MAX) - LAT_MAX
    lon = (_squeeze(F.shiftrightunsigned(code, 1)).cast("double") + 0.5) / cells * (2 * LON_MAX) - LON_MAX
    return lon, lat


def geohash_text(code: Column) -> Column:
    """The public 11-character geohash of a cell: encoded anew over all latitudes, its last character always 0."""
    at = lambda bits, i: F.substring(F.lit(BASE32), F.pmod(F.shiftrightunsigned(bits, 52 - 5 * (i + 1)), F.lit(32)).cast("int") + 1, 1)
    point = F.struct(*[c.alias(n) for c, n in zip(geohash_decode(code), ("x", "y"), strict=True)])
    bits = _once(point, lambda p: geohash_encode(p["x"], p["y"], 90.0))
    return _once(bits, lambda b: F.concat(*[at(b, i) for i in range(10)], F.lit("0")))


def _once(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere; points on one meridian take the arc of latitude."""
    u = F.sin((F.radians(lat2) - F.radians(lat1)) / 2)
    v = F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    arc = EARTH_RADIUS * F.abs(F.radians(lat2) - F.radians(lat1))
    chord = 2 * EARTH_RADIUS * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))
    return F.when(F.abs(v) <= 1e-15, arc).otherwise(chord)


def in_box(lon0: Column, lat0: Column, lon: Column, lat: Column, width_m: float, height_m: float) -> Column:
    """Within half the height by latitude, and within half the width by longitude at the point's own latitude."""
    return (EARTH_RADIUS * F.abs(F.radians(lat) - F.radians(lat0)) <= height_m / 2) & (haversine(lon0, lat, lon, lat) <= width_m / 2)


def in_polygon(lon: Column, lat: Column, vertices: list[tuple[float, float]]) -> Column:
    """Ray casting: an odd number of edges lies beyond the point."""
    if len(vertices) < 3:
        raise ValueError("a polygon has three vertices at least")
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(vertices, vertices[1:] + vertices[:1], strict=True):
        if y1 != y2:
            crossings = crossings + F.when(((F.lit(y1) > lat) != (F.lit(y2) > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return crossings % 2 == 1


# -- vectors: arrays of floats, sums in double


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, the cosine held to [-1, 1]; 1 where a vector has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm < 1e-12, F.lit(1.0)).otherwise(1 - F.least(F.greatest(dot(a, b) / norm, F.lit(-1.0)), F.lit(1.0)))


def l2_distance(a: Column, b: Column) -> Column:
    """The squared Euclidean distance."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def inner_product_distance(a: Column, b: Column) -> Column:
    return 1 - dot(a, b)


METRICS = {"COSINE": cosine_distance, "L2": l2_distance, "IP": inner_product_distance}


def quantize_int8(v: Column) -> Column:
    """Each item held to [-1, 1], times 127, cut towards zero."""
    return F.transform(v, lambda x: (F.least(F.greatest(x.cast("double"), F.lit(-1.0)), F.lit(1.0)) * 127).cast("int"))


def hamming(a: Column, b: Column) -> Column:
    """Bits that differ in two arrays of integers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


# -- slots


def crc16(value: Column) -> Column:
    """CRC-16/XMODEM of a string's bytes."""
    hexed = F.hex(value.cast("binary"))
    return F.aggregate(
        F.sequence(F.lit(0), F.greatest(F.octet_length(value) * 8 - 1, F.lit(0))),
        F.lit(0),
        lambda acc, i: F.when(F.octet_length(value) == 0, 0).otherwise(_crc_bit(acc, i, hexed)),
    )


def _crc_bit(acc: Column, i: Column, hexed: Column) -> Column:
    byte = F.conv(F.substr(hexed, F.floor(i / 8).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")
    mixed = F.when(i % 8 == 0, acc.bitwiseXOR(F.shiftleft(byte, 8))).otherwise(acc)
    return F.when(mixed.bitwiseAND(F.lit(32768)) != 0, F.shiftleft(mixed, 1).bitwiseXOR(F.lit(4129))).otherwise(F.shiftleft(mixed, 1)).bitwiseAND(F.lit(65535))


def key_slot(key: Column) -> Column:
    """The slot of 16384 of a key, or of what stands in its first braces if that is not empty."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.pmod(crc16(F.when(tag != "", tag).otherwise(key)), F.lit(16384)).cast("int")
