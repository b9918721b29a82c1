"""Geographic sets: rows (key, member, lon, lat), or ordered sets whose score is a cell of 52 bits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.functions.exprs import EARTH_RADIUS, UNITS, geohash_decode, geohash_encode, geohash_text, haversine, in_box, in_polygon


def geoadd(points: DataFrame) -> DataFrame:
    """With ``score``, the cell of each point. A point outside the grid is an error."""
    cell = geohash_encode(F.col("lon"), F.col("lat"))
    return points.withColumn("score", F.coalesce(cell, F.raise_error(F.lit("invalid longitude or latitude")).cast("long")))


def geopos(cells: DataFrame) -> DataFrame:
    lon, lat = geohash_decode(F.col("score"))
    return cells.withColumns({"lon": lon, "lat": lat})


def stored(points: DataFrame) -> DataFrame:
    """Points as a set holds them: the centres of their cells. Distances between members are between these."""
    return geopos(geoadd(points))


def geohash(cells: DataFrame) -> DataFrame:
    return cells.withColumn("hash", geohash_text(F.col("score")))


def geodist(points: DataFrame, pairs: DataFrame, unit: str = "m") -> DataFrame:
    """Pairs (key, member1, member2) with ``dist``, null where a member is missing."""
    a = points.select("key", F.col("member").alias("member1"), F.col("lon").alias("_x1"), F.col("lat").alias("_y1"))
    b = points.select("key", F.col("member").alias("member2"), F.col("lon").alias("_x2"), F.col("lat").alias("_y2"))
    both = pairs.join(a, ["key", "member1"], "left").join(b, ["key", "member2"], "left")
    return both.withColumn("dist", haversine(F.col("_x1"), F.col("_y1"), F.col("_x2"), F.col("_y2")) / UNITS[unit]).drop("_x1", "_y1", "_x2", "_y2")


def _around(lon: float, lat: float, half_w: float, half_h: float):
    """A plain rectangle of degrees that holds everything within the distances: it reaches the Parquet scan. Longitudes are
    bounded only where the rectangle crosses neither a pole nor the date line."""
    dy = math.degrees(half_h / EARTH_RADIUS) * 1.0001 + 1e-9
    box = F.col("lat").between(lat - dy, lat + dy)
    widest = max(abs(lat - dy), abs(lat + dy))
    if widest < 89:
        s = math.sin(min(half_w / (2 * EARTH_RADIUS), math.pi / 2)) / math.cos(math.radians(widest))
        if s < 1:
            dx = math.degrees(2 * math.asin(s)) * 1.0001 + 1e-9
            if lon - dx >= -180 and lon + dx <= 180:
                box = box & F.col("lon").between(lon - dx, lon + dx)
    return box


def geosearch(points: DataFrame, lon: float, lat: float, radius: float | None = None, box: tuple[float, float] | None = None, polygon: list[tuple[float, float]] | None = None, unit: str = "m", count: int | None = None, desc: bool = False, any_: bool = False) -> DataFrame:
    """Points within a circle, a box (width, height) or a polygon, with ``dist`` from the centre in the unit.

    Nearest first (ties by member) where ``count`` is given; ``any_`` takes the first found instead."""
    u = UNITS[unit]
    x, y = F.col("lon"), F.col("lat")
    metres = haversine(F.lit(float(lon)), F.lit(float(lat)), x, y)
    if radius is not None:
        rows = points.where(_around(lon, lat, radius * u, radius * u)).withColumn("dist", metres).where(F.col("dist") <= radius * u)
    elif box is not None:
        w, h = box[0] * u, box[1] * u
        rows = points.where(_around(lon, lat, w / 2, h / 2)).where(in_box(F.lit(float(lon)), F.lit(float(lat)), x, y, w, h)).withColumn("dist", metres)
    else:
        xs, ys = [p[0] for p in polygon], [p[1] for p in polygon]
        rows = points.where(x.between(min(xs), max(xs)) & y.between(min(ys), max(ys)) & in_polygon(x, y, polygon)).withColumn("dist", metres)
    rows = rows.withColumn("dist", F.col("dist") / u)
    if count is None:
        return rows
    return rows.limit(count) if any_ else rows.orderBy(F.col("dist").desc() if desc else F.col("dist"), "member").limit(count)


def geosearch_by_member(points: DataFrame, key: str, member, **options) -> DataFrame:
    """GEOSEARCH around a member; the centre is one row, looked up first."""
    at = points.where((F.col("key") == key) & (F.col("member") == member)).select("lon", "lat").first()
    if at is None:
        raise ValueError("could not decode requested member")
    return geosearch(points.where(F.col("key") == key), at.lon, at.lat, **options)


def geosearch_store(found: DataFrame, key: str, store_dist: bool = False) -> DataFrame:
    """The result of a search as an ordered set: scores are cells, or distances."""
    score = F.col("dist") if store_dist else geohash_encode(F.col("lon"), F.col("lat")).cast("double")
    return found.select(F.lit(key).alias("key"), "member", score.alias("score"))
