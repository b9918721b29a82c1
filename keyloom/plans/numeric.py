"""Queries of bitmaps, sketches, places and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.exprs import geohash_decode
from keyloom.functions.ranks import numbered
from keyloom.operators import bitmaps, geo, sketches, vectors
from keyloom.plans.base import POINTS, distance_sql, points
from keyloom.plans.registry import query
from keyloom.sources.tables import read

BITS = "bits AS (SELECT DISTINCT event_type AS key, user_id AS pos FROM events)"


def _bits(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("pos")).distinct()


def _two(spark, d):
    r = read(spark, d, "events").agg(F.min("event_type").alias("a"), F.max("event_type").alias("b")).first()
    return [r.a, r.b]


TWO = "two AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events)"


@query("bit_count", f"WITH {BITS} SELECT key, count(*) AS n FROM bits GROUP BY key")
def bit_count(spark, d):
    return bitmaps.bitcount(_bits(spark, d))


@query("bit_count_range", f"WITH {BITS} SELECT key, count(*) AS n FROM bits WHERE pos BETWEEN 8 AND 79 GROUP BY key")
def bit_count_range(spark, d):
    return bitmaps.bitcount(_bits(spark, d), 8, 79)


for _op, _test in (("and", "count(*) = 2"), ("or", "true"), ("xor", "count(*) % 2 = 1")):

    @query(f"bit_op_{_op}", f"WITH {BITS}, {TWO} SELECT pos FROM bits, two WHERE key IN (a, b) GROUP BY pos HAVING {_test}")
    def bit_op(spark, d, op=_op.upper()):
        return bitmaps.bitop(_bits(spark, d), op, _two(spark, d))


@query("bit_op_not", f"WITH {BITS}, {TWO} SELECT i AS pos FROM range(0, (SELECT max(user_id) + 1 FROM events)) t(i) WHERE i NOT IN (SELECT pos FROM bits, two WHERE key = a)")
def bit_op_not(spark, d):
    longest = read(spark, d, "events").agg(F.max("user_id")).first()[0]
    return bitmaps.bitop(_bits(spark, d), "NOT", _two(spark, d)[:1], longest + 1)


@query("bit_pos", f"WITH {BITS} SELECT key, min(pos) AS pos FROM bits GROUP BY key")
def bit_pos(spark, d):
    return bitmaps.bitpos(_bits(spark, d))


@query("bit_get", f"WITH {BITS}, {TWO} SELECT c_custkey AS pos, a AS key, CAST(EXISTS (SELECT 1 FROM bits WHERE key = a AND pos = c_custkey) AS INTEGER) AS bit FROM customer, two")
def bit_get(spark, d):
    probes = read(spark, d, "customer").select(F.lit(_two(spark, d)[0]).alias("key"), F.col("c_custkey").alias("pos"))
    return bitmaps.getbit(_bits(spark, d), probes)


@query("bit_field", "SELECT p_partkey, ascii(substr(p_name, 1, 1)) * 256 + ascii(substr(p_name, 2, 1)) AS u16, (ascii(substr(p_name, 1, 1)) % 16) * 16 + ascii(substr(p_name, 2, 1)) // 16 - CASE WHEN ascii(substr(p_name, 1, 1)) % 16 >= 8 THEN 256 ELSE 0 END AS i8, least(p_size + 120, 127) AS sat, (p_size + 120 + 128) % 256 - 128 AS wrap, CASE WHEN p_size + 120 <= 127 THEN p_size + 120 END AS fail FROM part".replace("SELECT p_partkey, ", "SELECT p_partkey, CAST(").replace(" AS u16, ", " AS BIGINT) AS u16, CAST(").replace(" AS i8, ", " AS BIGINT) AS i8, CAST(").replace(" AS sat, ", " AS BIGINT) AS sat, CAST(").replace(" AS wrap, ", " AS BIGINT) AS wrap, CAST(").replace(" AS fail FROM", " AS BIGINT) AS fail FROM"))
def bit_field(spark, d):
    raw, size, step = F.col("p_name").cast("binary"), F.col("p_size").cast("long"), F.lit(120).cast("long")
    return read(spark, d, "part").select(
        "p_partkey",
        bitmaps.bitfield_get(raw, "u16", 0).alias("u16"),
        bitmaps.bitfield_get(raw, "i8", 4).alias("i8"),
        *[bitmaps.bounded_add(size, step, "i8", o).alias(o.lower()) for o in ("SAT", "WRAP", "FAIL")],
    )


# -- sketches: hashes that both engines have


HASHED = "hashed AS (SELECT event_type AS key, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 15) AS BIGINT) AS h FROM events)"


def _hashed(spark, d):
    return read(spark, d, "events").select(F.col("event_type").alias("key"), F.conv(F.substring(F.md5(F.col("user_id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long").alias("h"))


@query("hll_registers", f"WITH {HASHED}, r AS (SELECT key, CAST(h & 16383 AS INTEGER) AS reg, (h >> 14) | (CAST(1 AS BIGINT) << 50) AS rest FROM hashed) SELECT key, reg, CAST(max(bit_count((rest & -rest) - 1) + 1) AS INTEGER) AS rank FROM r GROUP BY 1, 2")
def hll_registers(spark, d):
    return sketches.registers(_hashed(spark, d), hashed=F.col("h"))


@query("frequencies", "SELECT event_type AS key, user_id AS member, count(*) AS n FROM events GROUP BY 1, 2")
def frequencies(spark, d):
    return sketches.frequencies(read(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member")))


# -- places


@query("geo_radius", f"WITH {POINTS}, p AS (SELECT *, {distance_sql('13.361389', '38.115556')} AS m FROM points) SELECT member, round(m / 1000, 4) AS dist FROM p WHERE m <= 3000000 ORDER BY m, member LIMIT 50")
def geo_radius(spark, d):
    out = geo.geosearch(points(spark, d), 13.361389, 38.115556, radius=3000, unit="km", count=50)
    return out.select("member", F.round("dist", 4).alias("dist"))


@query("geo_box", f"WITH {POINTS} SELECT member, round({distance_sql('15.0', '37.0')} / 1609.34, 4) AS dist FROM points WHERE 6372797.560856 * abs(radians(lat) - radians(37.0)) <= 1500 * 1609.34 / 2 AND {distance_sql('15.0', 'lat')} <= 2500 * 1609.34 / 2")
def geo_box(spark, d):
    return geo.geosearch(points(spark, d), 15.0, 37.0, box=(2500, 1500), unit="mi").select("member", F.round("dist", 4).alias("dist"))


TRIANGLE = [(-20.0, -30.0), (60.0, -10.0), (10.0, 50.0)]


def _crossings() -> str:
    edges = zip(TRIANGLE, TRIANGLE[1:] + TRIANGLE[:1], strict=True)
    return " + ".join(f"CASE WHEN (({y1} > lat) <> ({y2} > lat)) AND lon < ({x2 - x1}) * (lat - ({y1})) / ({y2 - y1}) + ({x1}) THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in edges)


@query("geo_polygon", f"WITH {POINTS} SELECT member FROM points WHERE ({_crossings()}) % 2 = 1")
def geo_polygon(spark, d):
    return geo.geosearch(points(spark, d), 0.0, 0.0, polygon=TRIANGLE).select("member")


CELLS = f"""{POINTS}, grid AS (SELECT member, CAST(floor((lat + 85.05112878) / (2 * 85.05112878) * 67108864) AS BIGINT) AS y, CAST(floor((lon + 180.0) / 360.0 * 67108864) AS BIGINT) AS x FROM points),
cells AS (SELECT member, x, y, CAST(list_sum(list_transform(range(0, 26), lambda i: (((y >> i) & 1) << (2 * i)) + (((x >> i) & 1) << (2 * i + 1)))) AS BIGINT) AS score FROM grid)"""


@query("geo_add", f"WITH {CELLS} SELECT member, score FROM cells")
def geo_add(spark, d):
    return geo.geoadd(points(spark, d)).select("member", "score")


@query("geo_pos", f"WITH {CELLS} SELECT member, round((x + 0.5) / 67108864 * 360 - 180, 5) AS lon, round((y + 0.5) / 67108864 * (2 * 85.05112878) - 85.05112878, 5) AS lat FROM cells")
def geo_pos(spark, d):
    lon, lat = geohash_decode(F.col("score"))
    return geo.geoadd(points(spark, d)).select("member", F.round(lon, 5).alias("lon"), F.round(lat, 5).alias("lat"))


@query("geo_dist", f"WITH {POINTS} SELECT a.member AS member1, a.member + 1 AS member2, round({distance_sql('a.lon', 'a.lat', 'b.lon', 'b.lat')}, 2) AS dist FROM points a LEFT JOIN points b ON b.member = a.member + 1")
def geo_dist(spark, d):
    p = points(spark, d)
    pairs = p.select("key", F.col("member").alias("member1"), (F.col("member") + 1).alias("member2"))
    return geo.geodist(p, pairs).select("member1", "member2", F.round("dist", 2).alias("dist"))


# -- vectors


def _vectors(spark, d):
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("ext_id"), "embedding")


def _probe(spark, d, i=0):
    return [float(x) for x in read(spark, d, "embeddings").where(F.col("vec_id") == i).first().embedding]


V = "v AS (SELECT vec_id AS ext_id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS qe FROM v WHERE ext_id = 0)"
DOT = "list_inner_product(e, qe)"
FORMS = {
    "cosine": f"1 - greatest(-1, least(1, {DOT} / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(qe, qe)))))",
    "l2": "list_sum(list_transform(list_zip(e, qe), lambda p: (p[1] - p[2]) * (p[1] - p[2])))",
    "ip": f"1 - {DOT}",
}

for _name, _form in FORMS.items():

    @query(f"vector_{_name}", f"WITH {V}, s AS (SELECT ext_id, {_form} AS d FROM v, q) SELECT ext_id, round(d, 6) + 0.0 AS distance FROM s ORDER BY d, ext_id LIMIT 10")
    def vector(spark, d, metric=_name):
        out = vectors.vsearch(_vectors(spark, d), _probe(spark, d), 10, metric)
        return out.select("ext_id", (F.round("distance", 6) + 0.0).alias("distance"))


@query("vector_batch", f"WITH {V}, b AS (SELECT ext_id AS query_id, e AS qe FROM v WHERE ext_id % 50 = 0), s AS (SELECT query_id, ext_id, {FORMS['cosine']} AS d FROM v, b), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, ext_id) AS rank FROM s) SELECT query_id, ext_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def vector_batch(spark, d):
    v = _vectors(spark, d)
    q = v.where("ext_id % 50 = 0").select(F.col("ext_id").alias("query_id"), F.col("embedding").alias("q"))
    return vectors.vsearch_batch(v, q, 5).select("query_id", "ext_id", "rank")


@query("vector_int8", "SELECT vec_id AS ext_id, CAST(list_sum(list_transform(embedding::DOUBLE[], lambda x: trunc(greatest(-1, least(1, x)) * 127))) AS BIGINT) AS total FROM embeddings")
def vector_int8(spark, d):
    q = vectors.quantized(_vectors(spark, d))
    return q.select("ext_id", F.aggregate("q8", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("vector_info", "SELECT CAST(max(len(embedding)) AS INTEGER) AS dim, count(*) AS count, count(*) AS live FROM embeddings")
def vector_info(spark, d):
    return vectors.vinfo(_vectors(spark, d))


@query("vector_fusion", "WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS pos FROM documents), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos FROM documents), u AS (SELECT * FROM a UNION ALL SELECT * FROM b) SELECT doc_id, round(sum(1.0::DOUBLE / (pos + 60)), 9) AS score FROM u GROUP BY 1")
def vector_fusion(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "n_chars", (-F.col("doc_id")).alias("_late"), F.lit(0).alias("key"))
    longest = numbered(docs.withColumn("_short", -F.col("n_chars")), ["key"], "_short", ["doc_id"], out="pos")
    latest = numbered(docs, ["key"], "_late", out="pos")
    return vectors.rank_fusion(longest, latest).withColumn("score", F.round("score", 9))
