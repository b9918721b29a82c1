"""The data model bound to the driver's tables, once in DataFrames and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.sources.tables import read


def cents(c: str):
    return F.round(F.col(c) * 100).cast("long")


def spend(spark: SparkSession, d: str) -> DataFrame:
    """Ordered sets: customers by what they spent, in cents, per market segment."""
    o = read(spark, d, "orders").groupBy("o_custkey").agg(F.sum(cents("o_totalprice")).alias("score"))
    return o.join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_mktsegment").alias("key"), F.col("c_custkey").alias("member"), "score")


SPEND = """spend AS (SELECT c_mktsegment AS key, c_custkey AS member, score FROM customer JOIN (
  SELECT o_custkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS score FROM orders GROUP BY 1) o ON o_custkey = c_custkey)"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Ordered sets: parts by quantity per return flag."""
    return read(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("key"), F.col("l_partkey").alias("member")).agg(F.sum("l_quantity").alias("score"))


FLAGS = "flags AS (SELECT l_returnflag AS key, l_partkey AS member, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"


def names(spark: SparkSession, d: str) -> DataFrame:
    """Ordered sets with equal scores: supplier names per nation."""
    return read(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("key"), F.col("s_name").alias("member"), F.lit(0.0).alias("score"))


NAMES = "names AS (SELECT CAST(s_nationkey AS VARCHAR) AS key, s_name AS member FROM supplier)"


def users(spark: SparkSession, d: str) -> DataFrame:
    """Sets: users per event type and day."""
    return read(spark, d, "events").select(F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("key"), F.col("user_id").alias("member")).distinct()


USERS = "users AS (SELECT DISTINCT event_type || '/' || strftime(ts, '%Y-%m-%d') AS key, user_id AS member FROM events)"


def days(spark: SparkSession, d: str) -> tuple[str, str, str]:
    """Three keys of ``users``: by a rule, so that the SQL has the same."""
    rows = read(spark, d, "events").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("a"), F.min("event_type").alias("x"), F.max("event_type").alias("y")).first()
    return f"{rows.x}/{rows.a}", f"{rows.y}/{rows.a}", f"{rows.x}/none"


DAYS = """days AS (SELECT min(event_type) || '/' || strftime(min(ts), '%Y-%m-%d') AS a, max(event_type) || '/' || strftime(min(ts), '%Y-%m-%d') AS b FROM events)"""


def history(spark: SparkSession, d: str) -> DataFrame:
    """Lists: each user's event types in order."""
    return read(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("pos"), F.col("event_type").alias("val"))


HISTORY = """hist AS (SELECT user_id AS key, event_id AS pos, event_type AS val,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, count(*) OVER (PARTITION BY user_id) AS len FROM events)"""


def fields(spark: SparkSession, d: str) -> DataFrame:
    """Hashes: attributes of customers. Balances have a time, one in three of them past; segments of every fifth have one ahead."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), "c_name", "c_mktsegment", F.col("c_nationkey").cast("string").alias("c_nationkey"))
    rows = c.unpivot("key", ["c_name", "c_mktsegment", "c_nationkey"], "field", "val")
    time = F.when(F.col("field") == "c_nationkey", 1_000_000 + (F.col("key") % 3 - 1) * 1000 + F.col("key") % 7).when((F.col("field") == "c_mktsegment") & (F.col("key") % 5 == 0), 2_000_000 + F.col("key"))
    return rows.withColumn("field_expire_ms", time.cast("long"))


FIELDS = """fields AS (SELECT key, field, val, CASE WHEN field = 'c_nationkey' THEN 1000000 + (key % 3 - 1) * 1000 + key % 7
    WHEN field = 'c_mktsegment' AND key % 5 = 0 THEN 2000000 + key END AS field_expire_ms FROM (
  SELECT c_custkey AS key, 'c_name' AS field, c_name AS val FROM customer UNION ALL
  SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer UNION ALL
  SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS VARCHAR) FROM customer))"""


def stream(spark: SparkSession, d: str) -> DataFrame:
    """Streams: events per type, ids of milliseconds and a number within."""
    from keyloom.operators.streams import assign_ids

    e = read(spark, d, "events").select(F.col("event_type").alias("key"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_id", "user_id")
    return assign_ids(e, order="event_id")


STREAM = """stream AS (SELECT event_type AS key, (epoch_us(ts) // 1000) AS ms, event_id, user_id,
  row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) ORDER BY event_id) - 1 AS seq FROM events)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Time series: event values, in whole hundredths, per type."""
    return read(spark, d, "events").select(F.col("event_type").alias("series"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.round(F.col("value") * 100).cast("long").alias("value"), "event_id", "user_id")


SAMPLES = "samples AS (SELECT event_type AS series, (epoch_us(ts) // 1000) AS ts, CAST(round(value * 100) AS BIGINT) AS value, event_id, user_id FROM events)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Places: customers spread over the globe by a rule."""
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(F.lit("customers").alias("key"), k.alias("member"), ((k * 7919 % 360000) / 1000.0 - 180.0).alias("lon"), ((k * 104729 % 170000) / 1000.0 - 85.0).alias("lat"))


POINTS = "points AS (SELECT 'customers' AS key, c_custkey AS member, (c_custkey * 7919 % 360000) / 1000.0 - 180.0 AS lon, (c_custkey * 104729 % 170000) / 1000.0 - 85.0 AS lat FROM customer)"


def distance_sql(lon: str, lat: str, x: str = "lon", y: str = "lat") -> str:
    return (
        f"(CASE WHEN abs(sin((radians({x}) - radians({lon})) / 2)) <= 1e-15 THEN 6372797.560856 * abs(radians({y}) - radians({lat})) ELSE "
        f"2 * 6372797.560856 * asin(sqrt(pow(sin((radians({y}) - radians({lat})) / 2), 2) + cos(radians({lat})) * cos(radians({y})) * pow(sin((radians({x}) - radians({lon})) / 2), 2))) END)"
    )
