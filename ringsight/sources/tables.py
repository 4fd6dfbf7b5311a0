"""The given tables seen as monitoring data: frames, signals, element rows, passes, alerts.

Each binding exists twice, as a DataFrame and as the body of an SQL common table expression, so a query and
its SQL counterpart start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_EPOCH = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {0})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session zone."""
    return F.expr(_EPOCH.format(column))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    lane = F.col("user_id") % 3
    camera = F.when(lane == 0, "CAM-1").when(lane == 1, "CAM-3").otherwise("CAM-4")
    return e.select(
        "event_id",
        camera.alias("camera_id"),
        (F.col("event_id") * 7).alias("sequence_no"),
        micros("ts").alias("captured_us"),
        F.col("props").alias("payload"),
        F.col("value").alias("scalar"),
        (F.col("event_id") + (F.col("event_id") * 37) % 11).alias("arrival"),
        "user_id",
        "event_type",
    )


FRAMES = """frames AS (
  SELECT event_id,
         CASE user_id % 3 WHEN 0 THEN 'CAM-1' WHEN 1 THEN 'CAM-3' ELSE 'CAM-4' END AS camera_id,
         event_id * 7 AS sequence_no, epoch_us(ts) AS captured_us, props AS payload, value AS scalar,
         event_id + (event_id * 37) % 11 AS arrival, user_id, event_type
  FROM events)"""


def signal(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("col"),
        F.col("value").alias("x"),
        (F.col("value") < 20).alias("hidden"),
        (F.col("event_type") == "error").alias("bit"),
        "event_type",
        "user_id",
    )


SIGNAL = """signal AS (
  SELECT event_id AS col, value AS x, value < 20 AS hidden, event_type = 'error' AS bit, event_type, user_id
  FROM events)"""


def element_rows(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    short = F.col("l_quantity") < 9
    flag = F.col("l_returnflag")
    return li.select(
        F.col("l_partkey").alias("element_id"),
        (F.col("l_orderkey") % 12).alias("loop"),
        (F.col("l_quantity") * 3).alias("lip"),
        (F.col("l_linenumber") % 3).alias("n_views"),
        short.alias("short_any"),
        (short & (F.col("l_discount") < 0.05)).alias("short_both"),
        F.when(flag == "A", "readable").when(flag == "N", "edge").otherwise("weak").alias("status_left"),
        F.when(F.col("l_linestatus") == "F", "readable").otherwise("weak").alias("status_right"),
        (F.col("l_tax") * 100).alias("straight_left"),
        (F.col("l_discount") * 100).alias("straight_right"),
        (F.col("l_discount") * 10).alias("fill_left"),
        (F.col("l_tax") * 10 + 0.2).alias("fill_right"),
        (F.col("l_tax") - 0.04).alias("slope_left"),
        (F.col("l_discount") - 0.05).alias("slope_right"),
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_extendedprice").alias("price"),
    )


ELEMENT_ROWS = """element_rows AS (
  SELECT l_partkey AS element_id, l_orderkey % 12 AS loop, l_quantity * 3 AS lip,
         l_linenumber % 3 AS n_views, l_quantity < 9 AS short_any,
         (l_quantity < 9 AND l_discount < 0.05) AS short_both,
         CASE l_returnflag WHEN 'A' THEN 'readable' WHEN 'N' THEN 'edge' ELSE 'weak' END AS status_left,
         CASE l_linestatus WHEN 'F' THEN 'readable' ELSE 'weak' END AS status_right,
         l_tax * 100 AS straight_left, l_discount * 100 AS straight_right,
         l_discount * 10 AS fill_left, l_tax * 10 + 0.2 AS fill_right,
         l_tax - 0.04 AS slope_left, l_discount - 0.05 AS slope_right,
         l_orderkey AS order_key, l_linenumber AS line, l_suppkey AS supp_key, l_extendedprice AS price
  FROM lineitem)"""


def passes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("user_id").alias("element_id"),
        F.col("event_id").alias("pass_no"),
        F.col("value").alias("raw"),
        F.floor(F.col("event_id") / 1210).alias("loop"),
        "event_type",
    )


PASSES = """passes AS (
  SELECT user_id AS element_id, event_id AS pass_no, value AS raw,
         CAST(floor(event_id / 1210) AS BIGINT) AS loop, event_type
  FROM events)"""


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    return o.select(
        F.col("o_orderkey").alias("alert_id"),
        F.concat(F.lit("CAM-"), (F.col("o_custkey") % 6 + 1).cast("string")).alias("camera_id"),
        (F.col("o_custkey") % 500).alias("event_key"),
        (F.col("o_custkey") % 97).alias("element_id"),
        (F.col("o_orderkey") % 9).alias("loop_no"),
        micros("o_orderdate").alias("detected_us"),
        F.col("o_orderdate").alias("detected_at"),
        F.when(status == "O", "pending").when(status == "F", "confirmed").otherwise("other").alias("state"),
        F.when(F.col("o_custkey") % 4 == 0, "wheel_gap")
        .when(F.col("o_custkey") % 4 == 1, "wheel_density")
        .when(F.col("o_custkey") % 4 == 2, "wheel_missing")
        .otherwise("damage")
        .alias("kind"),
        F.when(F.col("o_orderpriority").startswith("5"), micros("o_orderdate") + 3_600_000_000).alias("seen_us"),
        F.col("o_totalprice").alias("amount"),
        F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("model_version"),
    )


ALERTS = """alerts AS (
  SELECT o_orderkey AS alert_id, 'CAM-' || CAST(o_custkey % 6 + 1 AS VARCHAR) AS camera_id,
         o_custkey % 500 AS event_key, o_custkey % 97 AS element_id, o_orderkey % 9 AS loop_no,
         epoch_us(o_orderdate) AS detected_us, o_orderdate AS detected_at,
         CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'confirmed' ELSE 'other' END AS state,
         CASE o_custkey % 4 WHEN 0 THEN 'wheel_gap' WHEN 1 THEN 'wheel_density'
              WHEN 2 THEN 'wheel_missing' ELSE 'damage' END AS kind,
         CASE WHEN o_orderpriority LIKE '5%' THEN epoch_us(o_orderdate) + 3600000000 END AS seen_us,
         o_totalprice AS amount, 'v' || CAST(o_orderkey % 3 AS VARCHAR) AS model_version
  FROM orders)"""


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("profile"), "label"
    )


PROFILES = """profiles AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS profile, label FROM embeddings)"""


BARCODE_LOOP = 400


def barcode_bit(position: Column) -> Column:
    """Pattern of the synthetic barcode at a loop position."""
    return (position * position * position + position * 7) % 401 < 100


def barcode(spark: SparkSession, sf: str) -> DataFrame:
    """Slots of a chain with a repeating pattern of marks, disturbed where the user id says so."""
    e = table(spark, sf, "events")
    noisy = F.col("user_id") % 25 == 0
    return e.select(F.col("event_id").alias("slot"), (barcode_bit(F.col("event_id") % BARCODE_LOOP) != noisy).alias("bit"))


def barcode_master() -> list[bool]:
    return [(p**3 + 7 * p) % 401 < 100 for p in range(BARCODE_LOOP)]


BARCODE = """barcode AS (
  SELECT event_id AS slot,
    (((event_id % 400) * (event_id % 400) * (event_id % 400) + (event_id % 400) * 7) % 401 < 100) <> (user_id % 25 = 0)
      AS bit FROM events),
master AS (SELECT p, (p * p * p + p * 7) % 401 < 100 AS bit FROM range(0, 400) AS g(p))"""


def anchors(spark: SparkSession, sf: str) -> DataFrame:
    """One anchor of every 25 events, shifted by their highest value."""
    col = (F.floor(F.col("event_id") / 25) * 25).cast("bigint")
    e = table(spark, sf, "events").groupBy(col.alias("col")).agg(F.max("value").alias("top"))
    return e.select("col", (F.col("col") * F.lit(1.01) + (F.col("top") - 190) / 1000).alias("pos"))


ANCHORS = """anchors AS (
  SELECT col, col * 1.01::DOUBLE + (top - 190) / 1000 AS pos FROM (
    SELECT event_id // 25 * 25 AS col, max(value) AS top FROM events GROUP BY 1))"""
