"""Queries from frames to classified slots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.operators import trigger as ops
from ringsight.operators.ordered import Lane
from ringsight.operators.sequencing import spaced_rows
from ringsight.plans.registry import query, with_views
from ringsight.sources import tables as t

BY_EVENT = Lane((), "event_id")

RAMP = "ramp AS (SELECT event_id, (event_id * 5) % 71 - 34 AS dx, value AS level FROM events)"
CAPTURED = """steps AS (
  SELECT *, row_number() OVER w AS rn, lag(dx) OVER w AS p1, lag(dx, 2) OVER w AS p2, lag(dx, 3) OVER w AS p3,
         lag(dx, 4) OVER w AS p4, lag(level) OVER w AS plevel, lag(event_id) OVER w AS pid
  FROM ramp WINDOW w AS (ORDER BY event_id)),
captured AS (
  SELECT event_id, CASE WHEN abs(dx) <= abs(p1) THEN 0 ELSE -1 END AS offset_rows,
         CASE WHEN abs(dx) <= abs(p1) THEN event_id ELSE pid END AS capture_id,
         CASE WHEN abs(dx) <= abs(p1) THEN dx ELSE p1 END AS capture_dx,
         CASE WHEN abs(dx) <= abs(p1) THEN level ELSE plevel END AS capture_level
  FROM steps WHERE rn >= 6 AND p1 < 0 AND dx >= 0 AND dx - p1 > 0 AND dx - p1 < 9 AND p1 - p2 > 0 AND p1 - p2 < 9
    AND p2 - p3 > 0 AND p2 - p3 < 9 AND p3 - p4 > 0 AND p3 - p4 < 9)"""


def _ramp(spark, sf):
    return t.table(spark, sf, "events").select(
        "event_id", ((F.col("event_id") * 5) % 71 - 34).alias("dx"), F.col("value").alias("level")
    )


@query(
    "ramp_trigger",
    with_views(RAMP, CAPTURED) + "SELECT event_id, offset_rows, capture_id, capture_dx, capture_level FROM captured",
)
def ramp_trigger(spark, sf):
    hits = ops.ramp_captures(_ramp(spark, sf), BY_EVENT, "dx", "level")
    return hits.select(
        "event_id",
        F.col("offset").alias("offset_rows"),
        F.col("capture.event_id").alias("capture_id"),
        F.col("capture.dx").alias("capture_dx"),
        F.col("capture.level").alias("capture_level"),
    )


@query(
    "minimum_separation",
    """WITH RECURSIVE cand AS (SELECT event_id FROM events WHERE event_type = 'error'),
    picks AS (SELECT min(event_id) AS event_id FROM cand
      UNION ALL
      SELECT (SELECT min(c.event_id) FROM cand c WHERE c.event_id > p.event_id + 12) AS event_id
      FROM picks p WHERE p.event_id IS NOT NULL)
    SELECT event_id FROM picks WHERE event_id IS NOT NULL""",
)
def minimum_separation(spark, sf):
    cand = t.table(spark, sf, "events").filter("event_type = 'error'").select("event_id")
    return spaced_rows(cand, BY_EVENT, "event_id", ops.MIN_SEPARATION, strict=True)


SLOTS = """cap AS (
  SELECT event_id, value AS level FROM events WHERE event_type = 'error' AND value > 80),
gaps AS (SELECT *, (event_id - lag(event_id) OVER (ORDER BY event_id)) / 25.0::DOUBLE AS gap FROM cap),
hid AS (SELECT event_id, level, CASE WHEN gap > 1.2 THEN greatest(CAST(round_even(gap / 0.8::DOUBLE, 0) AS BIGINT) - 1, 0)
                         ELSE 0 END AS hidden FROM gaps),
rows_ AS (SELECT event_id AS pos, unnest(generate_series(0, hidden)) AS k, hidden, event_id, level FROM hid),
slots AS (SELECT row_number() OVER (ORDER BY pos, k) - 1 AS slot, CASE WHEN k = hidden THEN 'real' ELSE 'virtual' END AS kind,
                 CASE WHEN k = hidden THEN event_id END AS event_id, CASE WHEN k = hidden THEN level END AS level FROM rows_)"""


def _slots(spark, sf):
    e = t.table(spark, sf, "events")
    cap = e.filter("event_type = 'error' AND value > 80").select("event_id", F.col("value").alias("level"))
    return ops.fill_virtual_slots(cap, BY_EVENT, "event_id")


@query("virtual_slots", with_views(SLOTS) + "SELECT slot, kind, event_id FROM slots")
def virtual_slots(spark, sf):
    return _slots(spark, sf).select("slot", "kind", "event_id")


STATUS = """meas AS (
  SELECT event_id, (event_id % 97) / 97.0::DOUBLE AS peak, (event_id * 5) % 71 - 34 AS dx, (event_id * 3) % 83 - 41 AS dy,
         value AS mean_level, (user_id % 30) * 1.0::DOUBLE AS face_residual FROM events),
lvl AS (SELECT *, quantile_cont(mean_level, 0.5) OVER w AS med, count(mean_level) OVER w AS n FROM meas
        WINDOW w AS (ORDER BY event_id ROWS BETWEEN 401 PRECEDING AND 1 PRECEDING)),
weakened AS (SELECT *, (peak < 0.35 OR abs(dy) >= 38 OR abs(dx) >= 30) AS weak FROM lvl),
classified AS (SELECT *, CASE WHEN weak AND n >= 50 AND mean_level > med + 6 THEN 'occluded'
                              WHEN weak OR face_residual > 20 THEN 'weak' ELSE 'readable' END AS status FROM weakened)"""


def _classified(spark, sf):
    e = t.table(spark, sf, "events")
    meas = e.select(
        "event_id",
        ((F.col("event_id") % 97) / 97.0).alias("peak"),
        ((F.col("event_id") * 5) % 71 - 34).alias("dx"),
        ((F.col("event_id") * 3) % 83 - 41).alias("dy"),
        F.col("value").alias("mean_level"),
        (F.col("user_id") % 30).cast("double").alias("face_residual"),
    )
    return ops.classify(meas, BY_EVENT)


@query(
    "slot_status",
    with_views(STATUS)
    + "SELECT event_id, CASE WHEN n >= 50 THEN round(med, 6) END AS usual_level, status FROM classified",
)
def slot_status(spark, sf):
    return _classified(spark, sf).select("event_id", F.round("usual_level", 6).alias("usual_level"), "status")


EDGES = """kinds AS (
  SELECT event_id AS slot, CASE WHEN event_id % 7 = 3 THEN 'virtual' ELSE 'real' END AS kind,
         CASE WHEN event_id % 7 = 3 THEN NULL WHEN value > 60 THEN 'occluded' WHEN value < 5 THEN 'weak'
              ELSE 'readable' END AS status FROM events),
edged AS (SELECT *, CASE WHEN kind = 'real' AND status IN ('readable', 'weak') AND (
    coalesce(max(CASE WHEN status = 'occluded' THEN 1 ELSE 0 END) OVER (ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), 0) = 1 OR
    coalesce(max(CASE WHEN status = 'occluded' AND kind = 'real' THEN 1 ELSE 0 END) OVER (ORDER BY slot ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), 0) = 1)
  THEN 'edge' ELSE status END AS final_status FROM kinds)"""


@query("edge_marking", with_views(EDGES) + "SELECT slot, kind, final_status AS status FROM edged")
def edge_marking(spark, sf):
    kind = F.when(F.col("event_id") % 7 == 3, "virtual").otherwise("real")
    status = (
        F.when(F.col("event_id") % 7 == 3, F.lit(None))
        .when(F.col("value") > 60, "occluded")
        .when(F.col("value") < 5, "weak")
        .otherwise("readable")
    )
    slots = t.table(spark, sf, "events").select(F.col("event_id").alias("slot"), kind.alias("kind"), status.alias("status"))
    return ops.mark_edges(slots, Lane((), "slot"))


@query(
    "short_flags",
    with_views(STATUS)
    + """SELECT event_id, status <> 'occluded' AND event_id % 200 < 123 AS short_left,
      status <> 'occluded' AND event_id % 170 < 112 AS short_right FROM classified""",
)
def short_flags(spark, sf):
    lit = _classified(spark, sf).withColumn("lit_left", F.col("event_id") % 200).withColumn("lit_right", F.col("event_id") % 170)
    return ops.short_flags(lit).select("event_id", "short_left", "short_right")


BAND = """pts AS (SELECT vec_id, r, list_max(profile[r * 4 + 1 : r * 4 + 4]) AS peak,
    list_position(profile[r * 4 + 1 : r * 4 + 4], list_max(profile[r * 4 + 1 : r * 4 + 4])) - 2.5::DOUBLE AS off
  FROM profiles, range(0, 16) AS g(r)),
band AS (SELECT vec_id, count(*) FILTER (peak > 0.1) AS lit_rows,
    coalesce(min(r) FILTER (peak > 0.1), -1) AS first_row, coalesce(max(r) FILTER (peak > 0.1), -1) AS last_row,
    coalesce(avg(peak) FILTER (peak > 0.1), 0) AS bright, sqrt(avg(off * off) FILTER (peak > 0.1)) AS straight,
    CASE WHEN count(*) FILTER (peak > 0.1) > 0 THEN regr_slope(off, r) END AS slope FROM pts GROUP BY vec_id)"""


@query(
    "band_profile_statistics",
    with_views(t.PROFILES, BAND)
    + """SELECT vec_id, lit_rows, CAST(first_row AS BIGINT) AS first_row, CAST(last_row AS BIGINT) AS last_row,
      round(bright, 6) AS bright, round(straight, 6) AS straight, round(slope, 6) AS slope FROM band""",
)
def band_profile_statistics(spark, sf):
    out = ops.band_summary(t.profiles(spark, sf), "profile", 16, 4, 0.1, 10)
    return out.select(
        "vec_id",
        F.col("lit_rows").cast("bigint").alias("lit_rows"),
        F.col("first_row").cast("bigint").alias("first_row"),
        F.col("last_row").cast("bigint").alias("last_row"),
        *[F.round(c, 6).alias(c) for c in ("bright", "straight", "slope")],
    )


@query(
    "profile_residual",
    with_views(
        t.PROFILES,
        """pts AS (SELECT vec_id, label, i, profile[i] AS a FROM profiles, range(1, 65) AS g(i))""",
        "ref AS (SELECT label, i, avg(a) AS r FROM pts GROUP BY label, i)",
    )
    + """SELECT vec_id, round(avg(abs(a - r)), 6) AS residual, round(avg(a), 6) AS level
    FROM pts JOIN ref USING (label, i) WHERE i BETWEEN 9 AND 56 GROUP BY vec_id""",
)
def profile_residual(spark, sf):
    p = t.profiles(spark, sf)
    out = ops.profile_residual(p.join(ops.mean_profile(p, ["label"], "profile"), "label"), "profile", "reference", 8, 56)
    return out.select("vec_id", F.round("residual", 6).alias("residual"), F.round("level", 6).alias("level"))


def _captures(spark, sf):
    lit = _classified(spark, sf).withColumn("lit_left", (F.col("event_id") % 200).cast("double"))
    lit = lit.withColumn(
        "lit_right", F.when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("event_id") % 170)
    )
    return ops.short_flags(lit).withColumn("is_capture", F.col("event_id") % 4 == 0)


@query(
    "indicator_detection",
    with_views(STATUS)
    + """SELECT event_id,
      CASE WHEN event_id % 4 = 0 AND status <> 'occluded' AND
        (event_id % 200 < 123 OR (event_id % 11 <> 0 AND event_id % 170 < 112)) THEN 1 ELSE 0 END AS detections,
      CASE WHEN event_id % 11 = 0 THEN 4 ELSE 5 END AS scalars FROM classified""",
)
def indicator_detection(spark, sf):
    out = ops.indicator_response(_captures(spark, sf))
    return out.select(
        "event_id", F.size("detections").alias("detections"), F.size("scalars").alias("scalars")
    )


@query(
    "retained_batches",
    with_views(t.FRAMES)
    + """SELECT camera_id, event_id, CAST(floor((row_number() OVER (PARTITION BY camera_id ORDER BY event_id) - 1) / 2)
      AS BIGINT) AS response_no, round(scalar, 4) AS chain_pos FROM frames WHERE event_type = 'view'""",
)
def retained_batches(spark, sf):
    kept = t.frames(spark, sf).filter("event_type = 'view'")
    scalars = F.create_map(
        F.lit("chain_step"), F.col("scalar") / 10, F.lit("chain_pos"), F.col("scalar"),
        F.lit("match_quality"), F.col("scalar") / 100, F.lit("chain_status"), F.lit(0.0),
    )
    out = ops.retained_batches(kept.withColumn("scalars", scalars), Lane(("camera_id",), "event_id"))
    return out.select("camera_id", "event_id", "response_no", F.round(F.col("scalars")["chain_pos"], 4).alias("chain_pos"))


@query(
    "response_validation",
    """SELECT event_id, concat_ws(',',
      CASE WHEN event_id % 13 = 0 THEN 'frame_id' END,
      CASE WHEN event_id % 17 = 0 THEN 'model_version' END,
      CASE WHEN event_id % 19 = 0 THEN 'not_finite' END,
      CASE WHEN user_id % 6 + 1 NOT IN (3, 4) THEN 'required_scalar' END,
      CASE WHEN floor(value / 10) <> value / 10 OR value / 10 > 2 THEN 'chain_status' END,
      CASE WHEN event_type IN ('view', 'error') AND event_type <> 'error' THEN 'target' END,
      CASE WHEN event_type IN ('view', 'error') AND event_id % 5 = 0 THEN 'fault' END,
      CASE WHEN event_type IN ('view', 'error') AND user_id % 20 >= 10 THEN 'box_area' END) AS violations
    FROM events""",
)
def response_validation(spark, sf):
    e = t.table(spark, sf, "events")
    eid = F.col("event_id")
    nan = F.lit(float("nan"))
    found = F.col("event_type").isin("view", "error")
    responses = e.select(
        "event_id",
        eid.alias("request_id"),
        F.when(eid % 13 == 0, eid + 1).otherwise(eid).alias("frame_id"),
        F.concat(F.lit("CAM-"), (F.col("user_id") % 6 + 1).cast("string")).alias("camera_id"),
        F.when(eid % 17 == 0, "").otherwise("v1").alias("model_version"),
        F.create_map(
            F.lit("chain_step"), F.lit(4.0),
            F.lit("chain_pos"), F.lit(10.0) + eid,
            F.lit("match_quality"), F.when(eid % 19 == 0, nan).otherwise(0.5),
            F.lit("chain_status"), F.col("value") / 10,
        ).alias("side_scalars"),
        F.when(found, F.when(F.col("event_type") == "error", ops.DETECTED_TARGET).otherwise("WHEEL")).alias("target"),
        F.when(found, F.when(eid % 5 == 0, "CRACK").otherwise(ops.DETECTED_FAULT)).alias("fault"),
        F.when(
            found,
            F.struct(
                ((F.col("user_id") % 20) / 10).alias("x"), F.lit(0.1).alias("y"),
                F.lit(0.5).alias("width"), F.lit(0.4).alias("height"),
            ),
        ).alias("box"),
    )
    # The trigger camera's rules apply to cameras without a side plate; drop the key that marks one.
    side = F.col("camera_id").isin("CAM-3", "CAM-4")
    scalars = F.when(side, F.col("side_scalars")).otherwise(
        F.map_filter("side_scalars", lambda k, _: k != "chain_pos")
    )
    out = responses.withColumn("scalars", scalars)
    return out.select("event_id", F.array_join(ops.response_violations(), ",").alias("violations"))


@query(
    "request_validation",
    """SELECT event_id, concat_ws(',', CASE WHEN event_id % 9 = 0 THEN 'frame_id' END,
      CASE WHEN user_id % 8 + 1 > 6 THEN 'camera_id' END, CASE WHEN event_type = 'view' THEN 'image' END,
      CASE WHEN event_id % 21 = 0 THEN 'captured_at' END) AS violations FROM events""",
)
def request_validation(spark, sf):
    e = t.table(spark, sf, "events")
    digest = F.md5(F.col("event_id").cast("string"))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    requests = e.select(
        "event_id",
        F.when(F.col("event_id") % 9 == 0, digest).otherwise(F.concat_ws("-", *parts)).alias("frame_id"),
        F.concat(F.lit("CAM-"), (F.col("user_id") % 8 + 1).cast("string")).alias("camera_id"),
        F.when(F.col("event_type") == "view", "").otherwise(F.col("props")).cast("binary").alias("image"),
        F.when(F.col("event_id") % 21 == 0, 0).otherwise(t.micros("ts")).alias("captured_us"),
    )
    return requests.select("event_id", F.array_join(ops.request_violations(), ",").alias("violations"))
