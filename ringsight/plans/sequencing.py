"""Queries over frame order, gaps, lateness and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.operators import sequencing as ops
from ringsight.operators.ordered import Lane
from ringsight.plans.registry import query, with_views
from ringsight.session import settle
from ringsight.sources import tables as t

BY_SEQUENCE = Lane(("camera_id",), "sequence_no")
BY_FRAME = Lane(("camera_id",), "event_id")
BY_ARRIVAL = Lane(("camera_id",), "arrival", ("event_id",))


def _wide(lane: Lane, spark, factor: int) -> Lane:
    """Block width in order units where a lane uses only every ``factor``-th number."""
    from dataclasses import replace

    from ringsight.session import block_rows

    return replace(lane, width=block_rows(spark) * factor)


@query(
    "frame_numbering",
    with_views(t.FRAMES)
    + """SELECT camera_id, event_id, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS frame_no
    FROM frames""",
)
def frame_numbering(spark, sf):
    return ops.number_frames(t.frames(spark, sf), BY_FRAME).select("camera_id", "event_id", "frame_no")


GAPS = """gaps AS (
  SELECT *, sequence_no - lag(sequence_no) OVER (PARTITION BY camera_id ORDER BY sequence_no) - 1 AS missing
  FROM frames)"""


@query(
    "gap_declaration",
    with_views(t.FRAMES, GAPS)
    + """SELECT camera_id, sequence_no, missing,
      CAST(CASE WHEN missing / 25.0::DOUBLE > 1.2
                THEN greatest(round_even(missing / 25.0::DOUBLE / 0.8::DOUBLE, 0) - 1, 0) ELSE 0 END AS BIGINT)
        AS hidden_elements
    FROM gaps WHERE missing > 0""",
)
def gap_declaration(spark, sf):
    out = ops.declare_gaps(t.frames(spark, sf), _wide(BY_SEQUENCE, spark, 7))
    return out.select("camera_id", "sequence_no", "missing", "hidden_elements")


@query(
    "gap_advance",
    with_views(t.FRAMES, GAPS)
    + """SELECT camera_id, sequence_no, missing, round(missing * coalesce(step, 0), 4) AS advance FROM (
      SELECT *, quantile_cont(scalar, 0.5) OVER (PARTITION BY camera_id ORDER BY sequence_no
                ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS step FROM gaps)
    WHERE missing > 0""",
)
def gap_advance(spark, sf):
    out = ops.gap_advance(t.frames(spark, sf), _wide(BY_SEQUENCE, spark, 7), "scalar")
    return out.select("camera_id", "sequence_no", "missing", F.round("advance", 4).alias("advance"))


def reorder_machine(arrivals: str) -> str:
    """SQL of the reorder window, one arrival after the other. ``arrivals``: camera_id, event_id, s and k, the arrival from 1."""
    return f"""a AS MATERIALIZED ({arrivals}),
w AS (
  SELECT camera_id, k, event_id, s, s + 1 AS expected, []::BIGINT[] AS held, false AS late, false AS restart FROM a WHERE k = 1
  UNION ALL
  SELECT camera_id, k, event_id, s, CASE WHEN late THEN e0 ELSE e1 + run END, CASE WHEN late THEN h0 ELSE h1[run + 1:] END, late, restart
  FROM (SELECT *, len(list_filter(h1, lambda x, i: x = e1 + i - 1)) AS run FROM (
    SELECT *, CASE WHEN s <> e0 AND len(h1) > {ops.REORDER_WINDOW} THEN h1[1] ELSE e0 END AS e1 FROM (
      SELECT *, s < e0 AS late, list_sort(list_distinct(list_append(h0, s))) AS h1 FROM (
        SELECT a.*, a.s + {ops.REORDER_WINDOW} < w.expected AS restart,
          CASE WHEN a.s + {ops.REORDER_WINDOW} < w.expected THEN a.s ELSE w.expected END AS e0,
          CASE WHEN a.s + {ops.REORDER_WINDOW} < w.expected THEN []::BIGINT[] ELSE w.held END AS h0
        FROM w JOIN a ON a.camera_id = w.camera_id AND a.k = w.k + 1)))))"""


def with_machine(*views: str) -> str:
    return with_views(*views).replace("WITH", "WITH RECURSIVE", 1)


@query(
    "late_drop",
    with_machine(
        t.FRAMES,
        reorder_machine("""SELECT camera_id, event_id, event_id AS s, row_number() OVER (PARTITION BY camera_id
          ORDER BY arrival + CASE WHEN event_id % 50 = 0 THEN 600 ELSE 0 END, event_id) AS k FROM frames"""),
    )
    + "SELECT camera_id, event_id, late FROM w",
)
def late_drop(spark, sf):
    delayed = F.col("arrival") + F.when(F.col("event_id") % 50 == 0, 600).otherwise(0)
    rows = t.frames(spark, sf).select("camera_id", "event_id", delayed.alias("arrival"))
    return ops.late_rows(rows, BY_ARRIVAL, "event_id").select("camera_id", "event_id", "late")


@query(
    "duplicate_slot_guard",
    with_views(
        "slots AS (SELECT event_id, (event_id - event_id % 3 * 2) AS slot FROM events)",
        """seen AS (SELECT *, max(slot) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
                   AND 1 PRECEDING) AS top FROM slots)""",
    )
    + "SELECT event_id, slot FROM seen WHERE top IS NULL OR slot > top",
)
def duplicate_slot_guard(spark, sf):
    slots = t.table(spark, sf, "events").select(
        "event_id", (F.col("event_id") - F.col("event_id") % 3 * 2).alias("slot")
    )
    return ops.first_seen_only(slots, Lane((), "event_id"), "slot")


@query(
    "restart_epochs",
    with_machine(
        t.FRAMES,
        reorder_machine("""SELECT camera_id, event_id, (event_id % 2500) * 7 AS s, row_number() OVER (PARTITION BY camera_id
          ORDER BY event_id) AS k FROM frames"""),
    )
    + """SELECT camera_id, event_id, s AS sequence_no, CAST(sum(CASE WHEN restart THEN 1 ELSE 0 END)
      OVER (PARTITION BY camera_id ORDER BY k) AS BIGINT) AS epoch FROM w""",
)
def restart_epochs(spark, sf):
    runs = t.frames(spark, sf).select(
        "camera_id", "event_id", ((F.col("event_id") % 2500) * 7).alias("sequence_no")
    )
    return ops.restart_epochs(runs, BY_FRAME, "sequence_no").select("camera_id", "event_id", "sequence_no", "epoch")


@query(
    "reorder_window",
    with_views(
        t.FRAMES,
        """lane AS (SELECT camera_id, row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS seq
                   FROM frames)""",
        "kept AS (SELECT *, max(seq) OVER (PARTITION BY camera_id) AS top FROM lane WHERE seq % 97 <> 5)",
    )
    + """SELECT camera_id, seq, coalesce(seq - lag(seq) OVER (PARTITION BY camera_id ORDER BY seq) - 1, 0)
           AS missing_before, 'released' AS outcome
    FROM kept WHERE (top - 5) % 97 > 64 OR seq < top - (top - 5) % 97""",
)
def reorder_window(spark, sf):
    lane = settle(ops.number_frames(t.frames(spark, sf), BY_FRAME).withColumnRenamed("frame_no", "seq"))
    arrival = F.when(F.col("event_id") < 50, F.col("event_id")).otherwise(F.col("arrival"))
    kept = lane.filter(F.col("seq") % 97 != 5).select("camera_id", arrival.alias("arrival"), "event_id", "seq")
    return ops.reorder(kept, BY_ARRIVAL, "seq").select("camera_id", "seq", "missing_before", "outcome")


DEAD = """letters AS (
  SELECT event_id, 'CAM-' || CAST(user_id % 6 + 1 AS VARCHAR) AS camera_id,
         CAST(floor(value * 40000) AS BIGINT) AS n_bytes,
         CAST(props->>'k' AS BIGINT) % 10 <> 0 AS decodable FROM events)"""


@query(
    "dead_letter_routing",
    with_views(DEAD)
    + """SELECT event_id, camera_id,
      CASE WHEN camera_id NOT IN ('CAM-1', 'CAM-3', 'CAM-4') THEN 'unknown camera_id'
           WHEN n_bytes > 8000000 THEN 'image too large'
           WHEN NOT decodable THEN 'undecodable image' END AS reason FROM letters""",
)
def dead_letter_routing(spark, sf):
    e = t.table(spark, sf, "events")
    frames = e.select(
        "event_id",
        F.concat(F.lit("CAM-"), (F.col("user_id") % 6 + 1).cast("string")).alias("camera_id"),
        F.floor(F.col("value") * 40000).alias("n_bytes"),
        (F.get_json_object("props", "$.k").cast("bigint") % 10 != 0).alias("decodable"),
    )
    return ops.dead_letters(frames, ["CAM-1", "CAM-3", "CAM-4"]).select("event_id", "camera_id", "reason")


@query(
    "deadline_skip",
    with_views(t.FRAMES)
    + """SELECT camera_id, count(*) AS frames, count(*) FILTER (captured_us + CAST(floor(scalar * 100000) AS BIGINT)
      - captured_us > 5000000) AS skipped FROM frames GROUP BY camera_id""",
)
def deadline_skip(spark, sf):
    f = t.frames(spark, sf).withColumn("done_us", F.col("captured_us") + F.floor(F.col("scalar") * 100000))
    flagged = ops.deadline_skips(f, "captured_us", "done_us")
    return ops.lane_counters(flagged, ["camera_id"], skipped=F.col("skipped"))


@query(
    "repeated_pictures",
    with_views(t.FRAMES)
    + """SELECT camera_id, event_id, coalesce(sha256(payload) =
      lag(sha256(payload)) OVER (PARTITION BY camera_id ORDER BY event_id), false) AS repeated FROM frames""",
)
def repeated_pictures(spark, sf):
    out = ops.repeated_pictures(t.frames(spark, sf), BY_FRAME, "payload")
    return out.select("camera_id", "event_id", "repeated")


@query(
    "arrival_health",
    with_views(
        t.FRAMES,
        """flagged AS (SELECT *, payload = lag(payload) OVER (PARTITION BY camera_id ORDER BY event_id) AS rep
                      FROM frames)""",
        """win AS (SELECT camera_id, event_id, count(*) OVER w AS n, max(captured_us) OVER w AS hi,
                   min(captured_us) OVER w AS lo,
                   avg(CASE WHEN rep THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) OVER w AS share
            FROM flagged WINDOW w AS (PARTITION BY camera_id ORDER BY event_id
                                      ROWS BETWEEN 249 PRECEDING AND CURRENT ROW))""",
    )
    + """SELECT camera_id, event_id, round(CASE WHEN n >= 50 AND hi > lo THEN (n - 1) / ((hi - lo) / 1e6::DOUBLE) END, 9)
        AS rate, round(CASE WHEN n >= 50 THEN share END, 6) AS repeated_share FROM win""",
)
def arrival_health(spark, sf):
    out = ops.arrival_health(t.frames(spark, sf), BY_FRAME, "captured_us", "payload")
    return out.select(
        "camera_id", "event_id", F.round("rate", 9).alias("rate"), F.round("repeated_share", 6).alias("repeated_share")
    )


@query(
    "interval_sampler",
    with_views(t.FRAMES)
    .replace("WITH ", "WITH RECURSIVE ")
    .rstrip()
    + """, picks AS (
      SELECT camera_id, min(captured_us) AS captured_us FROM frames GROUP BY camera_id
      UNION ALL
      SELECT p.camera_id, (SELECT min(f.captured_us) FROM frames f WHERE f.camera_id = p.camera_id
                           AND f.captured_us >= p.captured_us + 7200000000) AS captured_us
      FROM picks p WHERE p.captured_us IS NOT NULL)
    SELECT camera_id, captured_us FROM picks WHERE captured_us IS NOT NULL""",
)
def interval_sampler(spark, sf):
    f = t.frames(spark, sf).select("camera_id", "event_id", "captured_us")
    by_time = Lane(("camera_id",), "captured_us", ("event_id",))
    return ops.spaced_rows(f, by_time, "captured_us", 7_200_000_000).select("camera_id", "captured_us")


@query(
    "evidence_cache",
    with_views(t.FRAMES, """firsts AS (SELECT event_type, user_id, min(event_id) AS event_id FROM frames
                                      GROUP BY event_type, user_id)""")
    + """SELECT event_type, user_id, event_id FROM firsts
    QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 32""",
)
def evidence_cache(spark, sf):
    f = t.frames(spark, sf).select("event_type", "user_id", "event_id")
    return ops.newest_ring(f, ["event_type"], "user_id", "event_id", 32)


RING_POS = "pos AS (SELECT camera_id, event_id, event_id * 1.5::DOUBLE + scalar / 100 AS s FROM frames)"


def _positions(spark, sf):
    return t.frames(spark, sf).select(
        "camera_id", "event_id", (F.col("event_id") * F.lit(1.5) + F.col("scalar") / 100).alias("s")
    )


@query(
    "position_ring",
    with_views(t.FRAMES, RING_POS)
    + """SELECT camera_id, bucket, event_id FROM (
      SELECT camera_id, CAST(floor(s / 4) AS BIGINT) AS bucket, max(event_id) AS event_id, arg_max(s, event_id) AS s
      FROM pos GROUP BY 1, 2) WHERE s >= 1000
    QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY event_id DESC) <= 900""",
)
def position_ring(spark, sf):
    out = ops.bucket_ring(_positions(spark, sf), ["camera_id"], "s", "event_id", 4.0, 900, F.max_by, F.lit(1000.0))
    return out.select("camera_id", "bucket", "event_id")


@query(
    "sparse_ring",
    with_views(t.FRAMES, RING_POS)
    + """SELECT camera_id, bucket, event_id FROM (
      SELECT camera_id, CAST(floor(s / 400) AS BIGINT) AS bucket, min(event_id) AS event_id FROM pos GROUP BY 1, 2)
    QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY event_id DESC) <= 40""",
)
def sparse_ring(spark, sf):
    out = ops.bucket_ring(_positions(spark, sf), ["camera_id"], "s", "event_id", 400.0, 40, F.min_by)
    return out.select("camera_id", "bucket", "event_id")


@query(
    "request_correlation",
    """SELECT r.event_id, r.event_type <> 'error' AS answered,
         CASE WHEN r.event_type <> 'error' THEN r.value END AS response_value FROM events r""",
)
def request_correlation(spark, sf):
    e = t.table(spark, sf, "events")
    requests = e.select("event_id")
    responses = e.filter("event_type <> 'error'").select("event_id", F.col("value").alias("response_value"))
    return ops.correlate(requests, responses, "event_id")


@query(
    "lane_counters",
    with_views(
        t.FRAMES,
        """f AS (SELECT *, sequence_no - lag(sequence_no) OVER w - 1 AS missing, payload = lag(payload) OVER w AS rep
             FROM frames WINDOW w AS (PARTITION BY camera_id ORDER BY event_id))""",
    )
    + """SELECT camera_id, count(*) AS frames, count(*) FILTER (missing > 0) AS gaps,
      count(*) FILTER (rep) AS repeated, count(*) FILTER (scalar < 1) AS stopped FROM f GROUP BY camera_id""",
)
def lane_counters(spark, sf):
    from ringsight.operators.ordered import previous

    seen = previous(t.frames(spark, sf), BY_FRAME, "_prev", "sequence_no", "payload")
    return ops.lane_counters(
        seen,
        ["camera_id"],
        gaps=F.col("sequence_no") - F.col("_prev.sequence_no") - 1 > 0,
        repeated=F.col("payload") == F.col("_prev.payload"),
        stopped=F.col("scalar") < 1,
    )
