"""Queries over the alert pipeline, its sinks and its viewers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.functions.numeric import decode_missing, encode_missing
from ringsight.operators import alerts as ops
from ringsight.operators import reports
from ringsight.plans.registry import query, with_views
from ringsight.session import checkpoint_root
from ringsight.sources import tables as t
from ringsight.sources.sinks import append_dated, remove_before, run_folder

YEAR_1998, YEAR_1999 = 883_612_800_000_000, 915_148_800_000_000


@query(
    "qualifying_detections",
    with_views(t.PROFILES)
    + "SELECT vec_id, i AS detection_no, round(profile[i], 6) AS score FROM profiles, range(1, 65) AS g(i) WHERE profile[i] >= 0.1",
)
def qualifying_detections(spark, sf):
    found = F.transform("profile", lambda v, i: F.struct((i + 1).alias("no"), v.alias("score")))
    out = ops.qualifying_detections(t.profiles(spark, sf).select("vec_id", found.alias("detections")), 0.1)
    return out.select("vec_id", F.col("detection.no").cast("bigint").alias("detection_no"), F.round("detection.score", 6).alias("score"))


EVENTS = """ev AS (SELECT alert_id AS n, CASE WHEN alert_id % 3 = 0 THEN '' ELSE 'K' || event_key END AS event_key,
    CASE WHEN alert_id % 29 = 0 THEN 'other' ELSE kind END AS kind, camera_id, element_id, loop_no, state,
    CASE WHEN alert_id % 5 = 0 THEN 'F' || alert_id WHEN alert_id % 5 = 1 THEN '' ELSE 'X' END AS wanted, 'F' || alert_id AS frame_id,
    floor(amount / 1000) AS drop, CASE WHEN alert_id % 7 = 0 THEN detected_us + 5000000 ELSE detected_us END AS captured_us,
    detected_us + 5000000 AS now_us, model_version, alert_id % 10 / 10.0::DOUBLE AS bx, alert_id % 13 / 20.0::DOUBLE AS bw FROM alerts),
al AS (SELECT n, CASE WHEN event_key <> '' THEN event_key WHEN camera_id = 'CAM-1' THEN 'DAMAGE:' || element_id || ':' || loop_no
    ELSE camera_id || ':DAMAGE:' || element_id || ':' || loop_no END AS event_key, kind, camera_id, element_id, loop_no, state, wanted, frame_id, drop,
    captured_us, now_us, model_version, bx, bw, CAST(substr(camera_id, 5) AS BIGINT) AS cam
  FROM ev WHERE kind <> 'other' AND state IN ('pending', 'confirmed') AND element_id > 0),
hx AS (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(event_key)) AS h FROM al)"""


def _events(spark, sf):
    a = t.alerts(spark, sf)
    n = F.col("alert_id")
    text = F.concat(F.lit("F"), n.cast("string"))
    return a.select(
        n.alias("n"),
        F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("K"), F.col("event_key").cast("string"))).alias("event_key"),
        F.when(n % 29 == 0, "other").otherwise(F.col("kind")).alias("kind"),
        "camera_id", "element_id", "loop_no", "state",
        F.when(n % 5 == 0, text).when(n % 5 == 1, "").otherwise("X").alias("evidence_frame_id"),
        text.alias("frame_id"),
        F.create_map(F.lit("drop"), F.floor(F.col("amount") / 1000).cast("double"), F.lit("n"), n.cast("double")).alias("measurements"),
        F.when(n % 7 == 0, 0).otherwise(F.col("detected_us")).alias("captured_us"),
        (F.col("detected_us") + 5_000_000).alias("now_us"),
        "model_version",
        F.struct((n % 10 / 10).alias("x"), F.lit(0.0).alias("y"), (n % 13 / 20).alias("width"), F.lit(0.5).alias("height")).alias("box"),
    )


def _element_states(spark, sf):
    """States of most elements of each camera; every sixth element has none."""
    ids = t.alerts(spark, sf).select("camera_id", "element_id").distinct().filter("element_id % 6 <> 0")
    cam = F.substring("camera_id", 5, 9).cast("bigint")
    return ids.select(
        "camera_id", "element_id", (F.col("element_id") * 1.5 + cam).alias("lip"), (F.col("element_id") % 2 == 0).alias("near_plate"),
        (F.col("element_id") / 4.0).alias("severity"), (F.col("element_id") % 8).alias("passes_seen"),
    )


@query(
    "event_to_alert",
    with_views(t.ALERTS, EVENTS)
    + """SELECT n, event_key, element_id, loop_no, state AS alert_state, CASE kind WHEN 'damage' THEN 'godet' ELSE 'galet' END AS observation_target,
      upper(kind) AS fault_type, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
      CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9'
           WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS alert_id,
      camera_id, upper(kind) AS rule_id, frame_id, model_version, captured_us, now_us AS detected_us,
      CASE WHEN bw > 0 THEN round(bx, 6) ELSE 0 END AS x, CASE WHEN bw > 0 THEN round(least(bw, 1 - bx), 6) ELSE 1 END AS width,
      strftime(make_timestamp(captured_us), '%Y/%m/%d') || '/' || camera_id AS folder FROM hx""",
)
def event_to_alert(spark, sf):
    out = ops.events_to_alerts(_events(spark, sf), _element_states(spark, sf))
    n = F.col("measurements")["n"].cast("double").cast("bigint")
    return out.select(
        n.alias("n"), "event_key", "element_id", "loop_no", "alert_state", "observation_target", "fault_type", "alert_id",
        "camera_id", "rule_id", "frame_id", "model_version", "captured_us", "detected_us", F.round("box.x", 6).alias("x"),
        F.round("box.width", 6).alias("width"), F.regexp_replace("evidence_ref", "/[^/]*$", "").alias("folder"),
    )


@query(
    "measurement_merge",
    with_views(t.ALERTS, EVENTS)
    + """SELECT n, CAST(drop AS VARCHAR) AS drop_text, state AS state_text, CAST(loop_no AS VARCHAR) AS loop_text,
      CASE WHEN wanted NOT IN ('', frame_id) THEN 'latest_frame' END AS evidence,
      CASE WHEN kind = 'damage' AND camera_id NOT IN ('CAM-3', 'CAM-4') THEN CAST(CASE WHEN element_id % 6 = 0 THEN 0 ELSE element_id * 1.5::DOUBLE + cam END AS VARCHAR) END AS lip_text,
      CASE WHEN kind = 'damage' AND camera_id IN ('CAM-3', 'CAM-4') THEN CASE WHEN element_id % 6 = 0 THEN '0' ELSE CAST(element_id % 8 AS VARCHAR) END END AS passes_text FROM al""",
)
def measurement_merge(spark, sf):
    m = ops.events_to_alerts(_events(spark, sf), _element_states(spark, sf)).select("measurements")
    get = lambda k: F.col("measurements")[k]
    return m.select(
        get("n").cast("double").cast("bigint").alias("n"), get("drop").alias("drop_text"), get("state").alias("state_text"),
        get("last_seen_loop").alias("loop_text"), get("evidence").alias("evidence"), get("lip").alias("lip_text"),
        get("passes_seen").alias("passes_text"),
    )


@query(
    "events_from_states",
    with_views(
        t.ALERTS,
        "e AS (SELECT camera_id, CAST(event_key AS VARCHAR) AS event_key, kind, element_id, loop_no, state FROM alerts WHERE camera_id IN ('CAM-1', 'CAM-3'))",
        "s AS (SELECT camera_id, element_id, min(state) AS state, max(loop_no) AS loop_no FROM alerts GROUP BY 1, 2)",
    )
    + """SELECT * FROM e UNION ALL SELECT camera_id, camera_id || ':DAMAGE:' || element_id || ':' || loop_no, 'damage', element_id, loop_no, state
    FROM s WHERE camera_id NOT IN ('CAM-1', 'CAM-3') AND state IN ('pending', 'confirmed')""",
)
def events_from_states(spark, sf):
    a = t.alerts(spark, sf)
    events = a.filter(F.col("camera_id").isin("CAM-1", "CAM-3")).withColumn("event_key", F.col("event_key").cast("string"))
    states = a.groupBy("camera_id", "element_id").agg(F.min("state").alias("state"), F.max("loop_no").alias("last_seen_loop"))
    return ops.events_or_states(events, states)


@query(
    "event_box",
    """SELECT event_id, round(CASE WHEN ok THEN x ELSE 0 END, 6) AS x, round(CASE WHEN ok THEN least(w, 1 - x) ELSE 1 END, 6) AS width,
      ok OR event_type = 'error' AS drawn FROM (
      SELECT event_id, event_type, least(greatest(user_id / 100.0::DOUBLE - 0.2, 0), 1) AS x, value / 200 - 0.05 AS w,
        value / 200 - 0.05 > 0 AND least(value / 200 - 0.05, 1 - least(greatest(user_id / 100.0::DOUBLE - 0.2, 0), 1)) > 0 AS ok FROM events)""",
)
def event_box(spark, sf):
    box = F.struct(
        (F.col("user_id") / 100.0 - 0.2).alias("x"), F.lit(0.1).alias("y"), (F.col("value") / 200 - 0.05).alias("width"),
        F.lit(0.2).alias("height"),
    )
    e = t.table(spark, sf, "events").withColumn("box", box)
    cut, drawn = ops.event_box(F.col("box"), F.col("event_type") == "error")
    return e.select("event_id", F.round(cut["x"], 6).alias("x"), F.round(cut["width"], 6).alias("width"), drawn.alias("drawn"))


@query(
    "window_report",
    with_views(t.ALERTS)
    + f"""SELECT count(*) AS total, count(DISTINCT element_id) AS elements, count(*) FILTER (state = 'pending') AS pending,
      count(*) FILTER (state = 'confirmed') AS confirmed, count(seen_us) AS seen, count(*) - count(seen_us) AS unseen,
      string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS versions FROM alerts
    WHERE detected_us >= {YEAR_1998} AND detected_us < {YEAR_1999}""",
)
def window_report(spark, sf):
    return reports.window_report(reports.window_rows(t.alerts(spark, sf), "detected_us", YEAR_1998, YEAR_1999))


@query(
    "report_lines",
    with_views(t.ALERTS)
    + f"""SELECT concat_ws(' | ', CAST(element_id AS VARCHAR), CAST(loop_no AS VARCHAR), state,
      printf('%.1f', CAST(floor(amount / 1000) AS DOUBLE)), CASE WHEN seen_us IS NULL THEN 'no' ELSE 'yes' END) AS value FROM alerts
    WHERE detected_us >= {YEAR_1998} AND detected_us < {YEAR_1999}""",
)
def report_lines(spark, sf):
    rows = reports.window_rows(t.alerts(spark, sf), "detected_us", YEAR_1998, YEAR_1999)
    return reports.report_lines(rows.withColumn("drop", F.floor(F.col("amount") / 1000).cast("double")))


@query(
    "json_number_cell",
    """SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'x' ELSE props->>'k' END AS DOUBLE) AS cell FROM events""",
)
def json_number_cell(spark, sf):
    text = F.when(F.col("event_id") % 7 == 0, F.lit('{"k": "x"}')).otherwise(F.col("props"))
    return t.table(spark, sf, "events").select("event_id", reports.number_cell(text, "$.k").alias("cell"))


STORED = "stored AS (SELECT event_key, max(state) AS state FROM alerts WHERE alert_id % 4 = 0 GROUP BY event_key)"


@query(
    "change_detection",
    with_views(t.ALERTS, STORED)
    + """SELECT alert_id, event_key, state FROM (
      SELECT a.*, coalesce(lag(a.state) OVER (PARTITION BY a.event_key ORDER BY a.alert_id), s.state) AS last
      FROM alerts a LEFT JOIN stored s USING (event_key) WHERE a.alert_id % 4 <> 0) WHERE last IS NULL OR last <> state""",
)
def change_detection(spark, sf):
    a = t.alerts(spark, sf).select("alert_id", "event_key", "state")
    return ops.changed_events(a.filter("alert_id % 4 <> 0"), a.filter("alert_id % 4 = 0"), ["event_key"], "state", "alert_id").select("alert_id", "event_key", "state")


@query(
    "storage_cap_gate",
    with_views(
        t.ALERTS,
        "st AS (SELECT DISTINCT event_key FROM alerts WHERE alert_id % 40 = 0)",
        "ev AS (SELECT alert_id, event_key FROM alerts WHERE alert_id % 40 <> 0)",
        "fresh AS (SELECT event_key, row_number() OVER (ORDER BY min(alert_id)) AS r FROM ev WHERE event_key NOT IN (SELECT event_key FROM st) GROUP BY event_key)",
    )
    + """SELECT alert_id, event_key, event_key IN (SELECT event_key FROM st) OR event_key IN
      (SELECT event_key FROM fresh WHERE r <= 450 - (SELECT count(*) FROM st)) AS allowed FROM ev""",
)
def storage_cap_gate(spark, sf):
    a = t.alerts(spark, sf).select("alert_id", "event_key")
    stored = a.filter("alert_id % 40 = 0").select("event_key").distinct()
    return ops.storage_gate(a.filter("alert_id % 40 <> 0"), stored, "event_key", "alert_id", 450)


@query(
    "alert_page",
    with_views(t.ALERTS)
    + f"""SELECT alert_id, camera_id, detected_us, true AS has_more FROM alerts WHERE camera_id = 'CAM-1' AND seen_us IS NULL
      AND detected_us >= {YEAR_1998} ORDER BY detected_us DESC, alert_id DESC LIMIT 50""",
)
def alert_page(spark, sf):
    a = t.alerts(spark, sf).select("alert_id", "camera_id", "detected_us", "seen_us")
    return ops.list_alerts(a, 50, filters={"camera_id": "CAM-1"}, unseen=True, since=YEAR_1998).drop("seen_us")


@query(
    "alert_page_after_cursor",
    with_views(t.ALERTS)
    + f"""SELECT alert_id, detected_us FROM alerts WHERE detected_us < {YEAR_1999} OR (detected_us = {YEAR_1999} AND alert_id < 7000)
    ORDER BY detected_us DESC, alert_id DESC LIMIT 200""",
)
def alert_page_after_cursor(spark, sf):
    a = t.alerts(spark, sf).select("alert_id", "detected_us", "seen_us")
    return ops.list_alerts(a, 500, cursor=(YEAR_1999, 7000)).select("alert_id", "detected_us")


@query(
    "alert_lookup",
    with_views(t.ALERTS)
    + """SELECT count(*) AS stored, count(*) FILTER (event_key = 77) > 0 AS has_key, max(amount) FILTER (alert_id = 42) AS amount FROM alerts""",
)
def alert_lookup(spark, sf):
    return t.alerts(spark, sf).agg(
        F.count(F.lit(1)).alias("stored"), (F.count(F.when(F.col("event_key") == 77, 1)) > 0).alias("has_key"),
        F.max(F.when(F.col("alert_id") == 42, F.col("amount"))).alias("amount"),
    )


@query(
    "mark_seen",
    with_views(t.ALERTS)
    + """SELECT a.alert_id, coalesce(a.seen_us, m.mark) AS seen_us FROM alerts a LEFT JOIN (
      SELECT event_id * 3 % 5000 AS alert_id, min(epoch_us(ts)) AS mark FROM events GROUP BY 1) m USING (alert_id)""",
)
def mark_seen(spark, sf):
    marks = t.table(spark, sf, "events").select((F.col("event_id") * 3 % 5000).alias("alert_id"), t.micros("ts").alias("mark_us"))
    return ops.mark_seen(t.alerts(spark, sf).select("alert_id", "seen_us"), marks)


@query(
    "retention",
    with_views(t.ALERTS, "n AS (SELECT max(detected_us) AS newest FROM alerts)")
    + """SELECT alert_id, detected_us < newest - 365 * 86400000000 AS expired,
      CASE WHEN detected_us < newest - 365 * 86400000000 THEN strftime(detected_at, '%Y/%m/%d') || '/' || camera_id || '/' || alert_id || '.jpg' END AS file
    FROM alerts, n""",
)
def retention(spark, sf):
    a = t.alerts(spark, sf)
    newest = a.agg(F.max("detected_us").alias("newest"))  # one row
    out = ops.retention(a.crossJoin(F.broadcast(newest)), "detected_us", F.col("newest"), 365)
    path = ops.evidence_path(F.col("detected_at"), F.col("camera_id"), F.col("alert_id").cast("string"))
    return out.select("alert_id", "expired", F.when(F.col("expired"), path).alias("file"))


@query(
    "retained_table",
    with_views(t.ALERTS, "n AS (SELECT max(detected_us) - 365 * 86400000000 AS cut FROM alerts)")
    + """SELECT strftime(detected_at, '%Y-%m-%d') AS day, count(*) FILTER (detected_us >= cut) AS n_kept, count(*) FILTER (detected_us < cut) AS n_files
    FROM alerts, n GROUP BY 1""",
)
def retained_table(spark, sf):
    """Alerts written as a dated table, those of more than a year ago removed from it: rows left and evidence files to remove, for each day."""
    file = ops.evidence_path(F.col("detected_at"), F.col("camera_id"), F.col("alert_id").cast("string"))
    a = t.alerts(spark, sf).select("alert_id", "detected_us", file.alias("evidence_ref"))
    cut = a.agg(F.max("detected_us")).first()[0] - 365 * 86_400_000_000
    root = run_folder(f"{checkpoint_root(spark)}/retained")
    append_dated(a, f"{root}/table", "detected_us", days=30)
    files = remove_before(spark, f"{root}/table", "detected_us", cut, "evidence_ref", f"{root}/files", days=30)
    day = F.date_from_unix_date(F.floor(F.col("detected_us") / 86_400_000_000).cast("int")).cast("string")
    kept = spark.read.schema("detected_us bigint, day date").parquet(f"{root}/table").select(day.alias("day"), F.lit(1).alias("kept"))
    gone = files.select(F.replace(F.substring("file", 1, 10), F.lit("/"), F.lit("-")).alias("day"), F.lit(0).alias("kept"))
    counts = kept.unionByName(gone).groupBy("day")
    return counts.agg(F.sum("kept").alias("n_kept"), F.sum(1 - F.col("kept")).alias("n_files"))


@query(
    "alert_validation",
    """SELECT event_id, concat_ws(',', CASE WHEN event_id % 9 = 0 THEN 'alert_id' END, CASE WHEN user_id % 8 >= 6 THEN 'camera_id' END,
      CASE WHEN event_type = 'view' THEN 'observation_target' END, CASE WHEN event_id % 14 = 0 THEN 'fault_or_version' END,
      CASE WHEN value > 100 THEN 'confidence' END, CASE WHEN user_id % 20 > 10 THEN 'box' END,
      CASE WHEN event_id % 15 = 0 THEN 'evidence_ref' END) AS violations FROM events""",
)
def alert_validation(spark, sf):
    digest = F.md5(F.col("event_id").cast("string"))
    ident = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    box = F.struct(((F.col("user_id") % 20) / 20.0).alias("x"), F.lit(0.1).alias("y"), F.lit(0.5).alias("width"), F.lit(0.5).alias("height"))
    rows = t.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 9 == 0, "nope").otherwise(ident).alias("alert_id"), ident.alias("frame_id"),
        t.micros("ts").alias("detected_us"), F.concat(F.lit("CAM-"), (F.col("user_id") % 8 + 1).cast("string")).alias("camera_id"),
        F.when(F.col("event_type") == "view", "other").otherwise("godet").alias("observation_target"),
        F.when(F.col("event_id") % 14 == 0, "").otherwise("DAMAGE").alias("fault_type"), F.lit("v1").alias("model_version"),
        (F.col("value") / 100).alias("confidence"), box.alias("box"),
        F.when(F.col("event_id") % 15 == 0, "a/../b.jpg").otherwise("2024/01/01/CAM-1/x.jpg").alias("evidence_ref"),
    )
    return rows.select("event_id", F.array_join(ops.alert_violations(), ",").alias("violations"))


@query(
    "evidence_path",
    with_views(t.ALERTS)
    + """SELECT alert_id, CASE WHEN alert_id % 6 <> 0 THEN strftime(detected_at, '%Y/%m/%d') || '/' || camera_id || '/' || alert_id || '.jpg' END AS path FROM alerts""",
)
def evidence_path(spark, sf):
    camera = F.when(F.col("alert_id") % 6 == 0, "../up").otherwise(F.col("camera_id"))
    path = ops.evidence_path(F.col("detected_at"), camera, F.col("alert_id").cast("string"))
    return t.alerts(spark, sf).select("alert_id", path.alias("path"))


HHMM = "lpad(CAST({h} AS VARCHAR), 2, '0') || ':' || lpad(CAST({m} AS VARCHAR), 2, '0')"


@query(
    "schedule_membership",
    """WITH s AS (SELECT event_id, user_id % 11 <> 0 AS enabled, (user_id * 7) % 24 * 60 + 15 AS a,
      CASE WHEN user_id % 13 = 0 THEN (user_id * 7) % 24 * 60 + 15 ELSE (user_id * 5) % 24 * 60 + 30 END AS b,
      event_id % 17 = 0 AS broken, ts + INTERVAL 1 HOUR AS local FROM events),
    m AS (SELECT *, hour(local) * 60 + minute(local) AS mins FROM s)
    SELECT event_id, CASE WHEN NOT enabled THEN true WHEN broken THEN false WHEN a = b THEN true WHEN a < b THEN mins >= a AND mins < b
      ELSE mins >= a OR mins < b END AS inside FROM m""",
)
def schedule_membership(spark, sf):
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    u = F.col("user_id")
    start = F.concat(two((u * 7) % 24), F.lit(":15"))
    stop = F.when(u % 13 == 0, start).otherwise(F.concat(two((u * 5) % 24), F.lit(":30")))
    start = F.when(F.col("event_id") % 17 == 0, "25:99").otherwise(start)
    minute = ops.local_minute(F.col("ts"), F.lit("+01:00"))
    inside = ops.in_schedule(u % 11 != 0, start, stop, minute)
    return t.table(spark, sf, "events").select("event_id", inside.alias("inside"))


CAMS = """cams AS (SELECT s_suppkey, 'CAM-' || (s_suppkey + 1) AS camera_id,
  CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST(s_suppkey % 24 AS VARCHAR), 2, '0') || ':00' END AS own_start,
  CASE WHEN s_suppkey % 2 = 0 THEN lpad(CAST((s_suppkey + 5) % 24 AS VARCHAR), 2, '0') || ':00' END AS own_stop FROM (SELECT s_nationkey AS s_suppkey FROM supplier GROUP BY 1)),
setts AS (SELECT camera_id, CASE s_suppkey % 9 WHEN 1 THEN 'off' WHEN 4 THEN 'always' ELSE 'hours' END AS mode,
  CASE WHEN s_suppkey % 9 = 7 THEN '06:30' END AS start, CASE WHEN s_suppkey % 9 = 7 THEN '09:45' END AS stop FROM cams WHERE s_suppkey % 9 IN (1, 4, 7)),
hours AS (SELECT c.camera_id, CASE s.mode WHEN 'off' THEN 'off' WHEN 'always' THEN 'always' ELSE 'hours' END AS mode,
  CASE WHEN s.mode IS NOT NULL THEN s.start WHEN c.camera_id = 'CAM-3' THEN '09:00' WHEN c.camera_id = 'CAM-4' THEN '12:30' WHEN c.camera_id = 'CAM-1' THEN '16:00'
       ELSE coalesce(own_start, '00:00') END AS start,
  CASE WHEN s.mode IS NOT NULL THEN s.stop WHEN c.camera_id = 'CAM-3' THEN '12:30' WHEN c.camera_id = 'CAM-4' THEN '16:00' WHEN c.camera_id = 'CAM-1' THEN '08:00'
       ELSE coalesce(own_stop, '01:00') END AS stop,
  CASE WHEN s.mode IS NOT NULL THEN 'page' WHEN c.camera_id IN ('CAM-1', 'CAM-3', 'CAM-4') THEN 'default' WHEN own_start IS NOT NULL THEN 'own' ELSE 'common' END AS source
  FROM cams c LEFT JOIN setts s USING (camera_id))"""


def _hours(spark, sf):
    k = F.col("s_suppkey")
    two = lambda c: F.concat(F.lpad(c.cast("string"), 2, "0"), F.lit(":00"))
    cams = t.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("s_suppkey")).count()  # a camera of every nation
    s = cams.withColumn("camera_id", F.concat(F.lit("CAM-"), (k + 1).cast("string")))
    cameras = s.select("camera_id", F.when(k % 2 == 0, two(k % 24)).alias("own_start"), F.when(k % 2 == 0, two((k + 5) % 24)).alias("own_stop"))
    settings = s.filter((k % 9).isin(1, 4, 7)).select(
        "camera_id", F.when(k % 9 == 1, "off").when(k % 9 == 4, "always").otherwise("hours").alias("mode"),
        F.when(k % 9 == 7, "06:30").alias("start"), F.when(k % 9 == 7, "09:45").alias("stop"),
    )
    base = spark.range(1).select(F.lit("00:00").alias("base_start"), F.lit("01:00").alias("base_stop"))
    return ops.effective_hours(cameras, settings, base)


@query("effective_hours", with_views(CAMS) + "SELECT * FROM hours")
def effective_hours(spark, sf):
    return _hours(spark, sf)


@query(
    "overlapping_hours",
    with_views(
        CAMS,
        """mins AS (SELECT camera_id, m FROM hours, range(0, 1440) AS g(m) WHERE mode = 'always' OR (mode = 'hours' AND
            CASE WHEN start < stop THEN lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') >= start
                   AND lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') < stop
                 ELSE start > stop AND (lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') >= start
                   OR lpad(CAST(m // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') < stop) END))""",
    )
    + "SELECT DISTINCT a.camera_id AS first_key, b.camera_id AS second_key FROM mins a JOIN mins b ON a.m = b.m AND a.camera_id < b.camera_id",
)
def overlapping_hours(spark, sf):
    return ops.overlapping_hours(_hours(spark, sf), "camera_id")


@query(
    "window_counters",
    with_views(t.ALERTS)
    + """SELECT camera_id, CAST(floor(detected_us / 2592000000000) AS BIGINT) AS window_no, count(*) AS processed,
      count(*) FILTER (state = 'confirmed') AS stored, count(*) FILTER (state = 'pending') AS upserts, count(*) FILTER (state = 'other') AS dropped,
      string_agg(DISTINCT model_version, ',' ORDER BY model_version) AS versions FROM alerts GROUP BY 1, 2""",
)
def window_counters(spark, sf):
    state = F.col("state")
    outcome = F.when(state == "confirmed", "stored").when(state == "pending", "upsert").otherwise("dropped")
    return reports.window_counters(t.alerts(spark, sf).withColumn("outcome", outcome), "camera_id", "detected_us", 2_592_000_000_000)


@query(
    "readiness",
    with_views(t.FRAMES, "c AS (SELECT camera_id, count(*) % 2 = 0 AS in_window, avg(scalar) > 10 AS ready FROM frames GROUP BY 1)")
    + "SELECT count(*) FILTER (in_window) > 0 AND coalesce(bool_and(ready) FILTER (in_window), false) AS ready FROM c",
)
def readiness(spark, sf):
    c = t.frames(spark, sf).groupBy("camera_id").agg(
        (F.count(F.lit(1)) % 2 == 0).alias("in_window"), (F.avg("scalar") > 10).alias("ready")
    )
    return reports.readiness(c)


LATEST = """lat AS (SELECT 'U' || user_id AS camera_id, max(event_id) AS event_id,
  arg_max(CASE event_type WHEN 'view' THEN 'standby' ELSE event_type END, event_id) AS status FROM events GROUP BY 1)"""


def _latest_status(spark, sf):
    e = t.table(spark, sf, "events").select(
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("camera_id"), "event_id",
        F.when(F.col("event_type") == "view", "standby").otherwise(F.col("event_type")).alias("status"),
    )
    return reports.latest_status(e, "camera_id", "event_id")


@query("latest_status", with_views(LATEST) + "SELECT * FROM lat")
def latest_status(spark, sf):
    return _latest_status(spark, sf)


@query("status_summary", with_views(LATEST) + "SELECT * FROM lat ORDER BY status = 'standby', camera_id LIMIT 1")
def status_summary(spark, sf):
    return reports.status_summary(_latest_status(spark, sf), "camera_id")


VIEW = """vw AS (SELECT alert_id, camera_id, element_id, kind, state, seen_us, upper(kind) AS fault_type, CAST(alert_id % 12 AS DOUBLE) + 0.5 AS n,
  alert_id % 3 AS has, alert_id % 5 AS dt FROM alerts),
lb AS (SELECT *, CASE fault_type WHEN 'WHEEL_GAP' THEN 'Too few wheels' WHEN 'WHEEL_DENSITY' THEN 'Too many wheels' WHEN 'WHEEL_MISSING' THEN 'Wheel missing'
    ELSE CASE WHEN has <> 0 THEN 'Lip damage' WHEN dt = 1 THEN 'Cut' WHEN dt = 2 THEN 'Out of line' WHEN dt = 3 THEN 'Cut + out of line' ELSE 'Damage' END END AS label,
  CASE fault_type WHEN 'WHEEL_GAP' THEN floor(n + 0.5) <= 4 WHEN 'WHEEL_DENSITY' THEN floor(n + 0.5) >= 3 ELSE false END AS hidden FROM vw)"""


def _view(spark, sf):
    n = F.col("alert_id") % 12 + F.lit(0.5)
    text = F.when(
        F.col("alert_id") % 3 == 0, F.to_json(F.struct(n.alias("godets"), n.alias("min_spacing"), (F.col("alert_id") % 5).alias("damage_type")))
    ).otherwise(F.to_json(F.struct(n.alias("godets"), n.alias("min_spacing"), F.lit(1.0).alias("lip"))))
    return t.alerts(spark, sf).withColumn("fault_type", F.upper("kind")).withColumn("measurements", text)


@query(
    "viewer_rows",
    with_views(t.ALERTS, VIEW)
    + """SELECT alert_id, CASE WHEN seen_us IS NOT NULL THEN 'acked' WHEN state = 'confirmed' THEN 'critical' ELSE 'major' END AS severity, label, hidden
    FROM lb WHERE contains(CAST(element_id AS VARCHAR), '9')""",
)
def viewer_rows(spark, sf):
    v = _view(spark, sf).filter(F.contains(F.col("element_id").cast("string"), F.lit("9")))
    return v.select("alert_id", ops.severity_class().alias("severity"), ops.plain_label().alias("label"), ops.within_limits(4, 3).alias("hidden"))


@query(
    "viewer_counts",
    with_views(t.ALERTS, VIEW)
    + """SELECT CASE WHEN grouping(camera_id) = 1 THEN 'all' ELSE camera_id END AS camera_id, CASE WHEN grouping(kind) = 1 THEN 'all' ELSE kind END AS kind,
      count(*) FILTER (seen_us IS NULL) AS active, count(seen_us) AS acked FROM lb WHERE NOT hidden GROUP BY ROLLUP (camera_id, kind)""",
)
def viewer_counts(spark, sf):
    return ops.viewer_counts(_view(spark, sf).filter(~ops.within_limits(4, 3)))


@query(
    "label_evaluation",
    """WITH a AS (SELECT event_id AS alert_id, user_id * 6 AS doc_id, epoch_us(ts) AS us,
        CASE event_type WHEN 'error' THEN 'B' WHEN 'view' THEN 'O' ELSE 'C' END AS found FROM events),
      r AS (SELECT * FROM a WHERE us >= (SELECT max(us) FROM a) - 864000000000),
      n AS (SELECT doc_id, arg_max(found, (us, alert_id)) AS found FROM r GROUP BY doc_id),
      l AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'N' WHEN doc_id % 3 = 0 THEN 'C' WHEN doc_id % 3 = 1 THEN 'O' ELSE 'B' END AS label FROM labels JOIN documents USING (doc_id))
    SELECT count(*) AS keys, count(*) FILTER (label IN ('C', 'O', 'B')) AS damaged, count(*) FILTER (label = 'N') AS normal,
      count(*) FILTER (label IS NULL) AS unlabelled, count(*) FILTER (label IN ('C', 'O', 'B') AND (found = 'B') = (label = 'B')
        AND (found IN ('C', 'B')) = (label IN ('C', 'B'))) AS same_type FROM n LEFT JOIN l USING (doc_id)""",
)
def label_evaluation(spark, sf):
    kind = F.col("event_type")
    a = t.table(spark, sf, "events").select(
        F.col("event_id").alias("alert_id"), (F.col("user_id") * 6).alias("doc_id"), t.micros("ts").alias("us"),
        F.when(kind == "error", "B").when(kind == "view", "O").otherwise("C").alias("found"),
    )
    newest = a.agg(F.max("us").alias("newest"))  # one row
    d = F.col("doc_id")
    labels = t.table(spark, sf, "labels").join(t.table(spark, sf, "documents").select("doc_id"), "doc_id").select(
        "doc_id", F.when(F.col("quality") == 1, "N").when(d % 3 == 0, "C").when(d % 3 == 1, "O").otherwise("B").alias("label")
    )
    joined = a.crossJoin(F.broadcast(newest))
    return reports.label_evaluation(joined, labels, "doc_id", "us", F.col("newest") - 864_000_000_000)


DELTA = """snap AS (SELECT camera_id, event_id < (SELECT max(event_id) FROM frames) / 2 AS early, scalar FROM frames),
be AS (SELECT camera_id, count(*) FILTER (early) AS f0, count(*) AS f1, count(*) FILTER (early AND scalar > 50) AS l0, count(*) FILTER (scalar > 50) AS l1,
  sum(CASE WHEN early THEN floor(scalar) ELSE 0 END) AS c0, sum(floor(scalar)) AS c1 FROM snap GROUP BY 1)"""


def _snapshots(spark, sf):
    f = t.frames(spark, sf)
    half = f.agg((F.max("event_id") / 2).alias("half"))  # one row
    f = f.crossJoin(F.broadcast(half))

    def snap(cond):
        one = F.when(cond, 1.0).otherwise(0.0)
        return f.groupBy("camera_id").agg(
            F.create_map(
                F.lit("frames"), F.sum(one), F.lit("lost"), F.sum(F.when(F.col("scalar") > 50, one).otherwise(0.0)),
                F.lit("columns"), F.sum(one * F.floor("scalar")),
            ).alias("counters")
        )

    return snap(F.col("event_id") < F.col("half")), snap(F.lit(True))


@query(
    "counter_delta",
    with_views(t.FRAMES, DELTA)
    + """SELECT camera_id, 'frames' AS name, CAST(f1 - f0 AS DOUBLE) AS delta FROM be UNION ALL SELECT camera_id, 'lost', CAST(l1 - l0 AS DOUBLE) FROM be
    UNION ALL SELECT camera_id, 'columns', CAST(c1 - c0 AS DOUBLE) FROM be""",
)
def counter_delta(spark, sf):
    return reports.counter_delta(*_snapshots(spark, sf), ["camera_id"])


@query(
    "counter_rates",
    with_views(t.FRAMES, DELTA)
    + """SELECT camera_id, round((c1 - c0) / greatest(f1 - f0, 1), 6) AS columns_per_picture,
      round((l1 - l0) / greatest(CAST(f1 - f0 + l1 - l0 AS DOUBLE), 1), 6) AS lost_share FROM be""",
)
def counter_rates(spark, sf):
    out = reports.counter_rates(reports.counter_delta(*_snapshots(spark, sf), ["camera_id"]), ["camera_id"])
    return out.select("camera_id", F.round("columns_per_picture", 6).alias("columns_per_picture"), F.round("lost_share", 6).alias("lost_share"))


@query(
    "minute_rollup",
    with_views(t.FRAMES)
    + """SELECT camera_id, CAST(floor(captured_us / 3600000000) AS BIGINT) AS minute, count(*) AS frames,
      round(avg(CASE WHEN user_id % 3 = 2 AND event_id % 4 = 2 THEN 1.0::DOUBLE ELSE 0 END), 6) AS stopped_share, round(median(scalar), 6) AS median_step,
      round(median(user_id / 150.0::DOUBLE), 6) AS median_quality FROM frames GROUP BY 1, 2""",
)
def minute_rollup(spark, sf):
    f = t.frames(spark, sf).withColumn("quality", F.col("user_id") / 150.0)
    f = f.withColumn("status", F.when((F.col("user_id") % 3 == 2) & (F.col("event_id") % 4 == 2), 2).otherwise(0))
    out = reports.minute_rollup(f, ["camera_id"], "captured_us", "scalar", "quality", "status", 3_600_000_000)
    return out.select("camera_id", "minute", "frames", *[F.round(c, 6).alias(c) for c in ("stopped_share", "median_step", "median_quality")])


@query(
    "golden_comparison",
    """WITH g AS (SELECT event_id AS k, user_id AS i, CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS v FROM events WHERE event_id % 100 <> 3),
      w AS (SELECT event_id AS k, CASE WHEN event_id % 70 = 0 THEN user_id + 1 ELSE user_id END AS i,
        CASE WHEN event_id % 90 = 0 THEN value + 1 ELSE value END AS v FROM events WHERE event_id % 100 <> 7),
      j AS (SELECT g.k AS gk, w.k AS wk, g.k IS NOT NULL AND w.k IS NOT NULL AS both_, g.i IS NOT DISTINCT FROM w.i AS ie,
        (g.v IS NULL AND w.v IS NULL) OR coalesce(abs(g.v - w.v) <= 1e-6, false) AS ve FROM g FULL JOIN w ON g.k = w.k)
    SELECT count(*) FILTER (both_) AS in_both, count(*) FILTER (wk IS NULL) AS extra, count(*) FILTER (gk IS NULL) AS lacking,
      count(*) FILTER (both_ AND NOT ie) AS exact_differs, count(*) FILTER (both_ AND NOT ve) AS close_differs,
      count(*) FILTER (both_ AND ie AND ve) AS equal, count(*) FILTER (NOT (both_ AND ie AND ve) AND coalesce(gk, wk) % 70 <> 0) AS unexplained FROM j""",
)
def golden_comparison(spark, sf):
    e = t.table(spark, sf, "events")
    k = F.col("event_id")
    got = e.filter(k % 100 != 3).select(k.alias("k"), F.col("user_id").alias("i"), F.when(k % 50 != 0, F.col("value")).alias("v"))
    want = e.filter(k % 100 != 7).select(
        k.alias("k"), F.when(k % 70 == 0, F.col("user_id") + 1).otherwise(F.col("user_id")).alias("i"),
        F.when(k % 90 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("v"),
    )
    return reports.golden_comparison(got, want, ["k"], ["i"], ["v"], 1e-6, F.col("k") % 70 == 0)


@query(
    "nearest_alignment",
    """WITH RECURSIVE v AS (SELECT event_id FROM events WHERE event_type = 'view'),
    r AS MATERIALIZED (SELECT event_id AS ref, row_number() OVER (ORDER BY event_id) AS k, event_id - 1 IN (SELECT event_id FROM v) AS lo,
      event_id + 1 IN (SELECT event_id FROM v) AS hi FROM events WHERE event_type = 'error'),
    w AS (SELECT k, ref, CASE WHEN lo THEN ref - 1 WHEN hi THEN ref + 1 END AS target FROM r WHERE k = 1
      UNION ALL
      SELECT r.k, r.ref, CASE WHEN r.lo AND coalesce(w.target, -9) <> r.ref - 1 THEN r.ref - 1 WHEN r.hi THEN r.ref + 1 END
      FROM w JOIN r ON r.k = w.k + 1)
    SELECT ref, target FROM w""",
)
def nearest_alignment(spark, sf):
    e = t.table(spark, sf, "events")
    refs = e.filter("event_type = 'error'").select(F.col("event_id").alias("at"))
    targets = e.filter("event_type = 'view'").select(F.col("event_id").alias("at"))
    return reports.align_nearest(refs, targets, "at")


@query(
    "evidence_resolution",
    with_views(
        t.FRAMES,
        "ret AS (SELECT camera_id, event_id AS frame_id, captured_us FROM frames WHERE event_type = 'view')",
        "lt AS (SELECT camera_id, arg_max(frame_id, captured_us) AS latest FROM ret GROUP BY 1)",
        "ev AS (SELECT camera_id, event_id, event_id + 1 AS wanted FROM frames WHERE event_type = 'error')",
    )
    + """SELECT e.camera_id, e.event_id, coalesce(r.frame_id, l.latest) AS used_frame, CASE WHEN r.frame_id IS NULL THEN 'latest_frame' END AS evidence
    FROM ev e LEFT JOIN ret r ON r.camera_id = e.camera_id AND r.frame_id = e.wanted LEFT JOIN lt l ON l.camera_id = e.camera_id""",
)
def evidence_resolution(spark, sf):
    f = t.frames(spark, sf)
    retained = f.filter("event_type = 'view'").select("camera_id", F.col("event_id").alias("frame_id"), "captured_us")
    events = f.filter("event_type = 'error'").select("camera_id", "event_id", (F.col("event_id") + 1).alias("wanted_frame"))
    return ops.resolve_evidence(events, retained, ["camera_id"]).select("camera_id", "event_id", "used_frame", "evidence")


@query(
    "frame_hand_back",
    "SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE value > 200)",
)
def frame_hand_back(spark, sf):
    e = t.table(spark, sf, "events")
    return ops.hand_back(e.filter("event_type = 'error'").select("user_id"), e.filter("value > 200").select("user_id").distinct(), "user_id")


@query(
    "append_alerts",
    with_views(t.ALERTS) + "SELECT alert_id, nullif(loop_no, 0) AS loop_no, nullif(element_id, 0) AS element_id FROM alerts",
)
def append_alerts(spark, sf):
    return ops.append_alerts(t.alerts(spark, sf)).select("alert_id", "loop_no", "element_id")


@query(
    "keyed_upsert",
    with_views(
        t.ALERTS,
        "st AS (SELECT event_key, min(alert_id) AS alert_id, min(detected_us) AS created_at, arg_min(state, alert_id) AS state, arg_min(amount, alert_id) AS amount, arg_min(seen_us, alert_id) AS seen_at FROM alerts WHERE alert_id % 3 = 0 GROUP BY 1)",
        "ic AS (SELECT event_key, alert_id, detected_us AS created_at, state, amount, seen_us AS seen_at FROM alerts WHERE alert_id % 3 <> 0)",
        "nw AS (SELECT event_key, arg_max(state, alert_id) AS state, arg_max(amount, alert_id) AS amount, min(alert_id) AS alert_id, arg_min(created_at, alert_id) AS created_at FROM ic GROUP BY 1)",
        "fs AS (SELECT event_key, seen_at FROM ic QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY alert_id) = 1)",
        "st2 AS (SELECT event_key, alert_id, created_at, state, amount FROM st)",
        "sse AS (SELECT event_key, seen_us AS seen_at FROM alerts WHERE alert_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY event_key ORDER BY alert_id) = 1)",
    )
    + """SELECT coalesce(s.event_key, n.event_key) AS event_key, coalesce(s.alert_id, n.alert_id) AS alert_id, coalesce(s.created_at, n.created_at) AS created_at,
      coalesce(n.state, s.state) AS state, coalesce(n.amount, s.amount) AS amount, CASE WHEN s.event_key IS NOT NULL THEN sse.seen_at ELSE fs.seen_at END AS seen_at
    FROM st2 s FULL JOIN nw n ON s.event_key = n.event_key LEFT JOIN sse ON sse.event_key = s.event_key LEFT JOIN fs ON fs.event_key = n.event_key""",
)
def keyed_upsert(spark, sf):
    a = t.alerts(spark, sf).select(
        "event_key", "alert_id", F.col("detected_us").alias("created_at"), "state", "amount", F.col("seen_us").alias("seen_at")
    )
    old = a.filter("alert_id % 3 = 0")
    rest = ["alert_id", "state", "amount", "seen_at"]
    stored = old.groupBy("event_key").agg(F.min_by(F.struct(*rest), "alert_id").alias("_r"), F.min("created_at").alias("created_at"))
    stored = stored.select("event_key", "_r.*", "created_at")
    return ops.keyed_upsert(stored, a.filter("alert_id % 3 <> 0"), ["event_key"], ["alert_id"], ops.KEPT_ON_UPDATE)


@query(
    "row_upsert",
    with_views(t.ELEMENT_ROWS, "r AS (SELECT element_id % 40 AS slot, loop, order_key, line, supp_key, price FROM element_rows)")
    + "SELECT loop, slot, max((order_key, line, supp_key, price))[4] AS price FROM r GROUP BY loop, slot",
)
def row_upsert(spark, sf):
    r = t.element_rows(spark, sf).select((F.col("element_id") % 40).alias("slot"), "loop", "order_key", "line", "supp_key", "price")
    order = ["order_key", "line", "supp_key", "price"]
    empty = r.filter(F.lit(False))
    return ops.keyed_upsert(empty, r, ["loop", "slot"], order).select("loop", "slot", "price")


@query(
    "insert_ignore",
    with_views(t.ALERTS)
    + """SELECT DISTINCT kind, element_id, loop_no FROM alerts WHERE alert_id % 2 = 1 AND (kind, element_id, loop_no) NOT IN
      (SELECT (kind, element_id, loop_no) FROM alerts WHERE alert_id % 2 = 0)""",
)
def insert_ignore(spark, sf):
    a = t.alerts(spark, sf)
    return ops.insert_ignore(a.filter("alert_id % 2 = 0"), a.filter("alert_id % 2 = 1"), ["kind", "element_id", "loop_no"])


@query(
    "missing_value_text",
    "SELECT event_id, CASE WHEN event_id % 6 = 0 THEN '__nan__' ELSE 'number' END AS stored, CASE WHEN event_id % 6 <> 0 THEN value END AS restored FROM events",
)
def missing_value_text(spark, sf):
    value = F.when(F.col("event_id") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    e = t.table(spark, sf, "events").withColumn("_text", encode_missing(value))
    return e.select(
        "event_id", F.when(F.col("_text") == "__nan__", F.col("_text")).otherwise("number").alias("stored"),
        decode_missing(F.col("_text")).alias("restored"),
    )
