"""Queries over the loop rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ringsight.operators import rules as ops
from ringsight.plans.registry import query, with_views
from ringsight.session import settle
from ringsight.sources import tables as t

PERSISTENT = """last3 AS (SELECT DISTINCT loop FROM element_rows ORDER BY loop DESC LIMIT 3),
seen3 AS (SELECT * FROM element_rows WHERE loop IN (SELECT loop FROM last3) AND n_views > 0),
pl AS (SELECT element_id, loop, bool_or(short_any) AS s FROM seen3 GROUP BY 1, 2),
pc AS (SELECT element_id, count(*) AS loops_seen, count(*) FILTER (s) AS loops_short FROM pl GROUP BY 1),
pm AS (SELECT element_id, median(lip) AS lip_median, round_even(median(least(fill_left, fill_right)) * 100, 0) / 100 AS fill_median,
   avg(CASE WHEN status_left = 'edge' OR status_right = 'edge' THEN 1.0::DOUBLE ELSE 0 END) >= 0.5 AS near_plate FROM seen3 GROUP BY 1),
persistent AS (SELECT element_id, loops_seen, loops_short, lip_median, fill_median, near_plate, coalesce(fill_median < 0.7, false) AS broken
  FROM pc JOIN pm USING (element_id) WHERE loops_seen >= 2 AND loops_short >= 2)"""
LOOPS = """two AS (SELECT element_id, loop, min(lip) AS lip, bool_or(short_both) AS both_, min(straight_left) AS sl, min(straight_right) AS sr
  FROM element_rows WHERE n_views = 2 GROUP BY 1, 2),
ranks AS (SELECT loop, row_number() OVER (ORDER BY loop) AS rk FROM (SELECT DISTINCT loop FROM two)),
ranked AS (SELECT two.*, rk FROM two JOIN ranks USING (loop)),
based AS (SELECT *, quantile_cont(lip, 0.5) OVER h AS base, count(lip) OVER h AS known, quantile_cont(sl, 0.5) OVER h AS bl,
    quantile_cont(sr, 0.5) OVER h AS br, count(sl) OVER h AS kl,
    max(lip) OVER n AS nlip, max(sl) OVER n AS nl, max(sr) OVER n AS nr FROM ranked
  WINDOW h AS (PARTITION BY element_id ORDER BY rk RANGE BETWEEN 3 PRECEDING AND 1 PRECEDING),
         n AS (PARTITION BY element_id ORDER BY loop RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING))"""
DROPS = """drops AS (SELECT element_id, loop, base AS lip_before, lip AS lip_now, base - lip AS drop,
    CASE WHEN nlip IS NULL THEN 'pending' WHEN nlip <= base - 25 THEN 'confirmed' ELSE 'not confirmed' END AS status
  FROM based WHERE known >= 2 AND lip <= base - 25 AND both_ AND element_id NOT IN (SELECT element_id FROM persistent WHERE near_plate))"""
SPLAYS = """splays AS (SELECT element_id, loop, round_even((bl + br) / 2 * 100, 0) / 100 AS s_before, round_even((sl + sr) / 2 * 100, 0) / 100 AS s_now,
    round_even(least(sl - bl, sr - br) * 100, 0) / 100 AS rise,
    CASE WHEN nl IS NULL OR nr IS NULL THEN 'pending' WHEN nl >= bl + 1 AND nr >= br + 1 THEN 'confirmed' ELSE 'not confirmed' END AS status
  FROM based WHERE kl >= 2 AND sl >= bl + 1 AND sr >= br + 1 AND element_id NOT IN (SELECT element_id FROM persistent WHERE near_plate))"""


def _persistent(spark, sf):
    return settle(ops.persistent_list(t.element_rows(spark, sf)))


def _drops(spark, sf):
    return ops.new_drop_alerts(t.element_rows(spark, sf), ops.near_plate_ids(_persistent(spark, sf)))


def _splays(spark, sf):
    return ops.splay_alerts(t.element_rows(spark, sf), ops.near_plate_ids(_persistent(spark, sf)))


@query("persistent_list", with_views(t.ELEMENT_ROWS, PERSISTENT) + "SELECT * FROM persistent")
def persistent_list(spark, sf):
    return ops.persistent_list(t.element_rows(spark, sf))


@query(
    "persistent_list_finished",
    with_views(
        t.ELEMENT_ROWS.replace("element_rows AS (", "all_rows AS (", 1),
        """st AS (SELECT loop, n, sum(n) OVER (ORDER BY loop) - n AS start FROM (SELECT loop, count(*) AS n FROM all_rows GROUP BY loop)),
        done AS (SELECT max(loop) AS frontier FROM (SELECT *, lead(start) OVER (ORDER BY loop) AS nx FROM st) WHERE n >= nx - start),
        element_rows AS (SELECT * EXCLUDE (frontier) FROM all_rows, done WHERE loop <= frontier)""",
        PERSISTENT,
    )
    + "SELECT * FROM persistent",
)
def persistent_list_finished(spark, sf):
    rows = t.element_rows(spark, sf)
    sizes = rows.groupBy("loop").agg(F.count("*").alias("n"))  # one row per loop
    starts = sizes.select("loop", (F.sum("n").over(Window.orderBy("loop")) - F.col("n")).alias("start"))
    return ops.persistent_list(ops.finished_rows(rows, ops.completed_loops(rows, starts)))


@query("new_drop_alerts", with_views(t.ELEMENT_ROWS, PERSISTENT, LOOPS, DROPS) + "SELECT * FROM drops")
def new_drop_alerts(spark, sf):
    return _drops(spark, sf)


@query("splay_alerts", with_views(t.ELEMENT_ROWS, PERSISTENT, LOOPS, SPLAYS) + "SELECT * FROM splays")
def splay_alerts(spark, sf):
    return _splays(spark, sf)


@query(
    "nonparallel_list",
    with_views(
        t.ELEMENT_ROWS,
        PERSISTENT,
        """np AS (SELECT element_id, count(*) AS loops, median(slope_left - 0.005) AS dl, median(slope_right - 0.005) AS dr,
            median(lip) AS lip FROM element_rows
          WHERE n_views = 2 AND element_id NOT IN (SELECT element_id FROM persistent WHERE near_plate) GROUP BY 1 HAVING count(*) >= 3)""",
    )
    + """SELECT element_id, loops, round_even(dl * 10000, 0) / 10000 AS dev_left, round_even(dr * 10000, 0) / 10000 AS dev_right,
      round_even(lip, 0) AS lip_median FROM np WHERE abs(dl) >= 0.0123 AND abs(dr) >= 0.0123""",
)
def nonparallel_list(spark, sf):
    near = ops.near_plate_ids(_persistent(spark, sf))
    return ops.nonparallel_list(t.element_rows(spark, sf), 0.005, 0.005, near, 0.0123, 0.0123)


@query(
    "loop_completion",
    """WITH starts AS (SELECT event_id AS start, row_number() OVER (ORDER BY event_id) - 1 AS loop FROM events WHERE value > 240),
    slots AS (SELECT e.event_id, s.loop FROM events e ASOF JOIN starts s ON e.event_id >= s.start WHERE e.value >= 0.2),
    n AS (SELECT loop, count(*) AS n FROM slots GROUP BY loop)
    SELECT s.loop, s.start, coalesce(n.n, 0) AS rows_seen,
      coalesce(lead(s.start) OVER (ORDER BY s.loop) IS NOT NULL AND n.n >= lead(s.start) OVER (ORDER BY s.loop) - s.start, false) AS complete
    FROM starts s LEFT JOIN n USING (loop)""",
)
def loop_completion(spark, sf):
    from ringsight.operators.alignment import assign_loops
    from ringsight.operators.ordered import Lane, with_ordinal

    e = t.table(spark, sf, "events")
    starts = with_ordinal(e.filter("value > 240").select(F.col("event_id").alias("start")), Lane((), "start"), "loop")
    slots = e.filter("value >= 0.2").select(F.col("event_id").alias("slot"))
    rows = assign_loops(slots, starts, [], "slot", "start", 1000).filter(F.col("loop").isNotNull())
    return ops.completed_loops(rows, starts)


@query(
    "emit_once",
    with_views(t.ALERTS)
    + """SELECT kind, element_id, loop_no, min(alert_id) AS alert_id, arg_min(state, alert_id) AS state FROM alerts
    GROUP BY 1, 2, 3""",
)
def emit_once(spark, sf):
    a = t.alerts(spark, sf).select("kind", "element_id", "loop_no", "alert_id", "state")
    return ops.emit_once(a, ["kind", "element_id", "loop_no"], ["alert_id"])


@query(
    "template_lost",
    with_views(
        t.FRAMES,
        "l AS (SELECT * FROM frames QUALIFY row_number() OVER (PARTITION BY camera_id ORDER BY event_id DESC) <= 200)",
    )
    + """SELECT camera_id, round(median(scalar / 60), 6) AS median_peak, count(*) >= 50 AND median(scalar / 60) < 0.5 AS template_lost
    FROM l GROUP BY camera_id""",
)
def template_lost(spark, sf):
    f = t.frames(spark, sf).select("camera_id", "event_id", (F.col("scalar") / 60).alias("peak"))
    out = ops.template_lost(f, ["camera_id"], "event_id", "peak")
    return out.withColumn("median_peak", F.round("median_peak", 6))


@query(
    "trigger_lost",
    """WITH m AS (SELECT user_id, max(epoch_us(ts)) AS hi, min(epoch_us(ts)) AS lo FROM events GROUP BY 1)
    SELECT user_id, count(*) FILTER (hi - epoch_us(ts) < 86400000000) AS recent_captures,
      any_value(hi - lo >= 172800000000) AND count(*) FILTER (hi - epoch_us(ts) < 86400000000) < 3 AS trigger_lost
    FROM events JOIN m USING (user_id) GROUP BY user_id""",
)
def trigger_lost(spark, sf):
    e = t.table(spark, sf, "events").select("user_id", t.micros("ts").alias("at_us"))
    return ops.trigger_lost(e, ["user_id"], "at_us", 172_800_000_000, 86_400_000_000, 3)


@query(
    "population_change",
    with_views(t.ELEMENT_ROWS, LOOPS)
    + """SELECT loop, count(*) FILTER (base IS NOT NULL) AS covered, count(*) FILTER (lip <= base - 25) AS dropped,
      count(*) FILTER (base IS NOT NULL) > 0 AND count(*) FILTER (lip <= base - 25) / count(*) FILTER (base IS NOT NULL) > 0.05 AS alarm
    FROM based WHERE rk > 1 GROUP BY loop""",
)
def population_change(spark, sf):
    return ops.population_change(t.element_rows(spark, sf))


CURRENT = """marks AS (SELECT element_id, status FROM drops WHERE status IN ('confirmed', 'pending')
  UNION ALL SELECT element_id, status FROM splays WHERE status IN ('confirmed', 'pending')
  UNION ALL SELECT element_id, 'persistent' FROM persistent),
current_states AS (SELECT element_id, CASE min(CASE status WHEN 'confirmed' THEN 1 WHEN 'pending' THEN 2 ELSE 3 END)
  WHEN 1 THEN 'confirmed' WHEN 2 THEN 'pending' ELSE 'persistent' END AS state FROM marks GROUP BY 1)"""


@query(
    "current_states",
    with_views(t.ELEMENT_ROWS, PERSISTENT, LOOPS, DROPS, SPLAYS, CURRENT) + "SELECT * FROM current_states",
)
def current_states(spark, sf):
    rows, persistent = t.element_rows(spark, sf), _persistent(spark, sf)
    near = ops.near_plate_ids(persistent)
    return ops.current_states(ops.new_drop_alerts(rows, near), ops.splay_alerts(rows, near), persistent)


@query(
    "latest_element_rows",
    with_views(
        t.ELEMENT_ROWS,
        "m AS (SELECT element_id, loop, avg(lip) AS lip FROM element_rows GROUP BY 1, 2)",
        "r AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY loop DESC) <= 3)",
        """h AS (SELECT element_id, string_agg(CAST(CAST(round(lip * 1000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY loop) AS lip_history
            FROM r GROUP BY 1)""",
        """n AS (SELECT element_id, max((loop, order_key, line, supp_key, price)) AS k FROM element_rows GROUP BY 1)""",
    )
    + "SELECT n.element_id, k[1] AS loop, k[2] AS order_key, k[5] AS price, lip_history FROM n JOIN h USING (element_id)",
)
def latest_element_rows(spark, sf):
    rows = t.element_rows(spark, sf).select("element_id", "loop", "order_key", "line", "supp_key", "price", "lip")
    out = ops.latest_rows(rows, ["loop", "order_key", "line", "supp_key", "price"])
    text = F.array_join(F.transform("lip_history", lambda v: F.round(v * 1000).cast("bigint").cast("string")), ",")
    return out.select("element_id", "loop", "order_key", "price", text.alias("lip_history"))


@query(
    "evidence_feed",
    with_views(t.ELEMENT_ROWS, PERSISTENT, LOOPS, DROPS)
    + """SELECT d.element_id, d.loop, d.status, (SELECT max(e.order_key) FROM element_rows e WHERE e.element_id = d.element_id
      AND e.loop = d.loop AND e.line % 2 = 0) AS evidence_frame FROM drops d WHERE d.status <> 'not confirmed'""",
)
def evidence_feed(spark, sf):
    events = _drops(spark, sf).filter("status <> 'not confirmed'").select("element_id", "loop", "status")
    rows = t.element_rows(spark, sf).withColumn("frame", F.when(F.col("line") % 2 == 0, F.col("order_key")))
    return ops.evidence_feed(events, rows, "frame", "order_key")


@query(
    "requested_elements",
    with_views(t.ELEMENT_ROWS, PERSISTENT)
    + "SELECT element_id, loops_short, lip_median FROM persistent WHERE element_id IN (SELECT p_partkey FROM part WHERE p_size < 20)",
)
def requested_elements(spark, sf):
    wanted = t.table(spark, sf, "part").filter("p_size < 20").select(F.col("p_partkey").alias("element_id"))
    return ops.requested_only(_persistent(spark, sf), wanted).select("element_id", "loops_short", "lip_median")


FLAGS = """flags AS (SELECT user_id, count(*) FILTER (event_type = 'error') % 7 = 0 AS chain_changed,
    count(*) FILTER (event_type = 'view') % 5 = 0 AS resyncing, count(*) % 4 <> 0 AS locked,
    CASE WHEN avg(value) < 45 THEN 'TEMPLATE LOST' END AS template_line, CASE WHEN max(value) > 300 THEN 'LOOP DRIFT' END AS drift_line,
    CASE WHEN min(value) > 1.5 THEN 'TRIGGER LOST' END AS trigger_line, CASE WHEN avg(value) > 55 THEN 'POPULATION CHANGE' END AS population_line
  FROM events GROUP BY user_id),
joined AS (SELECT *, concat_ws('; ', template_line, drift_line, trigger_line, population_line) AS line_text FROM flags)"""


def _flags(spark, sf):
    kind = F.col("event_type")
    return t.table(spark, sf, "events").groupBy("user_id").agg(
        (F.count(F.when(kind == "error", 1)) % 7 == 0).alias("chain_changed"),
        (F.count(F.when(kind == "view", 1)) % 5 == 0).alias("resyncing"),
        (F.count(F.lit(1)) % 4 != 0).alias("locked"),
        F.when(F.avg("value") < 45, "TEMPLATE LOST").alias("template_line"),
        F.when(F.max("value") > 300, "LOOP DRIFT").alias("drift_line"),
        F.when(F.min("value") > 1.5, "TRIGGER LOST").alias("trigger_line"),
        F.when(F.avg("value") > 55, "POPULATION CHANGE").alias("population_line"),
    )


@query(
    "trigger_lane_status",
    with_views(FLAGS)
    + """SELECT user_id, CASE WHEN chain_changed OR resyncing THEN 'resyncing' WHEN template_line IS NOT NULL THEN 'template_lost'
      WHEN NOT locked THEN 'not_ready' WHEN trigger_line IS NOT NULL THEN 'trigger_lost'
      WHEN population_line IS NOT NULL THEN 'population_alarm' ELSE 'ok' END AS status,
      CASE WHEN chain_changed THEN 'chain order changed: rebuild master (runbook)' || CASE WHEN line_text = '' THEN '' ELSE '; ' || line_text END
      WHEN resyncing THEN 'loop re-alignment in progress' WHEN template_line IS NULL AND NOT locked
      THEN 'collecting first loop+300 slots for alignment' WHEN line_text = '' THEN 'all clear' ELSE line_text END AS detail FROM joined""",
)
def trigger_lane_status(spark, sf):
    status, detail = ops.trigger_lane_status()
    return _flags(spark, sf).select("user_id", status.alias("status"), detail.alias("detail"))


@query(
    "side_lane_status",
    """WITH f AS (SELECT user_id, avg(value) < 42 AS view_lost, count(*) % 4 <> 0 AS locked, count(*) % 3 = 0 AS resyncing,
      count(*) % 8 = 0 AS ever_locked, count(*) >= 60 AS history_ready, 250 + count(*) AS elements, avg(value) / 300 AS share,
      CASE WHEN count(*) > 55 THEN avg(value) / 2 END AS rate, CASE WHEN count(*) > 55 THEN max(value) / 1200 END AS repeated,
      min(value) > 0.8 AS stopped, avg(value) / 90 AS empty_share, count(*) AS passes FROM events GROUP BY user_id),
    g AS (SELECT *, NOT locked AND (resyncing OR ever_locked) AS relock, history_ready AND elements >= 300 AND share > 0.15 AS populated,
      rate IS NOT NULL AND (coalesce(repeated > 0.2, false) OR rate < 20) AS losing FROM f)
    SELECT user_id, CASE WHEN view_lost THEN 'template_lost' WHEN relock THEN 'resyncing' WHEN NOT locked THEN 'not_ready'
      WHEN populated THEN 'population_alarm' ELSE 'ok' END AS status,
      coalesce(nullif(concat_ws('; ', CASE WHEN view_lost THEN 'view lost' WHEN relock THEN 'lost the chain map: re-locking'
        WHEN NOT locked THEN 'locking onto the chain map' WHEN populated THEN 'too many elements confirmed' END,
        CASE WHEN losing THEN 'camera stream losing frames' END,
        CASE WHEN stopped AND NOT coalesce(repeated > 0.2, false) THEN 'conveyor stopped' END,
        CASE WHEN empty_share > 0.5 THEN 'conveyor empty: plates not judged' END,
        CASE WHEN NOT history_ready THEN 'history building: ' || passes || ' of 300 needed' END), ''), 'all clear') AS detail FROM g""",
)
def side_lane_status(spark, sf):
    n = F.count(F.lit(1))
    v = F.col("value")
    lanes = t.table(spark, sf, "events").groupBy("user_id").agg(
        (F.avg(v) < 42).alias("view_lost"), (n % 4 != 0).alias("locked"), (n % 3 == 0).alias("resyncing"),
        (n % 8 == 0).alias("ever_locked"), (n >= 60).alias("history_ready"), (n + 250).alias("elements"),
        (F.avg(v) / 300).alias("confirmed_share"), F.when(n > 55, F.avg(v) / 2).alias("rate"),
        F.when(n > 55, F.max(v) / 1200).alias("repeated_share"), (F.min(v) > 0.8).alias("stopped"),
        (F.avg(v) / 90).alias("empty_share"), n.alias("passes"),
    )
    status, detail = ops.side_lane_status()
    return lanes.select("user_id", status.alias("status"), detail.alias("detail"))


@query(
    "state_validation",
    """SELECT event_id, concat_ws(',', CASE WHEN user_id % 50 = 0 THEN 'element_id' END,
      CASE WHEN event_type = 'purchase' THEN 'state' END, CASE WHEN event_id % 23 = 0 THEN 'lip' END,
      CASE WHEN event_id % 31 = 0 THEN 'severity' END, CASE WHEN event_id % 41 = 0 THEN 'health' END) AS violations FROM events""",
)
def state_validation(spark, sf):
    kind = F.col("event_type")
    state = (
        F.when(kind == "error", "confirmed").when(kind == "view", "pending").when(kind == "click", "suspect")
        .when(kind == "signup", "healthy").otherwise("broken")
    )
    rows = t.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 50).alias("element_id"), state.alias("state"),
        F.when(F.col("event_id") % 23 == 0, F.lit(float("nan"))).otherwise(F.col("value")).alias("lip"),
        F.when(F.col("event_id") % 31 == 0, F.lit(float("inf"))).otherwise(F.col("value")).alias("severity"),
        (F.col("event_id") % 41 != 0).alias("has_health"),
    )
    return rows.select("event_id", F.array_join(ops.state_violations(), ",").alias("violations"))


@query(
    "final_recompute",
    with_views(
        t.ELEMENT_ROWS, PERSISTENT, LOOPS, DROPS, SPLAYS,
        """ev AS (SELECT 'damage' AS kind, element_id, loop, status FROM drops WHERE status <> 'not confirmed'
            UNION ALL SELECT 'splay', element_id, loop, status FROM splays WHERE status <> 'not confirmed')""",
    )
    + "SELECT kind, element_id, loop, min(status) AS state FROM ev GROUP BY 1, 2, 3",
)
def final_recompute(spark, sf):
    """End of stream: every list from the whole table, every event once."""
    rows, near = t.element_rows(spark, sf), ops.near_plate_ids(_persistent(spark, sf))
    drops = ops.new_drop_alerts(rows, near).select(F.lit("damage").alias("kind"), "element_id", "loop", F.col("status").alias("state"))
    splays = ops.splay_alerts(rows, near).select(F.lit("splay").alias("kind"), "element_id", "loop", F.col("status").alias("state"))
    events = drops.unionByName(splays).filter("state <> 'not confirmed'")
    return ops.emit_once(events, ["kind", "element_id", "loop"], ["state"])
