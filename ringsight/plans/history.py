"""Queries over element history, plates and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.operators import history as ops
from ringsight.operators.ordered import Lane
from ringsight.plans.registry import query, with_views
from ringsight.sources import tables as t

PASSES = Lane((), "pass_no")
BY_ELEMENT = Lane(("element_id",), "pass_no")
ALARM, PASS_ALARM = 0.5, 1.65

SCORED = """pop AS (SELECT *, quantile_cont(raw, 0.5) OVER w AS mid, quantile_cont(raw, 0.9) OVER w AS high FROM passes
  WINDOW w AS (ORDER BY pass_no ROWS BETWEEN 1209 PRECEDING AND CURRENT ROW)),
opening AS (SELECT mid AS mid0, high AS high0 FROM pop WHERE pass_no = 299),
scored AS (SELECT element_id, pass_no, loop, raw, event_type,
    (raw - CASE WHEN pass_no < 299 THEN mid0 ELSE mid END) / greatest(CASE WHEN pass_no < 299 THEN high0 - mid0 ELSE high - mid END, 1e-3) AS rel
  FROM pop, opening)"""
STATES = """hist AS (SELECT *, count(*) OVER h AS n_passes, quantile_cont(rel, 0.5) OVER h AS typical FROM scored
  WINDOW h AS (PARTITION BY element_id ORDER BY pass_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
states AS (SELECT *, CASE WHEN n_passes >= 2 AND typical >= 0.5 THEN 'confirmed' WHEN rel >= 1.65 THEN 'suspect'
  ELSE 'healthy' END AS state FROM hist)"""
CHANGES = """prev AS (SELECT *, lag(state) OVER (PARTITION BY element_id ORDER BY pass_no) AS before FROM states),
changes AS (SELECT *, state = 'confirmed' AND coalesce(before, '') <> 'confirmed' AS entered FROM prev),
started AS (SELECT *, CASE WHEN state = 'confirmed' THEN last_value(CASE WHEN entered THEN loop END IGNORE NULLS)
  OVER (PARTITION BY element_id ORDER BY pass_no) END AS confirmed_loop FROM changes)"""


def _scored(spark, sf):
    return ops.population_scores(t.passes(spark, sf), PASSES, "raw")


def _states(spark, sf, lists=False):
    return ops.history_states(_scored(spark, sf), BY_ELEMENT, "rel", ALARM, PASS_ALARM, lists)


@query("population_score", with_views(t.PASSES, SCORED) + "SELECT element_id, pass_no, round(rel, 6) AS rel FROM scored")
def population_score(spark, sf):
    return _scored(spark, sf).select("element_id", "pass_no", F.round("rel", 6).alias("rel"))


@query(
    "history_state",
    with_views(t.PASSES, SCORED, STATES)
    + "SELECT element_id, pass_no, CAST(n_passes AS INTEGER) AS n_passes, round(typical, 6) AS typical, state FROM states",
)
def history_state(spark, sf):
    out = _states(spark, sf)
    return out.select("element_id", "pass_no", "n_passes", F.round("typical_rel", 6).alias("typical"), "state")


@query(
    "confirmation_events",
    with_views(t.PASSES, SCORED, STATES, CHANGES)
    + """SELECT element_id, loop, min(pass_no) AS pass_no, round(arg_min(typical, pass_no), 6) AS severity FROM changes
    WHERE entered GROUP BY element_id, loop""",
)
def confirmation_events(spark, sf):
    out = ops.confirmation_events(_states(spark, sf), ["element_id"], "loop", "pass_no")
    return out.select("element_id", "loop", "pass_no", F.round("typical_rel", 6).alias("severity"))


@query(
    "confirmed_loop",
    with_views(t.PASSES, SCORED, STATES, CHANGES) + "SELECT element_id, pass_no, confirmed_loop FROM started",
)
def confirmed_loop(spark, sf):
    out = ops.confirmed_since(_states(spark, sf), BY_ELEMENT, "loop")
    return out.select("element_id", "pass_no", "confirmed_loop")


@query(
    "evidence_choice",
    with_views(
        t.PASSES,
        SCORED,
        "framed AS (SELECT *, CASE WHEN event_type <> 'error' THEN pass_no END AS frame FROM scored)",
        """picked AS (SELECT element_id, pass_no,
            last_value(CASE WHEN rel >= 1.65 THEN frame END IGNORE NULLS) OVER w AS strong,
            arg_max(frame, (rel, pass_no)) FILTER (frame IS NOT NULL) OVER w AS best FROM framed
            WINDOW w AS (PARTITION BY element_id ORDER BY pass_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    )
    + "SELECT element_id, pass_no, coalesce(strong, best) AS evidence FROM picked",
)
def evidence_choice(spark, sf):
    framed = _scored(spark, sf).withColumn("frame", F.when(F.col("event_type") != "error", F.col("pass_no")))
    out = ops.chosen_evidence(framed, BY_ELEMENT, "rel", "frame", PASS_ALARM)
    return out.select("element_id", "pass_no", "evidence")


LATEST = "latest AS (SELECT * FROM states QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY pass_no DESC) = 1)"


@query(
    "confirmed_share",
    with_views(t.PASSES, SCORED, STATES, LATEST)
    + """SELECT round(coalesce(avg((state = 'confirmed')::INT::DOUBLE) FILTER (n_passes >= 2), 0), 6) AS confirmed_share,
      count(*) FILTER (n_passes >= 2) AS elements FROM latest""",
)
def confirmed_share(spark, sf):
    out = ops.confirmed_share(ops.latest_per_element(_states(spark, sf), ["element_id"], "pass_no"))
    return out.select(F.round("confirmed_share", 6).alias("confirmed_share"), "elements")


@query(
    "severity_history",
    with_views(t.PASSES, SCORED)
    + """SELECT element_id, string_agg(CAST(CAST(round(rel * 10000, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY pass_no) AS history FROM (
      SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY element_id ORDER BY pass_no DESC) <= 8)
    GROUP BY element_id""",
)
def severity_history(spark, sf):
    latest = ops.latest_per_element(_states(spark, sf, lists=True), ["element_id"], "pass_no")
    text = F.transform("history_rel", lambda v: F.round(v * 10000).cast("bigint").cast("string"))
    return latest.select("element_id", F.array_join(text, ",").alias("history"))


MU, SD, WEIGHT, BIAS, THRESHOLD = [0.1, -0.2, 0.3, 0.5], [1.5, 1.2, 1.1, 0.9], [0.8, 0.5, 0.4, 0.6], -0.4, 0.55

PLATES = """probs AS (SELECT element_id, pass_no, loop, raw, raw / (raw + 20) AS p1, (element_id % 20 + 1) / 22.0::DOUBLE AS p2,
    (pass_no % 17 + 1) / 19.0::DOUBLE AS p3,
    quantile_cont(raw, 0.5) OVER w AS mid, quantile_cont(raw, 0.9) OVER w AS high, count(*) OVER w AS n FROM passes
  WINDOW w AS (ORDER BY pass_no ROWS BETWEEN 1499 PRECEDING AND CURRENT ROW)),
valley AS (SELECT *, (raw - CASE WHEN n >= 200 THEN mid ELSE 0 END) /
    greatest(CASE WHEN n >= 200 THEN high - mid ELSE 1 END, 1e-6) AS v FROM probs),
med AS (SELECT element_id, pass_no, count(*) OVER h AS k, quantile_cont(p1, 0.5) OVER h AS m1, quantile_cont(p2, 0.5) OVER h AS m2,
    quantile_cont(p3, 0.5) OVER h AS m3, quantile_cont(v, 0.5) OVER h AS mv FROM valley
  WINDOW h AS (PARTITION BY element_id ORDER BY pass_no ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)),
clipped AS (SELECT *, least(greatest(m1, 0.0001), 0.9999) AS c1, least(greatest(m2, 0.0001), 0.9999) AS c2,
    least(greatest(m3, 0.0001), 0.9999) AS c3 FROM med),
stacked AS (SELECT *, 1 / (1 + exp(-(-0.4 + (ln(c1 / (1 - c1)) - 0.1) / 1.5 * 0.8 + (ln(c2 / (1 - c2)) + 0.2) / 1.2 * 0.5
    + (ln(c3 / (1 - c3)) - 0.3) / 1.1 * 0.4 + (mv - 0.5) / 0.9 * 0.6))) AS score FROM clipped)"""


def _stacked(spark, sf):
    raw = F.col("raw")
    probs = t.passes(spark, sf).withColumns(
        {
            "p1": raw / (raw + 20),
            "p2": (F.col("element_id") % 20 + 1) / 22.0,
            "p3": (F.col("pass_no") % 17 + 1) / 19.0,
        }
    )
    valley = ops.guarded_scores(probs, PASSES, "raw")
    med = ops.recent_history(valley, BY_ELEMENT, "p1", "p2", "p3", "rel")
    parts = [F.col(f"typical_{c}") for c in ("p1", "p2", "p3", "rel")]
    return med.withColumn("score", ops.stacked_score(parts, MU, SD, WEIGHT, BIAS))


@query(
    "valley_relative",
    with_views(t.PASSES, PLATES) + "SELECT element_id, pass_no, round(v, 6) AS rel FROM valley",
)
def valley_relative(spark, sf):
    return ops.guarded_scores(t.passes(spark, sf), PASSES, "raw").select("element_id", "pass_no", F.round("rel", 6).alias("rel"))


@query(
    "stacked_plate_score",
    with_views(t.PASSES, PLATES) + "SELECT element_id, pass_no, round(score, 6) AS score FROM stacked",
)
def stacked_plate_score(spark, sf):
    return _stacked(spark, sf).select("element_id", "pass_no", F.round("score", 6).alias("score"))


@query(
    "hysteresis_state",
    with_views(
        t.PASSES,
        PLATES,
        """marks AS (SELECT *, CASE WHEN k >= 2 AND score >= 0.55 THEN 1 WHEN k >= 4 AND score < 0.275 THEN 0 END AS mark FROM stacked)""",
    )
    + """SELECT element_id, pass_no, CASE WHEN coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY element_id
      ORDER BY pass_no), 0) = 1 THEN 'confirmed' ELSE 'healthy' END AS state FROM marks""",
)
def hysteresis_state(spark, sf):
    out = ops.hysteresis(_stacked(spark, sf), BY_ELEMENT, "score", "n_passes", THRESHOLD)
    return out.select("element_id", "pass_no", "state")


@query(
    "damage_type",
    with_views(t.PASSES, PLATES)
    + """SELECT element_id, pass_no, CASE WHEN m2 >= 0.5 AND m3 >= 0.5 THEN 'cut + out of line' WHEN m2 >= 0.5 THEN 'cut'
      WHEN m3 >= 0.5 THEN 'out of line' WHEN m2 > m3 THEN 'cut' ELSE 'out of line' END AS damage_type FROM med""",
)
def damage_type(spark, sf):
    out = _stacked(spark, sf)
    kind = ops.damage_type(F.col("typical_p2"), F.col("typical_p3"))
    return out.select("element_id", "pass_no", kind.alias("damage_type"))


@query("joint_chain")
def joint_chain(spark, sf):
    """A strip with a joint every 19 columns or so, buried in the signal; in blocks of 2,000 columns."""
    s = t.signal(spark, sf)
    peak = F.when(F.col("col") % 19 == 3, 60.0).otherwise(0.0)
    strip = s.select("col", (F.col("x") / 4 + peak).alias("strength"))
    dp = {"lo": 15, "hi": 23, "step": 19.0, "lam": 0.05, "skip_cost": 4.0, "seed": 40}
    return ops.strip_joints(strip, Lane((), "col", (), 2000), "strength", dp)


PLATE_IDS = """ids AS (SELECT event_id AS plate, CAST(floor(event_id / 3000) AS BIGINT) AS loop,
  (CAST(floor((event_id % 3000) * 0.9::DOUBLE) AS BIGINT)) % 500 AS element FROM events),
pv AS (SELECT *, lag(element) OVER w AS pe, lag(loop) OVER w AS pl FROM ids WINDOW w AS (ORDER BY plate)),
fl AS (SELECT *, coalesce(pl = loop AND pe = element, false) AS rep, coalesce(pl = loop AND (pe + 1) % 500 = element, false) AS fol FROM pv),
seg AS (SELECT *, sum(CASE WHEN rep OR fol THEN 0 ELSE 1 END) OVER (ORDER BY plate) AS s FROM fl),
num AS (SELECT plate, loop, element, sum(CASE WHEN rep THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY plate) AS flips FROM seg)"""


@query("plate_numbers", with_views(PLATE_IDS) + "SELECT plate, loop, CAST((element + flips % 2) % 500 AS BIGINT) AS numbered FROM num")
def plate_numbers(spark, sf):
    e = t.table(spark, sf, "events")
    ids = e.select(
        F.col("event_id").alias("plate"),
        F.floor(F.col("event_id") / 3000).alias("loop"),
        (F.floor((F.col("event_id") % 3000) * F.lit(0.9)) % 500).alias("element"),
    )
    return ops.plate_numbers(ids, Lane((), "plate"), "element", "loop", 500).select("plate", "loop", "numbered")


@query(
    "plates_fully_seen",
    with_views(
        t.SIGNAL,
        "plates AS (SELECT min(col) AS lo, min(col) + 15 AS hi FROM signal GROUP BY col // 20)",
        "gone AS (SELECT col FROM signal WHERE user_id < 5)",
    )
    + "SELECT lo, hi FROM plates WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.col >= lo AND gone.col < hi)",
)
def plates_fully_seen(spark, sf):
    s = t.signal(spark, sf)
    plates = s.groupBy(F.floor(F.col("col") / 20)).agg(F.min("col").alias("lo")).select("lo", (F.col("lo") + 15).alias("hi"))
    return ops.fully_seen(plates, s.filter("user_id < 5").select("col"), [], "lo", "hi", "col", 64)


@query("valley_score")
def valley_score(spark, sf):
    """Every profile as an 8 x 8 patch, three times as high so that lines have room."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(23)), lambda r: F.transform(
        F.slice("profile", (r % 8) * 8 + 1, 8), lambda v: v * 100 + 100))
    return t.profiles(spark, sf).select("vec_id", F.round(ops.valley_scores(rows), 6).alias("valley"))


@query(
    "ensemble_mean",
    with_views(t.PROFILES)
    + "SELECT vec_id, round(list_avg(list_transform(profile, lambda v: 1 / (1 + exp(-v)))), 6) AS probability FROM profiles",
)
def ensemble_mean(spark, sf):
    p = ops.ensemble_mean(F.col("profile"))
    return t.profiles(spark, sf).select("vec_id", F.round(p, 6).alias("probability"))


@query(
    "capped_keep_list",
    with_views(
        t.PASSES,
        SCORED,
        STATES,
        LATEST,
        "k AS (SELECT count(*) FILTER (state = 'confirmed') AS fixed FROM latest)",
        "o AS (SELECT *, row_number() OVER (ORDER BY rel DESC, element_id DESC) AS rk FROM latest WHERE state <> 'confirmed')",
    )
    + """SELECT element_id, state FROM latest WHERE state = 'confirmed'
    UNION ALL SELECT element_id, state FROM o, k WHERE rk <= 60 - fixed""",
)
def capped_keep_list(spark, sf):
    latest = ops.latest_per_element(_states(spark, sf), ["element_id"], "pass_no").select("element_id", "state", "rel")
    return ops.capped_keep(latest, "state", "rel", "element_id", 60).select("element_id", "state")


NEAR = """tg AS (SELECT camera_id, event_id * 3 AS pos FROM frames WHERE event_type = 'error'),
close AS (SELECT camera_id, event_id * 3 + 1 AS pos, event_id AS frame FROM frames WHERE event_type = 'view' AND scalar > 120),
far AS (SELECT camera_id, event_id * 3 + 1 AS pos, event_id AS frame FROM frames)"""


def _nearest_sql(name, side, reach):
    return f"""{name} AS (SELECT b.camera_id, b.pos,
      CASE WHEN a_at IS NULL OR (b_at IS NOT NULL AND b.pos - b_at <= a_at - b.pos)
        THEN CASE WHEN b.pos - b_at <= {reach} THEN b_frame END
        ELSE CASE WHEN a_at - b.pos <= {reach} THEN a_frame END END AS frame FROM (
      SELECT t.camera_id, t.pos, x.pos AS b_at, x.frame AS b_frame, y.pos AS a_at, y.frame AS a_frame FROM tg t
      ASOF LEFT JOIN {side} x ON t.camera_id = x.camera_id AND t.pos >= x.pos
      ASOF LEFT JOIN {side} y ON t.camera_id = y.camera_id AND t.pos < y.pos) b)"""


@query(
    "nearest_frame",
    with_views(t.FRAMES, NEAR, _nearest_sql("n1", "close", 120), _nearest_sql("n2", "far", 700))
    + "SELECT n1.camera_id, n1.pos, coalesce(n1.frame, n2.frame) AS frame FROM n1 JOIN n2 USING (camera_id, pos)",
)
def nearest_frame(spark, sf):
    f = t.frames(spark, sf)
    targets = f.filter("event_type = 'error'").select("camera_id", (F.col("event_id") * 3).alias("pos"))
    close = f.filter("event_type = 'view' AND scalar > 120")
    close = close.select("camera_id", (F.col("event_id") * 3 + 1).alias("pos"), F.col("event_id").alias("frame_no"))
    far = f.select("camera_id", (F.col("event_id") * 3 + 1).alias("pos"), F.col("event_id").alias("frame_no"))
    out = ops.nearest_frame(targets, close, far, ["camera_id"], "pos", "frame_no")
    return out.select("camera_id", "pos", "frame")


@query(
    "evidence_box",
    """WITH p AS (SELECT event_id, 200 + (value - 50) * 0.9::DOUBLE + user_id * 0.3::DOUBLE AS px,
      150 + (value - 50) * 0.1::DOUBLE + user_id * 1.1::DOUBLE AS py FROM events)
    SELECT event_id, round(greatest(px - 60, 0) / 647, 6) AS x, round(greatest(py - 60, 0) / 359, 6) AS y,
      round((least(px + 60, 647) - greatest(px - 60, 0)) / 647, 6) AS width,
      round((least(py + 60, 359) - greatest(py - 60, 0)) / 359, 6) AS height FROM p""",
)
def evidence_box(spark, sf):
    e = t.table(spark, sf, "events")
    box = ops.evidence_box(F.col("value") - 50, F.col("user_id").cast("double"), (200.0, 150.0), (0.9, 0.1), (0.3, 1.1), 60.0, (647.0, 359.0))
    return e.select("event_id", *[F.round(c, 6).alias(n) for n, c in box.items()])


@query(
    "report_when_delivered",
    with_views(t.PASSES, SCORED, STATES, LATEST)
    + """SELECT element_id, pass_no, EXISTS (SELECT 1 FROM events e WHERE e.event_id = pass_no AND e.event_type <> 'error') AS delivered
    FROM latest WHERE state <> 'healthy'""",
)
def report_when_delivered(spark, sf):
    latest = ops.latest_per_element(_states(spark, sf), ["element_id"], "pass_no").filter("state <> 'healthy'")
    sent = t.table(spark, sf, "events").filter("event_type <> 'error'").select(F.col("event_id").alias("pass_no"))
    return ops.delivered_only(latest, sent, "pass_no").select("element_id", "pass_no", "delivered")
