"""Queries over sequence identity and alignment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ringsight.operators import alignment as ops
from ringsight.operators.asof import circular
from ringsight.operators.ordered import Lane
from ringsight.plans.registry import query, with_views
from ringsight.sources import tables as t

COLUMNS = Lane((), "col")
SLOTS = Lane((), "slot")
STATUS_SQL = """CASE event_type WHEN 'error' THEN 'occluded' WHEN 'view' THEN 'weak' WHEN 'click' THEN 'edge'
  WHEN 'signup' THEN 'none' ELSE 'readable' END"""


def _status():
    kind = F.col("event_type")
    return (
        F.when(kind == "error", "occluded").when(kind == "view", "weak").when(kind == "click", "edge")
        .when(kind == "signup", "none").otherwise("readable")
    )


@query(
    "barcode_bits",
    f"""WITH s AS (SELECT event_id, {STATUS_SQL} AS status, value < 20 AS short FROM events)
    SELECT event_id, status = 'occluded' OR (short AND status IN ('readable', 'weak', 'edge')) AS bit FROM s""",
)
def barcode_bits(spark, sf):
    e = t.table(spark, sf, "events")
    return e.select("event_id", ops.barcode_bit(_status(), F.col("value") < 20).alias("bit"))


@query(
    "bit_dilation",
    with_views(t.SIGNAL)
    + "SELECT col, bool_or(bit) OVER (ORDER BY col ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS dilated FROM signal",
)
def bit_dilation(spark, sf):
    return ops.dilated(t.signal(spark, sf), COLUMNS, "bit", 2).select("col", "dilated")


OFFSETS = """n AS (SELECT max(slot) + 1 AS n FROM barcode),
starts AS (SELECT l AS loop, l * 400 + o AS start FROM range(0, 100000) AS ll(l), range(-20, 21) AS oo(o), n
  WHERE l * 400 < n AND l * 400 + o >= 0 AND l * 400 + o + 300 <= n),
mm AS (SELECT p, bit, lag(bit) OVER (ORDER BY p) AS b, lead(bit) OVER (ORDER BY p) AS a FROM master),
cc AS (SELECT slot, bit, lag(bit) OVER (ORDER BY slot) AS b, lead(bit) OVER (ORDER BY slot) AS a FROM barcode),
pairs AS (SELECT s.loop, s.start, least(400, n - s.start) AS len,
    m.bit OR coalesce(m.b, false) OR (coalesce(m.a, false) AND m.p + 1 < least(400, n - s.start)) AS x,
    c.bit OR (coalesce(c.b, false) AND m.p > 0) OR (coalesce(c.a, false) AND m.p + 1 < least(400, n - s.start)) AS y
  FROM starts s, n, mm m, cc c WHERE c.slot = s.start + m.p),
scored AS (SELECT loop, start, coalesce(corr(x::INT, y::INT), -1) AS score FROM pairs GROUP BY loop, start)"""


@query(
    "pattern_score",
    with_views(t.BARCODE, OFFSETS) + "SELECT loop, start, round(score, 6) AS score FROM scored WHERE start = loop * 400",
)
def pattern_score(spark, sf):
    out = ops.loop_offsets(t.barcode(spark, sf), "bit", "slot", t.barcode_master(), 0, every=True)
    return out.select("loop", "start", F.round("score", 6).alias("score"))


@query(
    "best_offset",
    with_views(
        t.BARCODE,
        OFFSETS,
        "best AS (SELECT loop, arg_max(start, (score, -start)) AS start, max(score) AS score FROM scored GROUP BY loop)",
    )
    + """SELECT b.loop, b.start, round(b.score, 6) AS score,
      round(b.score - coalesce(max(s.score) FILTER (abs(s.start - b.start) > 2), -1), 6) AS margin
    FROM best b JOIN scored s USING (loop) GROUP BY b.loop, b.start, b.score""",
)
def best_offset(spark, sf):
    out = ops.loop_offsets(t.barcode(spark, sf), "bit", "slot", t.barcode_master(), 20)
    return out.select("loop", "start", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(
    "loop_autocorrelation",
    with_views(
        t.BARCODE,
        "mu AS (SELECT avg(bit::INT) AS mu, var_pop(bit::INT) AS var FROM barcode)",
        "xm AS (SELECT slot, bit::INT - mu AS x FROM barcode, mu)",
    )
    + """SELECT CAST(g.lag AS INTEGER) AS lag, round(avg(a.x * b.x) / (any_value(var) + 1e-9), 6) AS score
    FROM range(380, 420) AS g(lag), xm a, xm b, mu WHERE b.slot = a.slot + g.lag GROUP BY g.lag""",
)
def loop_autocorrelation(spark, sf):
    out = ops.autocorrelation(t.barcode(spark, sf), SLOTS, "bit", 380, 420)
    return out.select("lag", F.round("score", 6).alias("score"))


@query("loop_length_and_drift")
def loop_length_and_drift(spark, sf):
    scores = ops.autocorrelation(t.barcode(spark, sf), SLOTS, "bit", 300, 500)
    return ops.drift(ops.loop_length(scores, []), t.BARCODE_LOOP).select("length", F.round("score", 6).alias("score"), "chain_changed")


RULES = {"score": 0.6, "margin": 0.2, "search": 20}


@query("loop_lock")
def loop_lock(spark, sf):
    events = ops.loop_lock(t.barcode(spark, sf), SLOTS, "bit", t.barcode_master(), RULES)
    return events.select("slot", "event", "start", F.round("score", 6).alias("score"), F.round("margin", 6).alias("margin"))


@query(
    "locked_loop_starts",
    with_views(t.BARCODE, "n AS (SELECT max(slot) AS top FROM barcode)")
    + "SELECT l AS loop, l * 400 AS start FROM range(0, 100000) AS g(l), n WHERE l * 400 <= top",
)
def locked_loop_starts(spark, sf):
    """On this pattern every loop must be found where it was laid."""
    return ops.loop_starts(ops.loop_lock(t.barcode(spark, sf), SLOTS, "bit", t.barcode_master(), RULES), [])


STARTS = """starts AS (SELECT event_id AS start, row_number() OVER (ORDER BY event_id) - 1 AS loop FROM events
  WHERE value > 240)"""


@query(
    "loop_assignment",
    with_views(STARTS)
    + """SELECT e.event_id AS slot, s.loop, (e.event_id - s.start) % 120 AS element_id
    FROM events e ASOF LEFT JOIN starts s ON e.event_id >= s.start""",
)
def loop_assignment(spark, sf):
    from ringsight.operators.ordered import with_ordinal

    e = t.table(spark, sf, "events")
    starts = with_ordinal(e.filter("value > 240").select(F.col("event_id").alias("start")), Lane((), "start"), "loop")
    slots = e.select(F.col("event_id").alias("slot"))
    return ops.assign_loops(slots, starts, [], "slot", "start", 120).select("slot", "loop", "element_id")


VIEWS = f"""slots AS (SELECT event_id AS slot, CAST(floor(event_id / 130) AS BIGINT) AS loop, {STATUS_SQL} AS status, value AS lit_left,
    value * 0.9 AS lit_right, user_id / 10.0::DOUBLE AS straight_left, user_id / 20.0::DOUBLE AS straight_right,
    user_id * 1.0::DOUBLE AS face_residual, value < 30 AS short_left, user_id < 50 AS short_right FROM events),
nx AS (SELECT *, lead(loop) OVER w = loop AS same, lead(status) OVER w AS nstatus, lead(lit_right) OVER w AS nlit,
    lead(straight_right) OVER w AS nstraight, lead(face_residual) OVER w AS nface, lead(short_right) OVER w AS nshort
  FROM slots WINDOW w AS (ORDER BY slot)),
vv AS (SELECT *, status IN ('readable', 'weak', 'edge') AS vl,
    coalesce(same, false) AND coalesce(nstatus IN ('readable', 'weak', 'edge'), false) AS vr FROM nx),
views AS (SELECT slot, loop, status AS status_left, CASE WHEN coalesce(same, false) THEN nstatus ELSE 'none' END AS status_right,
    vl::INT + vr::INT AS n_views,
    round(CASE WHEN vl AND vr THEN least(lit_left, nlit) WHEN vl THEN lit_left WHEN vr THEN nlit END, 6) AS lip,
    CASE WHEN vl AND vr THEN greatest(face_residual, nface) WHEN vl THEN face_residual WHEN vr THEN nface END AS face_max,
    vl AND short_left AND vr AND coalesce(nshort, false) AS short_both,
    (vl AND short_left) OR (vr AND coalesce(nshort, false)) AS short_any FROM vv)"""


def _views(spark, sf):
    e = t.table(spark, sf, "events")
    slots = e.select(
        F.col("event_id").alias("slot"), F.floor(F.col("event_id") / 130).alias("loop"), _status().alias("status"),
        F.col("value").alias("lit_left"), (F.col("value") * F.lit(0.9)).alias("lit_right"),
        (F.col("user_id") / 10.0).alias("straight_left"), (F.col("user_id") / 20.0).alias("straight_right"),
        F.col("user_id").cast("double").alias("face_residual"),
        (F.col("value") < 30).alias("short_left"), (F.col("user_id") < 50).alias("short_right"),
    )
    return ops.two_view_rows(slots, SLOTS)


VIEW_COLS = ["slot", "loop", "status_left", "status_right", "n_views", "lip", "face_max", "short_both", "short_any"]


@query("two_view_assembly", with_views(VIEWS) + f"SELECT {', '.join(VIEW_COLS)} FROM views")
def two_view_assembly(spark, sf):
    return _views(spark, sf).withColumn("lip", F.round("lip", 6)).select(*VIEW_COLS)


@query(
    "closed_loop_emission",
    with_views(VIEWS, "h AS (SELECT max(loop) AS head, max(slot) AS newest FROM views)")
    + "SELECT slot, loop, lip FROM views, h WHERE loop < head AND slot + 2 <= newest",
)
def closed_loop_emission(spark, sf):
    out = ops.closed_rows(_views(spark, sf), [], "slot")
    return out.select("slot", "loop", F.round("lip", 6).alias("lip"))


@query(
    "fill_ratio",
    f"""SELECT event_id, round(CASE WHEN {STATUS_SQL} IN ('readable', 'weak', 'edge') AND user_id - 20 >= 0
      AND event_id % 150 - 10 >= 0 AND event_id % 150 - 10 - (user_id - 20) + 1 > 0
      THEN value / (event_id % 150 - 10 - (user_id - 20) + 1) END, 6) AS fill FROM events""",
)
def fill_ratio(spark, sf):
    fill = ops.fill_ratio(_status(), F.col("user_id") - 20, F.col("event_id") % 150 - 10, F.col("value"))
    return t.table(spark, sf, "events").select("event_id", F.round(fill, 6).alias("fill"))


@query(
    "variance_normalisation",
    with_views(
        t.SIGNAL,
        "b AS (SELECT CAST(floor(col / 100) AS BIGINT) AS batch, col, x, user_id % 10 = 0 AS missing FROM signal)",
        "s AS (SELECT batch, count(*) FILTER (NOT missing) AS n, avg(x * x) FILTER (NOT missing) AS sq FROM b GROUP BY batch)",
        """v AS (SELECT -1::BIGINT AS batch, 900.0::DOUBLE AS var UNION ALL
            SELECT v.batch + 1, (1 - s.n / 20000.0::DOUBLE) * v.var + s.n / 20000.0::DOUBLE * coalesce(s.sq, 0)
            FROM v JOIN s ON s.batch = v.batch + 1)""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)
    + "SELECT col, round(CASE WHEN missing THEN 0 ELSE x / sqrt(greatest(var, 1e-6)) END, 6) AS scaled FROM b JOIN v USING (batch)",
)
def variance_normalisation(spark, sf):
    s = t.signal(spark, sf).select("col", "x", (F.col("user_id") % 10 == 0).alias("missing"))
    out = ops.normalise_variance(s, COLUMNS, "x", "missing", 900.0, 100)
    return out.select("col", F.round("scaled", 6).alias("scaled"))


@query(
    "sliding_pieces",
    with_views(t.SIGNAL)
    + """SELECT p AS piece, count(*) AS n_cols, round(avg(x), 6) AS level FROM signal,
      range(0, (SELECT CAST(max(col) / 125 AS BIGINT) + 1 FROM signal)) AS g(p)
    WHERE col >= p * 125 AND col < p * 125 + 200 GROUP BY p HAVING count(*) = 200""",
)
def sliding_pieces(spark, sf):
    out = ops.sliding_pieces(t.signal(spark, sf).select("col", (F.col("x")).alias("x")), "col", 200, 125)
    out = out.groupBy("piece").agg(F.count(F.lit(1)).alias("n_cols"), F.avg("x").alias("level")).filter("n_cols = 200")
    return out.select("piece", "n_cols", F.round("level", 6).alias("level"))


RING = 500


def _reference(spark, sf) -> np.ndarray:
    """Calibration ring: RING values, whatever the table holds."""
    return np.array([r["base"] for r in _ring_columns(spark, sf).orderBy("at").collect()], float)


def _ring_columns(spark, sf):
    """The highest value of every ring column over all loops."""
    return t.signal(spark, sf).groupBy((F.col("col") % RING).alias("at")).agg(F.max("x").alias("base"))


def _chain(spark, sf):
    """A chain that repeats the calibration ring, disturbed by the table's own values."""
    s = t.signal(spark, sf).select("col", "x", (F.col("col") % RING).alias("at"))
    return s.join(_ring_columns(spark, sf), "at").select("col", (F.col("base") + F.col("x") * 0.25).alias("x"))


CHAIN = """ref AS MATERIALIZED (SELECT col % 500 AS col, max(x) AS x FROM signal GROUP BY 1),
chain AS MATERIALIZED (SELECT s.col, r.x + s.x * 0.25::DOUBLE AS x FROM signal s JOIN ref r ON r.col = s.col % 500),
numbers AS MATERIALIZED (SELECT p FROM range(0, 1000000) AS g(p) WHERE p * 125 + 200 <= (SELECT max(col) + 1 FROM signal)),
pieces AS MATERIALIZED (SELECT p AS piece, o, c.x FROM numbers, range(0, 200) AS oo(o), chain c WHERE c.col = p * 125 + o),
nccs AS MATERIALIZED (SELECT p.piece, (r.col - p.o + 500) % 500 AS k, round(corr(p.x, r.x), 9) AS score FROM pieces p CROSS JOIN ref r
  GROUP BY p.piece, k),
matched AS (SELECT piece, piece * 125 + 100 AS centre, max(score) AS score, (arg_max(k, (score, -k)) + 100) % 500 AS pos
  FROM nccs GROUP BY piece)"""


def _matched(spark, sf):
    return ops.match_pieces(_chain(spark, sf), "col", "x", _reference(spark, sf), 200, 125)


@query(
    "reference_match",
    with_views(t.SIGNAL, CHAIN)
    + "SELECT piece, centre, round(score, 6) AS score, CAST(pos AS DOUBLE) AS pos FROM matched",
)
def reference_match(spark, sf):
    return _matched(spark, sf).select("piece", "centre", F.round("score", 6).alias("score"), "pos")


@query("reference_match_scaled")
def reference_match_scaled(spark, sf):
    out = ops.match_pieces(_chain(spark, sf), "col", "x", _reference(spark, sf), 200, 125, (0.98, 1.0, 1.02))
    return out.select("piece", "centre", F.round("score", 6).alias("score"), "pos")


@query(
    "lock_by_agreement",
    with_views(
        t.SIGNAL,
        CHAIN,
        """lagged AS (SELECT *, lag(score) OVER w AS ps, (pos - lag(pos) OVER w) - (centre - lag(centre) OVER w) + 250 AS d
            FROM matched WINDOW w AS (ORDER BY piece))""",
    )
    + """SELECT piece, coalesce(score >= 0.45 AND ps >= 0.45 AND abs(((d % 500) + 500) % 500 - 250) < 30, false) AS agrees
    FROM lagged""",
)
def lock_by_agreement(spark, sf):
    out = ops.agreeing_pieces(_matched(spark, sf), Lane((), "piece"), RING, 0.45, 30.0)
    return out.select("piece", "agrees")


@query("anchor_tracking")
def anchor_tracking(spark, sf):
    rules = {"ring": RING, "min_match": 0.45, "agree": 30.0, "local_min": 0.30, "window": 120.0, "lost": 2000.0,
             "scale_low": 0.98, "scale_high": 1.02, "span": 600.0, "tolerance": 20.0}
    out = ops.track_anchors(_matched(spark, sf), Lane((), "piece"), rules)
    return out.select("piece", "centre", "event", "lock_no", F.round("advance", 6).alias("advance"))


@query(
    "predicted_position",
    with_views(
        t.SIGNAL,
        t.ANCHORS,
        """fit AS (SELECT col, pos, CASE WHEN count(*) OVER w >= 3 AND col - first_value(col) OVER w >= 300
              THEN least(greatest(regr_slope(pos, col) OVER w, 0.98), 1.02) ELSE 1.0 END AS scale FROM anchors
            WINDOW w AS (ORDER BY col ROWS BETWEEN 15 PRECEDING AND CURRENT ROW))""",
    )
    + """SELECT s.col, round(a.pos + (s.col - a.col) * a.scale, 6) AS predicted
    FROM signal s ASOF LEFT JOIN fit a ON s.col >= a.col""",
)
def predicted_position(spark, sf):
    out = ops.predicted_positions(t.signal(spark, sf).select("col"), t.anchors(spark, sf), [], "col", "pos", span=300)
    return out.select("col", F.round("predicted", 6).alias("predicted"))


BETWEEN = """around AS (SELECT s.col, b.col AS c0, b.pos AS p0, n.col AS c1, n.pos AS p1 FROM signal s
  ASOF LEFT JOIN anchors b ON s.col >= b.col ASOF LEFT JOIN anchors n ON s.col < n.col)"""


@query(
    "interpolated_position",
    with_views(t.SIGNAL, t.ANCHORS, BETWEEN)
    + """SELECT col, round(CASE WHEN c0 IS NULL THEN p1 + col - c1 WHEN col = c0 THEN p0
      ELSE p0 + (col - c0) * (p1 - p0) / greatest(c1 - c0, 1.0) END, 6) AS position,
      coalesce(abs(CASE WHEN c0 IS NULL THEN 1 ELSE (p1 - p0) / greatest(c1 - c0, 1.0) END - 1) <= 0.015, false) AS trusted
    FROM around""",
)
def interpolated_position(spark, sf):
    out = ops.interpolated_positions(t.signal(spark, sf).select("col"), t.anchors(spark, sf), [], "col", "pos", 0.015)
    return out.select("col", F.round("position", 6).alias("position"), "trusted")


MAPPED = """mapped AS (SELECT col, x, user_id, CAST(floor((col * 1.01::DOUBLE - 3.0) / 2000) AS BIGINT) AS loop,
  CAST(floor(((col * 1.01::DOUBLE - 3.0) - 2000 * floor((col * 1.01::DOUBLE - 3.0) / 2000)) / 20) AS BIGINT) % 100 AS element_id
  FROM signal)"""


def _mapped(spark, sf):
    loop, element = ops.locate(F.col("col") * F.lit(1.01), 3.0, 2000.0, 20.0, 100)
    return t.signal(spark, sf).select("col", "x", "user_id", loop.alias("loop"), element.alias("element_id"))


@query(
    "column_to_element",
    with_views(t.SIGNAL, MAPPED)
    + "SELECT col, loop, element_id, CASE WHEN element_id = 0 THEN 100 ELSE element_id END AS external_id FROM mapped",
)
def column_to_element(spark, sf):
    out = _mapped(spark, sf)
    return out.select("col", "loop", "element_id", ops.external_id(F.col("element_id"), 100).alias("external_id"))


@query(
    "pass_aggregation",
    with_views(
        t.SIGNAL,
        MAPPED,
        "m AS (SELECT *, user_id % 12 = 0 AS missing FROM mapped)",
        """g AS (SELECT loop, element_id, count(*) AS columns, count(*) FILTER (missing) AS miss,
            max(x) FILTER (NOT missing) AS raw, arg_max(col, (x, -col)) FILTER (NOT missing) AS best_col FROM m GROUP BY 1, 2)""",
    )
    + "SELECT loop, element_id, columns, raw, best_col FROM g WHERE columns >= 16 AND miss <= 0.2 * columns AND raw IS NOT NULL",
)
def pass_aggregation(spark, sf):
    cols = _mapped(spark, sf).withColumn("missing", F.col("user_id") % 12 == 0).withColumn("top", F.col("x"))
    out = ops.aggregate_passes(cols, COLUMNS, "x", "top", "missing", 20.0)
    return out.select("loop", "element_id", "columns", "raw", "best_col")


@query(
    "circular_distance",
    """SELECT event_id, round(((value - user_id + 100) - 200 * floor((value - user_id + 100) / 200)) - 100, 6) AS gap FROM events""",
)
def circular_distance(spark, sf):
    gap = circular(F.col("value") - F.col("user_id"), 200.0)
    return t.table(spark, sf, "events").select("event_id", F.round(gap, 6).alias("gap"))
