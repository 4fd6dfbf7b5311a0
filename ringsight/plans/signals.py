"""Queries over the unrolled chain."""

from __future__ import annotations


from pyspark.sql import functions as F

from ringsight.operators import signals as ops
from ringsight.operators.ordered import Lane
from ringsight.plans.registry import query, with_views
from ringsight.sources import tables as t

COLUMNS = Lane((), "col")
BY_EVENT = Lane((), "event_id")


def _back(expr):
    return "[" + ", ".join(expr.format(k=k, m=k + 3) for k in range(1, 5)) + "]"


ODOMETER = f"""src AS MATERIALIZED (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n,
  {_back("(5.0::DOUBLE + user_id % 4) * {k} + ((event_id * {m}) % 11 - 5) / 20.0::DOUBLE + CASE WHEN event_id % 37 = {k} THEN 40 ELSE 0 END")} AS shift,
  {_back("CASE WHEN ((event_id * {k}) % 29) / 29.0::DOUBLE > 0.2 AND event_id % 53 <> {k} THEN ((event_id * {k}) % 29) / 29.0::DOUBLE * {k} ELSE 0 END")} AS weight
  FROM events),
way AS (SELECT event_id, n, 0.0::DOUBLE AS step, [0.0::DOUBLE] AS steps, [1] AS got, []::DOUBLE[] AS recent FROM src WHERE n = 1
  UNION ALL
  SELECT event_id, n, own + lost * usual, list_concat([own], trail)[1:4], list_concat([1], there)[1:4], list_concat([own], recent)[1:25]
  FROM (SELECT *, coalesce(list_sum(list_transform(near, lambda c: c.o * c.w)) / list_sum(list_transform(near, lambda c: c.w)), usual) AS own
  FROM (SELECT *, list_filter(usable, lambda c: abs(c.o - CASE WHEN weight[1] * there[1] > 0 AND shift[1] > -3 AND shift[1] < 80 THEN shift[1]
      ELSE list_median(list_transform(usable, lambda d: d.o)) END) <= 2) AS near
  FROM (SELECT *, list_filter(list_transform(range(1, len(trail) + 1), lambda j: {{'o': shift[j] - coalesce(list_sum(trail[1:j - 1]), 0), 'w': weight[j] * there[j]}}),
      lambda c: c.w > 0) AS usable
  FROM (SELECT *, list_concat(list_transform(range(least(lost, 4)), lambda j: usual), steps)[1:4] AS trail,
      list_concat(list_transform(range(least(lost, 4)), lambda j: 0), got)[1:4] AS there
  FROM (SELECT s.event_id, s.n, s.shift, s.weight, w.steps, w.got, w.recent, coalesce(list_median(w.recent), 0) AS usual, s.event_id - w.event_id - 1 AS lost
    FROM way w JOIN src s ON s.n = w.n + 1))))))"""


@query(
    "odometer_fusion",
    with_views(ODOMETER).replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT event_id, round(step, 6) AS step, round(sum(step) OVER (ORDER BY event_id), 4) AS position FROM way",
)
def odometer_fusion(spark, sf):
    """Shifts over 1..4 frames around the true step, with gross errors and weak matches mixed in."""
    e = t.table(spark, sf, "events")
    true_step = F.lit(5.0) + F.col("user_id") % 4
    spread = lambda k: ((F.col("event_id") * (k + 3)) % 11 - 5) / 20.0
    shift = F.array(*[true_step * k + spread(k) + F.when(F.col("event_id") % 37 == k, 40.0).otherwise(0.0) for k in range(1, 5)])
    cross = F.array(*[F.when(F.col("event_id") % 53 == k, 4.0).otherwise(0.5) for k in range(1, 5)])
    quality = F.array(*[((F.col("event_id") * k) % 29) / 29.0 for k in range(1, 5)])
    rows = e.select("event_id", shift.alias("shift"), cross.alias("cross_shift"), quality.alias("quality"))
    out = ops.odometer(rows, BY_EVENT, "shift", "cross_shift", "quality")
    return out.select("event_id", F.round("step", 6).alias("step"), F.round("position", 4).alias("position"))


@query(
    "chain_status",
    """WITH w AS (SELECT event_id, quantile_cont(value / 50, 0.5) OVER s AS step, count(*) OVER q AS n,
      quantile_cont(user_id / 400.0::DOUBLE, 0.5) OVER q AS quality FROM events
      WINDOW s AS (ORDER BY event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW),
             q AS (ORDER BY event_id ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))
    SELECT event_id, CASE WHEN n >= 25 AND step < 1 THEN 2 WHEN n >= 25 AND quality < 0.25 THEN 1 ELSE 0 END
      AS chain_status FROM w""",
)
def chain_status(spark, sf):
    e = t.table(spark, sf, "events").select(
        "event_id", (F.col("value") / 50).alias("step"), (F.col("user_id") / 400.0).alias("quality")
    )
    return ops.chain_status(e, BY_EVENT, "step", "quality").select("event_id", "chain_status")


@query(
    "bad_frames",
    "SELECT event_id, (user_id / 150.0::DOUBLE < 0.3 OR value / 10 < 4) AS bad FROM events",
)
def bad_frames(spark, sf):
    bad = ops.bad_frame(F.col("user_id") / 150.0, F.col("value") / 10)
    return t.table(spark, sf, "events").select("event_id", bad.alias("bad"))


def _frame_positions(spark, sf, scale=1.5):
    f = t.frames(spark, sf)
    return f.select(
        "camera_id", "event_id", "arrival", (F.col("event_id") * F.lit(scale) + F.col("scalar") / 100).alias("s"),
        F.col("scalar").alias("x"), (F.col("scalar") < 5).alias("bad"),
    )


@query(
    "coverage_widening",
    with_views(
        t.FRAMES,
        """a AS MATERIALIZED (SELECT camera_id, event_id, event_id * 4.5::DOUBLE + scalar / 100 AS s,
          row_number() OVER (PARTITION BY camera_id ORDER BY event_id) AS k FROM frames)""",
        """w AS (SELECT camera_id, event_id, s, k, 6 AS half FROM a WHERE k = 1
          UNION ALL
          SELECT a.camera_id, a.event_id, a.s, a.k, CAST(least(greatest(ceil(abs(a.s - w.s) - w.half) + 1, 6), 60) AS INTEGER)
          FROM w JOIN a ON a.camera_id = w.camera_id AND a.k = w.k + 1)""",
    ).replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT camera_id, event_id, half FROM w",
)
def coverage_widening(spark, sf):
    rows = _frame_positions(spark, sf, 4.5)
    out = ops.coverage_widths(rows, Lane(("camera_id",), "event_id"), "s")
    return out.select("camera_id", "event_id", "half")


SCATTER = """pos AS (SELECT camera_id, event_id, event_id * 1.5::DOUBLE + scalar / 100 AS s, scalar AS x, scalar < 5 AS bad
  FROM frames),
writes AS (SELECT camera_id, CAST(round_even(s - a, 0) AS BIGINT) AS col, 1 - abs(a) / 7.0::DOUBLE AS w, x, bad
  FROM pos, range(-6, 7) AS g(a)),
cols AS (SELECT camera_id, col, sum(w) AS weight, sum(w * x) / sum(w) AS value, bool_or(bad) AS bad
  FROM writes GROUP BY camera_id, col)"""


@query(
    "column_scatter",
    with_views(t.FRAMES, SCATTER)
    + "SELECT camera_id, col, round(weight, 6) AS weight, round(value, 6) AS value, bad FROM cols",
)
def column_scatter(spark, sf):
    out = ops.scatter_columns(_frame_positions(spark, sf), ["camera_id"], "s", "x", "bad")
    return out.select("camera_id", "col", F.round("weight", 6).alias("weight"), F.round("value", 6).alias("value"), "bad")


@query(
    "missing_columns",
    with_views(
        t.FRAMES,
        SCATTER,
        "lim AS (SELECT camera_id, min(col) AS lo, max(col) AS hi FROM cols GROUP BY camera_id)",
        "every AS (SELECT camera_id, unnest(generate_series(lo, hi)) AS col FROM lim)",
    )
    + """SELECT e.camera_id, e.col, c.col IS NULL AS missing FROM every e LEFT JOIN cols c
    ON c.camera_id = e.camera_id AND c.col = e.col""",
)
def missing_columns(spark, sf):
    cols = ops.scatter_columns(_frame_positions(spark, sf), ["camera_id"], "s", "x", "bad")
    return ops.add_missing_columns(cols, Lane(("camera_id",), "col")).select("camera_id", "col", "missing")


@query(
    "position_watermark",
    with_views(
        t.FRAMES,
        "pos AS (SELECT camera_id, event_id, arrival, event_id * 4.0::DOUBLE + scalar / 100 AS s FROM frames)",
        """seen AS (SELECT *, max(CAST(round_even(s - 6, 0) AS BIGINT) - 20) OVER (PARTITION BY camera_id
            ORDER BY arrival, event_id) AS final_before FROM pos)""",
        "writes AS (SELECT *, CAST(round_even(s - a, 0) AS BIGINT) AS col FROM seen, range(-6, 7) AS g(a))",
    )
    + """SELECT camera_id, event_id, count(*) AS accepted FROM writes WHERE col >= final_before
    GROUP BY camera_id, event_id""",
)
def position_watermark(spark, sf):
    lane = Lane(("camera_id",), "arrival", ("event_id",))
    out = ops.accepted_writes(_frame_positions(spark, sf, 4.0), lane, "s")
    return out.groupBy("camera_id", "event_id").agg(F.count(F.lit(1)).alias("accepted"))


def _centred(name, expr, half):
    return f"{expr} OVER (ORDER BY col ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) AS {name}"


SEVERITY = f"""e1 AS (SELECT col, x, 60 - x AS top, CAST(user_id AS DOUBLE) AS shadow FROM signal),
e2 AS (SELECT *, {_centred('base', 'quantile_cont(top, 0.5)', 60)}, {_centred('smooth', 'avg(shadow)', 6)} FROM e1),
e3 AS (SELECT *, CASE WHEN least(greatest(base - top, 0), 40) > 10 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS up FROM e2),
e4 AS (SELECT *, {_centred('raised', 'avg(up)', 6)}, {_centred('level', 'quantile_cont(smooth, 0.5)', 100)} FROM e3),
sev AS (SELECT col, (smooth - level) / 4 + 3 * raised AS severity FROM e4)"""


def _severity(spark, sf):
    s = t.signal(spark, sf).select("col", (60 - F.col("x")).alias("top"), F.col("user_id").cast("double").alias("shadow"))
    return ops.severity_scores(s, COLUMNS, "top", "shadow", 40)


@query("severity_score", with_views(t.SIGNAL, SEVERITY) + "SELECT col, round(severity, 6) AS severity FROM sev")
def severity_score(spark, sf):
    return _severity(spark, sf).select("col", F.round("severity", 6).alias("severity"))


@query(
    "block_scores",
    with_views(t.SIGNAL, SEVERITY, "ends AS (SELECT max(col) AS last_col FROM signal)")
    + """SELECT CAST(floor(col / 1000) AS BIGINT) AS block, count(*) AS n_cols, round(max(severity), 6) AS peak FROM sev, ends
    WHERE col >= 150 AND col <= last_col - 150 GROUP BY 1""",
)
def block_scores(spark, sf):
    """Only columns with full context on both sides are scored."""
    sev = _severity(spark, sf)
    last = t.signal(spark, sf).agg(F.max("col").alias("last_col"))  # one row
    inner = sev.crossJoin(F.broadcast(last)).filter("col >= 150 AND col <= last_col - 150")
    return inner.groupBy(F.floor(F.col("col") / 1000).alias("block")).agg(
        F.count(F.lit(1)).alias("n_cols"), F.round(F.max("severity"), 6).alias("peak")
    )


@query(
    "otsu_threshold",
    with_views(
        t.SIGNAL,
        "b AS (SELECT CAST(floor(col / 400) AS BIGINT) AS block, CAST(floor(least(greatest(x, 0), 255)) AS INTEGER) AS bin FROM signal)",
        "h AS (SELECT block, bin, count(*) AS n FROM b GROUP BY block, bin)",
        """c AS (SELECT block, bin, sum(n) OVER u AS w0, sum(n * bin) OVER u AS s0, sum(n) OVER a AS w, sum(n * bin) OVER a AS s
            FROM h WINDOW u AS (PARTITION BY block ORDER BY bin), a AS (PARTITION BY block))""",
        """v AS (SELECT block, bin, round(coalesce(CAST(w0 AS DOUBLE) * (w - w0) * power(s0 / CAST(w0 AS DOUBLE)
              - (s - s0) / nullif(CAST(w - w0 AS DOUBLE), 0), 2), 0), 6) AS spread FROM c)""",
    )
    + """SELECT block, bin AS threshold FROM v
    QUALIFY row_number() OVER (PARTITION BY block ORDER BY spread DESC, bin) = 1""",
)
def otsu_threshold(spark, sf):
    s = t.signal(spark, sf).withColumn("block", F.floor(F.col("col") / 400))
    return ops.otsu_thresholds(s, ["block"], "x")


@query(
    "first_bright_run",
    with_views(
        t.PROFILES,
        """hits AS (SELECT vec_id, i FROM profiles, range(0, 61) AS g(i)
            WHERE list_min(profile[i + 1 : i + 4]) > 0)""",
    )
    + """SELECT vec_id, coalesce(CAST(min(i) AS INTEGER), 64) AS edge FROM profiles LEFT JOIN hits USING (vec_id)
    GROUP BY vec_id""",
)
def first_bright_run(spark, sf):
    bright = F.transform("profile", lambda v: v > 0)
    return t.profiles(spark, sf).select("vec_id", ops.first_run(bright, 4, 64).alias("edge"))


@query(
    "outlier_rejection",
    with_views(t.SIGNAL, f"m AS (SELECT *, {_centred('base', 'quantile_cont(x, 0.5)', 241)} FROM signal)")
    + "SELECT col, round(CASE WHEN base - x > 20 THEN base ELSE x END, 6) AS cleaned FROM m",
)
def outlier_rejection(spark, sf):
    out = ops.reject_outliers(t.signal(spark, sf).select("col", "x"), COLUMNS, "x", 161, 20.0)
    return out.select("col", F.round("cleaned", 6).alias("cleaned"))


@query(
    "closed_dark_interval",
    with_views(
        t.PROFILES,
        "p AS (SELECT vec_id, list_transform(profile, lambda v: abs(v)) AS a FROM profiles)",
        "q AS (SELECT vec_id, a[1:20] AS seg, list_median(a[21:64]) AS body FROM p)",
        """d AS (SELECT vec_id, i, seg[i + 1] < body * 0.72 AS dark FROM q, range(0, 20) AS g(i))""",
        "f AS (SELECT vec_id, coalesce(min(i) FILTER (dark), 20) AS first_dark FROM d GROUP BY vec_id)",
        """l AS (SELECT f.vec_id, first_dark, coalesce(min(i) FILTER (NOT dark AND i >= first_dark), 20) AS lit
            FROM f JOIN d USING (vec_id) GROUP BY f.vec_id, first_dark)""",
    )
    + "SELECT vec_id, CAST(CASE WHEN first_dark >= 2 AND lit < 20 THEN lit - first_dark ELSE 0 END AS INTEGER) AS wedge FROM l",
)
def closed_dark_interval(spark, sf):
    a = F.transform("profile", lambda v: F.abs(v))
    staged = t.profiles(spark, sf).select("vec_id", F.slice(a, 1, 20).alias("seg"), ops.array_median(F.slice(a, 21, 44)).alias("body"))
    return staged.select("vec_id", ops.closed_interval(F.col("seg"), F.col("body"), 20).alias("wedge"))


@query(
    "along_gradient",
    with_views(t.SIGNAL, "g AS (SELECT col, abs(lead(x) OVER w - lag(x) OVER w) AS gradient FROM signal WINDOW w AS (ORDER BY col))")
    + "SELECT CAST(floor(col / 100) AS BIGINT) AS block, round(avg(gradient), 6) AS texture FROM g GROUP BY 1",
)
def along_gradient(spark, sf):
    out = ops.along_gradient(t.signal(spark, sf).select("col", "x"), COLUMNS, "x")
    return out.groupBy(F.floor(F.col("col") / 100).alias("block")).agg(F.round(F.avg("gradient"), 6).alias("texture"))


@query(
    "high_pass_fingerprint",
    with_views(t.SIGNAL.replace("value AS x", "value * 0.6180339887::DOUBLE AS x"),
               f"m AS (SELECT *, {_centred('base', 'avg(x)', 150)} FROM signal)")
    + "SELECT col, round(x - base, 6) AS hp_x FROM m",
)
def high_pass_fingerprint(spark, sf):
    s = t.signal(spark, sf).select("col", (F.col("x") * F.lit(0.6180339887)).alias("x"))
    out = ops.high_pass(s, COLUMNS, "x")
    return out.select("col", F.round("hp_x", 6).alias("hp_x"))


def _match_sql(offsets, step, pitch, half, search):
    ks = ", ".join(f"({k})" for k in offsets)
    return f"""ends AS (SELECT max(col) AS top FROM signal),
    grid AS (SELECT col AS c, k, s FROM signal, (VALUES {ks}) AS kk(k), range(-{search}, {search + 1}) AS ss(s), ends
      WHERE col % {step} = 0 AND col - {half} >= 0 AND col + {half} <= top
        AND col + k * {pitch} - {half + search} >= 0 AND col + k * {pitch} + {half + search} <= top),
    pairs AS (SELECT g.c, g.k, g.s, a.x AS ax, b.x AS bx FROM grid g, range(-{half}, {half + 1}) AS oo(o), signal a, signal b
      WHERE a.col = g.c + o AND b.col = g.c + g.k * {pitch} + g.s + o),
    cors AS (SELECT c, k, max(r) AS best FROM (SELECT c, k, s, corr(ax, bx) AS r FROM pairs GROUP BY c, k, s) GROUP BY c, k)"""


@query(
    "neighbour_dissimilarity",
    with_views(t.SIGNAL, _match_sql((-2, -1, 1, 2), 30, 40, 15, 3))
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY best DESC) AS r, count(*) OVER (PARTITION BY c) AS n
      FROM cors)
    SELECT s.col, round(1 - k.best, 6) AS score FROM (SELECT col FROM signal, ends WHERE col % 30 = 0 AND col >= 15 AND col + 15 <= top) s
    LEFT JOIN ranked k ON k.c = s.col AND k.r = 2 AND k.n >= 3""",
)
def neighbour_dissimilarity(spark, sf):
    out = ops.neighbour_scores(t.signal(spark, sf).select("col", "x"), COLUMNS, "x", 40, 15, 3)
    return out.select("col", F.round("score", 6).alias("score"))


@query(
    "local_contrast",
    with_views(t.SIGNAL, f"m AS (SELECT *, {_centred('top', 'max(x)', 12)} FROM signal)")
    + "SELECT col, round(greatest(top - x, 0), 6) AS contrast FROM m",
)
def local_contrast(spark, sf):
    out = ops.local_contrast(t.signal(spark, sf).select("col", "x"), COLUMNS, "x")
    return out.select("col", F.round("contrast", 6).alias("contrast"))


REPEAT = _match_sql((1, 2), 20, 40, 15, 3)
REPEAT += """, reps AS (SELECT s.col, avg(k.best) AS rep FROM (SELECT col FROM signal, ends WHERE col % 20 = 0 AND col >= 15
  AND col + 15 <= top) s LEFT JOIN cors k ON k.c = s.col GROUP BY s.col)"""


@query(
    "empty_guard",
    with_views(t.SIGNAL, REPEAT)
    + """SELECT col, round(rep, 6) AS repeat_score, round(quantile_cont(coalesce(rep, 0), 0.5) OVER w, 6) AS level,
      quantile_cont(coalesce(rep, 0), 0.5) OVER w >= 0.35 AS empty FROM reps
    WINDOW w AS (ORDER BY col RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING)""",
)
def empty_guard(spark, sf):
    reps = ops.repeat_scores(t.signal(spark, sf).select("col", "x"), COLUMNS, "x", 40, 15, 3, 20)
    out = ops.empty_columns(reps, COLUMNS, 40, 0.35)
    return out.select("col", F.round("repeat", 6).alias("repeat_score"), F.round("level", 6).alias("level"), "empty")


@query(
    "grid_hold",
    with_views(t.SIGNAL)
    + """SELECT a.col, b.x AS held FROM signal a LEFT JOIN signal b
    ON b.col = CAST(floor((a.col + 15) / 30) AS BIGINT) * 30""",
)
def grid_hold(spark, sf):
    return ops.grid_hold(t.signal(spark, sf), [], "col", "x").select("col", "held")


@query(
    "empty_share",
    with_views(
        t.SIGNAL,
        """b AS (SELECT CAST(floor(col / 50) AS BIGINT) AS block, avg(CASE WHEN hidden THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS share
            FROM signal GROUP BY 1)""",
    )
    + "SELECT block, round(avg(share) OVER (ORDER BY block ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 6) AS recent FROM b",
)
def empty_share(spark, sf):
    blocks = t.signal(spark, sf).groupBy(F.floor(F.col("col") / 50).alias("block")).agg(
        F.avg(F.col("hidden").cast("double")).alias("share")
    )
    return ops.recent_share(blocks, Lane((), "block"), "share").select("block", F.round("recent", 6).alias("recent"))


STRIPE = f"""s1 AS (SELECT col, x + 40 AS stripe, user_id % 10 = 0 AS bad, user_id = 7 AS missing FROM signal),
s2 AS (SELECT *, {_centred('visible', 'quantile_cont(stripe, 0.5)', 100)} FROM s1),
s3 AS (SELECT *, CASE WHEN stripe < 0.7 * greatest(visible, 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS low,
        CASE WHEN bad THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS good FROM s2),
s4 AS (SELECT *, {_centred('lowm', 'avg(low)', 4)}, {_centred('goodm', 'avg(good)', 20)} FROM s3),
s5 AS (SELECT *, round(lowm, 9) > 0.5 AS hid, round(goodm, 9) > 0.9 AS clean, CAST(floor(col / 200) AS BIGINT) AS block FROM s4),
s6 AS (SELECT *, {_centred('crowd', 'avg(CASE WHEN hid THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)', 40)} FROM s5),
mids AS (SELECT block, quantile_cont(visible, 0.5) AS mid FROM s5 GROUP BY block),
levels AS (SELECT 0::BIGINT AS block, (SELECT mid FROM mids WHERE block = 0) AS lev
  UNION ALL SELECT l.block + 1, 0.98::DOUBLE * l.lev + 0.02::DOUBLE * (SELECT mid FROM mids m WHERE m.block = l.block + 1)
  FROM levels l WHERE l.block + 1 IN (SELECT block FROM mids))"""


@query(
    "hidden_and_readable",
    with_views(t.SIGNAL, STRIPE).replace("WITH ", "WITH RECURSIVE ", 1)
    + """SELECT col, hid AS hidden, clean AND NOT missing AND NOT (visible < 0.5 * lev OR round(crowd, 9) > 0.6) AS readable
    FROM s6 JOIN levels USING (block)""",
)
def hidden_and_readable(spark, sf):
    s = t.signal(spark, sf).select(
        "col", (F.col("x") + 40).alias("stripe"), (F.col("user_id") % 10 == 0).alias("bad"),
        (F.col("user_id") == 7).alias("missing"),
    )
    out = ops.hidden_readable(s, COLUMNS, "stripe", "bad", "missing", wide=201, window=81, block=200)
    return out.select("col", "hidden", "readable")


@query(
    "template_peaks",
    with_views(
        t.SIGNAL,
        "p AS (SELECT col, x >= 90 AND x >= max(x) OVER (ORDER BY col ROWS BETWEEN 30 PRECEDING AND 30 FOLLOWING) AS peak FROM signal)",
    )
    + "SELECT col, peak, bool_or(peak) OVER (ORDER BY col ROWS BETWEEN 9 PRECEDING AND 10 FOLLOWING) AS hidden FROM p",
)
def template_peaks(spark, sf):
    return ops.template_peaks(t.signal(spark, sf).select("col", "x"), COLUMNS, "x", 90.0, 30, 10).select("col", "peak", "hidden")


@query(
    "strong_blocks",
    with_views(
        t.SIGNAL,
        "b AS (SELECT CAST(floor(col / 8) AS BIGINT) AS block, col, x FROM signal WHERE user_id % 9 <> 0)",
        """pk AS (SELECT block, col AS best_col, x AS peak FROM b
            QUALIFY row_number() OVER (PARTITION BY block ORDER BY x DESC, col) = 1)""",
        """q AS (SELECT *, count(*) OVER w AS n, quantile_cont(peak, 0.5) OVER w AS mid, quantile_cont(peak, 0.9) OVER w AS high
            FROM pk WINDOW w AS (ORDER BY block ROWS BETWEEN 2419 PRECEDING AND CURRENT ROW))""",
    )
    + "SELECT block, best_col, peak FROM q WHERE n >= 100 AND peak >= mid + 0.75 * greatest(high - mid, 0.001)",
)
def strong_blocks(spark, sf):
    s = t.signal(spark, sf).select("col", "x", (F.col("user_id") % 9 == 0).alias("missing"))
    return ops.strong_blocks(s, COLUMNS, "x", "missing", block=8, least=100).select("block", "best_col", "peak")
