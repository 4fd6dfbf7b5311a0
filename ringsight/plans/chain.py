"""Queries over the chain from frames to final columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.operators import chain as ops
from ringsight.operators.ordered import Lane
from ringsight.plans.registry import query, with_views
from ringsight.sources import tables as t

LANE = Lane(("camera_id",), "frame")
NAMES = ops.Frames("picture", "shift", "cross_shift", "quality", "scalar")


def chain_frames(spark, sf):
    """Three cameras, frames numbered without a hole. Neighbours with the same picture are repeats; now and then a shift is grossly wrong, and
    at a few frames all shifts agree on a wild jump ahead or back."""
    e = t.table(spark, sf, "events")
    at = F.col("event_id")
    jump = F.when(at % 1500 == 700, 9000.0).when(at % 1500 == 1200, -300.0).otherwise(0.0)
    shift = [(5.0 + F.col("user_id") % 4) * k + ((at * (k + 3)) % 11 - 5) / 20.0 + F.when(at % 37 == k, 40.0).otherwise(0.0) + jump for k in range(1, 5)]
    return e.select(
        (at % 3).alias("camera_id"), F.floor(at / 3).alias("frame"), (F.col("user_id") % 7).cast("string").alias("picture"),
        F.array(*shift).alias("shift"), F.array(*[F.when(at % 53 == k, 4.0).otherwise(0.5) for k in range(1, 5)]).alias("cross_shift"),
        F.array(*[(at * k) % 29 / 29.0 for k in range(1, 5)]).alias("quality"), (F.col("value") * 0.6180339887).alias("scalar"),
    )


def _each(expr):
    return "[" + ", ".join(expr.format(k=k, m=k + 3) for k in range(1, 5)) + "]"


CHAIN = f"""src AS (SELECT event_id % 3 AS camera_id, event_id // 3 AS frame, CAST(user_id % 7 AS VARCHAR) AS picture, value * 0.6180339887::DOUBLE AS scalar,
  {_each("(5.0::DOUBLE + user_id % 4) * {k} + ((event_id * {m}) % 11 - 5) / 20.0::DOUBLE + CASE WHEN event_id % 37 = {k} THEN 40 ELSE 0 END + CASE WHEN event_id % 1500 = 700 THEN 9000 WHEN event_id % 1500 = 1200 THEN -300 ELSE 0 END")} AS shift,
  {_each("CASE WHEN ((event_id * {k}) % 29) / 29.0::DOUBLE > 0.2 AND event_id % 53 <> {k} THEN ((event_id * {k}) % 29) / 29.0::DOUBLE * {k} ELSE 0 END")} AS weight,
  (event_id % 29) / 29.0::DOUBLE AS quality FROM events),
kept AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY frame) AS k FROM (
  SELECT *, lag(picture) OVER (PARTITION BY camera_id ORDER BY frame) AS before FROM src) WHERE picture IS DISTINCT FROM before),
chain AS (
  SELECT camera_id, k, frame, scalar, [0.0::DOUBLE] AS steps, [1] AS got, []::DOUBLE[] AS recent, 0.0::DOUBLE AS s, true AS bad,
    6::BIGINT AS half, 0::BIGINT AS final FROM kept WHERE k = 1
  UNION ALL
  SELECT camera_id, k, frame, scalar, list_concat([own], trail)[1:4], list_concat([1], there)[1:4], list_concat([own], recent)[1:25], s,
    plain < 0.3 OR own < 4, half, greatest(final, least(CAST(round_even(s - half, 0) AS BIGINT) + 8 - 20, final + 4096))
  FROM (SELECT *, least(greatest(CAST(ceil(abs(s - s0) - half0) AS BIGINT) + 1, 6), 60) AS half
  FROM (SELECT *, s0 + own + lost * usual AS s
  FROM (SELECT *, round_even(coalesce(list_sum(list_transform(near, lambda c: c.o * c.w)) / list_sum(list_transform(near, lambda c: c.w)), usual) * 256, 0) / 256 AS own
  FROM (SELECT *, list_filter(usable, lambda c: abs(c.o - CASE WHEN w1 > 0 AND shift[1] > -3 AND shift[1] < 80 THEN shift[1]
      ELSE list_median(list_transform(usable, lambda d: d.o)) END) <= 2) AS near
  FROM (SELECT *, list_filter(list_transform(range(1, len(trail) + 1), lambda j: {{'o': shift[j] - coalesce(list_sum(trail[1:j - 1]), 0), 'w': weight[j] * there[j]}}),
      lambda c: c.w > 0) AS usable, weight[1] * there[1] AS w1, quality * there[1] AS plain
  FROM (SELECT *, list_concat(list_transform(range(least(lost, 4)), lambda j: usual), steps)[1:4] AS trail,
      list_concat(list_transform(range(least(lost, 4)), lambda j: 0), got)[1:4] AS there
  FROM (SELECT n.camera_id, n.k, n.frame, n.scalar, n.shift, n.weight, n.quality, c.steps, c.got, c.recent, c.s AS s0, c.half AS half0, c.final,
      coalesce(list_median(c.recent), 0) AS usual, n.frame - c.frame - 1 AS lost
    FROM chain c JOIN kept n ON n.camera_id = c.camera_id AND n.k = c.k + 1))))))) ),
writes AS (SELECT camera_id, scalar, bad, final, 1 - abs(a) / (half + 1.0::DOUBLE) AS w, CAST(round_even(s - a, 0) AS BIGINT) + 8 AS col
  FROM chain, range(-60, 61) AS g(a) WHERE abs(a) <= half),
cols AS (SELECT camera_id, col, sum(w) AS weight, sum(w * scalar) / sum(w) AS value, bool_or(bad) AS bad FROM writes
  WHERE col >= final AND col < final + 4096 GROUP BY camera_id, col),
every AS (SELECT camera_id, unnest(range(0, top)) AS col FROM (SELECT camera_id, max(final) AS top FROM chain GROUP BY camera_id)),
strip AS MATERIALIZED (SELECT e.camera_id, e.col, coalesce(weight, 0) AS weight, coalesce(value, 0) AS value, coalesce(bad, false) AS bad,
  weight IS NULL AS missing FROM every e LEFT JOIN cols c ON c.camera_id = e.camera_id AND c.col = e.col)"""


@query(
    "chain_columns",
    with_views(CHAIN).replace("WITH", "WITH RECURSIVE", 1)
    + "SELECT camera_id, col, round(weight, 6) AS weight, round(value, 6) AS value, bad, missing FROM strip",
)
def chain_columns(spark, sf):
    """Every final column of three cameras: repeats taken as lost frames, widened writes, late and wild ones refused, holes marked."""
    out = ops.chain_columns(chain_frames(spark, sf), LANE, NAMES)
    return out.select("camera_id", "col", F.round("weight", 6).alias("weight"), F.round("value", 6).alias("value"), "bad", "missing")


JUDGED = """ends AS (SELECT camera_id, max(col) AS top FROM strip GROUP BY camera_id),
patches AS MATERIALIZED (SELECT camera_id, col, list(value) OVER (PARTITION BY camera_id ORDER BY col ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS patch
  FROM strip),
grid AS MATERIALIZED (SELECT p.camera_id, col AS c, patch, k, col + k * 40 + s AS other FROM patches p JOIN ends USING (camera_id), (VALUES (1), (2)) AS kk(k),
  range(-3, 4) AS ss(s) WHERE col % 40 = 0 AND col >= 15 AND col + 15 <= top AND col + k * 40 + 18 <= top),
pairs AS (SELECT g.camera_id, g.c, g.k, g.other, unnest(g.patch) AS ax, unnest(p.patch) AS bx
  FROM grid g JOIN patches p ON p.camera_id = g.camera_id AND p.col = g.other),
cors AS (SELECT camera_id, c, k, max(r) AS best FROM (SELECT camera_id, c, k, other, CASE WHEN stddev_pop(ax) * stddev_pop(bx) * 31 > 1e-9 THEN corr(ax, bx) END AS r
  FROM pairs GROUP BY camera_id, c, k, other) GROUP BY camera_id, c, k),
reps AS (SELECT p.camera_id, p.col, avg(best) AS rep FROM (SELECT camera_id, col FROM strip JOIN ends USING (camera_id)
  WHERE col % 40 = 0 AND col >= 15 AND col + 15 <= top) p LEFT JOIN cors k ON k.camera_id = p.camera_id AND k.c = p.col GROUP BY p.camera_id, p.col),
marks AS (SELECT camera_id, col AS at, quantile_cont(coalesce(rep, 0), 0.5) OVER w >= 0.35 AS empty FROM reps
  WINDOW w AS (PARTITION BY camera_id ORDER BY col RANGE BETWEEN 200 PRECEDING AND 200 FOLLOWING))"""


@query(
    "chain_judged",
    with_views(CHAIN, JUDGED).replace("WITH", "WITH RECURSIVE", 1)
    + """SELECT s.camera_id, s.col // 1000 AS block, count(*) AS n_cols, count(*) FILTER (missing) AS n_missing, count(*) FILTER (coalesce(empty, false)) AS n_empty,
      count(*) FILTER (NOT missing AND NOT coalesce(empty, false)) AS n_judged FROM strip s
    LEFT JOIN marks m ON m.camera_id = s.camera_id AND m.at = (s.col + 20) // 40 * 40 GROUP BY ALL""",
)
def chain_judged(spark, sf):
    """Missing, empty and judged columns per block of the final chain: what repeats from one pitch to the next is an empty conveyor."""
    columns = ops.chain_columns(chain_frames(spark, sf), LANE, NAMES)
    marked = ops.judged_columns(columns, Lane(("camera_id",), "col"), "value", 40, 15, 3, step=40)
    count = lambda name: F.count_if(name).alias(f"n_{name}")
    return marked.groupBy("camera_id", F.floor(F.col("col") / 1000).alias("block")).agg(
        F.count(F.lit(1)).alias("n_cols"), count("missing"), count("empty"), count("judged")
    )
