"""Queries over objects on the ring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ringsight.operators import wheels as ops
from ringsight.operators.ordered import Lane
from ringsight.plans.registry import query, with_views
from ringsight.session import settle
from ringsight.sources import tables as t

COLUMNS = Lane((), "col")

RUNS = """h1 AS (SELECT col, hidden, user_id % 5 <> 0 AS readable,
    max(CASE WHEN hidden THEN col END) OVER (ORDER BY col) AS here,
    max(CASE WHEN hidden THEN col END) OVER (ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM signal),
h2 AS (SELECT *, sum(CASE WHEN hidden AND (before IS NULL OR col - (before + 1) > 1) THEN 1 ELSE 0 END) OVER (ORDER BY col) AS run
  FROM h1 WHERE col - (here + 1) <= 1),
runs AS (SELECT CAST(run AS BIGINT) AS run, min(col) FILTER (hidden) AS first_col, max(col) FILTER (hidden) + 1 AS end_col,
    count(*) FILTER (readable) AS readable_columns, count(*) AS columns FROM h2 GROUP BY run)"""


def _runs(spark, sf):
    s = t.signal(spark, sf).withColumn("readable", F.col("user_id") % 5 != 0)
    return ops.hidden_runs(s, COLUMNS, "hidden", "readable", 1)


@query("hidden_runs", with_views(t.SIGNAL, RUNS) + "SELECT * FROM runs")
def hidden_runs(spark, sf):
    return _runs(spark, sf)


OBJECTS = """wide AS (SELECT *, end_col - first_col AS w, CASE WHEN end_col - first_col > 1.6::DOUBLE * 4
    THEN greatest(CAST(round_even((end_col - first_col) / 4.0::DOUBLE, 0) AS BIGINT), 1) ELSE 1 END AS n FROM runs
  WHERE readable_columns >= 0.7 * columns - 1e-9 AND end_col - first_col >= 3),
objects AS (SELECT run, first_col + CAST(floor((2 * k + 1) * w / (2.0::DOUBLE * n)) AS BIGINT) AS col
  FROM (SELECT *, unnest(generate_series(0, n - 1)) AS k FROM wide))"""


def _objects(spark, sf):
    return ops.run_objects(_runs(spark, sf), 0.7, 3, 4.0)


@query("run_objects", with_views(t.SIGNAL, RUNS, OBJECTS) + "SELECT run, col FROM objects")
def run_objects(spark, sf):
    return _objects(spark, sf).select("run", "col")


PLACED = """around AS (SELECT s.col, b.col AS c0, b.pos AS p0, n.col AS c1, n.pos AS p1 FROM signal s
  ASOF LEFT JOIN anchors b ON s.col >= b.col ASOF LEFT JOIN anchors n ON s.col < n.col),
mapped AS (SELECT col, CASE WHEN col = c0 THEN p0 ELSE p0 + (col - c0) * (p1 - p0) / greatest(c1 - c0, 1.0) END AS position,
    coalesce(abs((p1 - p0) / greatest(c1 - c0, 1.0) - 1) <= 0.02, false) AS trusted FROM around)"""


@query(
    "object_placement",
    with_views(t.SIGNAL, t.ANCHORS, RUNS, OBJECTS, PLACED)
    + """SELECT o.run, o.col, CAST(floor((position - 3) / 1000) AS BIGINT) AS loop, round(position - 1000 * floor(position / 1000), 6) AS pos
    FROM objects o JOIN mapped m USING (col) WHERE trusted""",
)
def object_placement(spark, sf):
    out = ops.place_objects(_objects(spark, sf), t.anchors(spark, sf), [], 3.0, 1000.0, 10.0, 100, 0.02)
    return out.select("run", "col", "loop", F.round("pos", 6).alias("pos"))


@query(
    "coverage_cells",
    with_views(t.SIGNAL, t.ANCHORS, PLACED)
    + """SELECT DISTINCT CAST(floor((position - 3) / 1000) AS BIGINT) AS loop,
      CAST(floor(((position - 3) - 1000 * floor((position - 3) / 1000)) / 8) AS BIGINT) AS cell
    FROM mapped JOIN signal USING (col) WHERE trusted AND col % 4 = 0 AND user_id % 5 <> 0""",
)
def coverage_cells(spark, sf):
    s = t.signal(spark, sf).withColumn("readable", F.col("user_id") % 5 != 0)
    return ops.coverage_cells(s, t.anchors(spark, sf), [], "readable", 3.0, 1000.0, 0.02)


WHEELS = """wheels AS (SELECT k // 20 AS loop, CAST((k * 50 % 1000 + 25 + u % 21 - 10 + 1000) % 1000 AS DOUBLE) AS pos FROM (
    SELECT event_id // 50 AS k, CAST(sum(user_id) AS BIGINT) AS u FROM events GROUP BY 1) WHERE u % 10 <> 0),
coverage AS (SELECT event_id // 1000 AS loop, event_id % 1000 // 8 AS cell FROM events GROUP BY 1, 2 HAVING sum(user_id) % 7 <> 0)"""
RING, MATCH_AT = 1000.0, 20.0


def _wheels(spark, sf):
    """An object of every 50 events, placed by their users; one in ten is absent."""
    e = t.table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 50).alias("k")).agg(F.sum("user_id").alias("u"))
    return e.filter("u % 10 <> 0").select(
        F.floor(F.col("k") / 20).alias("loop"),
        ((F.col("k") * 50 % 1000 + 25 + F.col("u") % 21 - 10 + 1000) % 1000).cast("double").alias("pos"),
    )


def _coverage(spark, sf):
    at = F.col("event_id")
    e = t.table(spark, sf, "events").groupBy(F.floor(at / 1000).alias("loop"), F.floor(at % 1000 / 8).alias("cell"))
    return e.agg(F.sum("user_id").alias("u")).filter("u % 7 <> 0").drop("u")


@query(
    "current_passes",
    with_views(WHEELS, "locked AS (SELECT loop, pos, CAST(floor(loop / 7) AS BIGINT) AS lock_no FROM wheels)",
               "top AS (SELECT max(lock_no) AS l FROM locked)",
               "keep AS (SELECT DISTINCT loop FROM locked, top WHERE lock_no = l ORDER BY loop DESC LIMIT 8)")
    + "SELECT loop, pos, lock_no FROM locked, top WHERE lock_no = l AND loop IN (SELECT loop FROM keep)",
)
def current_passes(spark, sf):
    locked = _wheels(spark, sf).withColumn("lock_no", F.floor(F.col("loop") / 7))
    return ops.current_passes(locked, [], "lock_no", "loop").select("loop", "pos", "lock_no")


@query(
    "evaluation_gate",
    with_views(WHEELS, "l AS (SELECT DISTINCT loop FROM wheels)")
    + """SELECT loop, CAST(n AS INTEGER) AS n_passes, n >= 3 AS evaluated FROM (SELECT loop, row_number() OVER (ORDER BY loop) AS n,
      lead(loop) OVER (ORDER BY loop) AS nx FROM l) WHERE nx IS NOT NULL""",
)
def evaluation_gate(spark, sf):
    return ops.due_evaluations(_wheels(spark, sf), [])


def _circ(expr):
    return f"(({expr}) + 500 - 1000 * floor((({expr}) + 500) / 1000) - 500)"


@query(
    "local_registration",
    with_views(
        WHEELS,
        "sizes AS (SELECT loop, count(*) AS n FROM coverage GROUP BY loop)",
        "base AS (SELECT DISTINCT pos AS b FROM wheels WHERE loop = (SELECT arg_max(loop, (n, -loop)) FROM sizes))",
        "oth AS (SELECT DISTINCT loop, pos FROM wheels WHERE loop <> (SELECT arg_max(loop, (n, -loop)) FROM sizes))",
        f"""trio AS (SELECT x.loop, x.pos AS x, b.b, {_circ('o.pos - b.b')} AS d FROM oth x, base b, oth o
            WHERE o.loop = x.loop AND abs({_circ('b.b - x.pos')}) <= 150 AND abs({_circ('o.pos - x.pos')}) <= 190)""",
        """votes AS (SELECT loop, x, s * 4 AS s, count(DISTINCT b) AS v FROM trio, range(-10, 11) AS g(s) WHERE abs(d - s * 4) <= 10 GROUP BY 1, 2, 3)""",
        "best AS (SELECT loop, x, arg_max(s, (v, -abs(s), -s)) AS shift FROM votes GROUP BY loop, x)",
    )
    + "SELECT w.loop, w.pos, coalesce(b.shift, 0) AS shift FROM wheels w LEFT JOIN best b ON b.loop = w.loop AND b.x = w.pos",
)
def local_registration(spark, sf):
    out = ops.register_passes(_wheels(spark, sf), _coverage(spark, sf), RING, 150.0, 40, 4, 10.0)
    return out.select("loop", "pos", "shift")


def _reference(tag, wheels, coverage):
    return f"""{tag}a AS (SELECT loop, pos, pos - lag(pos) OVER (ORDER BY pos, loop) AS gap FROM {wheels}),
{tag}b AS (SELECT loop, pos, sum(CASE WHEN gap IS NULL OR gap > 20 THEN 1 ELSE 0 END) OVER (ORDER BY pos, loop) AS c FROM {tag}a),
{tag}e AS (SELECT max(c) AS lastc, min(pos) AS lo, max(pos) AS hi FROM {tag}b),
{tag}c AS (SELECT CASE WHEN lastc > 1 AND lo + 1000 - hi <= 20 AND c = lastc THEN 1 ELSE c END AS k, median(pos) AS x
  FROM {tag}b, {tag}e GROUP BY 1),
{tag} AS (SELECT x, (SELECT count(DISTINCT v.loop) FROM {coverage} v WHERE v.cell = floor(x / 8)) AS could,
  (SELECT count(DISTINCT w.loop) FROM {wheels} w WHERE abs({_circ('w.pos - x')}) <= 20) AS hits FROM {tag}c)"""


@query(
    "reference_objects",
    with_views(WHEELS, _reference("refs", "wheels", "coverage"))
    + "SELECT x, could, hits FROM refs WHERE could > 0 AND hits >= least(2, could) AND hits >= 0.5 * could",
)
def reference_objects(spark, sf):
    return ops.reference_objects(_wheels(spark, sf), _coverage(spark, sf), RING, MATCH_AT)


TWO_RINGS = """w2 AS (SELECT camera_id, k // 20 AS loop, k // 20 // 12 AS lock_no,
    CAST((k * 50 % 1000 + 25 + u % 21 - 10 + k // 20 % 4 * 12 + 1000) % 1000 AS DOUBLE) AS pos FROM (
    SELECT event_id // 50 AS k, 'CAM-' || (event_id % 2 + 4) AS camera_id, CAST(sum(user_id) AS BIGINT) AS u FROM events GROUP BY 1, 2) WHERE u % 4 <> 0),
c2 AS (SELECT 'CAM-' || (event_id % 2 + 4) AS camera_id, event_id // 1000 AS loop, event_id // 1000 // 12 AS lock_no, event_id % 1000 // 8 AS cell
  FROM events GROUP BY ALL HAVING sum(user_id) % 7 <> 0),
np AS (SELECT *, row_number() OVER (PARTITION BY camera_id, lock_no ORDER BY loop) AS i, lead(loop) OVER (PARTITION BY camera_id, lock_no ORDER BY loop) AS nx
  FROM (SELECT camera_id, lock_no, loop FROM w2 UNION SELECT camera_id, lock_no, loop FROM c2)),
seen AS (SELECT p.camera_id, p.lock_no, p.loop, e.loop AS evaluation, CAST(e.i - p.i AS INTEGER) AS rank FROM np p JOIN np e USING (camera_id, lock_no)
  WHERE p.nx IS NOT NULL AND e.nx IS NOT NULL AND e.i >= 3 AND e.i - p.i BETWEEN 0 AND 7),
ew AS (SELECT s.camera_id, s.evaluation, s.rank, s.loop, w.pos FROM seen s JOIN w2 w ON w.camera_id = s.camera_id AND w.loop = s.loop),
ec AS (SELECT s.camera_id, s.evaluation, s.rank, s.loop, w.cell FROM seen s JOIN c2 w ON w.camera_id = s.camera_id AND w.loop = s.loop)"""
REGISTERED = f"""bl AS (SELECT camera_id, evaluation, arg_max(loop, (n, -loop)) AS base FROM (
    SELECT camera_id, evaluation, loop, count(*) AS n FROM ec GROUP BY ALL) GROUP BY ALL),
mk AS (SELECT ew.*, base FROM ew JOIN bl USING (camera_id, evaluation)),
trio AS (SELECT x.camera_id, x.evaluation, x.loop, x.pos AS x, b.pos AS b, {_circ('o.pos - b.pos')} AS d FROM mk x
  JOIN mk b ON b.camera_id = x.camera_id AND b.evaluation = x.evaluation AND b.loop = b.base AND abs({_circ('b.pos - x.pos')}) <= 150
  JOIN mk o ON o.camera_id = x.camera_id AND o.evaluation = x.evaluation AND o.loop = x.loop AND abs({_circ('o.pos - x.pos')}) <= 190
  WHERE x.loop <> x.base),
votes AS (SELECT camera_id, evaluation, loop, x, s * 4 AS s, count(DISTINCT b) AS v FROM trio, range(-10, 11) AS g(s) WHERE abs(d - s * 4) <= 10 GROUP BY 1, 2, 3, 4, 5),
best AS (SELECT camera_id, evaluation, loop, x, arg_max(s, (v, -abs(s), -s)) AS shift FROM votes GROUP BY ALL),
reg AS (SELECT m.camera_id, m.evaluation, m.rank, m.loop, coalesce(b.shift, 0) AS shift,
    m.pos - coalesce(b.shift, 0) - 1000 * floor((m.pos - coalesce(b.shift, 0)) / 1000) AS pos
  FROM mk m LEFT JOIN best b ON b.camera_id = m.camera_id AND b.evaluation = m.evaluation AND b.loop = m.loop AND b.x = m.pos)"""


def _keyed_reference(tag, where):
    return f"""{tag}a AS (SELECT *, pos - lag(pos) OVER (PARTITION BY camera_id, evaluation ORDER BY pos, loop) AS gap FROM reg WHERE {where}),
{tag}b AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, evaluation ORDER BY pos, loop) AS c FROM {tag}a),
{tag}e AS (SELECT camera_id, evaluation, max(c) AS lastc, min(pos) AS lo, max(pos) AS hi FROM {tag}b GROUP BY ALL),
{tag}c AS (SELECT camera_id, evaluation, CASE WHEN lastc > 1 AND lo + 1000 - hi <= 20 AND c = lastc THEN 1 ELSE c END AS k, median(pos) AS x
  FROM {tag}b JOIN {tag}e USING (camera_id, evaluation) GROUP BY 1, 2, 3),
{tag}v AS (SELECT r.camera_id, r.evaluation, r.k, count(DISTINCT v.loop) AS could FROM {tag}c r JOIN ec v
  ON v.camera_id = r.camera_id AND v.evaluation = r.evaluation AND v.cell = floor(r.x / 8) WHERE {where} GROUP BY ALL),
{tag}h AS (SELECT r.camera_id, r.evaluation, r.k, count(DISTINCT w.loop) AS hits FROM {tag}c r JOIN reg w
  ON w.camera_id = r.camera_id AND w.evaluation = r.evaluation AND abs({_circ('w.pos - r.x')}) <= 20 WHERE {where} GROUP BY ALL),
{tag} AS (SELECT camera_id, evaluation, x, could, hits FROM {tag}c JOIN {tag}v USING (camera_id, evaluation, k) JOIN {tag}h USING (camera_id, evaluation, k)
  WHERE hits >= least(2, could) AND hits >= 0.5 * could)"""


MISSING = _keyed_reference("erf", "rank >= 2") + f""",
lost AS (SELECT camera_id, evaluation, x FROM erf r WHERE (SELECT max(rank) FROM ec WHERE ec.camera_id = r.camera_id AND ec.evaluation = r.evaluation) >= 3
  AND (SELECT count(DISTINCT rank) FROM ec WHERE ec.camera_id = r.camera_id AND ec.evaluation = r.evaluation AND rank < 2 AND cell = floor(r.x / 8)) = 2
  AND NOT EXISTS (SELECT 1 FROM reg w WHERE w.camera_id = r.camera_id AND w.evaluation = r.evaluation AND rank < 2 AND abs({_circ('w.pos - r.x')}) <= 20))"""
CAMERA = ["camera_id"]
KEYED = ["camera_id", "evaluation"]
SHAPE = ops.Ring(RING, 3.0, 10.0, 100, 150.0, 40, 4, 10.0)


def _two_rings(spark, sf):
    """Objects and readable cells of two cameras; a quarter of the objects is absent in a pass, and passes are shifted."""
    e = t.table(spark, sf, "events").withColumn("camera_id", F.concat(F.lit("CAM-"), F.col("event_id") % 2 + 4))
    made = e.groupBy("camera_id", F.floor(F.col("event_id") / 50).alias("k")).agg(F.sum("user_id").alias("u")).filter("u % 4 <> 0")
    loop = F.floor(F.col("k") / 20)
    at = (F.col("k") * 50 % 1000 + 25 + F.col("u") % 21 - 10 + loop % 4 * 12 + 1000) % 1000
    wheels = made.select("camera_id", loop.alias("loop"), at.cast("double").alias("pos"))
    seen = e.groupBy("camera_id", F.floor(F.col("event_id") / 1000).alias("loop"), F.floor(F.col("event_id") % 1000 / 8).alias("cell"))
    coverage = seen.agg(F.sum("user_id").alias("u")).filter("u % 7 <> 0").drop("u")
    passes = wheels.select("camera_id", "loop").union(coverage.select("camera_id", "loop")).withColumn("lock_no", F.floor(F.col("loop") / 12))
    return wheels, coverage, ops.sliding_evaluations(passes, CAMERA, "lock_no")


def _registered_two(spark, sf):
    wheels, coverage, seen = _two_rings(spark, sf)
    pick = seen.select(*KEYED, "rank", "loop")
    ours, readable = (settle(df.join(pick, ["camera_id", "loop"])) for df in (wheels, coverage))
    moved = ops.register_passes(ours.drop("rank"), readable, RING, 150.0, 40, 4, 10.0, KEYED)
    return moved.join(pick, [*KEYED, "loop"]), readable


@query("sliding_evaluations", with_views(TWO_RINGS) + "SELECT * FROM seen")
def sliding_evaluations(spark, sf):
    return _two_rings(spark, sf)[2]


@query("evaluation_registration", with_views(TWO_RINGS, REGISTERED) + "SELECT camera_id, evaluation, rank, loop, shift, pos FROM reg")
def evaluation_registration(spark, sf):
    moved, _ = _registered_two(spark, sf)
    return moved.select("camera_id", "evaluation", "rank", "loop", "shift", F.col("registered").alias("pos"))


@query("evaluation_references", with_views(TWO_RINGS, REGISTERED, _keyed_reference("refs", "rank >= 0")) + "SELECT * FROM refs")
def evaluation_references(spark, sf):
    moved, readable = _registered_two(spark, sf)
    at = moved.select(*KEYED, "loop", F.col("registered").alias("pos"))
    return ops.reference_objects(at, readable, RING, MATCH_AT, KEYED)


@query("missing_objects", with_views(TWO_RINGS, REGISTERED, MISSING) + "SELECT * FROM lost")
def missing_objects(spark, sf):
    moved, readable = _registered_two(spark, sf)
    at = moved.select(*KEYED, "loop", "rank", F.col("registered").alias("pos"))
    return ops.missing_objects(at, readable, RING, MATCH_AT, KEYED)


_ID = "CAST(floor(({0} - 3 - 1000 * floor(({0} - 3) / 1000)) / 10) AS BIGINT) % 100"
FOUND = f"""ids AS (SELECT camera_id, evaluation, id, coalesce(objects, 0) AS objects, coalesce(covered, false) AS covered FROM (
    SELECT DISTINCT camera_id, evaluation FROM refs) CROSS JOIN range(100) g(id)
  LEFT JOIN (SELECT camera_id, evaluation, {_ID.format('x')} AS id, count(*) AS objects FROM refs GROUP BY ALL) USING (camera_id, evaluation, id)
  LEFT JOIN (SELECT DISTINCT camera_id, evaluation, {_ID.format('cell * 8')} AS id, true AS covered FROM ec) USING (camera_id, evaluation, id)),
gp AS (SELECT camera_id, evaluation, id, coalesce(lag(id) OVER w, max(id) OVER (PARTITION BY camera_id, evaluation) - 100) AS p FROM ids
  WHERE objects > 0 OR NOT covered WINDOW w AS (PARTITION BY camera_id, evaluation ORDER BY id)),
hot AS (SELECT a.camera_id, a.evaluation, a.id FROM ids a JOIN ids b ON b.camera_id = a.camera_id AND b.evaluation = a.evaluation AND (b.id - a.id + 100) % 100 < 3
  GROUP BY ALL HAVING sum(b.objects) >= 2),
hg AS (SELECT *, sum(CASE WHEN p IS NULL OR id - p > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY camera_id, evaluation ORDER BY id) AS g
  FROM (SELECT *, lag(id) OVER (PARTITION BY camera_id, evaluation ORDER BY id) AS p FROM hot)),
sp AS (SELECT camera_id, evaluation, g, min(id) AS a, max(id) + 2 AS b FROM hg GROUP BY ALL),
en AS (SELECT camera_id, evaluation, max(g) AS lastg, min(a) AS mina, max(b) AS maxb FROM sp GROUP BY ALL),
mg AS (SELECT camera_id, evaluation, CASE WHEN joins THEN 1 ELSE g END AS g, min(CASE WHEN joins THEN a - 100 ELSE a END) AS a, max(CASE WHEN joins THEN a - 100 ELSE b END) AS b
  FROM (SELECT *, lastg > 1 AND maxb + 1 >= mina + 100 AND g = lastg AS joins FROM sp JOIN en USING (camera_id, evaluation)) GROUP BY 1, 2, 3),
ob AS (SELECT mg.*, r.id + k * 100 AS id, r.objects FROM mg JOIN ids r USING (camera_id, evaluation), range(-1, 2) z(k) WHERE r.objects > 0 AND r.id + k * 100 BETWEEN a AND b),
ds AS (SELECT camera_id, evaluation, a, b, sum(objects) AS objects, coalesce(min(s), 0) AS s FROM (
    SELECT *, CASE WHEN objects > 1 THEN 0 ELSE id - lag(id) OVER (PARTITION BY camera_id, evaluation, a ORDER BY id) END AS s FROM ob) GROUP BY ALL),
found AS (SELECT camera_id, evaluation, 'wheel_gap' AS kind, (p + 101) % 100 AS first_id, (id + 99) % 100 AS last_id, id - p - 1 AS ids, 0 AS objects, NULL::BIGINT AS min_spacing
  FROM gp WHERE id - p - 1 >= 5
  UNION ALL SELECT camera_id, evaluation, 'wheel_density', (a + 100) % 100, b % 100, (b - a) % 100 + 1, CAST(objects AS BIGINT), s FROM ds
  UNION ALL SELECT camera_id, evaluation, 'wheel_missing', {_ID.format('x')}, {_ID.format('x')}, 1, 0, NULL FROM lost SEMI JOIN refs USING (camera_id, evaluation))"""


@query("ring_evaluation", with_views(TWO_RINGS, REGISTERED, _keyed_reference("refs", "rank >= 0"), MISSING, FOUND) + "SELECT * FROM found")
def ring_evaluation(spark, sf):
    wheels, coverage, seen = _two_rings(spark, sf)
    return ops.evaluated_rings(wheels, coverage, settle(seen), CAMERA, SHAPE, MATCH_AT)[0]


@query("ring_events")
def ring_events(spark, sf):
    wheels, coverage, seen = _two_rings(spark, sf)
    found, evaluations = ops.evaluated_rings(wheels, coverage, settle(seen), CAMERA, SHAPE, MATCH_AT)
    found = settle(found)
    changes = settle(ops.flagged(found, evaluations, CAMERA, 100, "CAM"))
    out = ops.measured_events(changes, found, evaluations, CAMERA, 100)
    return out.withColumn("measurements", F.to_json("measurements"))


RINGS = """ring AS (SELECT p_partkey AS id, p_partkey % 53 <> 0 AS covered,
    coalesce((SELECT count(*) // 30 FROM lineitem l WHERE l.l_partkey = p.p_partkey), 0) AS objects FROM part p),
size AS (SELECT count(*) AS n FROM part)"""


def _ring(spark, sf):
    found = t.table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("id"))
    found = found.agg(F.floor(F.count(F.lit(1)) / 30).alias("objects"))
    ids = t.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 53 != 0).alias("covered"))
    return ids.join(found, "id", "left").withColumn("objects", F.coalesce("objects", F.lit(0)))


@query(
    "gap_rule",
    with_views(
        RINGS,
        "solid AS (SELECT id FROM ring WHERE objects > 0 OR NOT covered)",
        "g AS (SELECT id, coalesce(lag(id) OVER (ORDER BY id), (SELECT max(id) FROM solid) - n) AS p, n FROM solid, size)",
    )
    + "SELECT (p + 1 + n) % n AS first_id, (id - 1 + n) % n AS last_id, id - p - 1 AS ids FROM g WHERE id - p - 1 >= 5",
)
def gap_rule(spark, sf):
    n = t.table(spark, sf, "part").agg(F.count(F.lit(1)).alias("n"))
    return ops.ring_gaps(_ring(spark, sf), Lane((), "id"), n)


DENSITY = """hot AS (SELECT a.id FROM ring a, size, ring b WHERE (b.id - a.id + n) % n < 3 GROUP BY a.id HAVING sum(b.objects) >= 2),
hg AS (SELECT id, sum(CASE WHEN p IS NULL OR id - p > 3 THEN 1 ELSE 0 END) OVER (ORDER BY id) AS g
  FROM (SELECT id, lag(id) OVER (ORDER BY id) AS p FROM hot)),
sp AS (SELECT g, min(id) AS a, max(id) + 2 AS b FROM hg GROUP BY g),
en AS (SELECT max(g) AS lastg, min(a) AS mina, max(b) AS maxb FROM sp),
mg AS (SELECT CASE WHEN lastg > 1 AND maxb + 1 >= mina + n AND g = lastg THEN 1 ELSE g END AS g,
    min(CASE WHEN lastg > 1 AND maxb + 1 >= mina + n AND g = lastg THEN a - n ELSE a END) AS a,
    max(CASE WHEN lastg > 1 AND maxb + 1 >= mina + n AND g = lastg THEN a - n ELSE b END) AS b FROM sp, en, size GROUP BY 1),
ob AS (SELECT mg.a, mg.b, r.id + k * n AS id, r.objects FROM mg, ring r, size, range(-1, 2) AS z(k)
  WHERE r.objects > 0 AND r.id + k * n BETWEEN mg.a AND mg.b),
sps AS (SELECT a, b, objects, CASE WHEN objects > 1 THEN 0 ELSE id - lag(id) OVER (PARTITION BY a ORDER BY id) END AS s FROM ob)"""


@query(
    "density_rule",
    with_views(RINGS, DENSITY)
    + """SELECT (a + n) % n AS first_id, b % n AS last_id, (b - a) % n + 1 AS ids, CAST(sum(objects) AS BIGINT) AS objects,
      coalesce(min(s), 0) AS min_spacing FROM sps, size GROUP BY a, b, n""",
)
def density_rule(spark, sf):
    n = t.table(spark, sf, "part").count()
    return ops.ring_density(_ring(spark, sf), Lane((), "id"), n)


def _flags(spark, sf):
    e = t.table(spark, sf, "events")
    kinds = F.when(F.col("event_type") == "error", "wheel_gap").when(F.col("event_type") == "view", "wheel_missing").otherwise("wheel_density")
    first = F.floor((F.col("event_id") % 500) / 10)
    rows = e.select(
        kinds.alias("kind"), F.floor(F.col("event_id") / 500).alias("loop"),
        F.when(F.col("value") > 120, F.struct(first.alias("first"), ((first + F.col("user_id") % 2) % 50).alias("last"))).alias("span"),
    )
    found = rows.groupBy("kind", "loop").agg(F.collect_set("span").alias("found"))
    return ops.track_flags(found, Lane(("kind",), "loop"), "kind", 50, "CAM-4")


@query("stable_flags")
def stable_flags(spark, sf):
    return _flags(spark, sf)


@query("flag_events")
def flag_events(spark, sf):
    out = ops.flag_events(_flags(spark, sf), ["kind"], "loop", 50)
    return out.select("kind", "event_key", "loop", "state", F.to_json("measurements").alias("measurements"))


@query("active_flag_counts")
def active_flag_counts(spark, sf):
    return ops.active_counts(_flags(spark, sf), ["kind"], "loop")
