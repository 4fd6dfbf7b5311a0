"""The chain from frames to final columns: batch and stream beside a plain loop over frames."""

import statistics

import pytest
from pyspark.sql import functions as F

from ringsight.operators import chain
from ringsight.operators.ordered import Lane, dealt_ranges
from ringsight.operators.signals import add_missing_columns
from ringsight.streaming import pipelines

NAMES = chain.Frames("picture", "shift", "cross_shift", "quality", "value")
REACH = chain.Reach(half=3, margin=5, ring=64, pad=4)
SCHEMA = "camera string, frame bigint, picture string, shift array<double>, cross_shift array<double>, quality array<double>, value double"


def frames(camera, speed):
    """250 frames: some lost, some repeated, one wild jump ahead by many rings, one back, a stretch that stands."""
    out, picture = [], 0
    for i in range(250):
        if i % 41 in (20, 21, 22):
            continue
        picture += i % 23 != 11
        step = 0.125 if 150 <= i < 160 else speed
        jump = 700.0 if i == 90 else -40.0 if i == 200 else 0.0
        shift = [step * k + jump + ((i * k) % 5) / 8 for k in range(1, 5)]
        weak = 0.1 if i % 31 == 7 else 0.75
        out.append((camera, i, None if i % 60 == 5 else f"p{picture}", shift, [0.5, 0.5, 4.0, 0.5], [weak, 0.5, 0.5, 0.25], None if i == 33 else float(i % 9)))
    return out


def loop(rows):
    """All columns as a lane's only reader would build them: whole strip in memory, nothing carried by rule."""
    weight, total, bad, closed = {}, {}, set(), 0
    placed, ways, at, before, half_before = {}, [], None, None, 0
    last = object()
    for _, frame, picture, shift, cross, quality, value in rows:
        if picture is not None and picture == last:
            continue
        last = picture
        usual = statistics.median(ways[-25:]) if ways else 0.0
        if before is None:
            at, own, match = 0.0, 0.0, 0.0
        else:
            start = at + usual * (frame - before - 1)
            own, match = usual, 0.0
            seen = [(k, placed[frame - k]) for k in range(1, 5) if frame - k in placed]
            match = quality[0] if frame - 1 in placed else 0.0
            to = {k: (p + shift[k - 1] - start, quality[k - 1] * k) for k, p in seen if quality[k - 1] > 0.2 and abs(cross[k - 1]) < 3}
            if to:
                centre = to[1][0] if 1 in to and -3 < shift[0] < 80 else statistics.median(v for v, _ in to.values())
                near = [(v, w) for v, w in to.values() if abs(v - centre) <= 2]
                if near:
                    own = sum(v * w for v, w in near) / sum(w for _, w in near)
            own = round(own * chain.STEP_GRID) / chain.STEP_GRID
            previous_at, at = at, start + own
            ways.append(own)
        half = REACH.half
        if before is not None:
            need = -(-abs(at - previous_at) // 1) - half_before + 1
            half = int(min(max(need, half), 60))
        placed[frame], before, half_before = at, frame, half
        want = round(at - half) + REACH.pad - REACH.margin
        closed = max(closed, min(want, closed + REACH.ring))
        for a in range(-half, half + 1):
            col = round(at - a) + REACH.pad
            if closed <= col < closed + REACH.ring:
                w = 1 - abs(a) / (half + 1)
                weight[col] = weight.get(col, 0) + w
                total[col] = total.get(col, 0) + (0 if value is None else w * value)
                if match < 0.3 or own < 4:
                    bad.add(col)
    return [(c, round(weight.get(c, 0.0), 6), round(total.get(c, 0.0) / weight[c], 6) if c in weight else 0.0, c in bad, c not in weight) for c in range(closed)]


@pytest.fixture(scope="module")
def data():
    return {"a": frames("a", 5.5), "b": frames("b", 9.0)}


@pytest.fixture(scope="module")
def want(data):
    return {(c, *row) for c, rows in data.items() for row in loop(rows)}


def rounded(df):
    return {(r.camera, r.col, round(r.weight, 6), round(r.value, 6), r.bad, r.missing) for r in df.collect()}


def close(got, want):
    """The same columns with the same marks; sums may end in another last digit."""
    key = lambda rows: {(r[0], r[1], r[4], r[5]): r[2:4] for r in rows}
    a, b = key(got), key(want)
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=2e-6) for k in a)


@pytest.mark.parametrize("width", [None, 17])
def test_batch_equals_plain_loop(spark, data, want, width):
    df = spark.createDataFrame([r for rows in data.values() for r in rows], SCHEMA).repartition(5)
    got = chain.chain_columns(df, Lane(("camera",), "frame", width=width), NAMES, REACH).collect()
    assert len(got) == len(want) and any(r.missing for r in got) and any(r.bad for r in got)
    close({(r.camera, r.col, round(r.weight, 6), round(r.value, 6), r.bad, r.missing) for r in got}, want)


def test_stream_equals_batch(spark, data, want, tmp_path):
    df = spark.createDataFrame([r for rows in data.values() for r in rows], SCHEMA)
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for low, high in ((0, 11), (11, 91), (91, 93), (93, 250)):  # cut at a repeat and around the jump
        df.filter((F.col("frame") >= low) & (F.col("frame") < high)).coalesce(1).write.mode("append").parquet(src)
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    pipelines.run_available(chain.chain_columns(source, Lane(("camera",), "frame"), NAMES, REACH), out, str(tmp_path / "cp"))
    got = spark.read.parquet(out)
    assert got.count() == len(want)
    close(rounded(got), want)


def test_repeated_pictures_are_lost_frames(spark):
    df = spark.createDataFrame([("a", i, p, [], [], [], 0.0) for i, p in enumerate(["x", "x", "y", None, None, "y", "x", "x", "x"])], SCHEMA)
    got = chain.new_pictures(df, Lane(("camera",), "frame", width=2), "picture")
    assert sorted(r.frame for r in got.collect()) == [0, 2, 3, 4, 5, 6]


def test_no_frames_give_no_columns(spark):
    assert chain.chain_columns(spark.createDataFrame([], SCHEMA), Lane(("camera",), "frame"), NAMES).count() == 0


def test_a_wide_gap_is_dealt_over_tasks(spark):
    gap = spark.createDataFrame([("a", 5, 100_000_004), ("b", 3, 3), ("c", 2, 1)], "lane string, low bigint, high bigint")
    rows = dealt_ranges(gap, "low", "high", "col")
    got = {r.lane: (r.n, r.low, r.high, r.total) for r in rows.groupBy("lane").agg(
        F.count("*").alias("n"), F.min("col").alias("low"), F.max("col").alias("high"), F.sum("col").alias("total")).collect()}
    assert got == {"a": (100_000_000, 5, 100_000_004, 100_000_000 * (5 + 100_000_004) // 2), "b": (1, 3, 3, 3)}
    assert rows.groupBy(F.spark_partition_id()).count().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_missing_columns_between_written_ones(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", 5, 2.0), ("b", 9, 3.0)], "lane string, col bigint, v double")
    got = add_missing_columns(df, Lane(("lane",), "col", width=2))
    assert sorted(tuple(r) for r in got.select("lane", "col", F.coalesce("v", F.lit(-1.0)), "missing").collect()) == [
        ("a", 2, 1.0, False), ("a", 3, -1.0, True), ("a", 4, -1.0, True), ("a", 5, 2.0, False), ("b", 9, 3.0, False)]
