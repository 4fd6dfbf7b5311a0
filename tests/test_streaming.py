"""Streaming forms give what the batch forms give, also across a restart."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ringsight.operators import sequencing as seq
from ringsight.operators.history import history_states, population_scores
from ringsight.operators.ordered import Lane
from ringsight.streaming import pipelines
from ringsight.streaming.processors import history

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def land(df, path, parts=3, key="arrival"):
    """Write a table as files that arrive one after the other."""
    top = df.agg(F.max(key)).first()[0] + 1
    for i in range(parts):
        low, high = top * i // parts, top * (i + 1) // parts
        df.filter((F.col(key) >= low) & (F.col(key) < high)).coalesce(1).write.mode("append").parquet(path)


def stream(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


@pytest.fixture
def shuffled(spark):
    rnd = random.Random(3)
    data = []
    for lane in ("CAM-1", "CAM-3"):
        numbers = [n for n in range(400) if n % 97 != 50]
        order = sorted(range(len(numbers)), key=lambda i: i + rnd.random() * 12)
        data += [(lane, at, numbers[i]) for at, i in enumerate(order)]
    return spark.createDataFrame(data, "camera_id string, arrival bigint, seq bigint")


def test_reorder_stream_equals_batch(spark, shuffled, tmp_path):
    lane = Lane(("camera_id",), "arrival")
    want = rows(seq.reorder(shuffled, lane, "seq"))
    src = str(tmp_path / "in")
    land(shuffled, src)
    out = seq.reorder(stream(spark, shuffled, src), lane, "seq")
    pipelines.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == want


def test_sampler_resumes_from_checkpoint(spark, shuffled, tmp_path):
    lane = Lane(("camera_id",), "arrival")
    want = rows(seq.spaced_rows(shuffled, lane, "arrival", 7.0))
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for low, high in ((0, 150), (150, 10_000)):
        part = shuffled.filter((F.col("arrival") >= low) & (F.col("arrival") < high))
        part.coalesce(1).write.mode("append").parquet(src)
        sampled = seq.spaced_rows(stream(spark, shuffled, src), lane, "arrival", 7.0)
        pipelines.run_available(sampled, out, cp)
    assert rows(spark.read.parquet(out)) == want


def test_history_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    data = [(i, int(rng.integers(0, 12)), i // 50, float(rng.normal(1, 0.5))) for i in range(500)]
    df = spark.createDataFrame(data, "pass_no bigint, element_id bigint, loop bigint, raw double")
    scored = population_scores(df, Lane((), "pass_no"), "raw", least=60)
    batch = history_states(scored, Lane(("element_id",), "pass_no"), "rel", 0.5, 1.65)
    want = rows(batch.select("element_id", "loop", F.round("rel", 6), "n_passes", F.round("typical_rel", 6), "state", "entered"))
    src = str(tmp_path / "in")
    land(df, src, key="pass_no")
    judged = history(stream(spark, df, src), Lane((), "pass_no"), "element_id", "loop", "raw",
                     {"alarm": 0.5, "pass_alarm": 1.65, "least": 60})
    pipelines.run_available(judged, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.select("element_id", "loop", F.round("rel", 6), "n_passes", F.round("typical", 6), "state", "entered")) == want


def test_alert_upserts_keep_first_values(spark, tmp_path):
    schema = "event_key string, alert_id string, created_at bigint, seen_at bigint, state string, n bigint"
    first = spark.createDataFrame([("a", "id1", 1, None, "pending", 1), ("b", "id2", 1, None, "pending", 2)], schema)
    second = spark.createDataFrame([("a", "id9", 9, None, "confirmed", 3), ("b", "id8", 9, None, "pending", 4)], schema)
    src, table, cp = (str(tmp_path / n) for n in ("in", "table", "cp"))
    for part in (first, second):
        part.coalesce(1).write.mode("append").parquet(src)
        pipelines.alert_upserts(stream(spark, first, src), table, cp, ["n"])
    from ringsight.sources.sinks import current_version

    got = {r["event_key"]: r for r in spark.read.parquet(current_version(spark, table)).collect()}
    assert (got["a"]["alert_id"], got["a"]["created_at"], got["a"]["state"]) == ("id1", 1, "confirmed")
    assert (got["b"]["alert_id"], got["b"]["n"]) == ("id2", 2)


def test_upserts_of_a_second_checkpoint_and_a_repeated_batch(spark, tmp_path):
    from ringsight.sources.sinks import complete_versions, current_version, upsert_parquet

    schema = "event_key string, alert_id string, created_at bigint, seen_at bigint, state string, n bigint"
    row = lambda key, state, n: spark.createDataFrame([(key, f"id{n}", n, None, state, n)], schema)
    table = str(tmp_path / "table")
    for i, key in enumerate("ab"):
        src = str(tmp_path / f"in{i}")
        row(key, "pending", i).coalesce(1).write.parquet(src)
        pipelines.alert_upserts(stream(spark, row("x", "x", 0), src), table, str(tmp_path / f"cp{i}"), ["n"])
    keys = lambda: {r["event_key"]: r["state"] for r in spark.read.parquet(current_version(spark, table)).collect()}
    assert keys() == {"a": "pending", "b": "pending"}
    before = complete_versions(spark, table)
    upsert_parquet(row("c", "pending", 5), table, ["event_key"], ["n"], "job", 0)
    upsert_parquet(row("c", "confirmed", 6), table, ["event_key"], ["n"], "job", 0)  # the same batch again
    assert keys() == {"a": "pending", "b": "pending", "c": "pending"} and len(complete_versions(spark, table)) == len(before) + 1
    upsert_parquet(row("c", "confirmed", 6), table, ["event_key"], ["n"], "job", 1)
    assert keys()["c"] == "confirmed"


def test_only_changes_pass(spark):
    from ringsight.operators.alerts import changed_events

    events = spark.createDataFrame([("a", "pending", 1), ("a", "pending", 2), ("a", "confirmed", 3), ("b", "pending", 4), ("b", "confirmed", 700)],
                                   "event_key string, state string, n bigint")
    stored = spark.createDataFrame([("b", "pending")], "event_key string, state string")
    got = changed_events(events, stored, ["event_key"], "state", "n")
    assert [r["n"] for r in got.orderBy("n").collect()] == [1, 3, 700]


def test_slow_lanes_keep_their_columns(spark, tmp_path):
    """Two lanes, one 100,000 columns ahead; stream equals batch, and batch equals a plain loop."""
    lane = Lane(("camera_id",), "frame")
    data = [(c, i, (100_000.0 + 20 * i if c == "fast" else 1.0 * i), float(i % 7), i % 50 == 0) for c in ("fast", "slow") for i in range(500)]
    df = spark.createDataFrame(data, "camera_id string, frame bigint, pos double, x double, bad boolean")
    args = (lane, "pos", "x", "bad", 3, 12)
    want = {}
    for c in ("fast", "slow"):
        newest, sums = -(10**9), {}
        for _, i, pos, x, bad in (r for r in data if r[0] == c):
            cols = [round(pos - a) for a in range(-3, 4)]
            for a, col in zip(range(-3, 4), cols, strict=True):
                if col >= newest - 12:
                    w = 1 - abs(a) / 4
                    old = sums.get(col, (0.0, 0.0, False))
                    sums[col] = (old[0] + w, old[1] + w * x, old[2] or bad)
            newest = max(newest, *cols)
        want |= {(c, k): (w, v / w, b) for k, (w, v, b) in sums.items() if k < newest - 12}
    batch = {(r["camera_id"], r["col"]): (r["weight"], r["value"], r["bad"]) for r in pipelines.final_columns(df, *args).collect()}
    assert batch.keys() == want.keys() and all(batch[k] == pytest.approx(want[k]) for k in want)
    src = str(tmp_path / "in")
    land(df, src, parts=5, key="frame")
    out = pipelines.final_columns(stream(spark, df, src), *args)
    pipelines.run_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["camera_id"], r["col"]): (r["weight"], r["value"], r["bad"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert max(col for c, col in got if c == "slow") > 480


def test_keys_are_emitted_once_for_ever(spark, tmp_path):
    df = spark.createDataFrame([(f"k{i % 40}", i) for i in range(400)], "key string, arrival bigint")
    src = str(tmp_path / "in")
    land(df, src, parts=4)
    pipelines.run_available(pipelines.emit_once_stream(stream(spark, df, src), ["key"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40


def test_unanswered_requests_come_out(spark, tmp_path):
    req = spark.range(40).select(
        F.col("id").alias("frame_id"), F.lit("CAM-1").alias("camera_id"), F.timestamp_seconds(F.col("id") * 10).alias("sent_at"))
    res = req.filter("frame_id % 3 <> 0").select(
        F.col("frame_id").alias("response_id"), (F.col("sent_at") + F.expr("INTERVAL 1 SECOND")).alias("answered_at"))
    req.coalesce(1).write.parquet(str(tmp_path / "req"))
    res.coalesce(1).write.parquet(str(tmp_path / "res"))
    joined = pipelines.correlate_streams(stream(spark, req, str(tmp_path / "req")), stream(spark, res, str(tmp_path / "res")), "5 SECONDS")
    pipelines.run_available(joined, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.filter("answered").count() == 26
    assert got.filter("NOT answered").count() >= 10


def test_sessions_equal_batch_runs(spark, tmp_path):
    cols = spark.range(600).select(F.lit("L").alias("lane"), F.col("id").alias("col"), ((F.col("id") * 7) % 11 < 5).alias("hidden"))
    cols = cols.withColumn("hidden", F.col("hidden") & (F.col("col") % 40 < 25) & (F.col("col") < 560))
    cols.coalesce(1).write.parquet(str(tmp_path / "in"))
    runs = pipelines.hidden_run_sessions(stream(spark, cols, str(tmp_path / "in")), ["lane"], "col", "hidden", 1)
    pipelines.run_available(runs, str(tmp_path / "out"), str(tmp_path / "cp"))
    from ringsight.operators.wheels import hidden_runs

    want = hidden_runs(cols.withColumn("r", F.lit(True)), Lane(("lane",), "col"), "hidden", "r", 1)
    want = sorted(tuple(r) for r in want.select("first_col", "end_col").collect())
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("first_col", "end_col").collect())
    assert got == want[: len(got)] and len(got) >= len(want) - 3  # the last runs wait for the watermark
