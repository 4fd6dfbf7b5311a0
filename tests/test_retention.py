"""Retention on a dated table: what goes, what is listed, what is left alone."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from ringsight.operators import trigger
from ringsight.operators.ordered import Lane
from ringsight.sources.sinks import DAY_US, append_dated, remove_before

SCHEMA = "alert_id bigint, detected_us bigint, evidence_ref string"


def table(spark, path, unsafe=False):
    """Ten days of four alerts each, six hours apart; one without evidence, two that share a file, one without a time."""
    rows = [(d * 4 + i, d * DAY_US + i * DAY_US // 4, f"d{d}/a{i}.jpg") for d in range(10) for i in range(4)]
    rows[1] = (*rows[1][:2], None)
    rows[3] = (*rows[3][:2], rows[2][2])
    rows[5] = (*rows[5][:2], "../outside.jpg") if unsafe else rows[5]
    append_dated(spark.createDataFrame([*rows, (99, None, "d/none.jpg")], SCHEMA), path, "detected_us")


def content(spark, path):
    return {r.alert_id for r in spark.read.parquet(path).select("alert_id").collect()}


def parts(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{path}/day=*/*.parquet")}


def test_days_go_whole_the_border_day_in_part_and_the_rest_is_untouched(spark, tmp_path):
    path, listing = str(tmp_path / "table"), str(tmp_path / "files")
    table(spark, path)
    before = parts(path)
    files = remove_before(spark, path, "detected_us", 3 * DAY_US + DAY_US // 2, "evidence_ref", listing)
    assert content(spark, path) == {*range(14, 40), 99}
    want = {f"d{d}/a{i}.jpg" for d in range(4) for i in range(4) if d < 3 or i < 2} - {"d0/a1.jpg", "d0/a3.jpg"}
    assert sorted(r.file for r in files.collect()) == sorted(want)
    after = parts(path)
    for day in ("1970-01-05", "1970-01-10", "__HIVE_DEFAULT_PARTITION__"):
        assert {p: m for p, m in before.items() if day in p} == {p: m for p, m in after.items() if day in p} != {}
    assert not glob.glob(f"{path}/day=1970-01-0[123]")
    again = remove_before(spark, path, "detected_us", 3 * DAY_US + DAY_US // 2, "evidence_ref", listing)
    assert again.count() == 0 and parts(path) == after and files.count() == len(want)


def test_a_cutoff_at_midnight_rewrites_nothing(spark, tmp_path):
    path = str(tmp_path / "table")
    table(spark, path)
    before = parts(path)
    remove_before(spark, path, "detected_us", 4 * DAY_US, "evidence_ref", str(tmp_path / "files"))
    assert content(spark, path) == {*range(16, 40), 99} and parts(path).items() <= before.items()


def test_an_unsafe_path_stops_everything(spark, tmp_path):
    path = str(tmp_path / "table")
    table(spark, path, unsafe=True)
    before = parts(path)
    with pytest.raises(ValueError):
        remove_before(spark, path, "detected_us", 5 * DAY_US, "evidence_ref", str(tmp_path / "files"))
    assert parts(path) == before and not os.path.exists(tmp_path / "files")


def test_a_long_gap_of_virtual_slots(spark):
    """A capture 8 * 10^7 frames after the one before it hides four million elements."""
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 80_000_000, 2.0), ("a", 80_000_020, 3.0), ("b", 7, 4.0)], "lane string, at bigint, v double")
    slots = trigger.fill_virtual_slots(df, Lane(("lane",), "at"), "at")
    got = slots.groupBy("lane", "kind").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.count_distinct("slot").alias("d"))
    hidden = 80_000_000 // 20 - 1
    assert {tuple(r) for r in got.collect()} == {("a", "virtual", hidden, 1, hidden, hidden), ("a", "real", 3, 0, hidden + 2, 3), ("b", "real", 1, 0, 0, 1)}
