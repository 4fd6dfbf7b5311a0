"""Window reports, counters, label evaluation and comparisons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringsight.operators.fold import lane_fold
from ringsight.operators.ordered import Lane
from ringsight.operators.quantiles import grouped_quantiles


def window_rows(df: DataFrame, at: str, start: int, end: int) -> DataFrame:
    return df.filter((F.col(at) >= start) & (F.col(at) < end))


def window_report(df: DataFrame) -> DataFrame:
    """Totals of a report window."""
    seen = F.col("seen_us").isNotNull()
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct("element_id").alias("elements"),
        F.count(F.when(F.col("state") == "pending", 1)).alias("pending"),
        F.count(F.when(F.col("state") == "confirmed", 1)).alias("confirmed"),
        F.count(F.when(seen, 1)).alias("seen"), F.count(F.when(~seen, 1)).alias("unseen"),
        F.array_join(F.sort_array(F.collect_set("model_version")), ",").alias("versions"),
    )


def number_cell(json: Column, path: str) -> Column:
    """Number in a JSON text, NULL when it is not numeric."""
    return F.get_json_object(json, path).try_cast("double")


def report_lines(df: DataFrame) -> DataFrame:
    """Detail lines of a report, ordered by element, loop and time."""
    line = F.concat_ws(
        " | ", F.col("element_id").cast("string"), F.col("loop_no").cast("string"), "state",
        F.coalesce(F.format_string("%.1f", "drop"), F.lit("")), F.when(F.col("seen_us").isNull(), "no").otherwise("yes"),
    )
    return df.orderBy("element_id", "loop_no", "detected_us", "alert_id").select(line.alias("value"))


def window_counters(df: DataFrame, camera: str, at_us: str, width_us: int) -> DataFrame:
    """Processed, stored, upserted and dropped per camera and window, with the versions seen."""
    window = F.floor(F.col(at_us) / width_us)
    outcome = lambda v: F.count(F.when(F.col("outcome") == v, 1))
    return df.groupBy(camera, window.alias("window_no")).agg(
        F.count(F.lit(1)).alias("processed"), outcome("stored").alias("stored"), outcome("upsert").alias("upserts"),
        outcome("dropped").alias("dropped"), F.array_join(F.sort_array(F.collect_set("model_version")), ",").alias("versions"),
    )


def readiness(cameras: DataFrame) -> DataFrame:
    """Ready when at least one camera is in its window and all of those are ready."""
    live = F.col("in_window")
    return cameras.agg(
        ((F.count(F.when(live, 1)) > 0) & F.coalesce(F.bool_and(F.when(live, F.col("ready"))), F.lit(False))).alias("ready")
    )


def latest_status(df: DataFrame, camera: str, at: str) -> DataFrame:
    rest = [c for c in df.columns if c != camera]
    return df.groupBy(camera).agg(F.max_by(F.struct(*rest), F.col(at)).alias("_r")).select(camera, "_r.*")


def status_summary(latest: DataFrame, camera: str) -> DataFrame:
    """First camera that is not on standby, else the first."""
    rest = F.struct(*latest.columns)
    pick = F.min_by(rest, F.struct((F.col("status") == "standby").alias("s"), F.col(camera)))
    return latest.agg(pick.alias("_r")).select("_r.*")


def label_evaluation(alerts: DataFrame, labels: DataFrame, key: str, at: str, since: Column) -> DataFrame:
    """Newest recent alert per key against labels: damaged, normal, unlabelled and agreement in type."""
    recent = alerts.filter(F.col(at) >= since)
    rest = [c for c in alerts.columns if c != key]
    newest = recent.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, "alert_id")).alias("_r")).select(key, "_r.*")
    joined = newest.join(labels, key, "left")
    label = F.col("label")
    return joined.agg(
        F.count(F.lit(1)).alias("keys"),
        F.count(F.when(label.isin("C", "O", "B"), 1)).alias("damaged"),
        F.count(F.when(label == "N", 1)).alias("normal"),
        F.count(F.when(label.isNull(), 1)).alias("unlabelled"),
        F.count(F.when(label.isin("C", "O", "B") & ((F.col("found") == "B") == (label == "B"))
                       & (F.col("found").isin("C", "B") == label.isin("C", "B")), 1)).alias("same_type"),
    )


def counter_delta(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Difference of two counter snapshots given as map<string,double> per key."""
    first = before.select(*keys, F.explode("counters").alias("name", "_a"))
    second = after.select(*keys, F.explode("counters").alias("name", "_b"))
    out = second.join(first, [*keys, "name"], "left")
    return out.select(*keys, "name", (F.col("_b") - F.coalesce("_a", F.lit(0.0))).alias("delta"))


def counter_rates(delta: DataFrame, keys: list[str]) -> DataFrame:
    """Columns per picture and lost share, guarded against an idle stretch."""
    value = lambda n: F.coalesce(F.max(F.when(F.col("name") == n, F.col("delta"))), F.lit(0.0))
    frames, cols, lost = value("frames"), value("columns"), value("lost")
    return delta.groupBy(*keys).agg(
        (cols / F.greatest(frames, F.lit(1.0))).alias("columns_per_picture"),
        (lost / F.greatest(frames + lost, F.lit(1.0))).alias("lost_share"),
    )


def minute_rollup(df: DataFrame, keys: list[str], at_us: str, step: str, quality: str, status: str, width_us: int) -> DataFrame:
    """Median step and quality, and the stopped and weak share, per lane and minute."""
    cut = df.withColumn("minute", F.floor(F.col(at_us) / width_us))
    shares = cut.groupBy(*keys, "minute").agg(
        F.count(F.lit(1)).alias("frames"), F.avg((F.col(status) == 2).cast("double")).alias("stopped_share"),
        F.avg((F.col(status) == 1).cast("double")).alias("weak_share"),
    )
    typical = grouped_quantiles(
        cut, [*keys, "minute"], {"median_step": (F.col(step), 0.5), "median_quality": (F.col(quality), 0.5)}
    )
    return shares.join(typical, [*keys, "minute"], "left")


def golden_comparison(
    got: DataFrame, want: DataFrame, keys: list[str], exact: list[str], close: list[str], tolerance: float,
    allowed: Column | None = None,
) -> DataFrame:
    """Counts of matching and differing keys and fields; a mismatch may be in an allowed class."""
    a = got.select(*keys, F.struct(*exact, *close).alias("_a"))
    b = want.select(*keys, F.struct(*exact, *close).alias("_b"))
    both = a.join(b, keys, "full_outer")
    there = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    exact_ok = F.lit(True)
    for c in exact:
        exact_ok = exact_ok & F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}"))
    close_ok = F.lit(True)
    for c in close:
        x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
        close_ok = close_ok & ((x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= tolerance, F.lit(False)))
    ok = F.coalesce(there & exact_ok & close_ok, F.lit(False))
    excuse = F.lit(False) if allowed is None else F.coalesce(allowed, F.lit(False))
    return both.agg(
        F.count(F.when(there, 1)).alias("in_both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("extra"),
        F.count(F.when(F.col("_a").isNull(), 1)).alias("lacking"), F.count(F.when(there & ~exact_ok, 1)).alias("exact_differs"),
        F.count(F.when(there & ~close_ok, 1)).alias("close_differs"), F.count(F.when(ok, 1)).alias("equal"),
        F.count(F.when(~ok & ~excuse, 1)).alias("unexplained"),
    )


def align_step(state: dict, side: str | None, position: int, reach: int) -> list[tuple[int, int | None]]:
    """One-to-one alignment in order: a reference is decided once no nearer target can follow.

    ``side`` is "refs", "targets" or None for the end. Returns decided (reference, target or NULL).
    """
    out = []
    while state["refs"] and position > state["refs"][0] + reach:
        ref = state["refs"].pop(0)
        near = [g for g in state["targets"] if abs(g - ref) <= reach]
        pick = min(near, key=lambda g: (abs(g - ref), g)) if near else None
        if pick is not None:
            state["targets"].remove(pick)
        out.append((ref, pick))
    if side is not None:
        state[side].append(position)
    low = state["refs"][0] if state["refs"] else position
    state["targets"] = [g for g in state["targets"] if g >= low - 2 * reach]
    return out


def align_nearest(refs: DataFrame, targets: DataFrame, at: str, reach: int = 1) -> DataFrame:
    """Each reference position with the nearest unused target within reach, in order."""
    side = lambda df, n: df.select(F.col(at).cast("bigint").alias("at"), F.lit(n).alias("side"))
    both = side(refs, "refs").unionByName(side(targets, "targets"))
    end = both.agg((F.max("at") + reach + 1).alias("at")).select("at", F.lit("~").alias("side"))  # one row

    def fold(state, pdf):
        rows = []
        for p, s in zip(pdf["at"], pdf["side"]):
            rows += align_step(state, None if s == "~" else s, int(p), reach)
        return state, pd.DataFrame(rows, columns=["ref", "target"]).astype("Int64")

    lane = Lane((), "at", ("side",))
    return lane_fold(both.unionByName(end), lane, fold, lambda: {"refs": [], "targets": []}, "ref bigint, target bigint", warm=512)
