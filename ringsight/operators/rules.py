"""Loop rules over the element history.

Rows are first reduced per (element, loop), which is where a hot element or a re-sent loop is absorbed by
map-side aggregation. What remains per element is one row per loop, so windows by element are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.functions.numeric import half_even, median_of, violations
from ringsight.operators.quantiles import grouped_quantiles
from ringsight.session import settle

# Fixed values of the loop rules.
HISTORY_LOOPS = 3
DROP_ROWS = 25.0
SPLAY_RISE = 1.0
BROKEN_FILL = 0.7
POPULATION_SHARE = 0.05
SLOPE_LEFT, SLOPE_RIGHT = 0.02, 0.02
TEMPLATE_WINDOW, TEMPLATE_LEAST, TEMPLATE_PEAK = 200, 50, 0.5
TRIGGER_SPAN_US, TRIGGER_RECENT_US, TRIGGER_LEAST = 120_000_000, 60_000_000, 60


def last_loops(df: DataFrame, size: int = HISTORY_LOOPS) -> DataFrame:
    """The latest existing loops; one row each."""
    return df.select("loop").distinct().orderBy(F.col("loop").desc()).limit(size)


def finished_rows(df: DataFrame, completed: DataFrame) -> DataFrame:
    """Rows up to the newest completed loop, so that a loop that still runs decides nothing.

    ``completed`` comes from ``completed_loops``. Without a completed loop no row is left.
    """
    frontier = completed.filter("complete").agg(F.max("loop").alias("_frontier"))  # one row
    return df.crossJoin(F.broadcast(frontier)).filter(F.col("loop") <= F.col("_frontier")).drop("_frontier")


def persistent_list(df: DataFrame, size: int = HISTORY_LOOPS) -> DataFrame:
    """Elements seen short in at least two of the latest loops."""
    recent = df.join(F.broadcast(last_loops(df, size)), "loop", "left_semi").filter("n_views > 0")
    edge = (F.col("status_left") == "edge") | (F.col("status_right") == "edge")
    # Only the latest loops are kept, so this stage is small beside the table it is read from.
    staged = settle(
        recent.select(
            "element_id", "loop", "lip", "short_any", F.least("fill_left", "fill_right").alias("_fill"),
            edge.cast("double").alias("_edge"),
        )
    )
    per_loop = staged.groupBy("element_id", "loop").agg(
        F.max("short_any").alias("_short"), F.sum("_edge").alias("_e"), F.count("_edge").alias("_n")
    )
    counts = per_loop.groupBy("element_id").agg(
        F.count(F.lit(1)).alias("loops_seen"),
        F.count(F.when(F.col("_short"), 1)).alias("loops_short"),
        (F.sum("_e") / F.sum("_n") >= 0.5).alias("near_plate"),
    )
    chosen = counts.filter("loops_seen >= 2 AND loops_short >= 2")
    typical = grouped_quantiles(
        staged, ["element_id"], {"lip_median": (F.col("lip"), 0.5), "fill_median": (F.col("_fill"), 0.5)}
    )
    out = chosen.join(typical, "element_id", "left")
    out = out.withColumn("fill_median", half_even(F.col("fill_median"), 2))
    out = out.withColumn("broken", F.coalesce(F.col("fill_median") < BROKEN_FILL, F.lit(False)))
    return out.orderBy("near_plate", F.col("broken").desc(), "lip_median")


def near_plate_ids(persistent: DataFrame) -> DataFrame:
    return persistent.filter("near_plate").select("element_id")


def _loop_table(df: DataFrame, near: DataFrame | None, **aggs: Column) -> DataFrame:
    """Two-view rows per (element, loop) with the rank of the loop among the existing ones."""
    two = df.filter("n_views = 2")
    loops = two.select("loop").distinct()  # one row per loop
    ranked = loops.withColumn("_rank", F.row_number().over(Window.orderBy("loop")))
    table = two.groupBy("element_id", "loop").agg(*[e.alias(n) for n, e in aggs.items()])
    if near is not None:
        table = table.join(near.select("element_id"), "element_id", "left_anti")
    return table.join(ranked, "loop")


def _history(value: str, size: int = HISTORY_LOOPS):
    window = Window.partitionBy("element_id").orderBy("_rank").rangeBetween(-size, -1)
    return median_of(F.col(value)).over(window), F.count(value).over(window)


def _following(value: str) -> Column:
    """The element's value in loop number + 1, NULL when that loop did not see it."""
    return F.max(value).over(Window.partitionBy("element_id").orderBy("loop").rangeBetween(1, 1))


def new_drop_alerts(df: DataFrame, near: DataFrame | None = None, drop: float = DROP_ROWS) -> DataFrame:
    """Elements whose lip drops against their own last loops, judged by the loop that follows."""
    table = _loop_table(df, near, lip=F.min("lip"), both=F.max("short_both"))
    base, known = _history("lip")
    staged = table.select("element_id", "loop", "lip", "both", base.alias("base"), known.alias("known"), _following("lip").alias("next"))
    low = F.col("base") - drop
    status = (
        F.when(F.col("next").isNull(), "pending").when(F.col("next") <= low, "confirmed").otherwise("not confirmed")
    )
    hits = staged.filter((F.col("known") >= 2) & (F.col("lip") <= low) & F.col("both"))
    return hits.select(
        "element_id", "loop", F.col("base").alias("lip_before"), F.col("lip").alias("lip_now"),
        (F.col("base") - F.col("lip")).alias("drop"), status.alias("status"),
    )


def splay_alerts(df: DataFrame, near: DataFrame | None = None, rise: float = SPLAY_RISE) -> DataFrame:
    """Elements whose two straightness values both rise against their own last loops."""
    table = _loop_table(df, near, left=F.min("straight_left"), right=F.min("straight_right"))
    base_l, known_l = _history("left")
    base_r, known_r = _history("right")
    s = table.select(
        "element_id", "loop", "left", "right", base_l.alias("bl"), base_r.alias("br"), known_l.alias("kl"),
        known_r.alias("kr"), _following("left").alias("nl"), _following("right").alias("nr"),
    )
    up = lambda a, b: (F.col(a) >= F.col("bl") + rise) & (F.col(b) >= F.col("br") + rise)
    hits = s.filter((F.col("kl") >= 2) & (F.col("kr") >= 2) & up("left", "right"))
    status = (
        F.when(F.col("nl").isNull() | F.col("nr").isNull(), "pending").when(up("nl", "nr"), "confirmed")
        .otherwise("not confirmed")
    )
    return hits.select(
        "element_id", "loop",
        half_even((F.col("bl") + F.col("br")) / 2, 2).alias("s_before"),
        half_even((F.col("left") + F.col("right")) / 2, 2).alias("s_now"),
        half_even(F.least(F.col("left") - F.col("bl"), F.col("right") - F.col("br")), 2).alias("rise"),
        status.alias("status"),
    )


def nonparallel_list(
    df: DataFrame, slope_left: float, slope_right: float, near: DataFrame | None = None,
    limit_left: float = SLOPE_LEFT, limit_right: float = SLOPE_RIGHT,
) -> DataFrame:
    """Elements whose typical slopes both differ from the template's."""
    two = df.filter("n_views = 2")
    counts = two.groupBy("element_id").agg(F.count(F.lit(1)).alias("loops")).filter("loops >= 3")
    typical = grouped_quantiles(
        two,
        ["element_id"],
        {
            "dev_left": (F.col("slope_left") - slope_left, 0.5),
            "dev_right": (F.col("slope_right") - slope_right, 0.5),
            "lip_median": (F.col("lip"), 0.5),
        },
    )
    out = counts.join(typical, "element_id")
    if near is not None:
        out = out.join(near.select("element_id"), "element_id", "left_anti")
    out = out.filter((F.abs("dev_left") >= limit_left) & (F.abs("dev_right") >= limit_right))
    out = out.select(
        "element_id", "loops", half_even(F.col("dev_left"), 4).alias("dev_left"),
        half_even(F.col("dev_right"), 4).alias("dev_right"), half_even(F.col("lip_median")).alias("lip_median"),
    )
    return out.orderBy(F.least(F.abs("dev_left"), F.abs("dev_right")).desc())


def completed_loops(rows: DataFrame, starts: DataFrame) -> DataFrame:
    """Loops whose successor has started and all of whose rows are there."""
    spans = starts.withColumn("_next", F.lead("start").over(Window.orderBy("loop")))  # one row per loop
    have = rows.groupBy("loop").agg(F.count(F.lit(1)).alias("rows_seen"))
    joined = spans.join(have, "loop", "left").withColumn("rows_seen", F.coalesce("rows_seen", F.lit(0)))
    done = F.col("_next").isNotNull() & (F.col("rows_seen") >= F.col("_next") - F.col("start"))
    return joined.withColumn("complete", done & (F.col("rows_seen") > 0)).drop("_next")


def emit_once(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First event of every key; later states of the same key are not emitted again."""
    rest = [c for c in events.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order))
    return events.groupBy(*keys).agg(first.alias("_row")).select(*keys, "_row.*")


def template_lost(df: DataFrame, keys: list[str], order: str, peak: str, limit: float = TEMPLATE_PEAK) -> DataFrame:
    """Whether the median match peak of the latest rows is too low."""
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    latest = df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= TEMPLATE_WINDOW)
    out = latest.groupBy(*keys).agg(F.percentile(peak, F.lit(0.5)).alias("median_peak"), F.count(peak).alias("_n"))
    lost = (F.col("_n") >= TEMPLATE_LEAST) & (F.col("median_peak") < limit)
    return out.withColumn("template_lost", lost).drop("_n")


def trigger_lost(
    df: DataFrame, keys: list[str], at_us: str, span: int = TRIGGER_SPAN_US, recent: int = TRIGGER_RECENT_US,
    least: int = TRIGGER_LEAST,
) -> DataFrame:
    """Whether too few captures came lately although the lane has run long enough."""
    ends = df.groupBy(*keys).agg(F.max(at_us).alias("_last"), F.min(at_us).alias("_first"))
    joined = df.join(ends, keys)
    out = joined.groupBy(*keys, "_last", "_first").agg(
        F.count(F.when(F.col("_last") - F.col(at_us) < recent, 1)).alias("recent_captures")
    )
    lost = (F.col("_last") - F.col("_first") >= span) & (F.col("recent_captures") < least)
    return out.select(*keys, "recent_captures", lost.alias("trigger_lost"))


def population_change(df: DataFrame, drop: float = DROP_ROWS, share: float = POPULATION_SHARE) -> DataFrame:
    """Per loop: covered elements, how many dropped, and whether that is too many to be damage."""
    table = _loop_table(df, None, lip=F.min("lip"))
    base, _ = _history("lip")
    staged = table.select("loop", "_rank", "lip", base.alias("base"))
    covered = F.col("base").isNotNull() & F.col("lip").isNotNull()
    out = staged.filter("_rank > 1").groupBy("loop").agg(
        F.count(F.when(covered, 1)).alias("covered"),
        F.count(F.when(covered & (F.col("lip") <= F.col("base") - drop), 1)).alias("dropped"),
    )
    return out.withColumn("alarm", (F.col("covered") > 0) & (F.col("dropped") / F.col("covered") > share))


PRIORITY = ["confirmed", "pending", "persistent", "healthy"]  # fixed order


def current_states(alerts: DataFrame, splay: DataFrame, persistent: DataFrame) -> DataFrame:
    """Worst current state of every flagged element."""
    marks = alerts.select("element_id", "status").unionByName(splay.select("element_id", "status"))
    marks = marks.filter(F.col("status").isin("confirmed", "pending"))
    marks = marks.unionByName(persistent.select("element_id", F.lit("persistent").alias("status")))
    rank = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("status"))
    best = marks.groupBy("element_id").agg(F.min(rank).alias("_p"))
    return best.select("element_id", F.element_at(F.array(*[F.lit(p) for p in PRIORITY]), F.col("_p").cast("int")).alias("state"))


def latest_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """Newest row of every element and its mean lip in the last three loops it was seen in."""
    rest = [c for c in df.columns if c != "element_id"]
    newest = df.groupBy("element_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    per_loop = df.groupBy("element_id", "loop").agg(F.avg("lip").alias("_lip"))
    window = Window.partitionBy("element_id").orderBy(F.col("loop").desc())
    last = per_loop.withColumn("_r", F.row_number().over(window)).filter(F.col("_r") <= HISTORY_LOOPS)
    lists = last.groupBy("element_id").agg(F.sort_array(F.collect_list(F.struct("loop", "_lip"))).alias("_h"))
    out = newest.join(lists, "element_id")
    history = F.transform("_h", lambda s: F.coalesce(s["_lip"], F.lit(0.0)))
    return out.select("element_id", "_row.*", history.alias("lip_history"))


def evidence_feed(events: DataFrame, rows: DataFrame, frame: str, slot: str) -> DataFrame:
    """Events with the frame of the latest row of the same element and loop that has one."""
    shown = rows.filter(F.col(frame).isNotNull()).groupBy("element_id", "loop").agg(
        F.max_by(frame, slot).alias("evidence_frame")
    )
    return events.join(shown, ["element_id", "loop"], "left")


def requested_only(df: DataFrame, requested: DataFrame | None, key: str = "element_id") -> DataFrame:
    """Rows of the requested elements; no request means all."""
    return df if requested is None else df.join(requested.select(key), key, "left_semi")


def trigger_lane_status() -> tuple[Column, Column]:
    """Status and detail of a trigger lane from its flags, most serious first."""
    lines = F.concat_ws("; ", F.array_compact(F.array("template_line", "drift_line", "trigger_line", "population_line")))
    lines = F.when(lines == "", "all clear").otherwise(lines)
    status = (
        F.when(F.col("chain_changed"), "resyncing").when(F.col("resyncing"), "resyncing")
        .when(F.col("template_line").isNotNull(), "template_lost").when(~F.col("locked"), "not_ready")
        .when(F.col("trigger_line").isNotNull(), "trigger_lost")
        .when(F.col("population_line").isNotNull(), "population_alarm").otherwise("ok")
    )
    changed = F.concat_ws("; ", F.lit("chain order changed: rebuild master (runbook)"), F.nullif(lines, F.lit("all clear")))
    detail = (
        F.when(F.col("chain_changed"), changed)
        .when(F.col("resyncing"), "loop re-alignment in progress")
        .when(F.col("template_line").isNotNull(), lines)
        .when(~F.col("locked"), "collecting first loop+300 slots for alignment")
        .otherwise(lines)
    )
    return status, detail


SIDE_POPULATION_ALARM, SIDE_ELEMENTS = 0.15, 300  # fixed values


def side_lane_status() -> tuple[Column, Column]:
    """Status and detail of a side-plate lane.

    Needs view_lost, locked, resyncing, ever_locked, history_ready, elements, confirmed_share, rate,
    repeated_share, stopped, empty_share and passes.
    """
    populated = F.col("history_ready") & (F.col("elements") >= SIDE_ELEMENTS) & (F.col("confirmed_share") > SIDE_POPULATION_ALARM)
    relock = ~F.col("locked") & (F.col("resyncing") | F.col("ever_locked"))
    status = (
        F.when(F.col("view_lost"), "template_lost").when(relock, "resyncing").when(~F.col("locked"), "not_ready")
        .when(populated, "population_alarm").otherwise("ok")
    )
    head = (
        F.when(F.col("view_lost"), "view lost").when(relock, "lost the chain map: re-locking")
        .when(~F.col("locked"), "locking onto the chain map").when(populated, "too many elements confirmed")
    )
    known = F.col("rate").isNotNull()
    repeats = F.coalesce(F.col("repeated_share") > 0.2, F.lit(False))
    losing = known & (repeats | (F.col("rate") < 20))
    lines = F.array(
        head,
        F.when(losing, "camera stream losing frames"),
        F.when(F.col("stopped") & ~repeats, "conveyor stopped"),
        F.when(F.col("empty_share") > 0.5, "conveyor empty: plates not judged"),
        F.when(~F.col("history_ready"), F.concat(F.lit("history building: "), F.col("passes").cast("string"), F.lit(" of 300 needed"))),
    )
    text = F.concat_ws("; ", F.array_compact(lines))
    return status, F.when(text == "", "all clear").otherwise(text)


STATES = ["healthy", "suspect", "pending", "confirmed", "persistent"]  # fixed values


def state_violations() -> Column:
    """Rules an element state breaks."""
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    return violations(
        (F.col("element_id") > 0, "element_id"),
        (F.col("state").isin(STATES), "state"),
        (F.col("lip").isNull() | finite(F.col("lip")), "lip"),
        (F.col("severity").isNull() | finite(F.col("severity")), "severity"),
        (F.col("has_health"), "health"),
    )
