"""The unrolled chain, from frames to final columns.

Frames come with shifts against the frames before them. They are placed by the odometer, each is spread over the columns around its
position, and a column is final once the newest frame has left it behind. The chain is one machine per lane with a state that holds
an absolute position, which no warm-up can guess; in a batch it is therefore taken apart:

* steps of frames forget quickly and are folded block-parallel, positions are their running sum;
* width and the final border of each frame depend on the frames shortly before and are folded block-parallel;
* columns are sums over the accepted writes, and columns that nobody wrote are filled in from dealt ranges.

On a stream the same steps run one after the other with the open columns as state. Both give the same columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringsight.functions.numeric import half_even
from ringsight.operators.fold import lane_fold
from ringsight.operators.ordered import Lane, Running, dealt_ranges, previous, running
from ringsight.operators.signals import (
    FINAL_MARGIN, GRID, bad_frame, coverage_step, empty_columns, odometer_fold, odometer_start, repeat_scores, stacked,
)
from ringsight.session import settle

#: Steps are whole multiples of 1 / STEP_GRID column: exact in nine digits, so that states lose nothing at block borders.
STEP_GRID = 256


@dataclass(frozen=True)
class Reach:
    """Columns a frame writes on either side, how far a column is left behind when it is final, how many columns are open at most,
    and the number of the column at position 0."""

    half: int = 6
    margin: int = FINAL_MARGIN
    ring: int = 4096
    pad: int = 8


@dataclass(frozen=True)
class Frames:
    """Names of the columns of a frame: its picture (bytes or a digest), the arrays of shifts, cross shifts and match qualities against
    the last four frames, and the value that it writes."""

    picture: str
    shift: str
    cross: str
    quality: str
    value: str


def new_pictures(df: DataFrame, lane: Lane, picture: str) -> DataFrame:
    """Frames without those whose picture equals the one before it in the lane: such a frame was lost on the way, the chain did not stop.
    A frame without a picture (null) equals none."""
    same = F.col(picture) == F.col(f"_before.{picture}")
    return previous(df, lane, "_before", picture).filter(~F.coalesce(same, F.lit(False))).drop("_before")


def border_start() -> dict:
    return {"at": None, "half": 0, "final": None}


def border_step(state: dict, position: float, reach: Reach) -> tuple[int, int]:
    """Half width of a frame and the first column that is still open for it.

    The border follows the frame's lowest column at a distance, never back, and by one ring at most: what a wild jump leaves behind is
    closed ring by ring while frames go on.
    """
    half = coverage_step(state, position, reach.half)
    wanted = round(position - half) + reach.pad - reach.margin
    known = state["final"]
    state["final"] = max(0, wanted) if known is None else max(known, min(wanted, known + reach.ring))
    return half, state["final"]


def placed_frames(df: DataFrame, lane: Lane, names: Frames) -> DataFrame:
    """Position, own step and badness of every frame that is not a repeated picture."""
    keys = list(lane.keys)

    def fold(state, pdf):
        numbers = pdf[lane.order].to_numpy(np.int64).tolist()
        state, way, step, plain = odometer_fold(state, numbers, *stacked(pdf, names.shift, names.cross, names.quality), STEP_GRID)
        return state, pdf[[*keys, lane.order, names.value]].assign(way=way, step=step, plain=plain)

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {types[k]}" for k in [*keys, lane.order, names.value]) + ", way double, step double, plain double"
    fresh = settle(new_pictures(df, lane, names.picture))
    steps = settle(lane_fold(fresh, lane, fold, odometer_start, schema, warm=256))
    placed = running(steps, lane, position=Running("sum", F.col("way")))
    return placed.select(*keys, lane.order, names.value, "position", "step", bad_frame(F.col("plain"), F.col("step")).alias("bad"))


def bordered_frames(df: DataFrame, lane: Lane, reach: Reach) -> DataFrame:
    """Placed frames with their half width and the first column open for them."""
    names = df.columns

    def fold(state, pdf):
        found = np.array([border_step(state, p, reach) for p in pdf["position"].tolist()], np.int64).reshape(-1, 2)
        return state, pdf[names].assign(half=found[:, 0], final=found[:, 1])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", half bigint, final bigint"
    return lane_fold(df, lane, fold, border_start, schema, warm=1024)


def written_columns(frames: DataFrame, keys: list[str], value: str, reach: Reach) -> DataFrame:
    """Weighted mean of the accepted writes of each column; columns below the border and those a ring or more above it are refused."""
    spread = frames.withColumn("_a", F.explode(F.sequence(-F.col("half"), F.col("half"))))
    spread = spread.withColumn("col", half_even(F.col("position") - F.col("_a")).cast("bigint") + reach.pad)
    open_now = (F.col("col") >= F.col("final")) & (F.col("col") < F.col("final") + reach.ring)
    weight = 1 - F.abs("_a") / (F.col("half") + 1.0)
    sums = spread.filter(open_now).groupBy(*keys, "col").agg(
        F.sum(weight).alias("weight"), F.sum(weight * F.col(value)).alias("_x"), F.max("bad").alias("bad")
    )
    return sums.select(*keys, "col", "weight", (F.col("_x") / F.col("weight")).alias("value"), "bad")


def chain_columns(df: DataFrame, lane: Lane, names: Frames, reach: Reach = Reach()) -> DataFrame:
    """Final columns of each lane, gapless from 0: col, weight, value, bad, missing; batch or streaming.

    ``lane.order`` is the frame number; numbers that are left out are lost frames. A column nobody wrote is missing: weight and value
    are 0 and it is not bad. A null value writes nothing into the sum but its weight. An empty table gives no columns. Columns of a lane that
    are still open after its last frame do not come out.
    """
    keys = list(lane.keys)
    if df.isStreaming:
        return _streamed(df, lane, names, reach)
    frames = settle(bordered_frames(settle(placed_frames(df, lane, names)), lane, reach))
    wrote = written_columns(frames, keys, names.value, reach)
    ends = frames.groupBy(*keys).agg((F.max("final") - 1).alias("_end"))  # a row per lane
    closed = wrote.join(ends, keys) if keys else wrote.crossJoin(ends)
    closed = settle(closed.filter("col <= _end").drop("_end"))
    there = closed.select(*keys, "col", "weight", F.coalesce("value", F.lit(0.0)).alias("value"), "bad", F.lit(False).alias("missing"))
    absent = dealt_ranges(_gaps(closed, ends, lane), "_low", "_high", "col").select(
        *keys, "col", F.lit(0.0).alias("weight"), F.lit(0.0).alias("value"), F.lit(False).alias("bad"), F.lit(True).alias("missing")
    )
    return there.unionByName(absent)


def _gaps(closed: DataFrame, ends: DataFrame, lane: Lane) -> DataFrame:
    """Stretches of unwritten columns, from 0 to the end of each lane."""
    keys = list(lane.keys)
    edge = ends.select(*keys, (F.col("_end") + 1).alias("col")).filter("col > 0")
    marks = closed.select(*keys, "col").unionByName(edge)
    before = F.coalesce(F.col("_prev.col"), F.lit(-1).cast("bigint"))
    seen = previous(marks, Lane(lane.keys, "col", width=lane.width), "_prev", "col")
    return seen.select(*keys, (before + 1).alias("_low"), (F.col("col") - 1).alias("_high")).filter("_low <= _high")


def _streamed(df: DataFrame, lane: Lane, names: Frames, reach: Reach) -> DataFrame:
    keys = list(lane.keys)
    kinds = {"col": np.int64, "weight": float, "x": float, "bad": bool}

    def start():
        return {"picture": None, "odometer": odometer_start(), "position": 0.0, "border": border_start(), "open": []}

    def fold(state, pdf):
        pictures = pdf[names.picture].map(lambda v: v.hex() if isinstance(v, (bytes, bytearray)) else v).astype(object)
        before = pictures.shift(fill_value=state["picture"])
        fresh = pdf[~((pictures == before) & pictures.notna())]
        last = pictures.iloc[-1] if len(pdf) else state["picture"]
        numbers = fresh[lane.order].to_numpy(np.int64).tolist()
        odometer, way, step, plain = odometer_fold(state["odometer"], numbers, *stacked(fresh, names.shift, names.cross, names.quality), STEP_GRID)
        position = state["position"] + np.cumsum(way)
        border = dict(state["border"])
        begin = border["final"] or 0
        found = np.array([border_step(border, p, reach) for p in position.tolist()], np.int64).reshape(-1, 2)
        end = border["final"] or 0
        half, final = found[:, 0], found[:, 1]
        row = np.repeat(np.arange(len(fresh)), 2 * half + 1)
        way_off = np.concatenate([np.arange(-h, h + 1) for h in half]) if len(half) else np.zeros(0, np.int64)
        col = np.rint(position[row] - way_off).astype(np.int64) + reach.pad
        weight = 1 - np.abs(way_off) / (half[row] + 1.0)
        value = fresh[names.value].to_numpy(float)[row]
        live = (col >= final[row]) & (col < final[row] + reach.ring)
        bad = ((plain < 0.3) | (step < 4.0))[row]
        wrote = pd.DataFrame({"col": col[live], "weight": weight[live], "x": np.nan_to_num(weight * value)[live], "bad": bad[live]})
        held = pd.DataFrame(state["open"], columns=list(kinds)).astype(kinds)
        sums = pd.concat([held, wrote.astype(kinds)]).groupby("col", as_index=False).agg({"weight": "sum", "x": "sum", "bad": "max"})
        done = sums["col"] < end
        rest = [[int(c), float(w), float(x), bool(b)] for c, w, x, b in sums[~done].itertuples(index=False)]
        out = sums[done].set_index("col").reindex(np.arange(begin, end))
        missing = out["weight"].isna()
        out = pd.DataFrame({
            "col": out.index.to_numpy(np.int64), "weight": out["weight"].fillna(0.0).to_numpy(), "value": (out["x"] / out["weight"]).fillna(0.0).to_numpy(),
            "bad": (out["bad"] == True).to_numpy(bool), "missing": missing.to_numpy(bool),  # noqa: E712 - absent is not bad
        })
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0] if len(pdf) else None)
        at = float(position[-1]) if len(position) else state["position"]
        return {"picture": last, "odometer": odometer, "position": at, "border": border, "open": rest}, out

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    head = "".join(f"{k} {types[k]}, " for k in keys)
    return lane_fold(df, lane, fold, start, f"{head}col bigint, weight double, value double, bad boolean, missing boolean", warm=0)


def judged_columns(columns: DataFrame, lane: Lane, value: str, pitch: int, half: int, search: int, limit: float = 0.35, step: int = 4 * GRID) -> DataFrame:
    """Columns with ``empty`` (their surroundings repeat too well, nothing lies there) and ``judged`` (neither missing nor empty)."""
    keys = list(lane.keys)
    columns = settle(columns)
    scores = settle(repeat_scores(columns.select(*keys, lane.order, value), lane, value, pitch, half, search, step))
    marks = empty_columns(scores, lane, pitch, limit).select(*keys, F.col(lane.order).alias("_grid"), "empty")
    nearest = F.floor((F.col(lane.order) + step // 2) / step).cast("bigint") * step
    held = columns.withColumn("_grid", nearest).join(marks, [*keys, "_grid"], "left").drop("_grid")
    empty = F.coalesce("empty", F.lit(False))
    return held.withColumn("empty", empty).withColumn("judged", ~F.col("missing") & ~F.col("empty"))
