"""From per-frame measurements to numbered, classified slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringsight.functions.numeric import clamp, half_even, measured, violations
from ringsight.operators.ordered import Lane, Running, dealt_ranges, framed, previous, running
from ringsight.operators.sequencing import ELEMENT_PERIOD, FRAME_RATE, GAP_SECONDS
from ringsight.operators.windows import trailing_quantiles
from ringsight.session import settle

# Fixed values of the slot classification.
PEAK_READABLE = 0.35
LIMIT_DY, LIMIT_DX = 38.0, 30.0
PLATE_LEVEL = 6.0
FACE_LIMIT = 20.0
MEAN_WINDOW, MEAN_LEAST = 401, 50
SHORT_LEFT, SHORT_RIGHT = 123, 112
MIN_SEPARATION = 12

CAMERAS = ["CAM-1", "CAM-2", "CAM-3", "CAM-4", "CAM-5", "CAM-6"]  # fixed values
TRIGGER_SCALARS = ["peak", "dx", "dy", "slot"]  # fixed values
SIDE_SCALARS = ["chain_step", "chain_pos", "match_quality", "chain_status"]  # fixed values
DETECTED_TARGET, DETECTED_FAULT = "GODET", "DAMAGE"  # fixed values
UUID_PATTERN = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def ramp_captures(df: DataFrame, lane: Lane, dx: str, *measured_columns: str) -> DataFrame:
    """Zero crossings at the end of a clean rising ramp, taking the frame nearer to zero.

    ``lane.order`` must be a dense position. The chosen frame's position and measurements are in
    ``capture``; ``offset`` is 0 for the current frame and -1 for the one before it.
    """

    def exprs(w):
        steps = [F.lag(dx, k).over(w) - F.lag(dx, k + 1).over(w) if k else F.col(dx) - F.lag(dx, 1).over(w) for k in range(4)]
        clean = F.lit(True)
        for step in steps:
            clean = clean & (step > 0) & (step < 9)
        crossing = (F.lag(dx, 1).over(w) < 0) & (F.col(dx) >= 0)
        ready = F.count(F.lit(1)).over(w.rowsBetween(-5, 0)) >= 6
        row = F.struct(lane.order, dx, *measured_columns)
        return {
            "_hit": ready & crossing & clean,
            "offset": F.when(F.abs(F.col(dx)) <= F.abs(F.lag(dx, 1).over(w)), 0).otherwise(-1),
            "_row": row,
            "_back": F.lag(row, 1).over(w),
        }

    hits = framed(df, lane, 5, 0, exprs).filter(F.coalesce("_hit", F.lit(False)))
    chosen = F.when(F.col("offset") == 0, F.col("_row")).otherwise(F.col("_back"))
    return hits.withColumn("capture", chosen).drop("_hit", "_row", "_back")


def fill_virtual_slots(df: DataFrame, lane: Lane, position: str) -> DataFrame:
    """Number captures consecutively, inserting a virtual slot for every element a long gap hides."""
    seen = previous(df, lane, "_prev", position)
    gap = (F.col(position) - F.col(f"_prev.{position}")) / FRAME_RATE
    hidden = F.when(gap > GAP_SECONDS, half_even(gap / ELEMENT_PERIOD) - 1).otherwise(0).cast("bigint")
    counted = seen.withColumn("_hidden", F.greatest(F.coalesce(hidden, F.lit(0)), F.lit(0).cast("bigint"))).drop("_prev")
    ended = settle(running(settle(counted), lane, _end=Running("sum", F.col("_hidden") + 1)))
    last = F.col("_end") - 1
    real = ended.select(*df.columns, last.alias("slot"), F.lit("real").alias("kind"))
    behind = ended.filter("_hidden > 0").select(*lane.keys, (last - F.col("_hidden")).alias("_low"), (last - 1).alias("_high"))
    virtual = dealt_ranges(behind, "_low", "_high", "slot").withColumn("kind", F.lit("virtual"))
    return real.unionByName(virtual, allowMissingColumns=True)


def classify(df: DataFrame, lane: Lane) -> DataFrame:
    """Preliminary status from match quality, offsets, brightness and face residual.

    Needs peak, dx, dy, mean_level and face_residual; brightness is judged against the trailing median
    of earlier captures once enough of them exist. ``lane.order`` must be a dense position.
    """
    with_level = trailing_quantiles(
        df, lane, "mean_level", MEAN_WINDOW, {"usual_level": 0.5}, include_current=False, least=MEAN_LEAST
    )
    weak = (F.col("peak") < PEAK_READABLE) | (F.abs("dy") >= LIMIT_DY) | (F.abs("dx") >= LIMIT_DX)
    plate = weak & F.coalesce(F.col("mean_level") > F.col("usual_level") + PLATE_LEVEL, F.lit(False))
    status = (
        F.when(plate, "occluded").when(weak | (F.col("face_residual") > FACE_LIMIT), "weak").otherwise("readable")
    )
    return with_level.withColumn("status", status)


def mark_edges(df: DataFrame, lane: Lane) -> DataFrame:
    """Readable or weak real slots next to an occluded one become edge slots.

    Behind a plate two slots are marked whatever kind lies between; ahead of it only a real plate marks.
    """
    occluded = F.coalesce((F.col("status") == "occluded").cast("int"), F.lit(0))

    def exprs(w):
        behind = F.max(occluded).over(w.rowsBetween(-2, -1)) == 1
        real_plate = F.when(F.col("kind") == "real", occluded).otherwise(0)
        ahead = F.max(real_plate).over(w.rowsBetween(1, 2)) == 1
        open_status = F.col("status").isin("readable", "weak") & (F.col("kind") == "real")
        near = F.coalesce(behind, F.lit(False)) | F.coalesce(ahead, F.lit(False))
        return {"status": F.when(open_status & near, "edge").otherwise(F.col("status"))}

    return framed(df, lane, 2, 2, exprs)


def short_flags(df: DataFrame, left: float = SHORT_LEFT, right: float = SHORT_RIGHT) -> DataFrame:
    """Flag views whose lit length is under the limit; an occluded slot is never short."""
    clear = F.col("status") != "occluded"
    return df.withColumn("short_left", clear & (F.col("lit_left") < left)).withColumn(
        "short_right", clear & (F.col("lit_right") < right)
    )


def band_summary(df: DataFrame, profile: str, rows: int, per_row: int, threshold: float, least: int) -> DataFrame:
    """Count, extent, brightness, straightness and slope of the lit lines of a profile column.

    The profile holds ``rows`` lines of ``per_row`` samples. Each line is reduced to its maximum and to
    where that lies relative to the middle of the line; the slope needs ``least`` lines. Everything stays
    inside the row as array functions, so there is no shuffle.
    """
    whole = F.col(profile)
    line = lambda r: F.slice(whole, r * per_row + 1, per_row)
    middle = (per_row - 1) / 2
    lines = F.transform(
        F.sequence(F.lit(0), F.lit(rows - 1)),
        lambda r: F.struct(
            r.cast("double").alias("row"),
            F.array_max(line(r)).alias("peak"),
            (F.array_position(line(r), F.array_max(line(r))) - 1 - middle).alias("offset"),
        ),
    )
    staged = df.withColumn("_lines", lines).withColumn("_lit", F.filter("_lines", lambda s: s["peak"] > threshold))
    n = F.size("_lit")

    def total(array, fn):
        return F.aggregate(array, F.lit(0.0), lambda acc, s: acc + fn(s))

    sx, sy = total("_lines", lambda s: s["row"]), total("_lines", lambda s: s["offset"])
    sxx, sxy = total("_lines", lambda s: s["row"] * s["row"]), total("_lines", lambda s: s["row"] * s["offset"])
    slope = (rows * sxy - sx * sy) / F.nullif(rows * sxx - sx * sx, F.lit(0.0))
    row_of = F.transform("_lit", lambda s: s["row"])
    return staged.select(
        *df.columns,
        n.alias("lit_rows"),
        F.coalesce(F.array_min(row_of), F.lit(-1.0)).alias("first_row"),
        F.coalesce(F.array_max(row_of), F.lit(-1.0)).alias("last_row"),
        F.when(n > 0, total("_lit", lambda s: s["peak"]) / n).otherwise(0.0).alias("bright"),
        F.when(n > 0, F.sqrt(total("_lit", lambda s: s["offset"] * s["offset"]) / n)).alias("straight"),
        F.when((n > 0) & F.lit(rows >= least), slope).alias("slope"),
    )


def profile_residual(df: DataFrame, profile: str, reference: str, first: int, last: int) -> DataFrame:
    """Mean absolute difference to a reference profile and mean level over the band [first, last)."""
    width = last - first
    a = F.slice(profile, first + 1, width)
    r = F.slice(reference, first + 1, width)
    gap = F.zip_with(a, r, lambda x, y: F.abs(x - y))
    add = lambda arr: F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)
    return df.withColumn("residual", add(gap) / width).withColumn("level", add(a) / width)


def mean_profile(df: DataFrame, keys: list[str], profile: str, name: str = "reference") -> DataFrame:
    """Element-wise mean profile per key: partial sums per position, then one short array per key."""
    points = df.select(*keys, F.posexplode(profile).alias("_at", "_x"))
    means = points.groupBy(*keys, "_at").agg(F.avg("_x").alias("_x"))
    ordered = F.sort_array(F.collect_list(F.struct("_at", "_x")))
    return means.groupBy(*keys).agg(F.transform(ordered, lambda s: s["_x"]).alias(name))


def indicator_response(df: DataFrame) -> DataFrame:
    """One fixed-box detection for a short capture, and the measured scalars only."""
    found = F.col("is_capture") & (F.col("short_left") | F.col("short_right")) & (F.col("status") != "occluded")
    box = F.struct(*[F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("width", 1.0), ("height", 1.0))])
    one = F.array(F.struct(F.lit(DETECTED_TARGET).alias("target"), F.lit(DETECTED_FAULT).alias("fault"), box.alias("box")))
    none = F.filter(one, lambda _: F.lit(False))
    scalars = F.map_from_arrays(
        F.array(*[F.lit(c) for c in ("peak", "dx", "dy", "lit_left", "lit_right")]),
        F.array(*[measured(F.col(c).cast("double")) for c in ("peak", "dx", "dy", "lit_left", "lit_right")]),
    )
    return df.withColumn("detections", F.when(found, one).otherwise(none)).withColumn(
        "scalars", F.map_filter(scalars, lambda _, v: v.isNotNull())
    )


def retained_batches(df: DataFrame, lane: Lane, per_response: int = 2) -> DataFrame:
    """Response number that carries each retained frame, at most ``per_response`` frames each."""
    counted = running(df, lane, _n=Running("sum", F.lit(1).cast("bigint")))
    return counted.withColumn("response_no", F.floor((F.col("_n") - 1) / per_response)).drop("_n")


def response_violations() -> Column:
    """Rules a measurement response breaks.

    Needs request_id, frame_id, camera_id, model_version, scalars (map), target, fault and box (struct);
    the last three are NULL where nothing was detected.
    """
    scalars = F.col("scalars")
    values = F.map_values(scalars)
    finite = lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))
    has = lambda names: F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.map_contains_key(scalars, n))
    side_plate = F.col("camera_id").isin("CAM-3", "CAM-4") | (
        (F.col("camera_id") == "CAM-1") & F.map_contains_key(scalars, F.lit("chain_pos"))
    )
    code = lambda name, top: F.coalesce(
        scalars[name].between(0, top) & (scalars[name] == F.floor(scalars[name])), F.lit(True)
    )
    nothing = F.col("target").isNull()
    sized = clamped_box(*[F.col(f"box.{c}") for c in ("x", "y", "width", "height")])
    return violations(
        (F.col("frame_id") == F.col("request_id"), "frame_id"),
        (F.length("model_version") > 0, "model_version"),
        (F.forall(values, finite), "not_finite"),
        (F.when(side_plate, has(SIDE_SCALARS)).otherwise(has(TRIGGER_SCALARS)), "required_scalar"),
        (code("status_code", 3), "status_code"),
        (code("chain_status", 2), "chain_status"),
        (nothing | (F.col("target") == DETECTED_TARGET), "target"),
        (nothing | (F.col("fault") == DETECTED_FAULT), "fault"),
        (nothing | ((sized["width"] > 0) & (sized["height"] > 0)), "box_area"),
    )


def clamped_box(x: Column, y: Column, w: Column, h: Column) -> dict[str, Column]:
    """Box cut to the unit frame."""
    left, top = clamp(x, 0.0, 1.0), clamp(y, 0.0, 1.0)
    return {"x": left, "y": top, "width": clamp(w, 0.0, 1.0 - left), "height": clamp(h, 0.0, 1.0 - top)}


def request_violations() -> Column:
    """Rules a frame request breaks."""
    return violations(
        (F.col("frame_id").rlike(UUID_PATTERN), "frame_id"),
        (F.col("camera_id").isin(CAMERAS), "camera_id"),
        (F.length("image") > 0, "image"),
        (F.col("captured_us") > 0, "captured_at"),
    )
