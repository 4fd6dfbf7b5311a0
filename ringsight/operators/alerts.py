"""Alert pipeline: events to alerts, upserts, list queries, retention, hours and viewer queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.functions.numeric import clamp, violations
from ringsight.operators.ordered import Lane, previous
from ringsight.operators.trigger import CAMERAS, UUID_PATTERN

# Event kind -> observation target and fault type.
EVENT_KINDS = {
    "damage": ("godet", "DAMAGE"),
    "wheel_gap": ("galet", "WHEEL_GAP"),
    "wheel_density": ("galet", "WHEEL_DENSITY"),
    "wheel_missing": ("galet", "WHEEL_MISSING"),
}
TARGETS = ["godet", "galet", "clinker_level"]  # fixed values
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"  # fixed value: name space of URLs for name-based UUIDs
KEPT_ON_UPDATE = ("alert_id", "created_at", "seen_at")
PAGE_MIN, PAGE_MAX = 1, 200
FIXED_BOX = (0.0, 0.0, 1.0, 1.0)
LATEST_FRAME = "latest_frame"  # fixed value


def name_uuid(name: Column) -> Column:
    """Name-based (SHA-1) UUID of a text in the URL name space."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    nibble = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(F.lower(F.hex(nibble)), F.substring(h, 18, 3)), F.substring(h, 21, 12),
    )


def qualifying_detections(df: DataFrame, threshold: float) -> DataFrame:
    """One row per detection at or above the threshold."""
    return df.withColumn("detection", F.explode("detections")).filter(F.col("detection.score") >= threshold).drop("detections")


def event_key(camera: Column, element: Column, loop: Column) -> Column:
    tail = F.concat_ws(":", F.lit("DAMAGE"), element.cast("string"), loop.cast("string"))
    plain = F.coalesce(camera, F.lit("")).isin("", "CAM-1")
    return F.when(plain, tail).otherwise(F.concat_ws(":", camera, tail))


def event_box(box: Column, legacy: Column) -> tuple[Column, Column]:
    """Box of an event cut to the frame, and whether it is drawn; without one the whole frame is stored."""
    x, y = clamp(box["x"].cast("double"), 0.0, 1.0), clamp(box["y"].cast("double"), 0.0, 1.0)
    w, h = F.least(box["width"].cast("double"), 1 - x), F.least(box["height"].cast("double"), 1 - y)
    good = F.coalesce((box["width"] > 0) & (box["height"] > 0) & (w > 0) & (h > 0), F.lit(False))
    own = F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    whole = F.struct(*[F.lit(v).alias(n) for n, v in zip(("x", "y", "width", "height"), FIXED_BOX)])
    return F.when(good, own).otherwise(whole), good | legacy


def kind_lookup(kind: Column, part: int) -> Column:
    pairs = [F.lit(v) for k, v in EVENT_KINDS.items() for v in (k, v[part])]
    return F.element_at(F.create_map(*pairs), kind)


def events_to_alerts(events: DataFrame, states: DataFrame) -> DataFrame:
    """Alert rows of known pending / confirmed events, with measurements merged from event and state.

    Needs event_key, kind, camera_id, element_id, loop_no, state, evidence_frame_id, frame_id,
    measurements (map<string,double>); captured_us, model_version, box (struct) and now_us for the stored row; states:
    camera_id, element_id, lip, near_plate, severity, passes_seen, at most one row of each element. An event whose
    element has no state keeps its own, with nothing measured.
    """
    good = events.filter(
        F.col("kind").isin(list(EVENT_KINDS)) & F.col("state").isin("pending", "confirmed")
        & (F.col("element_id") > 0) & (F.col("loop_no") >= 0)
    )
    fields = {"lip": 0.0, "near_plate": False, "severity": 0.0, "passes_seen": 0}
    known = states.select("camera_id", "element_id", *fields)
    joined = good.join(known, ["camera_id", "element_id"], "left").fillna(fields)
    key = F.when(F.length(F.coalesce("event_key", F.lit(""))) > 0, F.col("event_key")).otherwise(
        event_key(F.col("camera_id"), F.col("element_id"), F.col("loop_no"))
    )
    target = kind_lookup(F.col("kind"), 0)
    text = lambda c: c.cast("string")
    own = F.transform_values("measurements", lambda _, v: text(v))
    side = F.col("camera_id").isin("CAM-3", "CAM-4")
    extra = (
        F.when((target == "galet") | F.map_contains_key("measurements", F.lit("damage_type")), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
        .when(side, F.create_map(F.lit("severity"), text(F.col("severity")), F.lit("passes_seen"), text(F.col("passes_seen"))))
        .otherwise(F.create_map(F.lit("lip"), text(F.col("lip")), F.lit("near_plate"), text(F.col("near_plate"))))
    )
    fallback = F.coalesce((F.col("evidence_frame_id") != "") & (F.col("evidence_frame_id") != F.col("frame_id")), F.lit(False))
    mark = F.create_map(F.lit("evidence"), F.when(fallback, LATEST_FRAME))
    tail = F.create_map(F.lit("state"), F.col("state"), F.lit("last_seen_loop"), text(F.col("loop_no")))
    own = F.map_filter(own, lambda k, _: ~F.array_contains(F.map_keys(extra), k))
    merged = F.map_concat(own, extra, F.map_filter(mark, lambda _, v: v.isNotNull()), tail)
    fault = kind_lookup(F.col("kind"), 1)
    box, drawn = event_box(F.col("box"), (target == "godet") & ~F.map_contains_key("measurements", F.lit("severity")))
    whole = F.struct(*[F.lit(v).alias(n) for n, v in zip(("x", "y", "width", "height"), (0.0, 0.0, 1.0, 1.0))])
    shown = F.when(drawn, box).otherwise(whole)
    named = joined.withColumn("_box", shown).withColumn("event_key", key).withColumn("alert_id", name_uuid(F.col("event_key")))
    captured = F.coalesce(F.nullif("captured_us", F.lit(0)), F.col("now_us"))
    return named.withColumn("measurements", merged).select(
        "alert_id", "event_key", "camera_id", "element_id", "loop_no",
        F.col("state").alias("alert_state"), target.alias("observation_target"), fault.alias("fault_type"), fault.alias("rule_id"),
        "frame_id", F.col("frame_id").alias("evidence_frame_id"), "model_version",
        captured.alias("captured_us"), F.col("now_us").alias("detected_us"), F.col("now_us").alias("created_us"),
        F.col("_box").alias("box"), evidence_path(F.date_from_unix_date(F.floor(captured / 86_400_000_000).cast("int")), F.col("camera_id"), F.col("alert_id")).alias("evidence_ref"),
        "measurements",
    )


def events_or_states(events: DataFrame, states: DataFrame) -> DataFrame:
    """Events as given; for cameras that sent none, damage events made from flagged element states."""
    fields = ["camera_id", "event_key", "kind", "element_id", "loop_no", "state"]
    silent = states.join(events.select("camera_id").distinct(), "camera_id", "left_anti")
    made = silent.filter(F.col("state").isin("pending", "confirmed") & (F.col("last_seen_loop") >= 0))
    key = event_key(F.col("camera_id"), F.col("element_id"), F.col("last_seen_loop"))
    made = made.select(
        "camera_id", key.alias("event_key"), F.lit("damage").alias("kind"), "element_id",
        F.col("last_seen_loop").alias("loop_no"), "state",
    )
    return events.select(*fields).unionByName(made.select(*fields))


def append_alerts(df: DataFrame) -> DataFrame:
    """Rows as stored by a plain append: 0 means "no loop / no element"."""
    zero = lambda c: F.nullif(F.col(c), F.lit(0))
    return df.withColumn("loop_no", zero("loop_no")).withColumn("element_id", zero("element_id"))


def keyed_upsert(
    stored: DataFrame, incoming: DataFrame, keys: list[str], order: list[str], kept: tuple[str, ...] = ()
) -> DataFrame:
    """Stored table after an upsert: the last incoming row of a key wins, ``kept`` columns stay as first stored.

    Both sides are reduced per key by an aggregate, so any number of copies of a key is harmless.
    """
    fields = [c for c in stored.columns if c not in keys]
    valid = incoming.filter(F.forall(F.array(*[F.length(F.col(k).cast("string")) > 0 for k in keys]), lambda b: F.coalesce(b, F.lit(False))))
    pos = F.struct(*order)
    newest = valid.groupBy(*keys).agg(
        F.max_by(F.struct(*fields), pos).alias("_new"), F.min_by(F.struct(*fields), pos).alias("_first")
    )
    old = stored.select(*keys, F.struct(*fields).alias("_old"))
    joined = old.join(newest, keys, "full_outer")
    cols = []
    for c in fields:
        if c in kept:
            first = F.when(F.col("_old").isNotNull(), F.col(f"_old.{c}")).otherwise(F.col(f"_first.{c}"))
            cols.append(first.alias(c))
        else:
            cols.append(F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c))
    return joined.select(*keys, *cols)


def insert_ignore(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming keys that are not stored yet, once each."""
    return incoming.select(*keys).distinct().join(stored.select(*keys), keys, "left_anti")


def changed_events(events: DataFrame, stored: DataFrame, keys: list[str], state: str, order: str) -> DataFrame:
    """Events whose state differs from what their key had before: the preceding event in arrival order, or else the
    stored row. ``order`` is an integer."""
    known = stored.groupBy(*keys).agg(F.max(state).alias("_stored"))
    seen = previous(events, Lane(tuple(keys), order), "_before", state).join(known, keys, "left")
    last = F.coalesce(F.col(f"_before.{state}"), F.col("_stored"))
    return seen.filter(last.isNull() | (last != F.col(state))).drop("_before", "_stored")


def storage_gate(events: DataFrame, stored: DataFrame, key: str, arrival: str, cap: int) -> DataFrame:
    """Whether an event may be stored: known keys always, new keys while there is room; 0 means no limit.

    New keys are ranked by arrival through a top-k, so only ``cap`` of them are ever ordered.
    """
    if cap <= 0:
        return events.withColumn("allowed", F.lit(True))
    known = stored.select(key).distinct().withColumn("_known", F.lit(True))
    total = stored.agg(F.count(F.lit(1)).alias("_total"))  # one row
    marked = events.join(known, key, "left")
    fresh = marked.filter(F.col("_known").isNull()).groupBy(key).agg(F.min(arrival).alias("_at"))
    first = fresh.orderBy("_at", key).limit(cap)
    ranked = first.withColumn("_r", F.row_number().over(Window.orderBy("_at", key)))
    room = ranked.crossJoin(F.broadcast(total)).filter(F.col("_r") <= cap - F.col("_total")).select(key, F.lit(True).alias("_room"))
    out = marked.join(room, key, "left")
    return out.withColumn("allowed", F.col("_known").isNotNull() | F.col("_room").isNotNull()).drop("_known", "_room")


def list_alerts(
    df: DataFrame, limit: int, *, filters: dict | None = None, unseen: bool = False, since=None, cursor=None
) -> DataFrame:
    """One page, newest first, with whether more rows follow. ``cursor`` is (detected, alert_id)."""
    limit = min(max(limit, PAGE_MIN), PAGE_MAX)
    for column, value in (filters or {}).items():
        df = df.filter(F.col(column) == value)
    if unseen:
        df = df.filter(F.col("seen_us").isNull())
    if since is not None:
        df = df.filter(F.col("detected_us") >= since)
    if cursor is not None:
        at, ident = cursor
        df = df.filter((F.col("detected_us") < at) | ((F.col("detected_us") == at) & (F.col("alert_id") < ident)))
    page = df.orderBy(F.col("detected_us").desc(), F.col("alert_id").desc()).limit(limit + 1)
    order = Window.orderBy(F.col("detected_us").desc(), F.col("alert_id").desc())  # limit + 1 rows
    numbered = page.withColumn("_r", F.row_number().over(order)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    return numbered.filter(F.col("_r") <= limit).withColumn("has_more", F.col("_n") > limit).drop("_r", "_n")


def mark_seen(df: DataFrame, marks: DataFrame) -> DataFrame:
    """First time an alert was marked stays."""
    first = marks.groupBy("alert_id").agg(F.min("mark_us").alias("_mark"))
    return df.join(first, "alert_id", "left").withColumn("seen_us", F.coalesce("seen_us", "_mark")).drop("_mark")


def retention(df: DataFrame, at: str, newest: Column, days: int) -> DataFrame:
    """Flag rows older than ``days``; those go, with their evidence files."""
    return df.withColumn("expired", F.col(at) < newest - days * 86_400_000_000)


def alert_violations() -> Column:
    b = lambda c: F.col(f"box.{c}")
    inside = (
        b("x").between(0, 1) & b("y").between(0, 1) & (b("width") > 0) & (b("height") > 0)
        & (b("x") + b("width") <= 1) & (b("y") + b("height") <= 1)
    )
    return violations(
        (F.col("alert_id").rlike(UUID_PATTERN), "alert_id"),
        (F.col("frame_id").rlike(UUID_PATTERN), "frame_id"),
        (F.col("detected_us") > 0, "detected_at"),
        (F.col("camera_id").isin(CAMERAS), "camera_id"),
        (F.col("observation_target").isin(TARGETS), "observation_target"),
        ((F.length("fault_type") > 0) & (F.length("model_version") > 0), "fault_or_version"),
        (F.col("confidence").isNull() | F.col("confidence").between(0, 1), "confidence"),
        (inside, "box"),
        (safe_path(F.col("evidence_ref")), "evidence_ref"),
    )


def safe_path(ref: Column) -> Column:
    """Relative path made of harmless parts that cannot leave its root."""
    return ref.rlike(r"^[A-Za-z0-9_.\-]+(/[A-Za-z0-9_.\-]+)*$") & ~ref.rlike(r"(^|/)\.{1,2}(/|$)")


def evidence_path(captured: Column, camera: Column, alert: Column) -> Column:
    """``yyyy/MM/dd/camera/alert.jpg``; NULL when a part is unsafe."""
    part_ok = camera.rlike(r"^[A-Za-z0-9_\-]+$") & alert.rlike(r"^[A-Za-z0-9_\-]+$")
    return F.when(part_ok, F.concat_ws("/", F.date_format(captured, "yyyy/MM/dd"), camera, F.concat(alert, F.lit(".jpg"))))


# -- hours ------------------------------------------------------------------------------------------------


def minute_of_day(text: Column) -> Column:
    """Minutes of a HH:MM text, NULL when malformed."""
    good = text.rlike("^([01][0-9]|2[0-3]):[0-5][0-9]$")
    return F.when(good, F.substring(text, 1, 2).cast("int") * 60 + F.substring(text, 4, 2).cast("int"))


def in_schedule(enabled: Column, start: Column, stop: Column, minute: Column) -> Column:
    """[start, stop) with wrap at midnight; disabled or equal ends mean always, malformed means never."""
    a, b = minute_of_day(start), minute_of_day(stop)
    between = F.when(a < b, (minute >= a) & (minute < b)).otherwise((minute >= a) | (minute < b))
    return F.when(~enabled, True).when(a.isNull() | b.isNull(), False).when(a == b, True).otherwise(between)


def local_minute(at: Column, zone: Column) -> Column:
    """Minute of the day in ``zone`` of a zone-less UTC time, whatever the session zone."""
    local = F.convert_timezone(F.lit("UTC"), zone, at)
    return F.hour(local) * 60 + F.minute(local)


DEFAULT_HOURS = {"CAM-3": ("09:00", "12:30"), "CAM-4": ("12:30", "16:00"), "CAM-1": ("16:00", "08:00")}  # fixed values


def effective_hours(cameras: DataFrame, settings: DataFrame, base: DataFrame) -> DataFrame:
    """Hours that apply to a camera: page setting, else built-in default, else its own, else the common ones.

    cameras: camera_id, own_start, own_stop; settings: camera_id, mode, start, stop; base: one row.
    """
    pairs = lambda i: F.element_at(
        F.create_map(*[F.lit(v) for k, h in DEFAULT_HOURS.items() for v in (k, h[i])]), F.col("camera_id")
    )
    joined = cameras.join(settings, "camera_id", "left").crossJoin(F.broadcast(base))
    page = F.col("mode").isNotNull()
    pick = lambda i, s, own, common: F.when(page, F.col(s)).otherwise(F.coalesce(pairs(i), F.col(own), F.col(common)))
    source = (
        F.when(page, "page").when(pairs(0).isNotNull(), "default").when(F.col("own_start").isNotNull(), "own").otherwise("common")
    )
    return joined.select(
        "camera_id",
        F.when(F.col("mode") == "off", "off").when(F.col("mode") == "always", "always").otherwise("hours").alias("mode"),
        pick(0, "start", "own_start", "base_start").alias("start"),
        pick(1, "stop", "own_stop", "base_stop").alias("stop"),
        source.alias("source"),
    )


def overlapping_hours(hours: DataFrame, key: str) -> DataFrame:
    """Pairs of keys that are on at the same time of day.

    Hours are one stretch of minutes, or two where they wrap at midnight. Two stretches overlap if and only if one starts inside the
    other, so starts meet the hours of the day (24 at most) that a stretch touches.
    """
    a, b = minute_of_day(F.col("start")), minute_of_day(F.col("stop"))
    piece = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    day, none = F.lit(1440), F.lit(0)
    pieces = F.when(F.col("mode") == "always", F.array(piece(none, day))).when(
        F.col("mode") == "hours",
        F.when(a < b, F.array(piece(a, b))).when(a > b, F.array(piece(a, day), piece(none, b))),
    )
    on = hours.select(F.col(key).alias("key"), F.inline(pieces)).filter("lo < hi")
    cells = F.explode(F.sequence(F.floor(F.col("lo") / 60), F.floor((F.col("hi") - 1) / 60)))
    spans = on.select(F.col("key").alias("k1"), F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), cells.alias("cell"))
    starts = on.select(F.col("key").alias("k2"), F.col("lo").alias("lo2"), F.floor(F.col("lo") / 60).alias("cell"))
    met = spans.join(starts, "cell").filter("k1 <> k2 and lo2 >= lo1 and lo2 < hi1")
    return met.select(F.least("k1", "k2").alias("first_key"), F.greatest("k1", "k2").alias("second_key")).distinct()


# -- viewer -----------------------------------------------------------------------------------------------


def severity_class() -> Column:
    return F.when(F.col("seen_us").isNotNull(), "acked").when(F.col("state") == "confirmed", "critical").otherwise("major")


def plain_label() -> Column:
    """What an alert is, in plain words."""
    damage = F.get_json_object("measurements", "$.damage_type").cast("double")
    return (
        F.when(F.col("fault_type") == "WHEEL_GAP", "Too few wheels").when(F.col("fault_type") == "WHEEL_DENSITY", "Too many wheels")
        .when(F.col("fault_type") == "WHEEL_MISSING", "Wheel missing")
        .when(damage == 1, "Cut").when(damage == 2, "Out of line").when(damage == 3, "Cut + out of line")
        .when(damage.isNotNull(), "Damage")
        .when(F.get_json_object("measurements", "$.lip").isNotNull(), "Lip damage").otherwise("Side-plate fault")
    )


def within_limits(gap: int, spacing: int) -> Column:
    """Wheel alerts that no longer break the limits set on the page."""
    number = lambda n: F.floor(F.get_json_object("measurements", f"$.{n}").cast("double") + 0.5)
    return F.coalesce(
        F.when(F.col("fault_type") == "WHEEL_GAP", number("godets") <= gap)
        .when(F.col("fault_type") == "WHEEL_DENSITY", number("min_spacing") >= spacing),
        F.lit(False),
    )


def viewer_counts(df: DataFrame) -> DataFrame:
    """Active and acknowledged counts per camera and kind with totals."""
    active = F.col("seen_us").isNull()
    out = df.rollup("camera_id", "kind").agg(
        F.count(F.when(active, 1)).alias("active"), F.count(F.when(~active, 1)).alias("acked"),
        F.grouping_id().alias("_level"),
    )
    total = lambda c, least: F.when(F.col("_level") >= least, "all").otherwise(F.col(c))
    return out.select(total("camera_id", 3).alias("camera_id"), total("kind", 1).alias("kind"), "active", "acked")


# -- evidence hand-over -----------------------------------------------------------------------------------


def resolve_evidence(events: DataFrame, retained: DataFrame, lanes: list[str]) -> DataFrame:
    """Named frame while it is retained, else the lane's latest frame, marked as such."""
    latest = retained.groupBy(*lanes).agg(F.max_by("frame_id", "captured_us").alias("_latest"))
    there = retained.select(*lanes, F.col("frame_id").alias("wanted_frame"), F.lit(True).alias("_there")).distinct()
    joined = events.join(there, [*lanes, "wanted_frame"], "left").join(latest, lanes, "left")
    named = F.coalesce("_there", F.lit(False))
    return joined.withColumn("used_frame", F.when(named, F.col("wanted_frame")).otherwise(F.col("_latest"))).withColumn(
        "evidence", F.when(~named, LATEST_FRAME)
    ).drop("_there", "_latest")


def hand_back(wanted: DataFrame, delivered: DataFrame, frame: str) -> DataFrame:
    """Frames still to be sent again, once each."""
    return wanted.dropDuplicates([frame]).join(delivered.select(frame), frame, "left_anti")
