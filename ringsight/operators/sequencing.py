"""Order, gaps, lateness and retention of frame streams."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringsight.functions.numeric import half_even, median_of
from ringsight.operators.fold import lane_fold
from ringsight.operators.ordered import BLOCK, Lane, Running, framed, lane_keys, numbered, previous, running, with_ordinal
from ringsight.session import block_rows, settle

FRAME_RATE = 25.0  # fixed value: nominal frames per second
ELEMENT_PERIOD = 0.8  # fixed value: seconds per element
GAP_SECONDS = 1.2  # fixed value: a longer gap hides whole elements
REORDER_WINDOW = 64  # fixed value: frames held before a hole counts as lost
DEADLINE_SECONDS = 5.0  # fixed value
MAX_IMAGE_BYTES = 8_000_000  # fixed value


def number_frames(df: DataFrame, lane: Lane) -> DataFrame:
    """Number a lane's frames 1..n in order."""
    return with_ordinal(df, lane, "frame_no").withColumn("frame_no", F.col("frame_no") + 1)


def hidden_elements(missing: Column) -> Column:
    """Whole elements hidden by a hole of ``missing`` frames."""
    seconds = missing / FRAME_RATE
    count = half_even(seconds / ELEMENT_PERIOD) - 1
    return F.when(seconds > GAP_SECONDS, F.greatest(count, F.lit(0.0))).otherwise(0.0).cast("bigint")


def declare_gaps(df: DataFrame, lane: Lane) -> DataFrame:
    """Rows after a hole in the sequence, with the frames lost and the elements that hides."""
    seen = previous(df, lane, "_prev", lane.order)
    missing = F.col(lane.order) - F.col(f"_prev.{lane.order}") - 1
    out = seen.withColumn("missing", missing).filter(F.col("missing") > 0).drop("_prev")
    return out.withColumn("hidden_elements", hidden_elements(F.col("missing")))


def gap_advance(df: DataFrame, lane: Lane, step: str, recent: int = 25) -> DataFrame:
    """Distance the chain moved while frames were missing: recent median step times lost frames."""
    rows = Lane(lane.keys, "_n", (), lane.width)
    med = framed(
        numbered(df, lane, lane.order),
        rows,
        recent,
        0,
        lambda w: {"recent_step": median_of(F.col(step)).over(w.rowsBetween(-recent, -1))},
    )
    missing = F.coalesce(F.col(lane.order) - F.col(f"_prev.{lane.order}") - 1, F.lit(0))
    out = med.withColumn("missing", missing).filter(F.col("missing") > 0)
    return out.withColumn("advance", F.col("missing") * F.coalesce("recent_step", F.lit(0.0))).drop("_prev", "_n")


def first_seen_only(df: DataFrame, arrival: Lane, slot: str) -> DataFrame:
    """Keep rows whose slot is beyond every slot seen before; re-sent slots are dropped."""
    top = running(df, arrival, _top=Running("max", F.col(slot), inclusive=False))
    return top.filter(F.col("_top").isNull() | (F.col(slot) > F.col("_top"))).drop("_top")


def arrival_status(df: DataFrame, arrival: Lane, sequence: str, window: int = REORDER_WINDOW) -> DataFrame:
    """Add what the reorder window makes of each arrival: ``late`` (its number was released or given up before) and
    ``restart`` (the lane began anew with it). A number that is merely out of order is held, not late."""

    names = df.columns

    def fold(state, pdf):
        _, late, restart = sequence_walk(state, pdf[sequence].to_numpy(np.int64), window)
        return state, pdf[names].assign(late=late, restart=restart)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return lane_fold(df, arrival, fold, sequence_start, f"{schema}, late boolean, restart boolean", warm=8 * window)


def late_rows(df: DataFrame, arrival: Lane, sequence: str, window: int = REORDER_WINDOW) -> DataFrame:
    """Flag rows whose sequence number is below the next one expected."""
    return arrival_status(df, arrival, sequence, window).drop("restart")


def restart_epochs(df: DataFrame, arrival: Lane, sequence: str, window: int = REORDER_WINDOW) -> DataFrame:
    """Epoch number of every row; a number more than the window below the expected one starts a new epoch."""
    seen = settle(arrival_status(df, arrival, sequence, window))
    return running(seen, arrival, epoch=Running("sum", F.col("restart").cast("bigint"))).drop("late", "restart")


def sequence_step(state: dict, seq: int, window: int = REORDER_WINDOW) -> tuple[list[tuple[int, int]], str]:
    """One arrival of the reorder window. Returns released (sequence, missing before it) and what happened."""
    note = "held"
    if state["expected"] is not None and seq + window < state["expected"]:
        state["held"], state["expected"], note = [], None, "restart"
    if state["expected"] is None:
        state["expected"] = seq
    if seq < state["expected"]:
        return [], "late"
    held = set(state["held"])
    held.add(seq)
    missing = 0
    if seq != state["expected"] and len(held) > window:
        lowest = min(held)
        missing, state["expected"] = lowest - state["expected"], lowest
    released = []
    while state["expected"] in held:
        held.discard(state["expected"])
        released.append((state["expected"], missing))
        missing = 0
        state["expected"] += 1
    state["held"] = sorted(held)
    if note != "restart":
        note = "released" if any(s == seq for s, _ in released) else "held"
    return released, note


def sequence_start() -> dict:
    return {"expected": None, "held": []}


def sequence_walk(state: dict, seqs: np.ndarray, window: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """All arrivals of a stretch. Returns released (number, arrival, missing before it, restart), and late and restart of
    each arrival. Unbroken runs with nothing held pass as a whole; only disorder is stepped through."""
    n = len(seqs)
    late, restart = np.zeros(n, bool), np.zeros(n, bool)
    ends = np.append(np.flatnonzero(np.diff(seqs) != 1) + 1, n)
    released: list[tuple] = []
    i = 0
    while i < n:
        if not state["held"] and state["expected"] in (None, int(seqs[i])):
            end = int(ends[np.searchsorted(ends, i, side="right")])
            released += [(number, at, 0, False) for number, at in zip(seqs[i:end].tolist(), range(i, end), strict=True)]
            state["expected"] = int(seqs[end - 1]) + 1
            i = end
            continue
        out, note = sequence_step(state, int(seqs[i]), window)
        late[i], restart[i] = note == "late", note == "restart"
        released += [(number, i, missing, note == "restart") for number, missing in out]
        i += 1
    return released, late, restart


def reorder(df: DataFrame, arrival: Lane, sequence: str, window: int = REORDER_WINDOW) -> DataFrame:
    """Release order of a lane that arrives shuffled.

    One row per released sequence number: the arrival that released it and the frames declared lost just
    before it; plus one row per late arrival (``outcome`` late).
    """
    order = arrival.order
    keys = list(arrival.keys)

    def fold(state, pdf):
        seqs, at = pdf[sequence].to_numpy(np.int64), pdf[order].to_numpy(np.int64)
        released, late, _ = sequence_walk(state, seqs, window)
        rows = [(i, number, int(at[i]), missing, "released", restart) for number, i, missing, restart in released]
        rows += [(int(i), int(seqs[i]), int(at[i]), 0, "late", False) for i in np.flatnonzero(late)]
        out = pd.DataFrame(rows, columns=["_i", sequence, "released_at", "missing_before", "outcome", "restart"])
        out = out.sort_values("_i", kind="stable")
        for k in reversed(keys):
            out.insert(0, k, pdf[k].to_numpy()[out["_i"].to_numpy(int)])
        return state, out.drop(columns="_i")

    types = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([f"{k} {types[k]}" for k in keys])
    schema = f"{schema}, {sequence} bigint, released_at bigint, missing_before bigint, outcome string, restart boolean"
    return lane_fold(df, arrival, fold, sequence_start, schema, warm=8 * window)


def dead_letters(df: DataFrame, supported: list[str], max_bytes: int = MAX_IMAGE_BYTES) -> DataFrame:
    """Reason a frame cannot be processed; NULL for good frames. Needs camera_id, n_bytes, decodable."""
    reason = (
        F.when(~F.col("camera_id").isin(supported), "unknown camera_id")
        .when(F.col("n_bytes") > max_bytes, "image too large")
        .when(~F.col("decodable"), "undecodable image")
    )
    return df.withColumn("reason", reason)


def deadline_skips(df: DataFrame, sent_us: str, done_us: str, limit: float = DEADLINE_SECONDS) -> DataFrame:
    """Flag rows whose processing took too long; they get no response but keep their position."""
    return df.withColumn("skipped", F.col(done_us) - F.col(sent_us) > int(limit * 1_000_000))


def repeated_pictures(df: DataFrame, lane: Lane, content: str) -> DataFrame:
    """Flag frames identical to the previous one of the lane: a lost frame, not a standing chain."""
    hashed = df.withColumn("_hash", F.sha2(F.col(content), 256))
    seen = previous(hashed, lane, "_prev", "_hash")
    same = F.coalesce(F.col("_hash") == F.col("_prev._hash"), F.lit(False))
    return seen.withColumn("repeated", same).drop("_hash", "_prev")


def arrival_health(
    df: DataFrame, lane: Lane, at_us: str, content: str, recent: int = 250, least: int = 50
) -> DataFrame:
    """Arrival rate and repeated share over the latest frames; NULL while too few have arrived."""
    hashed = df.withColumn("_hash", F.sha2(F.col(content), 256))
    rows = Lane(lane.keys, "_n", (), lane.width)
    count = F.least(F.col("_n") + 1, F.lit(recent))

    def totals(w):
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        repeated = F.coalesce((F.col("_hash") == F.col("_prev._hash")).cast("bigint"), F.lit(0))
        return {"_total": F.sum(repeated).over(so_far), "_start": F.first(at_us).over(so_far)}

    def health(w):
        # Differences of running totals: constant work per row, however long the stretch is.
        began = F.coalesce(F.lag(at_us, recent - 1).over(w), F.col("_start"))
        span = (F.col(at_us) - began) / 1_000_000
        repeats = F.col("_total") - F.coalesce(F.lag("_total", recent).over(w), F.lit(0))
        return {
            "rate": F.when((count >= least) & (span > 0), (count - 1) / span),
            "repeated_share": F.when(count >= least, repeats / count),
        }

    out = framed(numbered(hashed, lane, "_hash"), rows, recent, 0, totals, health)
    return out.drop("_n", "_hash", "_prev", "_total", "_start")


def spaced_step(state: dict, at: np.ndarray, gap: float, strict: bool) -> np.ndarray:
    """Greedy spacing over sorted positions: indexes accepted, given the last accepted position."""
    picks, last = [], state["last"]
    i = 0
    while i < len(at):
        if last is not None:
            i = max(i, int(np.searchsorted(at, last + gap, side="right" if strict else "left")))
            if i >= len(at):
                break
        picks.append(i)
        last = float(at[i])
        i += 1
    state["last"] = last
    return np.array(picks, dtype=int)


def spaced_exits(at: np.ndarray, gap: float, side: str) -> tuple[np.ndarray, np.ndarray]:
    """What a block makes of the acceptance before it: the last acceptance in the block (second array) for every first one up to
    the value in the first array. Firsts are in the block's first ``gap``; equal neighbours share an entry."""
    at = np.unique(at)
    after = np.searchsorted(at, at + gap, side=side)
    after = np.where(after > np.arange(len(at)), after, np.arange(len(at)) + 1)  # a gap of zero takes the next value
    firsts = min(int(after[0]) + 1, len(at))
    last = np.where(after < len(at), after, np.arange(len(at)))
    while True:
        further = last[last]
        if np.array_equal(further, last):
            break
        last = further
    ends = np.flatnonzero(np.append(last[1:firsts] != last[: firsts - 1], True))
    return at[ends], at[last[ends]]


def spaced_rows(df: DataFrame, lane: Lane, at: str, gap: float, strict: bool = False) -> DataFrame:
    """Accept the first row, then the next at least (or more than) ``gap`` after the last accepted one.

    The lane order must sort rows by ``at``; each acceptance depends on the one before it. Rows without ``at`` are left out.

    A chain of acceptances forgets its start slowly, so blocks do not guess their entry: each block tells what it makes of every
    acceptance that may come before it. These are at most the rows of its first ``gap``, and less where chains have met inside the
    block. They are followed block by block, a lane in one stream; each row is shuffled twice, however many blocks there are.
    Where ``at`` is the order, blocks without a given width span sixteen gaps or more.
    """
    names, side = df.columns, "right" if strict else "left"
    df = df.filter(F.col(at).isNotNull() & ~F.isnan(F.col(at).cast("double")))

    def fold(state, pdf):
        picks = spaced_step(state, pdf[at].to_numpy(dtype="float64"), gap, strict)
        return state, pdf.loc[picks, names]

    schema = df.schema.simpleString()[7:-1]
    if df.isStreaming:
        return lane_fold(df, lane, fold, lambda: {"last": None}, schema, warm=0)
    if lane.width is None and lane.order == at:
        lane = replace(lane, width=max(block_rows(df.sparkSession), int(np.ceil(16 * gap))))
    lane = lane.resolve(df)
    order, group = [lane.order, *lane.ties], lane.block_keys
    rows = df.withColumn(BLOCK, lane.block())
    key_fields = [rows.schema[k] for k in group]

    def through(key, pdf):
        return pd.DataFrame([[*key, *spaced_exits(pdf["_at"].to_numpy(dtype="float64"), gap, side)]], columns=[*group, "_upto", "_exit"])

    lists = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("_upto", "_exit")]
    blocks = rows.select(*group, F.col(at).cast("double").alias("_at")).groupBy(*group).applyInPandas(through, T.StructType([*key_fields, *lists]))

    def follow(batches):
        here, last = None, None
        for batch in batches:
            entries, n = [], len(group)
            upto, leave = (batch.column(n + i).values.to_numpy() for i in range(2))
            edge = batch.column(n).offsets.to_numpy()
            keys = zip(*(batch.column(i).to_pylist() for i in range(n)))
            for (*key, _), a, b in zip(keys, edge[:-1], edge[1:]):
                if key != here:
                    here, last = key, None
                entries.append(last)
                i = a if last is None else a + np.searchsorted(upto[a:b], last + gap, side=side)
                last = float(leave[i]) if i < b else last
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(group)], pa.array(entries, pa.float64())], names=[*group, "_entry"])

    placed = blocks.repartition(*lane.keys) if lane.keys else blocks.repartition(1)  # one row per block
    known = T.StructType([*key_fields, T.StructField("_entry", T.DoubleType())])
    entries = placed.sortWithinPartitions(*group).mapInArrow(follow, known)

    def emit(key, pdf, entry):
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        last = entry["_entry"].iloc[0]
        return fold({"last": None if pd.isna(last) else float(last)}, pdf)[1]

    return rows.groupBy(*group).cogroup(entries.groupBy(*group)).applyInPandas(emit, schema)


def newest_ring(df: DataFrame, keys: list[str], item: str, order: str, size: int) -> DataFrame:
    """Bounded cache per lane: the first write of an item wins, the newest ``size`` items stay."""
    rest = [c for c in df.columns if c not in (*keys, item)]
    first = df.groupBy(*keys, item).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_row"))
    first = first.select(*keys, item, "_row.*")
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return first.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= size).drop("_rank")


def bucket_ring(
    df: DataFrame, keys: list[str], position: str, order: str, width: float, size: int,
    keep: Callable = F.max_by, needed: Column | None = None,
) -> DataFrame:
    """One frame per position bucket - the newest (``max_by``) or the first (``min_by``) - and of those the
    newest ``size`` per lane at or beyond the position still needed."""
    rest = [c for c in df.columns if c not in keys]
    bucketed = df.withColumn("bucket", F.floor(F.col(position) / width).cast("bigint"))
    one = bucketed.groupBy(*keys, "bucket").agg(keep(F.struct(*rest), F.col(order)).alias("_row"))
    one = one.select(*keys, "bucket", "_row.*")
    if needed is not None:
        one = one.filter(F.col(position) >= needed)
    window = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return one.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= size).drop("_rank")


def correlate(requests: DataFrame, responses: DataFrame, key: str) -> DataFrame:
    """Requests with their response; unanswered ones are dead letters, stray responses are ignored."""
    answers = responses.withColumn("answered", F.lit(True))
    out = requests.join(answers, key, "left")
    return out.withColumn("answered", F.coalesce("answered", F.lit(False)))


def lane_counters(df: DataFrame, keys: list[str], **flags: Column) -> DataFrame:
    """Counts of true flags per lane."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frames"),
        *[F.count(F.when(flag, 1)).alias(name) for name, flag in flags.items()],
    )
