"""Streaming pipelines built from Spark's own streaming operators and the lane processors."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ringsight.operators.alerts import changed_events
from ringsight.operators.fold import lane_fold
from ringsight.operators.ordered import Lane
from ringsight.session import checkpoint_root
from ringsight.sources.sinks import current_version, upsert_parquet


def checkpoint_for(df: DataFrame, name: str, version: str = "v1") -> str:
    """Checkpoint folder of a query; a new version starts empty."""
    return f"{checkpoint_root(df.sparkSession)}/streams/{name}/{version}"


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is there and stop; a later call continues from the checkpoint."""
    query = (
        df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(path)
    )
    query.awaitTermination()
    return query


def correlate_streams(requests: DataFrame, responses: DataFrame, deadline: str) -> DataFrame:
    """Requests with their response; unanswered ones come out once the deadline has passed.

    requests: frame_id, camera_id, sent_at; responses: response_id, answered_at.
    """
    left = requests.withWatermark("sent_at", deadline)
    right = responses.withWatermark("answered_at", deadline)
    in_time = F.expr(
        f"frame_id = response_id AND answered_at >= sent_at AND answered_at <= sent_at + INTERVAL {deadline}"
    )
    return left.join(right, in_time, "leftOuter").withColumn("answered", F.col("response_id").isNotNull())


def emit_once_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """First event of every key, once for ever: seen keys stay in the state store, without a horizon."""
    return events.dropDuplicates(keys)


def final_columns(frames: DataFrame, lane: Lane, position: str, value: str, bad: str, half: int, margin: int) -> DataFrame:
    """Columns of the unrolled chain, each once, when the lane's newest write is more than ``margin`` past it.

    Every frame writes the columns within ``half`` of its position, weighted by distance. A write to a column that was
    final before its frame is dropped. What is final is decided per lane, from that lane's frames alone, so a lane that
    lags behind loses nothing; the result does not depend on how frames are grouped into batches. On a stream
    the state of a lane is its open columns; in a batch the last ``margin`` columns stay open too.
    """
    keys = list(lane.keys)
    reach = np.arange(-half, half + 1)
    share = 1 - np.abs(reach) / (half + 1.0)

    def fold(state, pdf):
        at = pdf[position].to_numpy(float)
        here = np.rint(at[:, None] - reach[None, :]).astype(np.int64)  # half to even
        newest = np.maximum.accumulate(np.concatenate([[state["newest"]], here.max(axis=1, initial=state["newest"])])).astype(np.int64)
        live = here >= newest[:-1, None] - margin
        x = pdf[value].to_numpy(float)[:, None] * share[None, :]
        writes = pd.DataFrame({
            "col": here[live], "weight": np.broadcast_to(share, here.shape)[live], "x": x[live],
            "bad": np.broadcast_to(pdf[bad].to_numpy(bool)[:, None], here.shape)[live],
        })
        before = pd.DataFrame(state["open"], columns=["col", "weight", "x", "bad"]).astype(writes.dtypes.to_dict())
        sums = pd.concat([before, writes]).groupby("col", as_index=False).agg({"weight": "sum", "x": "sum", "bad": "max"})
        done = sums["col"] < newest[-1] - margin
        state = {"newest": int(newest[-1]), "open": [[int(c), float(w), float(v), bool(b)] for c, w, v, b in sums[~done].itertuples(index=False)]}
        out = sums[done].assign(value=lambda d: d["x"] / d["weight"])[["col", "weight", "value", "bad"]]
        for k in reversed(keys):
            out.insert(0, k, pdf[k].iloc[0] if len(pdf) else None)
        return state, out

    types = {f.name: f.dataType.simpleString() for f in frames.schema}
    head = "".join(f"{k} {types[k]}, " for k in keys)
    start = lambda: {"newest": -(2**62), "open": []}
    return lane_fold(frames, lane, fold, start, f"{head}col bigint, weight double, value double, bad boolean", warm=0)


def hidden_run_sessions(columns: DataFrame, keys: list[str], col: str, hidden: str, join_gap: int) -> DataFrame:
    """Runs of hidden columns joined over short gaps, as session windows over the column number."""
    seen = columns.filter(F.col(hidden)).withColumn("_at", F.timestamp_seconds(col))
    seen = seen.withWatermark("_at", f"{join_gap + 2} seconds")
    runs = seen.groupBy(*keys, F.session_window("_at", f"{join_gap + 1} seconds").alias("s")).agg(
        F.min(col).alias("first_col"), (F.max(col) + 1).alias("end_col"), F.count(F.lit(1)).alias("hidden_columns")
    )
    return runs.drop("s")


def alert_upserts(events: DataFrame, path: str, checkpoint: str, order: list[str]) -> StreamingQuery:
    """Upsert changed events into the alert table, one version per micro-batch; a batch that is run again after a failure
    changes nothing. The checkpoint names the source, so a new one goes on with the table where it is."""
    source = hashlib.sha1(checkpoint.encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = current_version(spark, path)
        stored = spark.read.parquet(before) if before else spark.createDataFrame([], batch.schema)
        changed = changed_events(batch, stored, ["event_key"], "state", order[0])
        upsert_parquet(changed, path, ["event_key"], order, source, number)

    query = (
        events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
