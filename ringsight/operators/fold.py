"""Sequential folds over a lane, run block-parallel.

Some operators cannot be written as a window: whether a row is accepted depends on which earlier row was
accepted. ``lane_fold`` runs such a state machine without pulling a lane into one task:

1. every block guesses its entry state by folding a short warm-up stretch ahead of it, then folds its own
   rows and reports (entry state, exit state);
2. a block is settled when its entry state equals the exit state of the block before it; unsettled blocks
   are folded again from that exit state until none is left;
3. a last pass produces the output rows from the settled entry states.

The result is exactly the sequential one. Machines forget their start quickly, so step 2 normally finds
nothing to do; a machine that never forgets still comes out right, it only takes more rounds.
States travel as JSON; floats are rounded to nine digits at block borders so that equality is well defined.
The same fold functions drive the streaming processors, where state is carried per lane by Spark.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringsight.operators.ordered import BLOCK, Lane, halo
from ringsight.session import settle


def _settle(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, list):
        return [_settle(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _settle(v) for k, v in value.items()}
    return value


def pack(state) -> str:
    return json.dumps(_settle(state), sort_keys=True)


def unpack(text: str):
    return json.loads(text)


def lane_fold(
    df: DataFrame,
    lane: Lane,
    fold: Callable,
    start: Callable,
    schema: str,
    warm: int,
) -> DataFrame:
    """Fold every lane in order.

    ``start()`` is the initial state; ``fold(state, pdf) -> (state, out_pdf)`` consumes ordered rows.
    ``lane.order`` must be a non-negative integer. ``warm`` is the warm-up length in order units. On a
    streaming DataFrame the same fold runs as a stateful processor, one state per lane.
    """
    if df.isStreaming:
        from ringsight.streaming.processors import stream_fold

        return stream_fold(df, lane, fold, start, schema)
    lane = lane.resolve(df)
    order, group = [lane.order, *lane.ties], lane.block_keys
    key_fields = [df.schema[k] for k in lane.keys] + [T.StructField(BLOCK, T.LongType())]
    state_schema = T.StructType(
        [*key_fields, T.StructField("_entry", T.StringType()), T.StructField("_exit", T.StringType())]
    )

    def key_row(key, entry, leave):
        return pd.DataFrame([[*key, entry, leave]], columns=[*group, "_entry", "_exit"])

    def guess(key, pdf):
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        state = start()
        warmup = pdf[~pdf["_own"]]
        if len(warmup):
            state = unpack(pack(fold(state, warmup.reset_index(drop=True))[0]))
        own = pdf[pdf["_own"]].reset_index(drop=True)
        if own.empty:
            return key_row(key, None, None).iloc[:0]
        entry = pack(state)
        return key_row(key, entry, pack(fold(unpack(entry), own)[0]))

    rows = df.withColumn(BLOCK, lane.block())
    states = settle(halo(df, lane, warm, 0).groupBy(*group).applyInPandas(guess, state_schema))
    before = Window.partitionBy(*lane.keys).orderBy(BLOCK)
    first = pack(start())

    def redo(key, pdf, want):
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        if pdf.empty or want.empty:
            return key_row(key, None, None).iloc[:0]
        entry = want["_want"].iloc[0]
        return key_row(key, entry, pack(fold(unpack(entry), pdf)[0]))

    while True:
        chained = states.withColumn("_want", F.coalesce(F.lag("_exit").over(before), F.lit(first)))
        open_blocks = chained.filter("_entry <> _want").select(*group, "_want")
        if open_blocks.isEmpty():
            break
        again = rows.join(open_blocks.select(*group), group, "left_semi")
        redone = (
            again.groupBy(*group).cogroup(open_blocks.groupBy(*group)).applyInPandas(redo, state_schema)
        )
        states = settle(states.join(open_blocks, group, "left_anti").unionByName(redone))

    def emit(key, pdf, settled):
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        return fold(unpack(settled["_entry"].iloc[0]), pdf)[1]

    return rows.groupBy(*group).cogroup(states.groupBy(*group)).applyInPandas(emit, schema)
