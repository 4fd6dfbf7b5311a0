"""As-of, nearest and interval joins on ordered lanes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringsight.operators.ordered import Lane, Running, running

_SIDE, _HIT, _NEXT = "_side", "_hit", "_next"


def _stack(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str]) -> DataFrame:
    names = list(dict.fromkeys([*keys, at, *payload]))
    hit = F.struct(*[F.col(c) for c in dict.fromkeys([at, *payload])])
    marks = right.select(*names).select(*keys, at, hit.alias(_HIT), F.lit(0).alias(_SIDE))
    rows = left.withColumn(_HIT, F.lit(None).cast(marks.schema[_HIT].dataType)).withColumn(_SIDE, F.lit(1))
    return rows.unionByName(marks, allowMissingColumns=True)


def asof_backward(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    payload: Sequence[str],
    name: str = "match",
    width: int | None = None,
) -> DataFrame:
    """Every left row with the latest right row whose ``at`` is not greater, as struct ``name``."""
    stacked = _stack(left, right, keys, at, payload)
    lane = Lane(tuple(keys), at, (_SIDE,), width)
    out = running(stacked, lane, **{name: Running("last", F.col(_HIT))})
    return out.filter(F.col(_SIDE) == 1).drop(_SIDE, _HIT)


def asof_around(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    payload: Sequence[str],
    before: str = "before",
    after: str = "after",
    width: int | None = None,
) -> DataFrame:
    """Every left row with its bracketing right rows: last not after it, first strictly after it."""
    stacked = _stack(left, right, keys, at, payload)
    lane = Lane(tuple(keys), at, (_SIDE,), width)
    out = running(
        stacked,
        lane,
        **{
            before: Running("last", F.col(_HIT)),
            after: Running("last", F.col(_HIT), inclusive=False, reverse=True),
        },
    )
    return out.filter(F.col(_SIDE) == 1).drop(_SIDE, _HIT)


def nearest(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    at: str,
    payload: Sequence[str],
    reach: float | None = None,
    name: str = "match",
    width: int | None = None,
) -> DataFrame:
    """Every left row with the closest right row within ``reach``; the earlier one wins a tie."""
    both = asof_around(left, right, keys, at, payload, "_b", "_a", width)
    back = F.col(at) - F.col(f"_b.{at}")
    ahead = F.col(f"_a.{at}") - F.col(at)
    use_back = F.col("_a").isNull() | (F.col("_b").isNotNull() & (back <= ahead))
    best = F.when(use_back, F.col("_b")).otherwise(F.col("_a"))
    if reach is not None:
        gap = F.when(use_back, back).otherwise(ahead)
        best = F.when(gap <= reach, best)
    return both.withColumn(name, best).drop("_b", "_a")


def overlapping(
    intervals: DataFrame,
    points: DataFrame,
    keys: Sequence[str],
    lo: str,
    hi: str,
    at: str,
    cell: int,
    how: str = "left_semi",
) -> DataFrame:
    """Semi / anti join of half-open intervals [lo, hi) with points.

    Both sides are put on a grid of ``cell`` positions, so the join is an equi-join on (keys, cell);
    an interval is repeated once per cell it touches. Points are deduplicated to one range per cell.
    """
    ranges = (
        points.withColumn("_cell", F.floor(F.col(at) / cell))
        .groupBy(*keys, "_cell")
        .agg(F.sort_array(F.collect_set(at)).alias("_at"))
    )
    spread = intervals.withColumn(
        "_cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor((F.col(hi) - 1) / cell)))
    )
    inside = F.exists("_at", lambda p: (p >= F.col(lo)) & (p < F.col(hi)))
    id_cols = intervals.columns
    hits = spread.join(ranges, [*keys, "_cell"]).filter(inside).select(*id_cols).distinct()
    return intervals.join(hits, id_cols, how)


def circular(delta: Column, length) -> Column:
    """Signed distance on a ring of the given length, in [-length/2, length/2)."""
    length = length if isinstance(length, Column) else F.lit(length)
    return F.pmod(delta + length / 2, length) - length / 2
