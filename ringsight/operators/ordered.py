"""Ordered-lane primitives that never put a whole lane into one task.

A *lane* is a key (a camera, an element id, nothing at all) plus a numeric order column. A plain
``Window.partitionBy(lane)`` would sort a complete lane in one task, which does not hold when one
lane owns a third of the data. Everything here therefore works on *blocks*: ``floor(order / width)``
joins the lane key as the partition key, and what crosses a block border travels one of two ways:

* ``running``  - unbounded frames (running sum / max / last value, in either direction). Each block is
  reduced to one summary row by a map-side combined aggregate, the summaries are scanned (one row per
  block instead of one row per record), and the carry is joined back to the block.
* ``halo`` / ``framed`` - bounded frames. Rows near a border are copied to the neighbouring block,
  the frame is evaluated inside the block, and only the block's own rows are kept.

With the default 32,768-wide blocks a lane of 10^11 records has 3 * 10^6 summary rows, and the largest
sort any task sees is one block.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringsight.session import block_rows

BLOCK = "_blk"
_HEAD = Window.unboundedPreceding


@dataclass(frozen=True)
class Lane:
    """Keys and order of a stream; ``ties`` make the order total."""

    keys: tuple[str, ...]
    order: str
    ties: tuple[str, ...] = ()
    width: int | None = None

    def resolve(self, df: DataFrame) -> "Lane":
        return self if self.width else replace(self, width=block_rows(df.sparkSession))

    def block(self) -> Column:
        return F.floor(F.col(self.order) / F.lit(self.width)).cast("bigint")

    def sort(self, reverse: bool = False) -> list[Column]:
        cols = [F.col(c) for c in (self.order, *self.ties)]
        return [c.desc() for c in cols] if reverse else cols

    def position(self) -> Column:
        return F.struct(self.order, *self.ties) if self.ties else F.col(self.order)

    @property
    def block_keys(self) -> list[str]:
        return [*self.keys, BLOCK]


@dataclass(frozen=True)
class Running:
    """One running value.

    ``kind`` is sum, max, min or last (last non-null). ``reverse`` scans from the end (so ``last``
    becomes the next non-null value). ``inclusive=False`` leaves the current row out. ``fields`` says that
    the value is a struct of these columns: block totals are then taken field by field, which keeps
    numbers in a hash aggregate, where a struct would have to be sorted.
    """

    kind: str
    value: Column
    inclusive: bool = True
    reverse: bool = False
    default: object = field(default=None)
    fields: tuple[str, ...] = ()

    def summarise(self, lane: Lane) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        if self.kind == "min":
            return F.min(self.value)
        if self.kind == "last" and self.fields:
            by = F.min_by if self.reverse else F.max_by
            return F.struct(*[by(F.col(c), lane.position()).alias(c) for c in self.fields])
        if self.kind == "last":
            at = F.when(self.value.isNotNull(), lane.position())
            return (F.min_by if self.reverse else F.max_by)(self.value, at)
        raise ValueError(f"unknown running kind {self.kind!r}")

    def scan(self, value: Column, window) -> Column:
        if self.kind == "last":
            return F.last(value, ignorenulls=True).over(window)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.kind](value).over(window)

    def combine(self, carry: Column, local: Column) -> Column:
        if self.kind == "sum":
            both = F.coalesce(carry, F.lit(0)) + F.coalesce(local, F.lit(0))
        elif self.kind == "max":
            both = F.greatest(carry, local)
        elif self.kind == "min":
            both = F.least(carry, local)
        else:
            both = F.coalesce(local, carry)
        return both if self.default is None else F.coalesce(both, F.lit(self.default))


def running(df: DataFrame, lane: Lane, **specs: Running) -> DataFrame:
    """Add running values over a lane, computed block by block with a carried prefix."""
    lane = lane.resolve(df)
    blocked = df.withColumn(BLOCK, lane.block())
    summary = blocked.groupBy(*lane.block_keys).agg(
        *[spec.summarise(lane).alias(f"_s_{name}") for name, spec in specs.items()]
    )
    carried = []
    for name, spec in specs.items():
        across = Window.partitionBy(*lane.keys).orderBy(F.col(BLOCK).desc() if spec.reverse else F.col(BLOCK))
        carried.append(spec.scan(F.col(f"_s_{name}"), across.rowsBetween(_HEAD, -1)).alias(f"_c_{name}"))
    joined = blocked.join(summary.select(*lane.block_keys, *carried), lane.block_keys, "left")
    local = {}
    for name, spec in specs.items():
        inside = Window.partitionBy(*lane.block_keys).orderBy(*lane.sort(spec.reverse))
        frame = inside.rowsBetween(_HEAD, 0 if spec.inclusive else -1)
        local[name] = spec.combine(F.col(f"_c_{name}"), spec.scan(spec.value, frame))
    kept = [c for c in df.columns if c not in local]
    return joined.select(*kept, *[expr.alias(name) for name, expr in local.items()])


def previous(df: DataFrame, lane: Lane, name: str, *columns: str, reverse: bool = False) -> DataFrame:
    """Add the preceding (or following) row of the lane as a struct; NULL at the end of the lane."""
    return running(
        df, lane, **{name: Running("last", F.struct(*columns), inclusive=False, reverse=reverse, fields=columns)}
    )


def numbered(df: DataFrame, lane: Lane, *columns: str, name: str = "_n", before: str = "_prev") -> DataFrame:
    """Row number and preceding row in one pass."""
    out = running(
        df,
        lane,
        **{
            name: Running("sum", F.lit(1).cast("bigint")),
            before: Running("last", F.struct(*columns), inclusive=False, fields=columns),
        },
    )
    return out.withColumn(name, F.col(name) - 1)


def with_ordinal(df: DataFrame, lane: Lane, name: str = "_n") -> DataFrame:
    """Dense 0-based row number inside the lane."""
    out = running(df, lane, **{name: Running("sum", F.lit(1).cast("bigint"))})
    return out.withColumn(name, F.col(name) - 1)


def halo(df: DataFrame, lane: Lane, before: int, after: int) -> DataFrame:
    """Copy rows into every block whose frames need them.

    ``lane.order`` must be a non-negative integer position. A block receives its own rows
    (``_own``), the ``before`` positions ahead of it and the ``after`` positions behind it.
    """
    lane = lane.resolve(df)
    pos, width = F.col(lane.order), F.lit(lane.width)
    first = F.greatest(F.floor((pos - after) / width), F.lit(0)).cast("bigint")
    last = F.floor((pos + before) / width).cast("bigint")
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(
        "_own", lane.block() == F.col(BLOCK)
    )


def framed(
    df: DataFrame, lane: Lane, before: int, after: int, *stages: Callable[[object], dict[str, Column]]
) -> DataFrame:
    """Evaluate bounded window expressions; every stage gets the ordered block window.

    Later stages may use columns of earlier ones; ``before`` and ``after`` cover all stages together.
    """
    lane = lane.resolve(df)
    done = halo(df, lane, before, after)
    window = Window.partitionBy(*lane.block_keys).orderBy(*lane.sort())
    kept = df.columns
    for stage in stages:
        out = stage(window)
        kept = [c for c in kept if c not in out]
        done = done.select(*kept, *lane_extra(lane, kept), "_own", *[e.alias(n) for n, e in out.items()])
        kept = [*kept, *out]
    return done.filter("_own").select(*kept)


def lane_extra(lane: Lane, kept: Sequence[str]) -> list[str]:
    """Block columns a later stage still needs."""
    return [BLOCK] if BLOCK not in kept else []


def per_block(
    df: DataFrame, lane: Lane, before: int, after: int, fn: Callable, schema: str
) -> DataFrame:
    """Run a vectorised function on every block plus its halo.

    ``fn(pdf)`` receives the rows of one block in lane order with the boolean column ``_own`` and
    returns rows for its own part only. A block is at most ``width + before + after`` positions.
    """
    lane = lane.resolve(df)
    order = [lane.order, *lane.ties]

    def run(pdf):
        return fn(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return halo(df, lane, before, after).groupBy(*lane.block_keys).applyInPandas(run, schema)


def islands(df: DataFrame, lane: Lane, starts: Column, name: str = "island") -> DataFrame:
    """Number the runs of a lane; ``starts`` is true on the first row of a run."""
    return running(df, lane, **{name: Running("sum", F.when(starts, 1).otherwise(0).cast("bigint"))})


def dealt_ranges(df: DataFrame, low: str, high: str, name: str, span: int = 1 << 20, part: int = 1 << 10) -> DataFrame:
    """One row for every whole number from ``low`` to ``high``, both included, in place of the two columns.

    A range of any length is cut into spans, these are dealt over tasks, and only there filled in small parts: no task gets more than
    its share of spans and no row holds more than ``part`` numbers (10^12 numbers make 10^6 spans).
    """
    kept = [c for c in df.columns if c not in (low, high)]
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(rows: DataFrame, size: int) -> DataFrame:
        begins = rows.select(*kept, F.explode(F.sequence(low, high, F.lit(size).cast("bigint"))).alias("_begin"), high)
        return begins.select(*kept, F.col("_begin").alias(low), F.least(F.col("_begin") + (size - 1), F.col(high)).alias(high))

    whole = df.filter(F.col(low) <= F.col(high)).select(*kept, F.col(low).cast("bigint").alias(low), F.col(high).cast("bigint").alias(high))
    spans = cut(whole, span).repartition(tasks, *kept, low)
    return cut(spans, part).select(*kept, F.explode(F.sequence(low, high)).alias(name))


def lane_keys(pdf, keys: Sequence[str]) -> list[tuple]:
    """Key values of every row, also where a lane has no key."""
    return list(pdf[list(keys)].itertuples(index=False, name=None)) if keys else [()] * len(pdf)
