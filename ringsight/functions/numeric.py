"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_MEASURED = "__nan__"  # fixed value: text that stands for "not measured" in stored JSON


def measured(value: Column) -> Column:
    """NaN means "not measured": NULL from here on, so aggregates skip it."""
    return F.when(~F.isnan(value), value)


def half_even(value: Column, digits: int = 0) -> Column:
    """Round half to even on the scaled double, as array libraries do."""
    return F.rint(value) if digits == 0 else F.rint(value * 10.0**digits) / 10.0**digits


def clamp(value: Column, low, high) -> Column:
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.greatest(F.least(value, high), low)


def encode_missing(value: Column) -> Column:
    """Stored text of a number, with a sentinel where it is NaN."""
    return F.when(F.isnan(value), F.lit(NOT_MEASURED)).otherwise(value.cast("string"))


def decode_missing(text: Column) -> Column:
    return F.nullif(text, F.lit(NOT_MEASURED)).cast("double")


def logit(p: Column, eps: float = 1e-4) -> Column:
    q = clamp(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def median_of(column: Column) -> Column:
    """Exact median usable with a row frame (``median`` itself rejects frames)."""
    return F.percentile(column, F.lit(0.5))


def violations(*rules: tuple[Column, str]) -> Column:
    """Names of the rules a row breaks, as an array; a rule that cannot be decided counts as broken."""
    return F.array_compact(
        F.array(*[F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for holds, name in rules])
    )
