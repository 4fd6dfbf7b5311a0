"""Wide bounded frames, evaluated per block with rolling kernels.

A sliding ``percentile`` over a thousand rows is recomputed for every row by a SQL window, so frames beyond
a few dozen rows go through Arrow blocks instead: Spark splits the lane into blocks with a halo and each
task rolls over one block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ringsight.operators.ordered import Lane, per_block


def extended(df: DataFrame, **added: str) -> str:
    """Schema text of ``df`` with extra columns."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema] + [f"{n} {k}" for n, k in added.items()])


def own(pdf: pd.DataFrame, names: list[str]) -> pd.DataFrame:
    return pdf.loc[pdf["_own"], names]


def moving_median(x, size: int) -> np.ndarray:
    return pd.Series(x).rolling(size | 1, center=True, min_periods=1).median().to_numpy()


def moving_mean(x, size: int) -> np.ndarray:
    """Centred mean over an odd frame that shrinks at the ends; NaN is skipped."""
    x = np.asarray(x, dtype="float64")
    half, n = size // 2, len(x)
    good = ~np.isnan(x)
    total = np.concatenate([[0.0], np.cumsum(np.where(good, x, 0.0))])
    count = np.concatenate([[0], np.cumsum(good)])
    lo = np.maximum(np.arange(n) - half, 0)
    hi = np.minimum(np.arange(n) + half + 1, n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return (total[hi] - total[lo]) / (count[hi] - count[lo])


def trailing_quantiles(
    df: DataFrame,
    lane: Lane,
    value: str,
    size: int,
    probs: dict[str, float],
    include_current: bool = True,
    least: int = 1,
) -> DataFrame:
    """Exact quantiles of the latest ``size`` rows, NULL while fewer than ``least`` values are known.

    ``lane.order`` must be a dense position.
    """
    names = df.columns

    def fn(pdf):
        x = pdf[value].astype("float64")
        roll = (x if include_current else x.shift(1)).rolling(size, min_periods=least)
        for name, p in probs.items():
            pdf[name] = roll.quantile(p, interpolation="linear")
        return own(pdf, [*names, *probs])

    return per_block(df, lane, size, 0, fn, extended(df, **{n: "double" for n in probs}))
