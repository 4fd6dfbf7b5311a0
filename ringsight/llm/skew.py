"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT = 1000  # a key with more than one in HOT of all rows is hot, so there are fewer than HOT of them


def join_by_size(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key and the number of its rows in ``count``.

    Hot keys, fewer than ``HOT`` by their definition, are broadcast; the others meet in a shuffle, where none of them is large.
    """
    total = rows.count()
    hot = F.broadcast(table.filter(F.col(count) * HOT > total))
    cold = table.filter(F.col(count) * HOT <= total)
    return rows.join(hot, key).unionByName(rows.join(hot, key, "left_anti").join(cold, key))
