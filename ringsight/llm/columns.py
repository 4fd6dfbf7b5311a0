"""Column helpers of the native operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once per row, however often later columns read it: an exploded one-element array
    keeps the optimizer from copying the expression into each use."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores in front until no column of the table has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def carry(df: DataFrame, *names: str) -> DataFrame:
    """All columns in one struct ``row``, so that none can clash with an added one, and the named columns beside it."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), *names)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def literal_table(spark: SparkSession, names: tuple[str, ...], rows: list[tuple]) -> DataFrame:
    """A small table of constants that needs no Python on the executors."""
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows])
    return spark.range(1).select(F.inline(cells))
