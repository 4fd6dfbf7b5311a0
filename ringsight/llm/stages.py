"""Stages in the shared folder. A written stage cuts the lineage and outlives the executors that made it."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ringsight.session import checkpoint_root

_here = threading.local()


def settle(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write once to the shared folder and go on from there."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/stages/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    if getattr(_here, "lists", None):
        _here.lists[-1].append(path)
    writer = df.write if codec is None else df.write.option("compression", codec)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settle_compact(df: DataFrame) -> DataFrame:
    """As settle, with the compression that suits whole texts."""
    return settle(df, "zstd")


@contextmanager
def collecting(paths: list[str]) -> Iterator[None]:
    """Note the folders of all stages that this thread writes inside, in the order of writing."""
    _here.lists = [*getattr(_here, "lists", []), paths]
    try:
        yield
    finally:
        _here.lists = _here.lists[:-1]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete stages that no result needs any more."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        folder = jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
