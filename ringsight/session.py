"""Session construction and the few settings the package reads from it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BLOCK_ROWS_KEY = "spark.ringsight.blockRows"
BLOCK_ROWS_DEFAULT = 32768


def build_session(master: str = "local[*]", app: str = "ringsight", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for.

    On a cluster the caller usually brings its own session; nothing below is required for right
    results except the UTC session zone.
    """
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def block_rows(spark: SparkSession) -> int:
    """Width of one block of an ordered lane, in order-key units."""
    return int(spark.conf.get(BLOCK_ROWS_KEY, str(BLOCK_ROWS_DEFAULT)))


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset (a local test) a
    temporary folder is taken, and it is remembered for the life of the session.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(
        "spark.checkpoint.dir", None
    )
    if root:
        return root
    existing = spark.conf.get("spark.ringsight.checkpointRoot", None)
    if existing is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        existing = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.ringsight.checkpointRoot", existing)
    return existing


def settle(df: DataFrame) -> DataFrame:
    """Write a stage once to the shared folder and go on from there.

    A carry needs its input twice (block totals, then rows), so a chain of carries would compute its
    first stage again and again. A written stage is computed once, is read by column, and survives the
    loss of the executors that made it. Streams pass through unchanged.
    """
    if df.isStreaming:
        return df
    path = f"{_stage_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stage_folder(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/stages/{spark.sparkContext.applicationId}"


def clear_stages(spark: SparkSession) -> None:
    """Remove all stages that this application has written. Call it when no result that reads them is needed any more."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(_stage_folder(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
