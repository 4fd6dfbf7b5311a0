"""Sinks: appends, upserts into partitioned parquet, report files and schema migration."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringsight.operators.alerts import KEPT_ON_UPDATE, alert_violations, append_alerts, keyed_upsert, safe_path
from ringsight.session import settle

DAY_US = 86_400_000_000


def append_valid_alerts(df: DataFrame, path: str) -> DataFrame:
    """Append rows that break no rule; returns the rejected ones with their violations."""
    checked = df.withColumn("violations", alert_violations())
    good = append_alerts(checked.filter(F.size("violations") == 0).drop("violations"))
    good.write.mode("append").parquet(path)
    return checked.filter(F.size("violations") > 0)



def complete_versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete versions of an upserted table, oldest first."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder(path)):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder(path))]
    return sorted(n for n in names if fs.exists(folder(f"{path}/{n}/_SUCCESS")))


def current_version(spark: SparkSession, path: str) -> str | None:
    """Folder of the newest complete version of an upserted table."""
    done = complete_versions(spark, path)
    return f"{path}/{done[-1]}" if done else None


def upsert_parquet(
    incoming: DataFrame, path: str, keys: list[str], order: list[str], source: str, batch: int,
    kept: tuple[str, ...] = KEPT_ON_UPDATE,
) -> str:
    """Upsert a batch into a versioned parquet table and return the folder of the newest version.

    Versions count up by themselves, whoever writes. A version's name also holds its source (a query, by its checkpoint)
    and that source's batch number, so a batch that is run again after a failure finds itself and changes nothing, while a
    new checkpoint is a new source and is never skipped. A version is visible only once its ``_SUCCESS`` marker is
    there. One writer at a time.
    """
    spark = incoming.sparkSession
    done = complete_versions(spark, path)
    mine = [int(n.rpartition("-")[2]) for n in done if n.partition("-")[2].rpartition("-")[0] == source]
    if mine and max(mine) >= batch:
        return f"{path}/{done[-1]}"
    number = int(done[-1].partition("-")[0][1:]) + 1 if done else 0
    stored = spark.read.parquet(f"{path}/{done[-1]}") if done else spark.createDataFrame([], incoming.schema)
    target = f"{path}/v{number:012d}-{source}-{batch}"
    keyed_upsert(stored, incoming, keys, order, kept).write.mode("overwrite").parquet(target)
    return target


def append_dated(df: DataFrame, path: str, at: str, days: int = 1) -> None:
    """Append rows to a table with a partition for every ``days`` days of ``at`` (microseconds), named by the first of them in ``day``; rows
    without a time go to the null day. A hot day is written by several tasks, small ones share a task."""
    day = F.date_from_unix_date((F.floor(F.col(at) / (days * DAY_US)) * days).cast("int"))
    df.withColumn("day", day).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def remove_before(spark: SparkSession, path: str, at: str, cutoff_us: int, evidence: str, listing: str, days: int = 1) -> DataFrame:
    """Remove rows older than the cutoff from a dated table and return the evidence files that belonged to them (column ``file``).

    Days before that of the cutoff are dropped whole, the day of the cutoff is overwritten with its rest if anything of it expires, and no
    other partition is read or written. Rows without a time stay. The files are written to a folder of their own under ``listing`` before
    anything is removed, so a run that dies may simply be started again: what it had removed is listed already. If a file's path would leave the
    evidence folder, ValueError is raised and nothing is removed. One writer at a time.
    """
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = folder(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    border = (datetime.date(1970, 1, 1) + datetime.timedelta(days=cutoff_us // (days * DAY_US) * days)).isoformat()
    table = spark.read.parquet(path)
    old = table.filter((F.col("day") <= F.lit(border).cast("date")) & (F.col(at) < cutoff_us))
    files = settle(old.filter(F.col(evidence).isNotNull()).select(F.col(evidence).alias("file")).distinct())
    if not files.filter(~safe_path(F.col("file"))).isEmpty():
        raise ValueError("an expired row names a file outside the evidence folder")
    target = run_folder(listing)
    files.write.parquet(target)
    split = table.filter(F.col("day") == F.lit(border).cast("date"))
    goes, stays = (not split.filter(c).isEmpty() for c in (F.col(at) < cutoff_us, F.col(at) >= cutoff_us))
    if goes and stays:
        rest = settle(split.filter(F.col(at) >= cutoff_us))
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    names = [s.getPath().getName() for s in fs.listStatus(folder(path))]  # a name per day
    for name in names:
        if not (name.startswith("day=") and name[4:5].isdigit()):
            continue
        if name[4:] < border or (name[4:] == border and goes and not stays):
            fs.delete(folder(f"{path}/{name}"), True)
    return spark.read.schema(files.schema).parquet(target)


def write_window_stats(stats: DataFrame, path: str) -> None:
    """One small JSON document per window."""
    stats.coalesce(1).write.mode("overwrite").json(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Report text; the lines stay ordered across the part files."""
    lines.write.mode("overwrite").text(path)


def migrate(old: DataFrame, schema: str, renames: dict[str, str]) -> DataFrame:
    """Old rows in the current shape: renamed columns, missing ones added as NULL, types widened."""
    spark = old.sparkSession
    for before, after in renames.items():
        if before in old.columns:
            old = old.withColumnRenamed(before, after)
    empty = spark.createDataFrame([], schema)
    wide = empty.unionByName(old, allowMissingColumns=True)
    return wide.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in empty.schema])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that would break a unique index on non-null keys."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def run_folder(path: str) -> str:
    """A fresh folder name under ``path`` for one run."""
    return f"{path.rstrip('/')}/{uuid.uuid4().hex}"
