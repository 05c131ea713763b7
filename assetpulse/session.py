"""Session helpers: time zone check, shared scratch tables, bounded lookups."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F


def use_utc(spark: SparkSession) -> SparkSession:
    """All timestamps are UTC; the column functions rely on the session zone saying so."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


@lru_cache(maxsize=1)
def _local_scratch() -> str:
    return "file://" + tempfile.mkdtemp(prefix="spark-scratch-", dir="/tmp")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine; on a cluster an unset folder is an error,
    because tables written there would be lost with the executor.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local"):
        return _local_scratch()
    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def run_folder(spark: SparkSession) -> str:
    """Where this application keeps its intermediate tables."""
    return f"{scratch_dir(spark)}/assetpulse-{spark.sparkContext.applicationId}"


def stored(df: DataFrame, label: str, codec: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder; the table read back, and its path for ``forget``."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage of iterative jobs and lets several consumers share one computation. The files
    survive the loss of executors and keep column pruning and pushdown for whoever reads them. ``codec`` is for wide binary
    columns that the session's compression leaves as they are.
    """
    return stored(df, label, codec)[0]


def forget(spark: SparkSession, path: str | None) -> None:
    """Delete an intermediate table that nothing reads any more."""
    if path:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def forget_all(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written."""
    forget(spark, run_folder(spark))


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores when the scan yields fewer partitions than that (small files); large scans stay as they are.

    For work that is heavy per row, where one file's single split would leave the other cores idle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by their keys over all cores, whatever their bytes: for rows that are small and each ask for much work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def broadcast_below(df: DataFrame, rows: int, limit: int = 200_000) -> DataFrame:
    """Broadcast a side whose row count is known to stay below the limit; otherwise leave the join to the engine."""
    return F.broadcast(df) if rows <= limit else df


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that is never broadcast: both sides are shuffled and merged, whatever size Spark expects.

    For rows out of an explode, which Spark takes for as many as went in, and for arrays, which it takes for one element each: on
    that guess it would collect all of them in the driver.
    """
    return df.hint("merge")


def fixed_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A lookup table written in the program text (its size is bounded by that text), marked for broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))


def number_rows(df: DataFrame, order: list, column: str, label: str = "numbered") -> DataFrame:
    """Consecutive numbers 1..n in the given order without moving all rows to one task.

    Rows are range-partitioned and sorted once; the partitions' row counts (one row per partition) are then
    turned into offsets. Equal sort keys stay in one partition, so ``order`` should identify rows.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = materialize(
        df.repartitionByRange(parts, *order)
        .sortWithinPartitions(*order)
        .withColumn("_row", F.monotonically_increasing_id()),
        label,
    )
    part = F.shiftrightunsigned("_row", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    offsets = sizes.select(
        "_part", F.expr("sum(_n) OVER (ORDER BY _part) - _n").alias("_offset")
    )  # one row per partition
    local = F.col("_row") - F.shiftleft(F.col("_part"), 33) + 1
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(column, F.col("_offset") + local)
        .drop("_part", "_offset", "_row")
    )
