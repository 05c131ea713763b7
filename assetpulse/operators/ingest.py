"""Validation, deduplication and upsert of incoming readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..params import PLAUSIBLE_RANGES

REASONS = (
    "invalid_record",
    "unknown_sensor",
    "naive_timestamp",
    "non_finite_value",
    "unit_mismatch",
    "duplicate_reading",
)
TIME_SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
OFFSET_SHAPE = r"(Z|[+-]\d{2}:?\d{2})$"


def plausible(sensor_type: Column, value: Column) -> Column:
    ok = F.lit(True)
    for name, (low, high) in PLAUSIBLE_RANGES.items():
        ok = F.when(sensor_type == name, value.between(low, high)).otherwise(ok)
    return ok


def validate_readings(raw: DataFrame, sensors: DataFrame) -> DataFrame:
    """``raw`` (sensor_id, ts text, value double, unit, seq) plus ``time``, ``reason`` (null = accepted), ``status``.

    The first rule that fails names the reason. ``seq`` is the arrival order.
    """
    known = sensors.select(
        "sensor_id", F.col("sensor_type"), F.col("unit").alias("_unit"), F.lit(True).alias("_known")
    )
    shaped = F.col("ts").rlike(TIME_SHAPE)
    parsed = F.when(shaped, F.try_to_timestamp("ts"))
    value = F.col("value")
    reason = (
        F.when(F.coalesce(F.col("sensor_id"), F.lit("")) == "", "invalid_record")
        .when(F.col("time").isNull() | value.isNull(), "invalid_record")
        .when(F.col("_known").isNull(), "unknown_sensor")
        .when(~F.col("ts").rlike(OFFSET_SHAPE), "naive_timestamp")
        .when(F.isnan(value) | (F.abs(value) == float("inf")), "non_finite_value")
        .when(~F.col("unit").eqNullSafe(F.col("_unit")), "unit_mismatch")
    )
    return (
        raw.withColumn("time", parsed)
        .join(known, "sensor_id", "left")
        .withColumn("reason", reason)
        .withColumn(
            "status",
            F.when(F.col("reason").isNull(), F.when(plausible(F.col("sensor_type"), value), "ok").otherwise("suspect")),
        )
        .drop("_unit", "_known")
    )


def keep_last(validated: DataFrame) -> DataFrame:
    """The accepted readings, one per (sensor, instant): the last to arrive wins.

    A grouped ``max_by`` rather than a window: it combines on the map side, so a key that was re-sent very often
    does not travel to one task row by row.
    """
    return (
        validated.where(F.col("reason").isNull())
        .groupBy("sensor_id", F.col("time").alias("ts"), "sensor_type", "unit")
        .agg(
            F.max_by("value", "seq").alias("value"),
            F.max("seq").alias("seq"),
            (F.count("*") - 1).alias("superseded"),
        )
        .withColumn("status", F.when(plausible(F.col("sensor_type"), F.col("value")), "ok").otherwise("suspect"))
    )


def ingest_result(validated: DataFrame) -> DataFrame:
    """One row: accepted, suspect, rejected and the counts per reason (sorted map)."""
    kept = keep_last(validated).agg(
        F.count("*").alias("accepted"),
        F.count_if(F.col("status") == "suspect").alias("suspect"),
        F.coalesce(F.sum("superseded"), F.lit(0)).alias("dup"),
    )
    refused = validated.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count("*").alias("n"))
    parts = refused.unionByName(
        kept.select(F.lit("duplicate_reading").alias("reason"), F.col("dup").alias("n")).where("n > 0")
    )
    reasons = parts.agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("reasons"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rejected"),
    )
    return kept.crossJoin(F.broadcast(reasons)).select("accepted", "suspect", "rejected", "reasons")  # one row each


def merge_readings(existing: DataFrame, batch: DataFrame) -> DataFrame:
    """Existing readings overlaid with a batch: a re-sent (sensor, instant) takes the batch's value."""
    columns = ["sensor_id", "ts", "value", "unit", "status", "source"]
    both = existing.select(*columns, F.lit(0).cast("bigint").alias("_seq")).unionByName(
        batch.select(*columns, (F.col("seq") + 1).cast("bigint").alias("_seq"))
    )
    latest = F.max_by(F.struct("value", "unit", "status", "source"), "_seq").alias("r")
    return both.groupBy("sensor_id", "ts").agg(latest).select("sensor_id", "ts", "r.*")


def upsert_readings(path: str, batch: DataFrame) -> None:
    """Merge a batch into the readings table at ``path`` (partitioned by ``day``), rewriting only touched days."""
    spark = batch.sparkSession
    day = F.to_date("ts")
    batch = batch.withColumn("day", day)
    exists = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = exists.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(exists) and len(fs.listStatus(exists)) > 0:
        schema = "sensor_id string, ts timestamp, value double, unit string, status string, source string, day date"
        stored = spark.read.schema(schema).parquet(path)
        touched = stored.join(batch.select("day").distinct(), "day", "left_semi")
    else:
        touched = batch.limit(0)
    merged = merge_readings(touched, batch).withColumn("day", day)
    (
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    )
