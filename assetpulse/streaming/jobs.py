"""Streaming forms: ingest per micro-batch, cells as tumbling windows, events as sessions, offline detection.

Readings may come late, be sent again, or arrive newest first; none may be lost. So the stored results do not rest on a
watermark: cells are kept as mergeable parts of every micro-batch, sessions and silent times are derived again for the
sensors a micro-batch touches. What is still open when the input ends is stored like everything else and changes when more
arrives. Every micro-batch writes folders of its own number, so running one again replaces them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.timeaxis import TimeAxis
from ..operators import ingest
from ..params import GRID_TOLERANCE


def ingest_stream(raw: DataFrame, sensors: DataFrame, out: str, rejects: str, checkpoint: str, source: str) -> StreamingQuery:
    """Validate and upsert every micro-batch into ``out`` (by day); rejected rows with their reason go to ``rejects``.

    The upsert is idempotent and the reject files are named by batch, so a batch that is run again changes nothing.
    """

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        checked = ingest.validate_readings(batch, sensors)
        checked.persist()
        kept = ingest.keep_last(checked).withColumn("source", F.lit(source))
        ingest.upsert_readings(out, kept)
        refused = checked.where(F.col("reason").isNotNull()).withColumn("batch_id", F.lit(batch_id))
        refused.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(rejects)
        checked.unpersist()

    return (
        raw.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def cell_windows(readings: DataFrame, axis: TimeAxis, lateness: str | None = None) -> DataFrame:
    """Last value per sensor and grid cell of the axis, as an event-time window over ``(t - step, t]``.

    Shifting the time by one microsecond and by the tolerance of the axis, and holding it inside its cell, turns the half-open
    window of the engine into the cell rule. On a stream, ``lateness`` closes windows (and drops what comes later); without it
    nothing is dropped.
    """
    offset = axis.start_us % axis.step_us
    end = F.unix_micros(axis.at(axis.cell(F.col("ts"))))
    time = F.unix_micros("ts") - round(GRID_TOLERANCE * axis.step_us) - 1
    moved = readings.withColumn("at", F.timestamp_micros(F.greatest(F.least(time, end - 1), end - axis.step_us)))
    moved = moved.withWatermark("at", lateness) if lateness else moved
    w = F.window("at", f"{axis.step_s} seconds", f"{axis.step_s} seconds", f"{offset} microseconds")
    return moved.groupBy("sensor_id", w.alias("w")).agg(F.max(F.struct("ts", "value")).alias("r")).select(
        "sensor_id", axis.cell(F.col("w.end")).alias("cell"), "r.ts", "r.value"
    ).where(F.col("cell").between(0, axis.count - 1))


def cells_stream(readings: DataFrame, axis: TimeAxis, folder: str, checkpoint: str) -> StreamingQuery:
    """Writes the cells of every micro-batch; ``stored_cells`` merges them."""

    def one_batch(batch: DataFrame, number: int) -> None:
        cell_windows(batch, axis).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return readings.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stored_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The last value per sensor and cell over all micro-batches; of equal times that of the latest batch."""
    newest = F.struct("ts", "batch")
    return spark.read.parquet(folder).groupBy("sensor_id", "cell").agg(F.max("ts").alias("ts"), F.max_by("value", newest).alias("value"))


def session_events(
    flagged: DataFrame, axis: TimeAxis, gap_steps: int, min_flagged: int, z_strong: float, lateness: str | None = None
) -> DataFrame:
    """Runs of flagged steps as session windows with a gap of (merge gap + 1) steps; persistence as a filter.

    ``flagged`` has sensor_id, at (time of the step), z and critical, flagged steps only.
    """
    gap = f"{(gap_steps + 1) * axis.step_s} seconds"
    rows = flagged.withWatermark("at", lateness) if lateness else flagged
    sessions = rows.groupBy("sensor_id", F.session_window("at", gap).alias("w")).agg(
        F.min("at").alias("started_at"),
        F.max("at").alias("ended_at"),
        F.count("*").alias("flagged_steps"),
        F.max(F.abs("z")).alias("peak_abs_z"),
        F.bool_or("critical").alias("critical"),
    )
    keep = (F.col("peak_abs_z") >= z_strong) | (F.col("flagged_steps") >= min_flagged) | F.col("critical")
    return sessions.where(keep).drop("w")


def derived_stream(rows: DataFrame, key: str, derive: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``derive`` of all rows so far up to date, key by key; ``derived`` reads the result.

    A micro-batch is added to the history, and the keys it holds are derived again from their whole history.
    """

    def one_batch(batch: DataFrame, number: int) -> None:
        spark, own = batch.sparkSession, f"batch={number}"
        batch.write.mode("overwrite").parquet(f"{folder}/history/{own}")
        spark.read.parquet(f"{folder}/history/{own}").select(key).distinct().write.mode("overwrite").parquet(f"{folder}/keys/{own}")
        touched = spark.read.parquet(f"{folder}/keys/{own}")
        so_far = spark.read.parquet(f"{folder}/history").where(F.col("batch") <= number).drop("batch").select(*batch.columns)
        derive(so_far.join(touched, key, "left_semi")).write.mode("overwrite").parquet(f"{folder}/out/{own}")

    return rows.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def derived(spark: SparkSession, key: str, folder: str) -> DataFrame:
    """The rows of each key as its newest micro-batch left them."""
    newest = spark.read.parquet(f"{folder}/keys").groupBy(key).agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{folder}/out").join(newest, [key, "batch"]).drop("batch")


def silent_times(readings: DataFrame, interval_s: int) -> DataFrame:
    """(sensor_id, last_us, kind) of the readings so far: ``offline`` at a reading that is followed by a longer silence than
    the interval, ``online`` at the reading that ends it, and ``last`` at a sensor's newest reading."""
    us = F.unix_micros("ts").alias("us")
    seen = readings.select("sensor_id", us).distinct().withColumn("next", F.lead("us").over(W.partitionBy("sensor_id").orderBy("us")))
    silent = F.col("next") - F.col("us") > interval_s * 1_000_000
    mark = lambda at, kind: F.struct(F.col(at).alias("last_us"), F.lit(kind).alias("kind"))
    marks = F.when(F.col("next").isNull(), F.array(mark("us", "last"))).when(silent, F.array(mark("us", "offline"), mark("next", "online")))
    return seen.select("sensor_id", F.inline(marks))


def silences(times: DataFrame, interval_s: int) -> DataFrame:
    """``silent_times`` with the end of the input as the clock: a sensor whose newest reading is older than the interval is offline."""
    clock = times.where("kind = 'last'").agg(F.max("last_us").alias("now"))  # one row
    due = F.col("now") - F.col("last_us") > interval_s * 1_000_000
    rows = times.join(F.broadcast(clock), how="cross").where((F.col("kind") != "last") | due)
    return rows.select("sensor_id", "last_us", F.when(F.col("kind") == "last", "offline").otherwise(F.col("kind")).alias("kind"))


def offline_alerts(readings: DataFrame, interval_s: int, lateness: str) -> DataFrame:
    """(sensor_id, last_us, kind): ``offline`` when a sensor stays silent for its sampling interval, ``online`` when it
    reports again. State per sensor is one timestamp; the timeout runs on event time.

    These alerts are for watching: they come at once, and a late reading does not take one back. What is stored comes from
    ``silent_times``.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, silent = state.get if state.exists else (None, False)
        out = []
        if state.hasTimedOut:
            out.append((key[0], known, "offline"))
            state.update((known, True))
        else:
            newest = max(int(b["us"].max()) for b in batches)
            if silent and newest > known:
                out.append((key[0], newest, "online"))
            newest = newest if known is None else max(newest, known)
            state.update((newest, False))
            due_ms = (newest // 1000) + interval_s * 1000
            state.setTimeoutTimestamp(max(due_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["sensor_id", "last_us", "kind"])

    return (
        readings.withWatermark("ts", lateness)
        .withColumn("us", F.unix_micros("ts"))
        .groupBy("sensor_id")
        .applyInPandasWithState(
            watch, "sensor_id string, last_us bigint, kind string", "last_us bigint, silent boolean", "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def write_append(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Files in append mode, all available input, then stop."""
    return (
        stream.writeStream.format("parquet").outputMode("append").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
