"""From flagged steps to scored anomaly events.

All windows are keyed by sensor, so they reuse the partitioning the baseline already has; the grouping by
(sensor, island) is satisfied by it too. Only the final numbering moves rows again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import text
from ..functions.rounding import clip, round_even
from ..functions.rules import severity_of
from ..functions.timeaxis import TimeAxis
from ..params import (
    DURATION_FULL_HOURS,
    LOG_DOMAIN_TYPES,
    MAGNITUDE_BASE_Z,
    MAGNITUDE_DOUBLINGS,
    PRESSURE_DECLINE_MIN_HOURS,
    SCORE_WEIGHTS,
    TEMPERATURE_DRIFT_MIN_HOURS,
    VIBRATION_SPIKE_MAX_HOURS,
    Params,
)
from ..session import number_rows
from .grid import with_islands


def magnitude(peak_z: Column) -> Column:
    ratio = F.abs(peak_z) / MAGNITUDE_BASE_Z
    return F.when(ratio > 0, clip(F.log2(ratio) / MAGNITUDE_DOUBLINGS, 0, 1)).otherwise(0.0)


def duration_part(hours: Column) -> Column:
    return clip(F.log(1.0 + hours) / math.log(1.0 + DURATION_FULL_HOURS), 0, 1)


def threshold_part(level: Column) -> Column:
    return F.when(level == "critical", 1.0).when(level == "warning", 0.5).otherwise(0.0)


def score_of(m: Column, d: Column, t: Column) -> Column:
    total = m * SCORE_WEIGHTS["magnitude"] + d * SCORE_WEIGHTS["duration"] + t * SCORE_WEIGHTS["threshold"]
    return round_even(total, 3)


def anomaly_type(sensor_type: Column, peak_z: Column, hours: Column) -> Column:
    """Descriptive signature from the sensor type, the sign of the peak and the duration."""
    above = peak_z > 0
    vibration = F.when(~above, "vibration_drop").otherwise(
        F.when(hours <= VIBRATION_SPIKE_MAX_HOURS, "vibration_spike").otherwise("sustained_high_vibration")
    )
    pressure = F.when(above, "pressure_spike").otherwise(
        F.when(hours >= PRESSURE_DECLINE_MIN_HOURS, "pressure_decline").otherwise("pressure_drop")
    )
    temperature = F.when(hours >= TEMPERATURE_DRIFT_MIN_HOURS, "temperature_drift").otherwise(
        F.when(above, "temperature_spike").otherwise("temperature_drop")
    )
    return (
        F.when(sensor_type == "vibration", vibration)
        .when(sensor_type == "moisture", F.when(above, "moisture_increase").otherwise("moisture_decrease"))
        .when(sensor_type == "pressure", pressure)
        .when(sensor_type == "temperature", temperature)
        .otherwise(F.concat(sensor_type, F.lit("_anomaly")))
    )


def breach(lowest: Column, highest: Column) -> Column:
    """The most serious limit passed: critical before warning, low before high; null when none."""

    def entry(level, side, limit, extreme):
        return F.struct(
            F.lit(level).alias("level"), F.lit(side).alias("side"), limit.alias("limit"), extreme.alias("extreme")
        )

    out = None
    for level, low, high in (("critical", "crit_low", "crit_high"), ("warning", "warn_low", "warn_high")):
        for side, limit, extreme, hit in (
            ("below", F.col(low), lowest, lowest < F.col(low)),
            ("above", F.col(high), highest, highest > F.col(high)),
        ):
            case = entry(level, side, limit, extreme)
            out = F.when(hit, case) if out is None else out.when(hit, case)
    return out


def methods(threshold: Column, strong: Column, rolling: Column, forest: Column) -> Column:
    """Detectors that fired, in fixed order, joined by ``+``; moderate-only events count as robust z-score."""
    by_z = strong | ~(threshold | strong | rolling)
    return F.concat_ws(
        "+",
        F.when(threshold, "threshold"),
        F.when(by_z, "robust_zscore"),
        F.when(rolling, "rolling_median"),
        F.when(forest, "isolation_forest"),
    )


def trimmed(flags: DataFrame, params: Params) -> DataFrame:
    """Rows inside an event span: between the first and the last core step of their island."""
    rows = with_islands(flags, ["sensor_id"], F.col("flagged"), params.merge_gap_steps)
    w = W.partitionBy("sensor_id", "island")
    core = F.when(F.col("core"), F.col("cell"))
    return (
        rows.where("island > 0")
        .withColumn("start_cell", F.min(core).over(w))
        .withColumn("end_cell", F.max(core).over(w))
        .where(F.col("cell").between(F.col("start_cell"), F.col("end_cell")))
    )


def find_events(flags: DataFrame, axis: TimeAxis, params: Params) -> DataFrame:
    """One row per anomaly event, not numbered yet. Times are those of the stored readings."""
    inside = trimmed(flags, params)
    peak_rank = F.when(F.col("flagged"), F.struct(F.abs("z").alias("a"), (-F.col("cell")).alias("c")))
    at_peak = F.struct("cell", "ts", "z", "value", "expected")
    fixed = ["asset_id", "sensor_type", "placement", "unit", "lon", "lat", "peer_adjusted",
             "warn_low", "warn_high", "crit_low", "crit_high"]
    found = inside.groupBy("sensor_id", "island", "start_cell", "end_cell", *fixed).agg(
        F.max_by(at_peak, peak_rank).alias("p"),
        F.min("ts").alias("started_at"),
        F.max("ts").alias("ended_at"),
        F.count_if("flagged").alias("flagged_steps"),
        F.min("value").alias("lowest"),
        F.max("value").alias("highest"),
        F.bool_or("critical").alias("by_limit"),
        F.bool_or("strong").alias("by_z"),
        F.bool_or("rolling").alias("by_rolling"),
        F.bool_or("forest").alias("by_forest"),
    )
    hours = (F.rint((F.col("end_cell") - F.col("start_cell")) * axis.step_hours) + 1).cast("bigint")
    kept = found.where(
        (F.abs(F.col("p.z")) >= params.z_strong)
        | (F.col("flagged_steps") >= params.min_flagged)
        | F.col("by_limit")
    )
    end_of_axis = F.timestamp_micros(F.lit(axis.at_us(axis.last)))
    return (
        kept.withColumn("duration_hours", hours)
        .withColumn("breach", breach(F.col("lowest"), F.col("highest")))
        .withColumn("robust_z", F.col("p.z"))
        .withColumn("magnitude", magnitude(F.col("robust_z")))
        .withColumn("duration", duration_part(F.col("duration_hours")))
        .withColumn("threshold", threshold_part(F.col("breach.level")))
        .withColumn("anomaly_score", score_of(F.col("magnitude"), F.col("duration"), F.col("threshold")))
        .withColumn("severity", severity_of(F.col("anomaly_score")))
        .withColumn("anomaly_type", anomaly_type(F.col("sensor_type"), F.col("robust_z"), F.col("duration_hours")))
        .withColumn(
            "detection_method",
            methods(F.col("by_limit"), F.col("by_z"), F.col("by_rolling"), F.col("by_forest")),
        )
        .withColumn("status", F.when(F.col("ended_at") >= end_of_axis, "active").otherwise("resolved"))
        .select(
            "sensor_id", "asset_id", "sensor_type", "placement", "unit", "lon", "lat", "peer_adjusted",
            "anomaly_type", "started_at", "ended_at", F.col("p.ts").alias("peak_at"),
            "start_cell", "end_cell", F.col("p.cell").alias("peak_cell"), "flagged_steps", "duration_hours",
            F.col("p.value").alias("observed_value"), round_even(F.col("p.expected"), 4).alias("expected_value"),
            "robust_z", "anomaly_score",
            F.struct(
                round_even(F.col("magnitude"), 3).alias("magnitude"),
                round_even(F.col("duration"), 3).alias("duration"),
                round_even(F.col("threshold"), 3).alias("threshold"),
            ).alias("score_components"),
            "severity", "detection_method", "status", "breach",
        )
    )


def with_explanation(events: DataFrame) -> DataFrame:
    return events.withColumn("explanation", text.explanation(F.col("sensor_type").isin(*LOG_DOMAIN_TYPES)))


def number_anomalies(events: DataFrame) -> DataFrame:
    """Adds ``anomaly_id`` (ANM-0001 ...) in order of start and sensor."""
    return number_rows(events, ["started_at", "sensor_id"], "number", "anomalies").select(
        F.format_string("ANM-%04d", F.col("number")).alias("anomaly_id"),
        *[F.col(c) for c in events.columns],
    )
