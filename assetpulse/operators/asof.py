"""Latest readings, as-of status, the status of every sensor at every step, and the KPIs built on them."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules
from ..functions.timeaxis import TimeAxis
from ..params import AT_RISK_BELOW, SENSOR_STATUSES
from .grid import active_counts, axis_frame, carry_forward, to_cells

READING = ("value", "expected", "expected_low", "expected_high", "z", "flagged")


def with_scores(readings: DataFrame, scores: DataFrame) -> DataFrame:
    """Readings with their score columns; a reading without a score counts as not flagged."""
    extra = [c for c in ("expected", "expected_low", "expected_high", "z", "flagged") if c in scores.columns]
    return (
        readings.join(scores.select("sensor_id", "ts", *extra), ["sensor_id", "ts"], "left")
        .withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    )


def latest_per_sensor(readings: DataFrame, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Newest reading per sensor, of equal times the one with the greatest value; combined before the shuffle."""
    newest = F.max(F.struct("ts", *columns)).alias("_r")
    return readings.groupBy("sensor_id").agg(newest).select("sensor_id", "_r.*")


def sensor_latest(sensors: DataFrame, readings: DataFrame, columns: tuple[str, ...] = ("value",)) -> DataFrame:
    """Every sensor with its newest reading; null reading columns when it never reported."""
    return sensors.join(latest_per_sensor(readings, columns), "sensor_id", "left")


def asof_latest(readings: DataFrame, sensors: DataFrame, as_of: datetime, columns: tuple[str, ...]) -> DataFrame:
    """Last reading in ``(as_of - sampling interval, as_of]`` per sensor.

    The widest interval of the registry bounds the scan, so the time predicate reaches the files; each sensor's own
    interval is then checked on its newest reading only, which is enough because no other one is newer.
    """
    widest = sensors.agg(F.max("sampling_interval_s")).first()[0] or 0
    ts = F.col("ts")
    window = readings.where((ts <= F.lit(as_of)) & (ts > F.lit(as_of - timedelta(seconds=int(widest)))))
    age_s = (F.unix_micros(F.lit(as_of)) - F.unix_micros(ts)) / 1e6
    newest = latest_per_sensor(window, columns)
    return (
        newest.join(sensors.select("sensor_id", "sampling_interval_s"), "sensor_id")
        .where(age_s < F.col("sampling_interval_s"))
        .drop("sampling_interval_s")
    )


def sensor_status_at(
    sensors: DataFrame, thresholds: DataFrame, scored: DataFrame, anomalies: DataFrame, as_of: datetime
) -> DataFrame:
    """Status and current reading of every sensor at ``as_of``: offline, anomaly, warning or normal."""
    columns = tuple(c for c in READING if c in scored.columns)
    current = asof_latest(scored, sensors, as_of, columns)
    in_anomaly = (
        anomalies.where(rules.active(as_of)).select("sensor_id").distinct().withColumn("in_anomaly", F.lit(True))
    )
    limits = thresholds.select("sensor_type", "placement", "warn_low", "warn_high")
    warned = F.coalesce("flagged", F.lit(False)) | rules.outside(F.col("value"), F.col("warn_low"), F.col("warn_high"))
    return (
        sensors.join(limits, ["sensor_type", "placement"])
        .join(current, "sensor_id", "left")
        .join(in_anomaly, "sensor_id", "left")
        .withColumn(
            "status",
            rules.sensor_status(F.col("ts").isNotNull(), F.coalesce("in_anomaly", F.lit(False)), warned),
        )
        .withColumn("flagged", F.coalesce("flagged", F.lit(False)))
        .drop("in_anomaly", "warn_low", "warn_high")
    )


def sensor_status_series(
    sensors: DataFrame, thresholds: DataFrame, scored: DataFrame, anomalies: DataFrame, axis: TimeAxis
) -> DataFrame:
    """State of every sensor at every step: value, z of the step's own reading, reporting, flags and status."""
    columns = tuple(c for c in ("z", "flagged") if c in scored.columns)
    cells = to_cells(scored, axis, columns)
    limits = thresholds.select("sensor_type", "placement", "warn_low", "warn_high")
    known = sensors.join(limits, ["sensor_type", "placement"])
    dense = carry_forward(cells, known, axis, ["value", "flagged"])
    active = active_counts(anomalies, ["sensor_id"], axis)
    outside = rules.outside(F.col("value"), F.col("warn_low"), F.col("warn_high"))
    joined = dense.join(active, ["sensor_id", "step"], "left")
    return (
        joined.withColumn("anomaly_active", F.col("n_active").isNotNull())
        .withColumn("flagged", F.coalesce("flagged", F.lit(False)))
        .withColumn("outside_warn", outside)
        .withColumn("z", F.when(F.col("own_cell"), F.col("z")) if "z" in columns else F.lit(None).cast("double"))
        .withColumn(
            "status",
            rules.sensor_status(
                F.col("reporting"), F.col("anomaly_active"), F.col("flagged") | F.col("outside_warn")
            ),
        )
        .select(
            "sensor_id", "asset_id", "sensor_type", "placement", "step", "value", "z", "reporting", "flagged",
            "outside_warn", "anomaly_active", "status",
        )
    )


def kpis_at(
    assets: DataFrame, status: DataFrame, anomalies: DataFrame, health_at: DataFrame, as_of: datetime
) -> DataFrame:
    """The eleven KPIs at ``as_of``: one conditional aggregate per input, each a single row."""
    a = assets.agg(
        F.count("*").alias("total_assets"),
        F.count_if(~F.col("is_simulated")).alias("real_assets"),
        F.count_if("is_simulated").alias("simulated_assets"),
    )
    s = status.agg(
        F.countDistinct("asset_id").alias("monitored_assets"),
        F.count("*").alias("total_sensors"),
        F.count_if(F.col("status") != "offline").alias("active_sensors"),
        F.count_if(F.col("status") == "offline").alias("offline_sensors"),
        F.count_if(F.col("status") == "warning").alias("warning_sensors"),
    )
    n = anomalies.where(rules.active(as_of)).agg(
        F.count("*").alias("active_anomalies"), F.count_if(F.col("severity") == "critical").alias("critical_alerts")
    )
    h = health_at.agg(F.count_if(F.col("health_score") < AT_RISK_BELOW).alias("assets_at_risk"))
    return a.crossJoin(s).crossJoin(n).crossJoin(h)  # four single rows


def kpi_series(series: DataFrame, anomalies: DataFrame, health: DataFrame, axis: TimeAxis) -> DataFrame:
    """The six time-dependent KPIs at every step; every step has a row."""
    per_step = series.groupBy("step").agg(
        F.count_if(F.col("status") != "offline").alias("active_sensors"),
        F.count_if(F.col("status") == "offline").alias("offline_sensors"),
        F.count_if(F.col("status") == "warning").alias("warning_sensors"),
    )
    # Intervals become +1 / -1 marks per step (at most two rows per interval, combined before the shuffle).
    marks = (
        anomalies.select(
            F.explode(
                F.array(
                    F.struct(axis.first_cell_from(F.col("started_at")).alias("step"), F.lit(1).alias("d")),
                    F.struct((axis.last_cell_until(F.col("ended_at")) + 1).alias("step"), F.lit(-1).alias("d")),
                )
            ).alias("m"),
            (F.col("severity") == "critical").cast("int").alias("c"),
        )
        .groupBy(F.col("m.step").alias("step"))
        .agg(F.sum("m.d").alias("_a"), F.sum(F.col("m.d") * F.col("c")).alias("_c"))
    )
    risk = at_risk_series(health, axis)
    running = "OVER (ORDER BY step ROWS UNBOUNDED PRECEDING)"  # one row per axis step
    spark = series.sparkSession
    return (
        axis_frame(spark, axis)
        .join(marks, "step", "left")
        .withColumn("active_anomalies", F.expr(f"sum(coalesce(_a, 0)) {running}"))
        .withColumn("critical_alerts", F.expr(f"sum(coalesce(_c, 0)) {running}"))
        .join(per_step, "step", "left")
        .join(risk, "step")
        .select(
            "step",
            *[F.coalesce(c, F.lit(0)).alias(c) for c in ("active_sensors", "offline_sensors", "warning_sensors")],
            "active_anomalies", "critical_alerts", "assets_at_risk",
        )
    )


def at_risk_series(health: DataFrame, axis: TimeAxis, below: int = AT_RISK_BELOW) -> DataFrame:
    """Assets below a health score at every step, zeros kept (also gives the attention counts with 90)."""
    found = health.where(F.col("health_score") < below).groupBy("step").agg(F.count("*").alias("n"))
    return (
        axis_frame(health.sparkSession, axis)
        .join(found, "step", "left")
        .select("step", F.coalesce("n", F.lit(0)).alias("assets_at_risk"))
    )


def status_counts(status: DataFrame, names: tuple[str, ...] = SENSOR_STATUSES) -> DataFrame:
    """Count per status with the mandatory names zero-filled."""
    return zero_filled(status, "status", names)


def zero_filled(df: DataFrame, key: str, names: tuple[str, ...], value: Column | None = None) -> DataFrame:
    """Counts per key value; names without rows get 0, other values found in the data are kept."""
    spark = df.sparkSession
    found = df.groupBy(key).agg((F.count("*") if value is None else value).alias("n"))
    keys = spark.createDataFrame([(n,) for n in names], f"{key} string")
    return (
        found.unionByName(keys.withColumn("n", F.lit(0).cast("bigint")))
        .groupBy(key)
        .agg(F.sum("n").alias("n"))
    )
