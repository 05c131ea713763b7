"""Asset health at every step: four penalties from recent anomalies, recent readings and silent sensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import clip, round_even
from ..functions.rules import asset_status, recency_weight, severity_weight
from ..functions.timeaxis import TimeAxis, add_hours, hours_between
from ..params import ASSET_BANDS, ASSET_STATUS_CHARS, AT_RISK_BELOW, Params
from .asof import zero_filled
from .detectors import trailing_median
from .grid import expand_intervals, to_cells
from .medians import median


def penalties(weights: Column, weighted: Column, level: Column, silent_share: Column) -> dict[str, Column]:
    return {
        "frequency_penalty": F.least(F.lit(20.0), weights * 6.0),
        "severity_penalty": F.least(F.lit(45.0), weighted * 6.0),
        "reading_penalty": F.least(F.lit(10.0), level * 2.0),
        "sensor_penalty": silent_share * 20.0,
    }


def score(frequency: Column, severity: Column, reading: Column, sensor: Column) -> Column:
    """Halves round up; clamped to 0..100."""
    return clip(F.floor(F.lit(100.0) - (frequency + severity + reading + sensor) + 0.5), 0, 100).cast("bigint")


def reading_excess(recent_abs_z: Column) -> Column:
    return clip(recent_abs_z - 3.0, 0, 5)


def sensor_part(series: DataFrame, params: Params) -> DataFrame:
    """(asset_id, step): sensors, reporting sensors and the sum of their reading excess."""
    recent = trailing_median(F.abs("z"), params.steps(params.health_reading_hours), cell="step")
    return _by_asset(series.select("asset_id", "sensor_id", "step", "z", "reporting").withColumn("recent", recent))


def _by_asset(rows: DataFrame) -> DataFrame:
    """Sums over the sensors of an asset at a step, from reporting and the recent level of |z|."""
    excess = F.when(F.col("reporting"), reading_excess(F.coalesce("recent", F.lit(0.0)))).otherwise(0.0)
    return rows.groupBy("asset_id", "step").agg(
        F.count("*").alias("sensors_total"),
        F.count_if("reporting").alias("sensors_reporting"),
        F.sum(excess).alias("excess"),
    )


def sensor_part_at(sensors: DataFrame, thresholds: DataFrame, scored: DataFrame, axis: TimeAxis, params: Params, step: int) -> DataFrame:
    """``sensor_part`` of one step, from the readings that can matter to it; their time filter reaches the files."""
    known = sensors.join(thresholds.select("sensor_type", "placement"), ["sensor_type", "placement"], "left_semi")
    recent = params.steps(params.health_reading_hours)
    lasting = F.greatest(F.round(F.col("sampling_interval_s") / F.lit(float(axis.step_s))), F.lit(1)).cast("bigint")
    widest = known.agg(F.max(lasting)).first()[0] or 1
    after, until = (F.timestamp_micros(F.lit(axis.at_us(t))) for t in (step - max(recent, widest), step))
    near = scored.where((F.col("ts") > after) & (F.col("ts") <= until)).select("sensor_id", "ts", "value", "z")
    own = to_cells(near, axis, ("z",)).groupBy("sensor_id").agg(
        F.max("cell").alias("cell"), median(F.when(F.col("cell") > step - recent, F.abs("z"))).alias("recent")
    )
    rows = known.join(own, "sensor_id", "left").withColumn("step", F.lit(step).cast("bigint"))
    return _by_asset(rows.withColumn("reporting", F.coalesce(F.col("step") - F.col("cell") < lasting, F.lit(False))))


def anomaly_part(anomalies: DataFrame, axis: TimeAxis, params: Params) -> DataFrame:
    """(asset_id, step): decayed weights of the anomalies in the look-back window, summed before the shuffle."""
    window_hours = params.health_window_days * 24.0
    rows = expand_intervals(anomalies.select("asset_id", "severity", "started_at", "ended_at"), axis, grace_hours=window_hours)
    return _decayed(rows, axis, params)


def anomaly_part_at(anomalies: DataFrame, axis: TimeAxis, params: Params, step: int) -> DataFrame:
    """``anomaly_part`` of one step."""
    at = F.timestamp_micros(F.lit(axis.at_us(step)))
    seen = (F.col("started_at") <= at) & (add_hours(F.col("ended_at"), F.lit(params.health_window_days * 24.0)) >= at)
    rows = anomalies.where(seen).select("asset_id", "severity", "started_at", "ended_at", F.lit(step).cast("bigint").alias("step"))
    return _decayed(rows, axis, params)


def _decayed(rows: DataFrame, axis: TimeAxis, params: Params) -> DataFrame:
    age = hours_between(axis.at(F.col("step")), F.col("ended_at"))
    weight = recency_weight(age, params.health_half_life_hours, params.health_window_days * 24.0)
    return rows.withColumn("w", weight).groupBy("asset_id", "step").agg(
        F.sum("w").alias("weights"),
        F.sum(F.col("w") * severity_weight(F.col("severity"))).alias("weighted"),
        F.count_if(F.col("w") > 0).alias("anomalies_in_window"),
        F.count_if(age <= 0).alias("active_anomalies"),
    )


def asset_health(series: DataFrame, anomalies: DataFrame, axis: TimeAxis, params: Params) -> DataFrame:
    """One row per monitored asset and step with the score, its status and the penalties that explain it."""
    return _scored(sensor_part(series, params), anomaly_part(anomalies, axis, params), axis)


def asset_health_at(
    sensors: DataFrame, thresholds: DataFrame, scored: DataFrame, anomalies: DataFrame, axis: TimeAxis, params: Params, step: int
) -> DataFrame:
    """The rows of ``asset_health`` at one step, computed for that step alone."""
    return _scored(sensor_part_at(sensors, thresholds, scored, axis, params, step), anomaly_part_at(anomalies, axis, params, step), axis)


def _scored(sensor_rows: DataFrame, anomaly_rows: DataFrame, axis: TimeAxis) -> DataFrame:
    zero = F.lit(0)
    joined = sensor_rows.join(anomaly_rows, ["asset_id", "step"], "left")
    level = F.when(F.col("sensors_reporting") > 0, F.col("excess") / F.col("sensors_reporting")).otherwise(0.0)
    silent = (F.col("sensors_total") - F.col("sensors_reporting")) / F.col("sensors_total")
    parts = penalties(F.coalesce("weights", zero), F.coalesce("weighted", zero), level, silent)
    scored = joined.select(
        "asset_id", "step", "sensors_total", "sensors_reporting",
        F.coalesce("anomalies_in_window", zero).alias("anomalies_in_window"),
        F.coalesce("active_anomalies", zero).alias("active_anomalies"),
        *[c.alias(name) for name, c in parts.items()],
    ).withColumn("health_score", score(*[F.col(name) for name in parts]))
    return (
        scored.withColumn("status", asset_status(F.col("health_score")))
        .withColumns({name: round_even(F.col(name), 3) for name in parts})
        .withColumn("as_of", axis.at(F.col("step")))
    )


def health_latest(health: DataFrame) -> DataFrame:
    """Newest health row of every asset."""
    others = [c for c in health.columns if c not in ("asset_id", "as_of")]
    newest = F.max_by(F.struct("as_of", *others), "as_of").alias("h")
    return health.groupBy("asset_id").agg(newest).select("asset_id", "h.*")


def health_summary(health: DataFrame, axis: TimeAxis) -> DataFrame:
    """Assets per band at the last step, zero-filled, with the number below the at-risk bound."""
    final = health.where(F.col("step") == axis.last)
    bands = zero_filled(final, "status", tuple(n for n, _ in ASSET_BANDS))
    totals = final.agg(
        F.count("*").alias("monitored_assets"),
        F.count_if(F.col("health_score") < AT_RISK_BELOW).alias("assets_at_risk"),
    )
    return bands.crossJoin(F.broadcast(totals))  # one row


def health_strings(health: DataFrame) -> DataFrame:
    """Per asset the scores and one status character per step, in step order (a group is one axis long)."""
    from ..functions.rules import status_chars

    entry = F.struct("step", "health_score", status_chars(ASSET_STATUS_CHARS, F.col("status")).alias("c"))
    return (
        health.groupBy("asset_id")
        .agg(F.array_sort(F.collect_list(entry)).alias("s"))
        .select(
            "asset_id",
            F.transform("s", lambda e: e["health_score"]).alias("health"),
            F.array_join(F.transform("s", lambda e: e["c"]), "").alias("status"),
        )
    )


def needs_attention(health_now: DataFrame, assets: DataFrame, active_by_asset: DataFrame, top: int = 12) -> DataFrame:
    """Lowest health first, then most active anomalies, then id; the ranking is the feature, hence the limit."""
    return (
        health_now.where(F.col("health_score") < 90)
        .select("asset_id", "health_score", "status")
        .join(active_by_asset, "asset_id", "left")
        .join(assets.select("asset_id", "name", "asset_type"), "asset_id", "left")
        .withColumn("active_count", F.coalesce("active_count", F.lit(0)))
        .orderBy("health_score", F.desc("active_count"), "asset_id")
        .limit(top)
    )


def active_by_asset(anomalies: DataFrame, as_of) -> DataFrame:
    from ..functions.rules import active

    return anomalies.where(active(as_of)).groupBy("asset_id").agg(F.count("*").alias("active_count"))
