"""The batch jobs over stored tables: detection, then clusters, risk and health, each replacing its run's rows."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import params as fixed
from ..functions.geometry import utm_xy
from ..functions.timeaxis import TimeAxis
from ..operators import asof, cluster, events, health, quality, risk
from ..operators.baseline import sensor_baselines
from ..params import Params
from ..session import materialize, use_utc
from ..sources import sinks
from .detect import flag_readings, score_readings


def run_parameters(params: Params, axis: TimeAxis) -> str:
    """Every setting and fixed value a run depends on, as JSON."""
    names = (
        "LOG_DOMAIN_TYPES", "WEEKPART_TYPES", "PEER_TYPES", "PEER_EMA_HOURS", "MIN_CLASS_SENSORS", "SCALE_FLOORS",
        "SMALL_CLASS_FLOORS", "HUBER_C", "HUBER_ITERATIONS", "BAND_SIGMAS", "SCORE_WEIGHTS", "SEVERITY_MIN_SCORE",
    )
    return json.dumps(
        {
            "settings": asdict(params),
            "step_seconds": axis.step_s,
            "steps": axis.count,
            "fixed": {n.lower(): getattr(fixed, n) for n in names},
        },
        sort_keys=True,
    )


def run_detection(
    spark: SparkSession, readings: DataFrame, sensors: DataFrame, thresholds: DataFrame, params: Params, out: str, run_id: int
) -> TimeAxis:
    """Writes reading_scores, anomalies, sensor_baselines and the run record under ``out``."""
    use_utc(spark)
    quality.require_rows({"sensors": sensors, "readings": readings})
    axis = TimeAxis.of(readings, params.step_s)
    flags = materialize(flag_readings(score_readings(readings, sensors, axis, params), thresholds, params), "flags")
    found = events.number_anomalies(events.with_explanation(events.find_events(flags, axis, params)))
    sinks.replace_run(sinks.score_rows(flags, run_id), f"{out}/reading_scores", run_id)
    n = sinks.replace_run(sinks.anomaly_rows(found, sensors, run_id), f"{out}/anomalies", run_id)
    sinks.replace_run(sensor_baselines(flags).withColumn("run_id", F.lit(run_id)), f"{out}/sensor_baselines", run_id)
    record = sinks.run_record(run_parameters(params, axis), spark, run_id, axis, flags.count(), n)
    sinks.replace_run(record, f"{out}/detection_runs", run_id)
    return axis


def run_analysis(
    spark: SparkSession,
    readings: DataFrame,
    sensors: DataFrame,
    thresholds: DataFrame,
    params: Params,
    axis: TimeAxis,
    out: str,
    run_id: int,
    central_meridian: float,
) -> None:
    """Reads a run's anomalies and scores; writes cluster members and statistics, sparse risk and asset health."""
    use_utc(spark)
    run = F.col("run_id") == run_id
    anomalies = spark.read.parquet(f"{out}/anomalies").where(run)
    scores = spark.read.parquet(f"{out}/reading_scores").where(run).drop("run_id")
    quality.require_rows({"reading scores": scores})
    placed = anomalies.withColumn("_u", utm_xy(F.col("lon"), F.col("lat"), central_meridian)).select("*", "_u.x", "_u.y").drop("_u")
    placed = materialize(placed, "anomalies")

    points = placed.withColumnRenamed("anomaly_id", "id").withColumns(
        {"s": F.unix_micros("started_at") / 1e6, "e": F.unix_micros("ended_at") / 1e6}
    )
    labels = cluster.dbscan(points, params.cluster_eps_m, params.cluster_eps_hours, params.cluster_min_points)
    members = materialize(cluster.keep_clusters(points.join(labels, "id"), params.cluster_min_sensors), "members")
    stats = cluster.cluster_statistics(members).join(cluster.cluster_hulls(members), "cluster_id", "left")
    sinks.replace_run(stats.withColumn("run_id", F.lit(run_id)), f"{out}/anomaly_clusters", run_id)
    sinks.replace_run(members.select(F.col("id").alias("anomaly_id"), "cluster_id", F.lit(run_id).alias("run_id")), f"{out}/cluster_members", run_id)

    place = sensors.select(utm_xy(F.col("lon"), F.col("lat"), central_meridian).alias("u"))
    box = tuple(place.agg(F.min("u.x"), F.min("u.y"), F.max("u.x"), F.max("u.y")).first())
    cells = risk.hex_cover(spark, box, params.hex_edge_m)
    surface = risk.risk_surface(cells, placed, axis, params)
    sinks.replace_run(sinks.risk_rows(surface, run_id), f"{out}/risk_zone_scores", run_id)

    scored = asof.with_scores(readings, scores)
    series = asof.sensor_status_series(sensors, thresholds, scored, placed, axis)
    sinks.replace_run(health.asset_health(series, placed, axis, params).withColumn("run_id", F.lit(run_id)), f"{out}/asset_health", run_id)


def register_views(assets: DataFrame, sensors: DataFrame, readings: DataFrame, anomalies: DataFrame, asset_health: DataFrame) -> None:
    """The four views: latest reading per sensor, newest health, asset summary, active anomalies."""
    from ..operators import listing

    asof.sensor_latest(sensors, readings).createOrReplaceTempView("v_sensor_latest")
    health.health_latest(asset_health).createOrReplaceTempView("v_asset_health_latest")
    listing.asset_summary(assets, sensors, anomalies, asset_health).createOrReplaceTempView("v_asset_summary")
    listing.active_anomalies(anomalies, assets).createOrReplaceTempView("v_active_anomalies")
