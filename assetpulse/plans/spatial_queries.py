"""Registered queries of the proximity, grid, risk, cluster and evaluation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as geo
from ..functions.rounding import round_up
from ..functions.rules import severity_weight
from ..operators import cluster, evaluate, proximity, risk
from ..session import materialize
from .catalog import as_of, query
from .tables import CENTRE, Plant


@query
def assets_within_radius(p: Plant) -> DataFrame:
    return proximity.assets_within_radius(p.assets, *CENTRE, 400.0).select("asset_id", "asset_type", "name", "distance_m")


@query
def shapes_within_radius(p: Plant) -> DataFrame:
    """Lines and areas near the centre; the areas are the lines closed to rings."""
    lines = p.lines.select("asset_id", "coords")
    rings = lines.select(F.concat(F.lit("ring-"), "asset_id").alias("asset_id"), F.concat("coords", F.slice("coords", F.lit(1), F.lit(1))).alias("coords"))
    return proximity.shapes_within_radius(lines.union(rings), *CENTRE, 400.0)


@query
def radius_summary(p: Plant) -> DataFrame:
    return proximity.radius_summary(proximity.assets_within_radius(p.assets, *CENTRE, 400.0))


@query
def sensors_in_asset_area(p: Plant) -> DataFrame:
    return proximity.sensors_in_asset_areas(p.sensors, p.lines, 25.0)


@query
def sensors_of_top_asset(p: Plant) -> DataFrame:
    """Sensors in the area of the asset that carries the most sensors (smallest id on a tie)."""
    top = p.sensors.groupBy("asset_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "asset_id").limit(1)
    return proximity.sensors_in_asset_areas(p.sensors, p.lines.join(top, "asset_id", "left_semi"), 100.0)


@query
def assets_near_anomaly(p: Plant) -> DataFrame:
    near = proximity.assets_near_anomalies(p.anomalies, p.assets, p.params.proximity_m)
    return near.select("anomaly_id", "near_asset_id", "asset_type", "distance_m")


@query
def assets_near_top_anomaly(p: Plant) -> DataFrame:
    top = p.anomalies.orderBy(F.desc("anomaly_score"), "anomaly_id").limit(1)
    near = proximity.assets_near_anomalies(top, p.assets, 300.0, include_own=True)
    return near.select("anomaly_id", "near_asset_id", "is_host_asset", "distance_m")


@query
def nearby_counts(p: Plant) -> DataFrame:
    return proximity.nearby_asset_counts(p.anomalies, p.assets, p.params.proximity_m)


@query
def assets_near_active(p: Plant) -> DataFrame:
    return proximity.assets_near_active(p.anomalies, p.assets, as_of(p), 300.0)


def _shapes(p: Plant) -> DataFrame:
    """The assets as points, lines and areas in turn; an area is a line closed to a ring."""
    form, c = F.pmod("num", F.lit(3)), F.col("coords")
    first = F.slice(c, F.lit(1), F.lit(1))
    return p.lines.withColumn("coords", F.when(form == 0, first).when(form == 1, c).otherwise(F.concat(c, first)))


@query
def shapes_near_anomaly(p: Plant) -> DataFrame:
    near = proximity.assets_near_anomalies(p.anomalies, _shapes(p), p.params.proximity_m)
    return near.select("anomaly_id", "near_asset_id", "asset_type", "distance_m")


@query
def nearby_shape_counts(p: Plant) -> DataFrame:
    return proximity.nearby_asset_counts(p.anomalies, _shapes(p), p.params.proximity_m)


@query
def shapes_near_active(p: Plant) -> DataFrame:
    return proximity.assets_near_active(p.anomalies, _shapes(p), as_of(p), 300.0)


@query
def nearest_shape(p: Plant) -> DataFrame:
    """Nearest point, line or area of every sensor, on the spheroid."""
    n = proximity.nearest_join(_points(p), _shapes(p).select(F.col("asset_id").alias("target_id"), "coords"), 50.0)
    return n.select("point_id", "target_id", round_up(F.col("distance"), 1).alias("distance_m"))


@query
def nearest_shape_by_type(p: Plant) -> DataFrame:
    points = _points(p).crossJoin(F.broadcast(p.assets.select("asset_type").distinct()))  # the asset types are a short fixed list
    n = proximity.nearest_join(points, _shapes(p).select(F.col("asset_id").alias("target_id"), "coords", "asset_type"), 200.0, ["asset_type"])
    return n.select("point_id", "asset_type", "target_id", round_up(F.col("distance"), 1).alias("distance_m"))


@query
def nearest_shape_per_type(p: Plant) -> DataFrame:
    return proximity.nearest_per_type(_shapes(p), *CENTRE)


def _targets(p: Plant, types: bool = False) -> DataFrame:
    return p.assets.select(F.col("asset_id").alias("target_id"), "lon", "lat", *(["asset_type"] if types else []))


def _points(p: Plant) -> DataFrame:
    return p.sensors.select(F.col("sensor_id").alias("point_id"), F.col("lon").alias("plon"), F.col("lat").alias("plat"))


@query
def nearest_asset(p: Plant) -> DataFrame:
    """Nearest asset of every sensor."""
    n = proximity.nearest_join(_points(p), _targets(p), 50.0)
    return n.select("point_id", "target_id", round_up(F.col("distance"), 1).alias("distance_m"))


@query
def nearest_asset_by_type(p: Plant) -> DataFrame:
    """Nearest asset of every type for every sensor."""
    types = p.assets.select("asset_type").distinct()
    points = _points(p).crossJoin(F.broadcast(types))  # the asset types are a short fixed list
    n = proximity.nearest_join(points, _targets(p, True), 200.0, ["asset_type"])
    return n.select("point_id", "asset_type", "target_id", round_up(F.col("distance"), 1).alias("distance_m"))


@query
def nearest_per_type(p: Plant) -> DataFrame:
    return proximity.nearest_per_type(p.assets, *CENTRE)


@query
def five_nearest(p: Plant) -> DataFrame:
    return proximity.nearest_to_point(p.assets, *CENTRE, k=5).select(
        "asset_id", "asset_type", "name", round_up(F.col("distance"), 1).alias("distance_m")
    )


@query
def road_proximity_rollup(p: Plant) -> DataFrame:
    roads = p.lines.where(F.col("asset_type") == "road").select(F.col("asset_id").alias("line_id"), "coords")
    status = F.when(F.col("ended_at") >= F.lit(as_of(p)), "active").otherwise("resolved")
    found = proximity.road_rollup(roads, p.sensors, p.anomalies.withColumn("status", status), 30.0)
    return found.orderBy(F.desc("weighted_severity"), F.desc("anomalies_nearby"), "line_id").limit(25)


@query
def outside_area(p: Plant) -> DataFrame:
    ring = [(-100.027, 37.747), (-100.008, 37.747), (-100.008, 37.760), (-100.027, 37.760)]
    return proximity.points_outside(p.sensors, ring).select("sensor_id", "lon", "lat")


# --- hexagons, density, risk ------------------------------------------------------------------------------------------
def _cells(p: Plant) -> DataFrame:
    return risk.hex_cover(p.spark, p.utm_box, p.params.hex_edge_m)


@query
def hex_cells(p: Plant) -> DataFrame:
    """Cell of every asset."""
    return risk.with_cell(p.planar(p.assets), p.params.hex_edge_m).select("asset_id", "cell_id")


@query
def hex_grid(p: Plant) -> DataFrame:
    """Grid over the assets' bounds, clipped to the octagon inside them."""
    x0, y0, x1, y1 = p.utm_box
    c = min(x1 - x0, y1 - y0) / 5
    area = [
        (x0 + c, y0), (x1 - c, y0), (x1, y0 + c), (x1, y1 - c), (x1 - c, y1), (x0 + c, y1), (x0, y1 - c), (x0, y0 + c),
    ]
    return risk.hex_grid(p.spark, area, p.params.hex_edge_m).select("cell_id", "x", "y", "area_m2")


@query
def anomaly_density(p: Plant) -> DataFrame:
    return risk.anomaly_density(_cells(p), p.planar(p.anomalies), p.params.hex_edge_m, end=as_of(p))


@query
def anomalies_per_asset_type(p: Plant) -> DataFrame:
    return (
        p.anomalies.join(p.assets.select("asset_id", "asset_type"), "asset_id")
        .groupBy("asset_type")
        .agg(
            F.count("*").alias("anomaly_count"),
            F.countDistinct("asset_id").alias("assets_with_anomalies"),
            F.sum(severity_weight(F.col("severity"))).cast("bigint").alias("weighted_severity"),
        )
    )


def _risk(p: Plant) -> DataFrame:
    return risk.risk_surface(_cells(p), p.planar(p.anomalies), p.axis, p.params)


@query
def risk_surface(p: Plant) -> DataFrame:
    return _risk(p)


@query
def risk_asof(p: Plant) -> DataFrame:
    from .catalog import AS_OF

    return risk.risk_at(_cells(p), _risk(p), p.axis.index_of(AS_OF))


@query
def risk_series(p: Plant) -> DataFrame:
    return risk.risk_series(_risk(p), p.axis)


@query
def risk_summary(p: Plant) -> DataFrame:
    return risk.risk_summary(_cells(p), materialize(_risk(p), "risk"), p.axis)


# --- clusters -----------------------------------------------------------------------------------------------------------
def _seconds(name: str):
    return F.unix_micros(name) / 1e6


def space_time_points(p: Plant) -> DataFrame:
    return p.planar(p.anomalies).withColumnRenamed("anomaly_id", "id").withColumns(
        {"s": _seconds("started_at"), "e": _seconds("ended_at")}
    )


def _clusters(p: Plant) -> DataFrame:
    points = space_time_points(p)
    labels = cluster.dbscan(points, p.params.cluster_eps_m, p.params.cluster_eps_hours, p.params.cluster_min_points)
    return materialize(cluster.keep_clusters(points.join(labels, "id"), p.params.cluster_min_sensors), "members")


@query
def dbscan_space_time(p: Plant) -> DataFrame:
    pr = p.params
    return cluster.dbscan(space_time_points(p), pr.cluster_eps_m, pr.cluster_eps_hours, pr.cluster_min_points)


#: thousandths of a degree between neighbours of a dense place
DENSE_EPS = 0.3


@query
def dbscan_space(p: Plant) -> DataFrame:
    """Density clusters of all assets by place, no time."""
    points = p.assets.select(
        F.col("asset_id").alias("id"), (F.col("lon") * 1000).alias("x"), (F.col("lat") * 1000).alias("y"), F.lit(0.0).alias("s"), F.lit(0.0).alias("e")
    )
    return cluster.dbscan(points, DENSE_EPS, 1.0, 3)


@query
def space_cluster_summary(p: Plant) -> DataFrame:
    """Clusters of the anomalies in space only, with counts and span."""
    points = p.planar(p.anomalies).withColumnRenamed("anomaly_id", "id").withColumns({"s": F.lit(0.0), "e": F.lit(0.0)})
    labels = cluster.dbscan(points, 60.0, 1.0, 3)
    return points.join(labels, "id").groupBy("label").agg(
        F.count("*").alias("n_anomalies"),
        F.countDistinct("sensor_id").alias("n_sensors"),
        F.countDistinct("asset_id").alias("n_assets"),
        F.min("started_at").alias("first_started_at"),
        F.max("ended_at").alias("last_ended_at"),
    )


@query
def cluster_members(p: Plant) -> DataFrame:
    return _clusters(p).select("id", "cluster_id")


@query
def cluster_stats(p: Plant) -> DataFrame:
    s = cluster.cluster_statistics(_clusters(p))
    return s.select(
        "cluster_id", "n_anomalies", "n_sensors", "n_assets", F.array_join("sensor_types", ",").alias("sensor_types"),
        "max_severity", "first_started_at", "last_ended_at", F.round("lon", 9).alias("lon"), F.round("lat", 9).alias("lat"),
    )


@query
def cluster_hulls(p: Plant) -> DataFrame:
    h = cluster.cluster_hulls(_clusters(p))
    return h.select("cluster_id", F.size("hull").alias("corners"), "hull_hectares")


@query
def cluster_records(p: Plant) -> DataFrame:
    from ..operators.listing import cluster_records as records

    members = _clusters(p)
    r = records(cluster.cluster_statistics(members), members.withColumnRenamed("id", "anomaly_id"))
    return r.select("cluster_id", "n_anomalies", F.array_join("anomaly_ids", ",").alias("anomaly_ids"))


# --- evaluation -----------------------------------------------------------------------------------------------------------
@query
def detection_evaluation(p: Plant) -> DataFrame:
    return evaluate.evaluation(p.anomalies, p.labelled_events)


@query
def detection_delays(p: Plant) -> DataFrame:
    return evaluate.delay_by_type(p.anomalies, p.labelled_events)


@query
def event_hits(p: Plant) -> DataFrame:
    h = evaluate.event_hits(p.anomalies, p.labelled_events)
    return h.select("event_id", "event_type", "hits", F.round("delay_hours", 6).alias("delay_hours"))


@query
def false_anomalies(p: Plant) -> DataFrame:
    return evaluate.false_anomalies(p.anomalies, p.labelled_events).select("anomaly_id", "during_benign")


@query
def severity_counts(p: Plant) -> DataFrame:
    return evaluate.severity_counts(p.anomalies)


@query
def final_step_check(p: Plant) -> DataFrame:
    return evaluate.final_step_check(p.anomalies, p.labelled_events, as_of(p))


@query
def group_recovery(p: Plant) -> DataFrame:
    """Recovery of the labelled error events as one cluster."""
    members = _clusters(p).select(F.col("id").alias("anomaly_id"), "cluster_id")
    tagged = p.anomalies.join(members, "anomaly_id", "left")
    group = p.labelled_events.where(F.col("event_type") == "label_error")
    return evaluate.group_recovery(group, tagged)
