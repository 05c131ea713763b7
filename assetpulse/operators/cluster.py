"""Space-time density clusters of intervals at points, their statistics and hulls.

Two members are neighbours when they are at most ``eps_m`` apart and the gap between their intervals is at most
``eps_hours``. Points are put into units: squares of side eps / sqrt(2) by start-time slots of eps_hours, so members of
one unit are always neighbours and no pair within a unit is ever formed. Units carry the bounds of their members; for
most pairs of units the bounds alone prove that all members are neighbours or that none are. Only the rest is
tested point by point, and for core counts and borders these tests involve points of thin units only.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import round_up
from ..functions.rules import severity_of_rank, severity_rank
from ..params import HULL_BUFFER_M
from ..session import dealt, materialize, number_rows
from .components import connected_components

UNIT = ["ux", "uy", "ut"]


def _gap(a: str, b: str) -> Column:
    """Seconds between two intervals (negative when they overlap)."""
    return F.greatest(F.col(f"{a}.s"), F.col(f"{b}.s")) - F.least(F.col(f"{a}.e"), F.col(f"{b}.e"))


def _close(a: str, b: str, eps_m: float, eps_s: float) -> Column:
    d = F.sqrt(F.pow(F.col(f"{a}.x") - F.col(f"{b}.x"), 2) + F.pow(F.col(f"{a}.y") - F.col(f"{b}.y"), 2))
    return (d / eps_m <= 1.0) & (F.greatest(_gap(a, b), F.lit(0.0)) / eps_s <= 1.0)


def place_in_units(points: DataFrame, eps_m: float, eps_s: float) -> DataFrame:
    """(id, x, y, s, e) with the unit each point belongs to; s and e are seconds."""
    side = eps_m / math.sqrt(2.0) * (1 - 1e-9)
    return points.select(
        "id", "x", "y", "s", "e",
        F.floor(F.col("x") / side).alias("ux"),
        F.floor(F.col("y") / side).alias("uy"),
        F.floor(F.col("s") / eps_s).alias("ut"),
    ).withColumn("unit", F.concat_ws(":", "ut", "ux", "uy"))


def unit_pairs(units: DataFrame, eps_m: float, eps_s: float) -> DataFrame:
    """Ordered pairs (u, v) of different units that may hold neighbours, with ``sure`` when all members are."""
    reach = F.sequence(F.lit(-2), F.lit(2))
    slots = F.sequence(F.col("ut"), F.floor((F.col("e_max") + eps_s) / eps_s))
    probe = (
        units.withColumn("vt", F.explode(slots))
        .withColumn("dx", F.explode(reach))
        .withColumn("dy", F.explode(reach))
        .withColumn("vx", F.col("ux") + F.col("dx"))
        .withColumn("vy", F.col("uy") + F.col("dy"))
        .drop("dx", "dy")
        .alias("u")
    )
    later = units.alias("v")
    same = (F.col("u.vx") == F.col("v.ux")) & (F.col("u.vy") == F.col("v.uy")) & (F.col("u.vt") == F.col("v.ut"))
    after = F.struct("v.ut", "v.ux", "v.uy") > F.struct("u.ut", "u.ux", "u.uy")

    def span(c):  # smallest and largest difference along one axis
        low = F.greatest(F.col(f"v.{c}_min") - F.col(f"u.{c}_max"), F.col(f"u.{c}_min") - F.col(f"v.{c}_max"), F.lit(0.0))
        high = F.greatest(F.col(f"v.{c}_max") - F.col(f"u.{c}_min"), F.col(f"u.{c}_max") - F.col(f"v.{c}_min"))
        return low, high

    (x0, x1), (y0, y1) = span("x"), span("y")
    gap0 = F.greatest(F.col("u.s_min"), F.col("v.s_min")) - F.least(F.col("u.e_max"), F.col("v.e_max"))
    gap1 = F.greatest(F.col("u.s_max"), F.col("v.s_max")) - F.least(F.col("u.e_min"), F.col("v.e_min"))
    slack = 1e-9
    possible = (F.sqrt(x0 * x0 + y0 * y0) <= eps_m * (1 + slack)) & (gap0 <= eps_s * (1 + slack))
    sure = (F.sqrt(x1 * x1 + y1 * y1) <= eps_m * (1 - slack)) & (gap1 <= eps_s * (1 - slack))
    return probe.join(later, same & after).where(possible).select(
        F.col("u.unit").alias("u"), F.col("v.unit").alias("v"), sure.alias("sure")
    )


def outermost(core: DataFrame) -> DataFrame:
    """At most eight members of every unit: those farthest out in the plane, and the first and last in time."""
    ends = [f(F.struct(F.col(c).alias("_by"), "id", "x", "y", "s", "e")) for c in ("x", "y", "s", "e") for f in (F.min, F.max)]
    named = [m.alias(f"_m{i}") for i, m in enumerate(ends)]
    pick = F.array(*[F.struct(*[F.col(f"_m{i}")[c].alias(c) for c in ("id", "x", "y", "s", "e")]) for i in range(len(ends))])
    return core.groupBy("unit").agg(*named).select("unit", F.explode(F.array_distinct(pick)).alias("m")).select("unit", "m.*")


def _bridges(pairs: DataFrame, unit_component: DataFrame, members: DataFrame, eps_m: float, eps_s: float) -> DataFrame:
    """(src, dst): components of which two of these members are neighbours, over the pairs of units not yet in one component.

    One row per pair of components at most leaves a task; the partial aggregate absorbs the point tests.
    """
    left = unit_component.select(F.col("unit").alias("u"), F.col("component").alias("_cu"))
    right = unit_component.select(F.col("unit").alias("v"), F.col("component").alias("_cv"))
    apart = dealt(pairs.join(left, "u").join(right, "v").where("_cu <> _cv"), "u", "v")
    return (
        apart.alias("m")
        .join(members.alias("p"), F.col("m.u") == F.col("p.unit"))
        .join(members.alias("q"), F.col("m.v") == F.col("q.unit"))
        .where(_close("p", "q", eps_m, eps_s))
        .select(F.col("m._cu").alias("src"), F.col("m._cv").alias("dst"))
        .distinct()
    )


def dbscan(points: DataFrame, eps_m: float, eps_hours: float, min_points: int) -> DataFrame:
    """(id, label) of the clustered points; the label is the smallest core id of the cluster.

    A point counts itself. A border point joins the cluster with the smallest label among its core neighbours.
    """
    eps_s = eps_hours * 3600.0
    placed = materialize(place_in_units(points, eps_m, eps_s), "cluster-points")
    bounds = [f(c).alias(f"{c}_{n}") for c in ("x", "y", "s", "e") for f, n in ((F.min, "min"), (F.max, "max"))]
    units = materialize(placed.groupBy("unit", *UNIT).agg(F.count("*").alias("n"), *bounds), "cluster-units")
    pairs = materialize(unit_pairs(units, eps_m, eps_s), "cluster-pairs")
    both = pairs.select("u", "v", "sure").union(pairs.select(F.col("v"), F.col("u"), "sure"))

    # Neighbours that are certain from the bounds, own unit included.
    certain = (
        both.where("sure")
        .join(units.select(F.col("unit").alias("v"), F.col("n").alias("_n")), "v")
        .groupBy(F.col("u").alias("unit"))
        .agg(F.sum("_n").alias("_near"))
    )
    counted = units.select("unit", "n").join(certain, "unit", "left").select(
        "unit", (F.col("n") + F.coalesce("_near", F.lit(0))).alias("certain")
    )
    open_units = counted.where(F.col("certain") < min_points)  # such a unit has fewer than min_points members
    maybe = dealt(both.where("NOT sure").select("u", "v"), "u", "v")
    thin = placed.join(open_units, "unit")
    tests = (
        thin.alias("p").join(maybe.alias("m"), F.col("p.unit") == F.col("m.u"))
        .join(placed.alias("q"), F.col("m.v") == F.col("q.unit"))
    )
    extra = tests.where(_close("p", "q", eps_m, eps_s)).groupBy("p.id").agg(F.count("*").alias("_extra"))
    thin_core = (
        thin.join(extra, "id", "left")
        .where(F.col("certain") + F.coalesce("_extra", F.lit(0)) >= min_points)
        .select("id")
    )
    full_core = placed.join(counted.where(F.col("certain") >= min_points), "unit", "left_semi").select("id")
    core_ids = full_core.unionByName(thin_core)
    core = materialize(placed.join(core_ids, "id", "left_semi"), "cluster-core")

    # Components of the units that hold a core point; sure pairs first, then the undecided pairs still apart.
    nodes = core.groupBy(F.col("unit").alias("id")).agg(F.min("id").alias("_first"))
    nodes = materialize(nodes, "cluster-nodes")
    ids = nodes.select("id")
    linked = (
        pairs.join(ids.select(F.col("id").alias("u")), "u", "left_semi")
        .join(ids.select(F.col("id").alias("v")), "v", "left_semi")
    )
    sure_edges = linked.where("sure").select(F.col("u").alias("src"), F.col("v").alias("dst"))
    first = connected_components(ids, sure_edges)
    undecided = linked.where("NOT sure").select("u", "v")
    unit_component = first.withColumnRenamed("id", "unit")
    # The outermost members of two units link most units that touch; all members are tested only where units stay apart.
    for members in (outermost(core), core):
        bridges = materialize(_bridges(undecided, unit_component, members, eps_m, eps_s), "cluster-bridges")
        if not bridges.isEmpty():
            second = connected_components(unit_component.select(F.col("component").alias("id")).distinct(), bridges)
            renamed = second.select(F.col("id").alias("component"), F.col("component").alias("_final"))
            joined = unit_component.join(renamed, "component").select("unit", F.col("_final").alias("component"))
            unit_component = materialize(joined, "cluster-components")
    unit_label = unit_component.join(nodes.select(F.col("id").alias("unit"), "_first"), "unit")
    component_label = unit_label.groupBy("component").agg(F.min("_first").alias("label"))
    unit_label = materialize(unit_component.join(component_label, "component").select("unit", "label"), "cluster-labels")

    core_labels = core.select("id", "unit").join(unit_label, "unit").select("id", "label")
    # Borders: points that are not core. Certain neighbours through units, the rest by test; all in thin units.
    border = thin.join(core.select("id"), "id", "left_anti")
    core_near = both.where("sure").join(unit_label.withColumnRenamed("unit", "v"), "v").select(F.col("u").alias("unit"), "label")
    own = unit_label.select("unit", "label")
    by_unit = border.join(core_near.unionByName(own), "unit").select("id", "label")
    by_test = (
        border.alias("p").join(maybe.alias("m"), F.col("p.unit") == F.col("m.u"))
        .join(core.alias("q"), F.col("m.v") == F.col("q.unit"))
        .where(_close("p", "q", eps_m, eps_s))
        .join(unit_label.alias("l"), F.col("m.v") == F.col("l.unit"))
        .select(F.col("p.id").alias("id"), F.col("l.label").alias("label"))
    )
    border_labels = by_unit.unionByName(by_test).groupBy("id").agg(F.min("label").alias("label"))
    return core_labels.unionByName(border_labels)


def keep_clusters(members: DataFrame, min_sensors: int) -> DataFrame:
    """Members (id, label, sensor_id, ...) of clusters with enough distinct sensors, numbered by smallest member."""
    sizes = (
        members.groupBy("label")
        .agg(F.countDistinct("sensor_id").alias("_sensors"), F.min("id").alias("_first"))
        .where(F.col("_sensors") >= min_sensors)
    )
    numbered = number_rows(sizes.select("label", "_first"), ["_first"], "cluster_id", "clusters")
    return members.join(numbered.select("label", "cluster_id"), "label")


def cluster_statistics(members: DataFrame) -> DataFrame:
    """One row per cluster: sizes, types, highest severity, span and mean position."""
    return members.groupBy("cluster_id").agg(
        F.count("*").alias("n_anomalies"),
        F.countDistinct("sensor_id").alias("n_sensors"),
        F.countDistinct("asset_id").alias("n_assets"),
        F.array_sort(F.collect_set("sensor_type")).alias("sensor_types"),
        severity_of_rank(F.max(severity_rank(F.col("severity")))).alias("max_severity"),
        F.min("started_at").alias("first_started_at"),
        F.max("ended_at").alias("last_ended_at"),
        F.avg("lon").alias("lon"),
        F.avg("lat").alias("lat"),
    )


def convex_hull(points: np.ndarray) -> np.ndarray:
    """Counter-clockwise hull of distinct points (monotone chain)."""
    pts = np.unique(points, axis=0)
    if len(pts) <= 2:
        return pts

    def half(rows):
        out: list[np.ndarray] = []
        for p in rows:
            while len(out) >= 2:
                (ax, ay), (bx, by) = out[-1] - out[-2], p - out[-2]
                if ax * by - ay * bx > 0:
                    break
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def cluster_hulls(members: DataFrame, part_rows: int = 50_000) -> DataFrame:
    """(cluster_id, hull, hull_hectares): convex hull in the plane and the area of the hull widened by 40 m.

    Hulls are taken of salted parts first and then of the parts' hull points, so no task holds a whole cluster. Points
    on the same place are reduced beforehand.
    """
    places = members.select("cluster_id", "x", "y").distinct()
    parts = places.groupBy("cluster_id").agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts"))
    salted = places.join(parts, "cluster_id").withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.col("_parts")))

    def part_hull(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(pdf[["x", "y"]].to_numpy())
        return pd.DataFrame({"cluster_id": pdf["cluster_id"].iloc[0], "x": hull[:, 0], "y": hull[:, 1]})

    def whole_hull(pdf: pd.DataFrame) -> pd.DataFrame:
        hull = convex_hull(pdf[["x", "y"]].to_numpy())
        nxt = np.roll(hull, -1, axis=0)
        perimeter = float(np.hypot(*(nxt - hull).T).sum())  # two points: there and back
        area = abs(float((hull[:, 0] * nxt[:, 1] - nxt[:, 0] * hull[:, 1]).sum())) / 2
        widened = area + perimeter * HULL_BUFFER_M + math.pi * HULL_BUFFER_M**2
        return pd.DataFrame(
            {
                "cluster_id": [pdf["cluster_id"].iloc[0]],
                "hull": [[{"x": float(x), "y": float(y)} for x, y in hull]],
                "hull_hectares": [widened / 10000.0],
            }
        )

    corners = salted.groupBy("cluster_id", "_part").applyInPandas(part_hull, "cluster_id bigint, x double, y double")
    hulls = corners.groupBy("cluster_id").applyInPandas(
        whole_hull, "cluster_id bigint, hull array<struct<x:double,y:double>>, hull_hectares double"
    )
    return hulls.withColumn("hull_hectares", round_up(F.col("hull_hectares"), 2))
