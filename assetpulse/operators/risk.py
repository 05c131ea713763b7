"""Hexagonal grid, anomaly density and the kernel risk surface."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as geo
from ..functions.rounding import round_even
from ..functions.rules import recency_weight, risk_level, severity_weight
from ..functions.timeaxis import TimeAxis, hours_between
from ..params import MAX_RISK_AGE_HOURS, MIN_STORED_RISK, RISK_LEVELS, Params
from ..session import materialize
from .asof import zero_filled
from .grid import axis_frame, expand_intervals

NEGLIGIBLE = 1e-9  # what all terms beyond the reach of the kernel may add to a score of two decimals


def hex_cover(spark, box: tuple[float, float, float, float], edge: float) -> DataFrame:
    """Cells (i, j, cell_id, x, y) whose centre lies within one edge of the planar box; generated, no shuffle."""
    x0, y0, x1, y1 = box
    w, h = geo.hex_width(edge), geo.hex_height(edge)
    i0, i1 = math.ceil((x0 - edge) / w), math.floor((x1 + edge) / w)
    j0, j1 = math.floor((y0 - edge) / h) - 1, math.ceil((y1 + edge) / h) + 1
    rows = j1 - j0 + 1
    cells = spark.range((i1 - i0 + 1) * rows).select(
        (F.floor(F.col("id") / rows) + i0).alias("i"), (F.col("id") % rows + j0).alias("j")
    )
    centre = geo.hex_centre(F.col("i"), F.col("j"), edge)
    return (
        cells.withColumn("c", centre)
        .where(F.col("c.y").between(y0 - edge, y1 + edge))
        .select("i", "j", geo.hex_id(F.struct("i", "j")).alias("cell_id"), "c.x", "c.y")
    )


def hex_grid(spark, area: list[tuple[float, float]], edge: float, min_area_m2: float = 1.0) -> DataFrame:
    """Cells clipped to a convex counter-clockwise area; slivers are dropped. x, y = centroid of the clipped cell."""
    xs, ys = [p[0] for p in area], [p[1] for p in area]
    cover = hex_cover(spark, (min(xs), min(ys), max(xs), max(ys)), edge)
    ring = geo.hex_ring(F.struct("x", "y"), edge)
    clipped = cover.withColumn("ring", geo.clip_convex(ring, area)).withColumn("area_m2", geo.planar_area(F.col("ring")))
    as_lonlat = F.transform("ring", lambda p: F.struct(p["x"].alias("lon"), p["y"].alias("lat")))
    return (
        clipped.where(F.col("area_m2") >= min_area_m2)
        .withColumn("m", geo.polygon_centroid(as_lonlat))
        .select("i", "j", "cell_id", F.col("m.lon").alias("x"), F.col("m.lat").alias("y"), "area_m2", "ring")
    )


def with_cell(df: DataFrame, edge: float) -> DataFrame:
    """Adds ``cell_id`` from planar x, y by arithmetic."""
    return df.withColumn("cell_id", geo.hex_id(geo.hex_cell(F.col("x"), F.col("y"), edge)))


def nearest_cell_fallback(points: DataFrame, cells: DataFrame, edge: float) -> DataFrame:
    """(point_id, cell_id) of every point; one whose arithmetic cell was clipped away takes the kept cell with the nearest centre.

    Distinct places without a cell of their own meet centres by equality of squares, the own one and its eight neighbours; a
    centre within one square's width is the nearest for certain. Places without such a centre go on with squares four times as
    wide. Equal distances go to the smaller id. Points without finite coordinates, and all points if no cell is kept, get null.
    """
    placed = with_cell(points.select("point_id", "x", "y"), edge)
    own = cells.select(F.col("cell_id").alias("own"))
    finite = (F.abs("x") < F.lit(float("inf"))) & (F.abs("y") < F.lit(float("inf")))  # NaN counts as larger than infinity
    placed = placed.join(own, (F.col("cell_id") == F.col("own")) & finite, "left").select("point_id", "x", "y", "own")
    places = materialize(placed.where(F.col("own").isNull() & finite).select("x", "y").distinct(), "cell-places")
    kept = materialize(cells.select(F.col("cell_id").alias("near"), F.col("x").alias("cx"), F.col("y").alias("cy")), "cell-centres")
    nearest, width = places.withColumn("near", F.lit(None).cast("string")).limit(0), 2 * edge
    while not places.isEmpty() and not kept.isEmpty():
        steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
        squares = places.select("x", "y", F.explode(steps).alias("s")).select(
            "x", "y", (F.floor(F.col("x") / width) + F.col("s.a")).alias("a"), (F.floor(F.col("y") / width) + F.col("s.b")).alias("b")
        )
        centres = kept.withColumn("a", F.floor(F.col("cx") / width)).withColumn("b", F.floor(F.col("cy") / width))
        d = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
        hits = squares.join(centres, ["a", "b"]).where(d <= width * width)
        hits = materialize(hits.groupBy("x", "y").agg(F.min_by("near", F.struct(d, "near")).alias("near")), "cell-hits")
        nearest = nearest.unionByName(hits)
        places, width = materialize(places.join(hits, ["x", "y"], "left_anti"), "cell-places"), 4 * width
    return placed.join(nearest, ["x", "y"], "left").select("point_id", F.coalesce("own", "near").alias("cell_id"))


def anomaly_density(cells: DataFrame, anomalies: DataFrame, edge: float, start=None, end=None) -> DataFrame:
    """Per cell the anomalies whose interval overlaps [start, end], weighted and per hectare; every cell is kept."""
    rows = anomalies
    if end is not None:
        rows = rows.where(F.col("started_at") <= F.lit(end))
    if start is not None:
        rows = rows.where(F.col("ended_at") >= F.lit(start))
    sums = with_cell(rows, edge).groupBy("cell_id").agg(
        F.count("*").alias("n"), F.sum(severity_weight(F.col("severity"))).alias("w")
    )
    area = F.col("area_m2") if "area_m2" in cells.columns else F.lit(1.5 * math.sqrt(3.0) * edge * edge)
    return cells.join(sums, "cell_id", "left").select(
        "cell_id",
        F.coalesce("n", F.lit(0)).alias("anomaly_count"),
        F.coalesce("w", F.lit(0.0)).cast("bigint").alias("weighted_severity"),
        round_even(F.coalesce("n", F.lit(0)) / (area / 10000.0), 3).alias("anomalies_per_hectare"),
    )


def place_weights(anomalies: DataFrame, axis: TimeAxis, params: Params) -> DataFrame:
    """(x, y, step): severity-weighted recency of all anomalies at one place.

    Kernel and decay are separate factors, so the anomalies of a place are summed over time first; the spatial
    spread then works on places, of which there are as many as sensors, not on anomalies.
    """
    age = hours_between(axis.at(F.col("step")), F.col("ended_at"))
    weight = recency_weight(age, params.risk_half_life_hours, MAX_RISK_AGE_HOURS)
    rows = expand_intervals(
        anomalies.select("x", "y", "severity", "started_at", "ended_at"), axis, grace_hours=MAX_RISK_AGE_HOURS
    )
    return rows.groupBy("x", "y", "step").agg(F.sum(weight * severity_weight(F.col("severity"))).alias("w"))


def reachable_cells(x: Column, y: Column, radius: float, edge: float) -> Column:
    """Array of hexagon indexes whose centre may lie within the radius of a point."""
    w, h = geo.hex_width(edge), geo.hex_height(edge)
    return F.flatten(
        F.transform(
            F.sequence(F.ceil((x - radius) / w), F.floor((x + radius) / w)),
            lambda i: F.transform(
                F.sequence(F.floor((y - radius) / h) - 1, F.ceil((y + radius) / h)),
                lambda j: F.struct(i.alias("i"), j.alias("j")),
            ),
        )
    )


def risk_surface(cells: DataFrame, anomalies: DataFrame, axis: TimeAxis, params: Params) -> DataFrame:
    """Sparse (cell_id, step, risk_score, risk_level, anomaly_count) with scores of at least 0.5.

    Cells carry their centre (x, y). A place reaches only the cells inside a radius, found by index arithmetic and an
    equality join. The radius follows from the data: with all weights of the heaviest step at that distance, the terms left
    out still sum to less than NEGLIGIBLE.
    """
    b, edge = params.risk_bandwidth_m, params.hex_edge_m
    places = materialize(place_weights(anomalies, axis, params), "risk-places")
    heaviest = places.groupBy("step").agg(F.sum("w").alias("w")).agg(F.max("w")).first()[0] or 0.0
    radius = b * math.sqrt(2.0 * max(0.0, math.log(max(heaviest, 1e-300) * 100.0 / params.risk_reference / NEGLIGIBLE))) + edge
    # which cells a place reaches does not depend on the step: join places with cells once, then the steps
    spots = places.select("x", "y").distinct()
    spread = (
        spots.withColumn("n", F.explode(reachable_cells(F.col("x"), F.col("y"), radius, edge)))
        .select("x", "y", "n.i", "n.j")
        .join(cells.select("i", "j", "cell_id", F.col("x").alias("cx"), F.col("y").alias("cy")), ["i", "j"])
        .select(
            "x", "y", "cell_id",
            F.exp(-(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) / (2.0 * b * b)).alias("k"),
        )
    )
    score = F.least(F.lit(100.0), F.sum(F.col("k") * F.col("w")) * 100.0 / params.risk_reference)
    scores = places.join(spread, ["x", "y"]).groupBy("cell_id", "step").agg(round_even(score, 2).alias("risk_score"))
    return (
        scores.where(F.col("risk_score") >= MIN_STORED_RISK)
        .join(active_in_cell(anomalies, axis, edge), ["cell_id", "step"], "left")
        .select(
            "cell_id", "step", "risk_score", risk_level(F.col("risk_score")).alias("risk_level"),
            F.coalesce("n_active", F.lit(0)).alias("anomaly_count"),
        )
    )


def active_in_cell(anomalies: DataFrame, axis: TimeAxis, edge: float) -> DataFrame:
    """Active anomalies per (cell, step) by the cell their point lies in."""
    rows = expand_intervals(with_cell(anomalies, edge).select("cell_id", "started_at", "ended_at"), axis)
    return rows.groupBy("cell_id", "step").agg(F.count("*").alias("n_active"))


def risk_at(cells: DataFrame, risk: DataFrame, step: int) -> DataFrame:
    """Every cell at one step; cells without a stored row are 0 and low."""
    now = risk.where(F.col("step") == step).drop("step")
    return cells.select("cell_id").join(now, "cell_id", "left").select(
        "cell_id",
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("risk_level", F.lit("low")).alias("risk_level"),
        F.coalesce("anomaly_count", F.lit(0)).alias("anomaly_count"),
    )


def risk_series(risk: DataFrame, axis: TimeAxis) -> DataFrame:
    """(cell_id, step, risk) with whole numbers (halves up) for cells that are ever stored, 0 where absent."""
    cells = risk.select("cell_id").distinct().withColumn("step", F.explode(axis.all_cells()))
    return cells.join(risk.select("cell_id", "step", "risk_score"), ["cell_id", "step"], "left").select(
        "cell_id", "step", F.floor(F.coalesce("risk_score", F.lit(0.0)) + 0.5).alias("risk")
    )


def risk_summary(cells: DataFrame, risk: DataFrame, axis: TimeAxis) -> DataFrame:
    """Cells, stored rows, maxima and cells per level at the last step (zero-filled)."""
    at_end = risk_at(cells, risk, axis.last)
    levels = zero_filled(at_end, "risk_level", tuple(n for n, _ in RISK_LEVELS))
    totals = risk.agg(
        F.count("*").alias("score_rows"),
        F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("max_score_overall"),
        F.coalesce(F.max(F.when(F.col("step") == axis.last, F.col("risk_score"))), F.lit(0.0)).alias("max_score_at_end"),
    )
    return levels.crossJoin(F.broadcast(totals))  # one row
