"""Pixel statistics inside polygons, newest coverage first, and differences of pixel tables.

Pixels are rows (project, px, py, value) with planar centre coordinates and a common size; polygons are
(polygon_id, ring) with an open or closed ``array<struct<lon, lat>>`` ring in the same plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import clip_range, closed, point_in_segments, segments
from ..session import dealt, materialize
from .medians import counted_quantiles, grouped_quantiles
from .proximity import salted_bucket_join

# --- fixed values ---------------------------------------------------------------------------------------------------------
MIN_VALID_PIXELS = 4
STACK_VALUES = 10_000  # distinct values of a pixel centre above which they are cut into rows
HEIGHT_RANGE_M = (2.5, 60.0)
STATUSES = ("ok", "too_few", "below", "above", "no_coverage")
# --- end of fixed values ----------------------------------------------------------------------------------------------------


def subtract(top: DataFrame, terrain: DataFrame, row_shift: int = 0, col_shift: int = 0) -> DataFrame:
    """Pixel-wise top minus terrain where the grids (row, col, value) overlap, by equality of shifted indexes."""
    ground = terrain.select(
        (F.col("row") + row_shift).alias("row"), (F.col("col") + col_shift).alias("col"), F.col("value").alias("_g")
    )
    return top.join(ground, ["row", "col"]).withColumn("value", F.col("value") - F.col("_g")).drop("_g")


def stacked(pixels: DataFrame) -> DataFrame:
    """(project, px, py, values): the valid pixels of one centre as one row with its distinct values and how often each comes.

    Centres of more than ``STACK_VALUES`` distinct values are rows of about that many.
    """
    valid = pixels.where(F.col("value").isNotNull() & ~F.isnan("value"))
    at = ["project", "px", "py"]
    counted = materialize(valid.groupBy(*at, "value").agg(F.count("*").alias("n")), "zonal-values")
    crowded = counted.groupBy(*at).agg(F.count("*").alias("_d")).where(F.col("_d") > STACK_VALUES)
    crowded = F.broadcast(crowded.select(*at, F.ceil(F.col("_d") / STACK_VALUES).alias("_parts")))
    part = F.pmod(F.xxhash64("value"), F.coalesce("_parts", F.lit(1))).alias("_part")
    return counted.join(crowded, at, "left").groupBy(*at, part).agg(F.collect_list(F.struct("value", "n")).alias("values")).drop("_part")


def centres_near(polygons: DataFrame, centres: DataFrame, size: float, bucket: float, on: list[str] | None = None) -> DataFrame:
    """Polygons (polygon_id, ring, *on) with the pixel centres (project, px, py, ...) whose square meets their bounds.

    ``_seg`` holds the sides of the ring. ``on`` adds equality columns.
    """
    reach, keys = size / 2, on or []

    def span(low: Column, high: Column) -> Column:
        return F.sequence(F.floor((low - reach) / bucket), F.floor((high + reach) / bucket))

    def ends(axis: str) -> list[Column]:
        values = F.transform("ring", lambda v: v[axis])
        return [F.array_min(values), F.array_max(values)]

    (x0, x1), (y0, y1) = ends("lon"), ends("lat")
    probe = (
        polygons.select(
            "polygon_id", *keys, segments(closed(F.col("ring"))).alias("_seg"),
            x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1"),
        )
        .withColumn("cx", F.explode(span(F.col("x0"), F.col("x1"))))
        .withColumn("cy", F.explode(span(F.col("y0"), F.col("y1"))))
    )
    build = centres.withColumn("cx", F.floor(F.col("px") / bucket)).withColumn("cy", F.floor(F.col("py") / bucket))
    in_bounds = F.col("px").between(F.col("x0") - reach, F.col("x1") + reach) & F.col("py").between(
        F.col("y0") - reach, F.col("y1") + reach
    )
    # both sides are dealt out, because either may be the one that is streamed
    return salted_bucket_join(dealt(probe, "cx", "cy"), dealt(build, "cx", "cy"), ["cx", "cy", *keys]).where(in_bounds)


def measured(p90: Column, n: Column) -> Column:
    return (
        F.when(n < MIN_VALID_PIXELS, "too_few")
        .when(p90 < HEIGHT_RANGE_M[0], "below")
        .when(p90 > HEIGHT_RANGE_M[1], "above")
        .otherwise("ok")
    )


def zonal_heights(polygons: DataFrame, pixels: DataFrame, projects: DataFrame, size: float, bucket: float) -> DataFrame:
    """Per polygon the deciding project (newest that touches it), pixel count, p50, p90, maximum and status.

    ``projects`` is (project, collected). A polygon no project touches has no coverage. Polygons of the same ring are measured
    once, and pixels of the same centre and value are one value with a count: which project decides is asked of the centres
    alone, and only that project's centres inside a ring hand out their values, added up before they are shuffled.
    """
    rings = materialize(polygons.groupBy("ring").agg(F.min("polygon_id").alias("_id")), "zonal-rings")
    shapes = rings.withColumnRenamed("_id", "polygon_id")
    stacks = materialize(stacked(pixels), "zonal-stacks")
    inside = point_in_segments(F.col("px"), F.col("py"), F.col("_seg"))
    reach = size / 2
    box = (F.col("px") - reach, F.col("py") - reach, F.col("px") + reach, F.col("py") + reach)
    edge = F.exists("_seg", lambda s: clip_range(s["ax"], s["ay"], s["bx"], s["by"], box).isNotNull())
    newest = materialize(
        centres_near(shapes, stacks.drop("values"), size, bucket)
        .where(inside | edge)
        .select("polygon_id", "project").distinct()
        .join(projects, "project")
        .groupBy("polygon_id")
        .agg(F.max_by("project", F.struct("collected", "project")).alias("project")),
        "zonal-newest",
    )
    decided = shapes.join(newest, "polygon_id")
    values = (
        centres_near(decided, stacks, size, bucket, ["project"])
        .where(inside)
        .select("polygon_id", F.inline("values"))
    )
    heights = counted_quantiles(values, ["polygon_id"], "value", "n", {"p50": 0.5, "p90": 0.9}, top="vmax")
    n = F.coalesce("n", F.lit(0))
    return (
        polygons.select("polygon_id", "ring")
        .join(rings, "ring", "left")
        .join(newest.withColumnRenamed("polygon_id", "_id"), "_id", "left")
        .join(heights.withColumnRenamed("polygon_id", "_id"), "_id", "left")
        .withColumn("n_pixels", n)
        .withColumn("status", F.when(F.col("project").isNull(), "no_coverage").otherwise(measured(F.col("p90"), n)))
        .select("polygon_id", "project", "n_pixels", "p50", "p90", "vmax", "status")
    )


def measurement_summary(measurements: DataFrame) -> DataFrame:
    """Polygons per status with exact height quantiles of the accepted ones."""
    from .asof import zero_filled

    ok = measurements.where(F.col("status") == "ok").select("status", "p90")
    quantiles = grouped_quantiles(ok, ["status"], "p90", {"p10": 0.1, "p50": 0.5, "p90": 0.9}).drop("n")
    return zero_filled(measurements, "status", STATUSES).join(quantiles, "status", "left")
