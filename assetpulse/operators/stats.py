"""Counts, breakdowns, roll-ups, extents and the dataset record."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules
from ..functions.geometry import line_length, polygon_area_m2
from ..functions.rounding import round_up
from ..params import ASSET_BANDS, SENSOR_TYPES, SEVERITIES
from .asof import zero_filled


def statistics(anomalies: DataFrame, as_of) -> DataFrame:
    """(dimension, key, n): anomalies to date by severity and sensor type with mandatory keys, and the total.

    One pass counts by both columns; the two breakdowns and the total are sums over that small table.
    """
    spark = anomalies.sparkSession
    base = anomalies.where(rules.visible(as_of)).groupBy("severity", "sensor_type").agg(F.count("*").alias("n"))
    entries = F.array(
        F.struct(F.lit("severity").alias("dimension"), F.col("severity").alias("key")),
        F.struct(F.lit("sensor_type").alias("dimension"), F.col("sensor_type").alias("key")),
        F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("key")),
    )
    rows = base.select(F.explode(entries).alias("d"), "n").select("d.*", "n")
    keys = [("severity", s) for s in SEVERITIES] + [("sensor_type", t) for t in SENSOR_TYPES] + [("total", "all")]
    mandatory = spark.createDataFrame(keys, "dimension string, key string").withColumn("n", F.lit(0).cast("bigint"))
    return rows.unionByName(mandatory).groupBy("dimension", "key").agg(F.sum("n").alias("n"))


def counts_by(df: DataFrame, column: str, keys: tuple[str, ...]) -> DataFrame:
    return zero_filled(df, column, keys)


def health_bands(summary: DataFrame) -> DataFrame:
    """Assets per health band plus the unmonitored rest."""
    return zero_filled(summary, "status", (*[n for n, _ in ASSET_BANDS], "not_monitored"))


def asset_rollup(summary: DataFrame) -> DataFrame:
    """Per asset type: assets, simulated and monitored ones, sensors, anomalies, line km and footprint ha."""
    is_line, is_area = F.col("geom_type") == "LineString", F.col("geom_type") == "Polygon"
    return summary.groupBy("asset_type").agg(
        F.count("*").alias("assets"),
        F.count_if("is_simulated").alias("simulated_assets"),
        F.count_if("monitored").alias("monitored_assets"),
        F.sum("sensor_count").alias("sensors"),
        F.sum("anomaly_count").alias("anomalies"),
        round_up(F.sum(F.when(is_line, line_length(F.col("coords")))) / 1000.0, 2).alias("total_length_km"),
        round_up(F.sum(F.when(is_area, polygon_area_m2(F.col("coords")))) / 10000.0, 2).alias("total_footprint_ha"),
    )


def network_summary(sensors: DataFrame) -> DataFrame:
    """Sensors and monitored assets per (type, placement)."""
    return sensors.groupBy("sensor_type", "placement").agg(
        F.count("*").alias("sensors"), F.countDistinct("asset_id").alias("assets")
    )


def extent(df: DataFrame, coords: str = "coords") -> DataFrame:
    """West, south, east, north over all vertices; reduced per row before the aggregate."""
    lon = F.transform(coords, lambda v: v["lon"])
    lat = F.transform(coords, lambda v: v["lat"])
    return df.agg(
        F.min(F.array_min(lon)).alias("west"), F.min(F.array_min(lat)).alias("south"),
        F.max(F.array_max(lon)).alias("east"), F.max(F.array_max(lat)).alias("north"),
    )


def nested_thresholds(thresholds: DataFrame) -> DataFrame:
    """One row: map of sensor type to unit and map of placement to limits (as large as the threshold table)."""
    limits = F.struct("warn_low", "warn_high", "crit_low", "crit_high")
    per_type = thresholds.groupBy("sensor_type").agg(
        F.max("unit").alias("unit"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("placement"), limits.alias("l"))))).alias("placements"),
    )
    return per_type.agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("sensor_type", F.to_json(F.struct("unit", "placements")).alias("v"))))
        ).alias("sensor_types")
    )


def dataset_record(bounds: DataFrame, totals: dict[str, DataFrame], thresholds: DataFrame) -> DataFrame:
    """One row: area bounds and centre, table totals, nested thresholds."""
    out = bounds.withColumn("centre_lon", (F.col("west") + F.col("east")) / 2).withColumn(
        "centre_lat", (F.col("south") + F.col("north")) / 2
    )
    for name, df in totals.items():
        out = out.crossJoin(df.agg(F.count("*").alias(name)))  # single rows
    return out.crossJoin(nested_thresholds(thresholds))
