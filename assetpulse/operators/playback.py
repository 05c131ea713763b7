"""Series bundles aligned to the time axis. A group is one sensor, asset or cell: as long as the axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import shown, status_chars
from ..params import SENSOR_STATUS_CHARS


def in_step_order(value: Column) -> Column:
    """Array of a value per step, nulls kept."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col("step"), value.alias("v"))))
    return F.transform(ordered, lambda e: e["v"])


def sensor_bundle(series: DataFrame) -> DataFrame:
    """Per sensor the values and one status character per step."""
    return series.groupBy("sensor_id").agg(
        in_step_order(shown("value", F.col("value"))).alias("values"),
        F.array_join(in_step_order(status_chars(SENSOR_STATUS_CHARS, F.col("status"))), "").alias("status"),
    )


def asset_bundle(health: DataFrame) -> DataFrame:
    from .health import health_strings

    return health_strings(health)


def risk_bundle(risk_series: DataFrame) -> DataFrame:
    """Per cell the whole-number risk of every step."""
    return risk_series.groupBy("cell_id").agg(in_step_order(F.col("risk")).alias("risk"))


def kpi_bundle(kpis: DataFrame) -> DataFrame:
    """One array per KPI (as long as the axis)."""
    names = [c for c in kpis.columns if c != "step"]
    return kpis.agg(*[in_step_order(F.col(c)).alias(c) for c in names])


def playback(sensors: DataFrame, assets: DataFrame, cells: DataFrame) -> DataFrame:
    """The bundle as rows (kind, id, body JSON), to be written as lines."""
    def rows(df: DataFrame, kind: str, key: str) -> DataFrame:
        body = F.to_json(F.struct(*[c for c in df.columns if c != key]))
        return df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), body.alias("body"))

    return rows(sensors, "sensor", "sensor_id").unionByName(rows(assets, "asset", "asset_id")).unionByName(
        rows(cells, "risk_zone", "cell_id")
    )
