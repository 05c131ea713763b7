"""Per-step detectors over z: limits, levels, trailing medians, short-term features and the resulting flags.

Windows count grid steps, never rows: every frame is a RANGE over the cell index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.rules import outside
from ..params import Params
from .medians import median


def trailing(steps: int, keys: tuple[str, ...] = ("sensor_id",), cell: str = "cell"):
    return W.partitionBy(*keys).orderBy(cell).rangeBetween(-(max(steps, 1) - 1), 0)


def trailing_median(value: Column, steps: int, min_readings: int = 1, cell: str = "cell") -> Column:
    """Median of the values in the last ``steps`` steps; null below ``min_readings`` of them."""
    w = trailing(steps, cell=cell)
    return F.when(F.count(value).over(w) >= max(min_readings, 1), median(value).over(w))


def with_rolling(scores: DataFrame, params: Params) -> DataFrame:
    """Adds ``rolling``: sustained shift by the trailing median of z, at steps that have a reading."""
    level = trailing_median(F.col("z"), params.steps(params.rolling_hours), params.rolling_min_readings)
    return scores.withColumn("trailing_z", level).withColumn(
        "rolling", F.coalesce(F.abs("trailing_z") >= params.rolling_level, F.lit(False)) & F.col("z").isNotNull()
    )


def with_short_features(scores: DataFrame, params: Params) -> DataFrame:
    """Adds delta_z, mean_short, std_short and mean_long of z; a missing previous step gives a change of zero."""
    short, long = trailing(params.steps(params.short_hours)), trailing(params.steps(params.long_hours))
    previous = F.first("z").over(W.partitionBy("sensor_id").orderBy("cell").rangeBetween(-1, -1))
    return (
        scores.where(F.col("z").isNotNull())
        .withColumn("delta_z", F.coalesce(F.col("z") - previous, F.lit(0.0)))
        .withColumn("mean_short", F.avg("z").over(short))
        .withColumn("std_short", F.stddev_pop("z").over(short))
        .withColumn("mean_long", F.avg("z").over(long))
    )


def with_flags(scores: DataFrame, thresholds: DataFrame, params: Params) -> DataFrame:
    """Adds critical, strong, rolling, moderate, forest, flagged and core.

    ``forest`` needs a ``forest_score`` column; without one it is false. It corroborates and never makes an event.
    """
    limits = thresholds.select("sensor_type", "placement", "warn_low", "warn_high", "crit_low", "crit_high")
    rows = with_rolling(scores.join(limits, ["sensor_type", "placement"]), params)
    size = F.abs("z")
    forest = F.lit(False)
    if "forest_score" in scores.columns:
        forest = F.coalesce((F.col("forest_score") >= params.forest_threshold) & (size >= params.z_min), F.lit(False))
    return (
        rows.withColumn("critical", outside(F.col("value"), F.col("crit_low"), F.col("crit_high")))
        .withColumn("strong", size >= params.z_strong)
        .withColumn("moderate", size >= params.z_min)
        .withColumn("forest", forest)
        .withColumn("flagged", F.col("critical") | F.col("strong") | F.col("rolling") | F.col("moderate"))
        .withColumn("core", F.col("moderate") | F.col("critical"))
    )
