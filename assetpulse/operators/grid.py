"""Readings on the time grid: last value per cell, carry-forward, intervals over cells, islands, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.timeaxis import TimeAxis, add_hours, local_date


def sampling_step(sensors: DataFrame, default_s: int = 3600) -> int:
    """Most common sampling interval, the shortest on a tie."""
    row = (
        sensors.groupBy("sampling_interval_s")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "sampling_interval_s")
        .first()
    )
    return int(row.sampling_interval_s) if row else default_s


def to_cells(readings: DataFrame, axis: TimeAxis, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per (sensor, cell): the latest reading that falls into it. Readings off the axis are left out.

    Of readings at one time the one with the greatest value counts, as in ``asof.latest_per_sensor``.

    The aggregation combines before the shuffle; afterwards a sensor has at most one row per axis step, however
    many readings it sent, so everything keyed by sensor downstream is bounded by the axis.
    """
    placed = readings.withColumn("cell", axis.cell(F.col("ts"))).where(F.col("cell").between(0, axis.last))
    newest = F.max(F.struct("ts", "value", *extra)).alias("_r")
    return placed.groupBy("sensor_id", "cell").agg(newest).select("sensor_id", "cell", "_r.*")


def grid_report(readings: DataFrame, axis: TimeAxis) -> DataFrame:
    """Readings placed on the grid, superseded within their cell, and after the last grid point."""
    cell = axis.cell(F.col("ts"))
    per_cell = readings.groupBy("sensor_id", cell.alias("cell")).agg(F.count("*").alias("n"))
    inside = F.col("cell").between(0, axis.last)
    return per_cell.agg(
        F.count_if(inside).alias("n_readings"),
        F.coalesce(F.sum(F.when(inside, F.col("n") - 1)), F.lit(0)).alias("n_superseded"),
        F.coalesce(F.sum(F.when(~inside, F.col("n"))), F.lit(0)).alias("n_outside"),
    )


def carry_forward(cells: DataFrame, sensors: DataFrame, axis: TimeAxis, carried: list[str]) -> DataFrame:
    """Every (sensor, step) of the axis with the cell whose reading is current there (null when offline).

    A reading covers the steps up to the next reading's cell; it is current for the sensor's sampling interval.
    The rows are produced by expanding each reading's span, so the dense grid costs one shuffle by sensor and no
    join against a sensors-by-steps frame. Columns in ``carried`` are nulled where the reading is stale.
    """
    w = W.partitionBy("sensor_id").orderBy("cell")
    last = F.lit(axis.last).cast("bigint")
    start = F.when(F.lag("cell").over(w).isNull(), F.lit(0).cast("bigint")).otherwise(F.col("cell"))
    stop = F.coalesce(F.lead("cell").over(w) - 1, last)
    window = F.greatest(F.round(F.col("sampling_interval_s") / F.lit(float(axis.step_s))), F.lit(1)).cast("bigint")
    spans = (
        sensors.join(cells, "sensor_id", "left")
        .withColumn("_from", start)
        .withColumn("_to", stop)
        .withColumn("step", F.explode(F.sequence("_from", "_to")))
    )
    fresh = F.coalesce((F.col("step") >= F.col("cell")) & (F.col("step") - F.col("cell") < window), F.lit(False))
    out = spans.withColumn("reporting", fresh).withColumn("own_cell", F.col("step").eqNullSafe(F.col("cell")))
    for name in carried:
        out = out.withColumn(name, F.when(F.col("reporting"), F.col(name)))
    return out.withColumn("cell", F.when(F.col("reporting"), F.col("cell"))).drop("_from", "_to")


def expand_intervals(
    intervals: DataFrame, axis: TimeAxis, started: str = "started_at", ended: str = "ended_at", grace_hours: float = 0.0
) -> DataFrame:
    """One row per interval and step inside ``[started, ended + grace]`` (closed at both ends)."""
    until = F.col(ended) if not grace_hours else add_hours(F.col(ended), F.lit(grace_hours))
    return (
        intervals.withColumn("_a", axis.first_cell_from(F.col(started)))
        .withColumn("_b", axis.last_cell_until(until))
        .where(F.col("_a") <= F.col("_b"))
        .withColumn("step", F.explode(F.sequence("_a", "_b")))
        .drop("_a", "_b")
    )


def active_counts(intervals: DataFrame, keys: list[str], axis: TimeAxis) -> DataFrame:
    """Number of active intervals per (keys, step); steps without one have no row."""
    return expand_intervals(intervals, axis).groupBy(*keys, "step").agg(F.count("*").alias("n_active"))


def with_islands(df: DataFrame, keys: list[str], flag: Column, gap_steps: int, cell: str = "cell") -> DataFrame:
    """Adds ``island``: flagged cells belong together when their index difference is at most gap + 1.

    Unflagged rows carry the number of the island before them, so a span filter can pick what lies inside.
    """
    w = W.partitionBy(*keys).orderBy(cell)
    before = F.last(F.when(flag, F.col(cell)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce(flag, F.lit(False)) & F.coalesce(F.col(cell) - before > gap_steps + 1, F.lit(True))
    return df.withColumn("_opens", opens.cast("int")).withColumn("island", F.sum("_opens").over(w)).drop("_opens")


def axis_frame(spark, axis: TimeAxis) -> DataFrame:
    """The steps of the axis with their times."""
    return spark.range(axis.count).select(F.col("id").alias("step")).withColumn("as_of", axis.at(F.col("step")))


def calendar_days(spark, axis: TimeAxis, zone: str) -> DataFrame:
    """First and last step of every local day."""
    return (
        axis_frame(spark, axis)
        .groupBy(local_date(F.col("as_of"), zone).alias("day"))
        .agg(F.min("step").alias("first_step"), F.max("step").alias("last_step"))
    )


def change_counter(changes: DataFrame, axis: TimeAxis) -> DataFrame:
    """Running number of steps at which the set of started or ended intervals changed."""
    spark = changes.sparkSession
    marks = (
        changes.select(F.explode(F.array(
            axis.first_cell_from(F.col("started_at")), axis.last_cell_until(F.col("ended_at")) + 1
        )).alias("step"))
        .where(F.col("step").between(0, axis.last))
        .groupBy("step")
        .agg(F.lit(1).alias("mark"))
    )
    w = W.orderBy("step").rowsBetween(W.unboundedPreceding, 0)  # one row per axis step
    return (
        axis_frame(spark, axis)
        .join(marks, "step", "left")
        .select("step", F.sum(F.coalesce("mark", F.lit(0))).over(w).alias("version"))
    )


def trend(cells: DataFrame, lag_steps: int, dead_band: Column, log_types: tuple[str, ...] = ()) -> DataFrame:
    """Value against the value ``lag_steps`` steps earlier: rising, falling or steady; null when either is missing.

    Changes within the dead band are steady. Types in ``log_types`` measure the change as the logarithm of the
    ratio when both values are positive.
    """
    w = W.partitionBy("sensor_id").orderBy("cell").rangeBetween(-lag_steps, -lag_steps)
    now, before = F.col("value"), F.col("earlier")
    relative = F.col("sensor_type").isin(*log_types) & (now > 0) & (before > 0)
    size = F.when(relative, F.abs(F.log(now / before))).otherwise(F.abs(now - before))
    return (
        cells.withColumn("earlier", F.first("value").over(w))
        .withColumn("delta", now - before)
        .withColumn(
            "trend",
            F.when(F.col("delta").isNull(), None)
            .when((size <= dead_band) | (F.col("delta") == 0), "steady")
            .otherwise(F.when(F.col("delta") > 0, "rising").otherwise("falling")),
        )
    )
