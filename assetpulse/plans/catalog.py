"""Registered queries: name -> callable(spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions import rules, text, timeaxis
from ..functions.rounding import round_even, round_up
from ..operators import asof, baseline, detectors, events, grid, health, ingest, medians
from . import detect
from .tables import Plant, published

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
AS_OF = datetime(2024, 1, 20, 0, 0, 0)  # resolved against the axis, see ``as_of``


def query(call: Callable[[Plant], DataFrame]) -> Callable[[Plant], DataFrame]:
    """Registers a function of the plant under its own name."""
    QUERIES[call.__name__] = lambda spark, sf_dir: published(call(Plant(spark, sf_dir)))
    return call


def as_of(p: Plant) -> datetime:
    """The effective as_of: AS_OF floored to the plant's axis."""
    us = p.axis.at_us(p.axis.index_of(AS_OF))
    return datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=us)


# --- ingestion --------------------------------------------------------------------------------------------------
def raw_readings(p: Plant) -> DataFrame:
    """The events as incoming records, some of them spoiled by a rule on their id; every event is kept."""
    e = F.col("event_id")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.pmod(F.col("user_id"), F.lit(4))
    from .tables import UNITS, code, pick

    return p.events.select(
        F.when(e % 31 == 0, "").when(e % 37 == 0, F.concat(F.lit("X"), e.cast("string")))
        .otherwise(code("S", F.col("user_id"))).alias("sensor_id"),
        F.when(e % 41 == 0, iso).when(e % 43 == 0, "not a time")
        .when(e % 5 == 0, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00Z")))
        .otherwise(F.concat(iso, F.lit("Z"))).alias("ts"),
        F.when(e % 47 == 0, F.lit(float("nan"))).when(e % 53 == 0, F.lit(None))
        .when(e % 59 == 0, F.lit(float("inf"))).when(e % 7 == 0, -F.col("value"))
        .otherwise(F.col("value")).alias("value"),
        F.when(e % 61 == 0, "furlong").otherwise(pick(UNITS, kind)).alias("unit"),
        e.alias("seq"),
    )


@query
def ingest_validate(p: Plant) -> DataFrame:
    checked = ingest.validate_readings(raw_readings(p), p.sensors)
    return checked.select("seq", F.coalesce("reason", F.lit("accepted")).alias("reason"), "status")


@query
def ingest_dedup_upsert(p: Plant) -> DataFrame:
    """The stored readings overlaid with the accepted records of the batch."""
    kept = ingest.keep_last(ingest.validate_readings(raw_readings(p), p.sensors))
    stored = p.readings.join(p.sensors.select("sensor_id", "unit"), "sensor_id").select(
        "sensor_id", "ts", "value", "unit", F.lit("ok").alias("status"), F.lit("stored").alias("source")
    )
    batch = kept.withColumn("source", F.lit("batch"))
    return ingest.merge_readings(stored, batch).select("sensor_id", "ts", "value", "status", "source")


@query
def ingest_result(p: Plant) -> DataFrame:
    r = ingest.ingest_result(ingest.validate_readings(raw_readings(p), p.sensors))
    entries = F.transform(F.map_entries("reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return r.select("accepted", "suspect", "rejected", F.array_join(entries, ",").alias("reasons"))


# --- time axis and grid -----------------------------------------------------------------------------------------
@query
def reading_cells(p: Plant) -> DataFrame:
    return grid.to_cells(p.readings, p.axis)


@query
def grid_report(p: Plant) -> DataFrame:
    return grid.grid_report(p.readings, p.axis)


@query
def asof_resolve(p: Plant) -> DataFrame:
    """Every reading time shifted by up to 40 days either way, resolved to its effective as_of index."""
    shifted = timeaxis.add_hours(F.col("ts"), (F.pmod(F.col("event_id"), F.lit(81)) - 40) * 24)
    return p.events.select("event_id", p.axis.as_of_index(shifted).alias("step"))


@query
def local_profile_keys(p: Plant) -> DataFrame:
    return p.events.select(
        "event_id",
        timeaxis.local_hour(F.col("ts"), p.params.timezone).alias("hour"),
        timeaxis.is_weekend(F.col("ts"), p.params.timezone).alias("weekend"),
        timeaxis.iso_z(F.col("ts")).alias("iso"),
    )


@query
def sampling_step(p: Plant) -> DataFrame:
    """Most common order gap in days per market segment, shortest on a tie: the mode rule over whole tables."""
    gaps = (
        p.table("orders")
        .withColumn("prev", F.lag("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")))
        .where("prev IS NOT NULL")
        .select(F.datediff("o_orderdate", "prev").alias("gap"))
        .groupBy("gap")
        .agg(F.count("*").alias("n"))
    )
    return gaps.orderBy(F.desc("n"), "gap").limit(1)


# --- status -----------------------------------------------------------------------------------------------------
def simple_scores(p: Plant) -> DataFrame:
    """Readings with a plain flag (value over 100) so the status rules can be checked on their own."""
    return p.readings.withColumn("flagged", F.col("value") > 100).withColumn("z", (F.col("value") - 50) / 20.0)


@query
def sensor_latest(p: Plant) -> DataFrame:
    return asof.sensor_latest(p.sensors, p.readings).select("sensor_id", "asset_id", "sensor_type", "ts", "value")


@query
def sensor_status_asof(p: Plant) -> DataFrame:
    s = asof.sensor_status_at(p.sensors, p.thresholds, simple_scores(p), p.anomalies, as_of(p))
    return s.select("sensor_id", "asset_id", "sensor_type", "status", "ts", "value", "flagged")


def status_series(p: Plant) -> DataFrame:
    return asof.sensor_status_series(p.sensors, p.thresholds, simple_scores(p), p.anomalies, p.axis)


def health_series(p: Plant) -> DataFrame:
    return health.asset_health(status_series(p), p.anomalies, p.axis, p.params)


def health_spot(p: Plant, step: int) -> DataFrame:
    return health.asset_health_at(p.sensors, p.thresholds, simple_scores(p), p.anomalies, p.axis, p.params, step)


@query
def sensor_status_series(p: Plant) -> DataFrame:
    return status_series(p).select(
        "sensor_id", "step", "value", "reporting", "flagged", "outside_warn", "anomaly_active", "status"
    )


@query
def kpis_asof(p: Plant) -> DataFrame:
    status = asof.sensor_status_at(p.sensors, p.thresholds, simple_scores(p), p.anomalies, as_of(p))
    now = health_spot(p, p.axis.index_of(AS_OF))
    return asof.kpis_at(p.assets, status, p.anomalies, now, as_of(p))


@query
def kpi_series(p: Plant) -> DataFrame:
    series = status_series(p)
    return asof.kpi_series(series, p.anomalies, health.asset_health(series, p.anomalies, p.axis, p.params), p.axis)


# --- health -----------------------------------------------------------------------------------------------------
@query
def asset_health_series(p: Plant) -> DataFrame:
    return health_series(p).drop("as_of")


@query
def asset_health_latest(p: Plant) -> DataFrame:
    return health.health_latest(health_series(p)).select("asset_id", "as_of", "health_score", "status")


@query
def needs_attention(p: Plant) -> DataFrame:
    now = health_spot(p, p.axis.index_of(AS_OF))
    return health.needs_attention(now, p.assets, health.active_by_asset(p.anomalies, as_of(p)))


@query
def health_summary(p: Plant) -> DataFrame:
    return health.health_summary(health_series(p), p.axis)


@query
def health_strings(p: Plant) -> DataFrame:
    s = health.health_strings(health_series(p))
    return s.select("asset_id", "status", F.array_join(F.col("health").cast("array<string>"), ",").alias("health"))


# --- baseline, detectors, events --------------------------------------------------------------------------------
def work_cells(p: Plant) -> DataFrame:
    return baseline.prepare(grid.to_cells(p.readings, p.axis), p.sensors, p.axis, p.params)


def plain_scores(p: Plant) -> DataFrame:
    """Baseline without peer adjustment and isolation scores."""
    return detect.score_readings(p.readings, p.sensors, p.axis, p.params, peers=False, with_forest=False)


def plain_flags(p: Plant) -> DataFrame:
    return detect.flag_readings(plain_scores(p), p.thresholds, p.params)


def plain_events(p: Plant) -> DataFrame:
    return events.find_events(plain_flags(p), p.axis, p.params)


@query
def hourly_profile(p: Plant) -> DataFrame:
    return baseline.hourly_profile(work_cells(p)).withColumn("profile", F.round("profile", 9))


@query
def robust_scale(p: Plant) -> DataFrame:
    r = medians.robust_scale(work_cells(p), ["sensor_id"], "work")
    return r.select("sensor_id", F.round("center", 9).alias("center"), F.round("sigma", 9).alias("sigma"))


@query
def robust_z(p: Plant) -> DataFrame:
    s = plain_scores(p)
    return s.select(
        "sensor_id", "cell", "z", "floor",
        *[F.round(c, 8).alias(c) for c in ("scale", "expected", "expected_low", "expected_high")],
    )


@query
def class_median(p: Plant) -> DataFrame:
    m = baseline.class_medians(baseline.with_profile(work_cells(p), F.col("work")))
    return m.select("sensor_type", "placement", "cell", "n", F.round("class_median", 8).alias("class_median"))


@query
def price_medians(p: Plant) -> DataFrame:
    """Exact medians of groups that grow with the data: unit price by return flag and ship mode of all lines."""
    rows = p.table("lineitem").select(
        "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price")
    )
    m = medians.grouped_median(rows, ["l_returnflag", "l_linestatus"], "unit_price")
    return m.withColumn("median", F.round("median", 6))


@query
def rolling_median_flags(p: Plant) -> DataFrame:
    r = detectors.with_rolling(plain_scores(p), p.params)
    return r.select("sensor_id", "cell", F.round("trailing_z", 6).alias("trailing_z"), "rolling")


@query
def short_features(p: Plant) -> DataFrame:
    f = detectors.with_short_features(plain_scores(p), p.params)
    return f.select(
        "sensor_id", "cell", *[F.round(c, 6).alias(c) for c in ("delta_z", "mean_short", "std_short", "mean_long")]
    )


@query
def hour_flags(p: Plant) -> DataFrame:
    return plain_flags(p).select(
        "sensor_id", "cell", "z", "critical", "strong", "rolling", "moderate", "flagged", "core"
    )


@query
def flag_islands(p: Plant) -> DataFrame:
    rows = grid.with_islands(plain_flags(p), ["sensor_id"], F.col("flagged"), p.params.merge_gap_steps)
    return rows.where("flagged").groupBy("sensor_id", "island").agg(
        F.min("cell").alias("first_cell"), F.max("cell").alias("last_cell"), F.count("*").alias("flagged_steps")
    )


@query
def anomaly_events(p: Plant) -> DataFrame:
    return plain_events(p).select(
        "sensor_id", "started_at", "ended_at", "peak_at", "start_cell", "end_cell", "peak_cell", "flagged_steps",
        "duration_hours", "robust_z", "observed_value", "expected_value", "status",
    )


@query
def event_scores(p: Plant) -> DataFrame:
    return plain_events(p).select(
        "sensor_id", "start_cell", "anomaly_score", "severity", "anomaly_type",
        F.col("score_components.magnitude").alias("magnitude"),
        F.col("score_components.duration").alias("duration"),
        F.col("score_components.threshold").alias("threshold"),
    )


@query
def event_methods(p: Plant) -> DataFrame:
    return plain_events(p).select(
        "sensor_id", "start_cell", "detection_method", F.col("breach.level").alias("breach_level"),
        F.col("breach.side").alias("breach_side"), F.col("breach.limit").alias("breach_limit"),
        F.col("breach.extreme").alias("breach_extreme"),
    )


@query
def detect_anomalies(p: Plant) -> DataFrame:
    """Flagship: grid, baseline, flags, events and numbering over all readings."""
    found = events.number_anomalies(plain_events(p))
    return found.select(
        "anomaly_id", "sensor_id", "asset_id", "sensor_type", "anomaly_type", "started_at", "ended_at", "peak_at",
        "duration_hours", "observed_value", "robust_z", "anomaly_score", "severity", "detection_method", "status",
    )


@query
def anomaly_explanations(p: Plant) -> DataFrame:
    e = events.with_explanation(plain_events(p))
    return e.select("sensor_id", "start_cell", "explanation", F.size(text.causal_words(F.col("explanation"))).alias("causal"))


@query
def detect_full(p: Plant) -> DataFrame:
    """Detection with peer adjustment and isolation scores."""
    return detect.detect(p.readings, p.sensors, p.thresholds, p.axis, p.params).select(
        "anomaly_id", "sensor_id", "anomaly_type", "started_at", "ended_at", "robust_z", "severity",
        "detection_method", "explanation",
    )


@query
def peer_adjusted_z(p: Plant) -> DataFrame:
    s = detect.score_readings(p.readings, p.sensors, p.axis, p.params, with_forest=False)
    return s.select("sensor_id", "cell", "z", "adjustment", "peer_adjusted")


@query
def isolation_scores(p: Plant) -> DataFrame:
    from ..operators.forest import with_forest_scores

    return with_forest_scores(plain_scores(p), p.params).select("sensor_id", "cell", "z", "forest_score")


# --- single operators over given tables --------------------------------------------------------------------------
@query
def ema(p: Plant) -> DataFrame:
    """Regressors of every class: its mean value per step and, for moisture, the moving averages of it."""
    cells = grid.to_cells(p.readings, p.axis).join(p.sensors.select("sensor_id", "sensor_type", "placement"), "sensor_id")
    means = cells.groupBy("sensor_type", "placement", "cell").agg(F.round(F.avg("value"), 6).alias("class_median"))
    f = baseline.class_features(means, p.axis)
    return f.select("sensor_type", "cell", F.posexplode("features").alias("pos", "f")).select(
        "sensor_type", "cell", F.col("pos").cast("bigint").alias("pos"), F.round("f", 6).alias("feature")
    )


@query
def sampling_mode(p: Plant) -> DataFrame:
    """Most common sampling interval when sensors have one by their type and number."""
    intervals = p.sensors.withColumn("sampling_interval_s", (F.length("sensor_type") % 3 + 1) * 600)
    return p.spark.range(1).select(F.lit(grid.sampling_step(intervals)).cast("bigint").alias("step_s"))


@query
def readings_between(p: Plant) -> DataFrame:
    """Readings of a closed range of time, read from the file."""
    from ..sources import readings as src

    rows = src.read_readings(p.spark, f"{p.sf_dir}/events.parquet", datetime(2024, 1, 5, tzinfo=timezone.utc), datetime(2024, 1, 12, tzinfo=timezone.utc))
    return rows.select("event_id", "user_id", "value")


@query
def scored_readings(p: Plant) -> DataFrame:
    """All readings, scored where there is a score."""
    scores = simple_scores(p).where("value > 30").select("sensor_id", "ts", "z", "flagged")
    return asof.with_scores(p.readings, scores).select("sensor_id", "ts", "value", "z", "flagged")
