"""Detected anomalies against labelled events: recall, precision, delays, benign overlaps, group recovery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rounding import round_even
from ..params import MATCH_TOLERANCE_HOURS, SEVERITIES
from .asof import zero_filled
from .medians import grouped_median

DAY_US = 86_400_000_000
HOUR_US = 3_600_000_000


def _days(start_us: Column, end_us: Column) -> Column:
    return F.sequence(F.floor(start_us / DAY_US), F.floor(end_us / DAY_US))


def _spans(df: DataFrame, tolerance_hours: float = 0.0) -> DataFrame:
    pad = int(tolerance_hours * HOUR_US)
    return df.withColumn("_s", F.unix_micros("started_at") - pad).withColumn("_e", F.unix_micros("ended_at") + pad)


def overlapping(anomalies: DataFrame, events: DataFrame, keys: list[str], tolerance_hours: float) -> DataFrame:
    """(anomaly_id, event_id, a_started) of closed intervals that overlap, events widened on both sides.

    Intervals meet per key and day, so a key that holds very many intervals is spread over its days; a pair is
    reported on the day on which the later of the two begins, hence once.
    """
    a = _spans(anomalies).select(
        *keys, "anomaly_id", F.col("started_at").alias("a_started"), F.col("_s").alias("as_"), F.col("_e").alias("ae_")
    )
    e = _spans(events, tolerance_hours).select(
        *keys, "event_id", F.col("started_at").alias("e_started"), F.col("_s").alias("es_"), F.col("_e").alias("ee_")
    )
    a = a.withColumn("day", F.explode(_days(F.col("as_"), F.col("ae_"))))
    e = e.withColumn("day", F.explode(_days(F.col("es_"), F.col("ee_"))))
    return (
        a.join(e, [*keys, "day"])
        .where((F.col("as_") <= F.col("ee_")) & (F.col("ae_") >= F.col("es_")))
        .where(F.col("day") == F.floor(F.greatest("as_", "es_") / DAY_US))
        .select("anomaly_id", "event_id", "a_started", "e_started")
    )


def matches(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    abnormal = events.where("is_anomaly")
    return overlapping(anomalies, abnormal, ["sensor_id"], MATCH_TOLERANCE_HOURS)


def event_hits(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    """Every abnormal event with its number of hits and the delay of the first one in hours."""
    hits = matches(anomalies, events).groupBy("event_id").agg(
        F.count("*").alias("hits"), F.min("a_started").alias("first_hit")
    )
    delay = (F.unix_micros("first_hit") - F.unix_micros("started_at")) / float(HOUR_US)
    return (
        events.where("is_anomaly")
        .join(hits, "event_id", "left")
        .select("event_id", "event_type", "sensor_id", F.coalesce("hits", F.lit(0)).alias("hits"), delay.alias("delay_hours"))
    )


def false_anomalies(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    """Anomalies that meet no abnormal event, with ``during_benign``."""
    true_ids = matches(anomalies, events).select("anomaly_id").distinct()
    wrong = anomalies.join(true_ids, "anomaly_id", "left_anti").select(
        "anomaly_id", "sensor_id", "sensor_type", "started_at", "ended_at"
    )
    benign = events.where("NOT is_anomaly")
    typed = benign.where(F.col("sensor_type").isNotNull())
    general = benign.where(F.col("sensor_type").isNull()).withColumn("_all", F.lit(1)).drop("sensor_type")
    near = _existence(wrong, typed, ["sensor_type"]).unionByName(
        _existence(wrong.withColumn("_all", F.lit(1)), general, ["_all"])
    )
    return wrong.join(near.distinct().withColumn("_b", F.lit(True)), "anomaly_id", "left").withColumn(
        "during_benign", F.coalesce("_b", F.lit(False))
    ).drop("_b")


def _existence(anomalies: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Ids of anomalies that overlap at least one event. Events of one key are merged into disjoint runs first,
    so the join meets each anomaly with at most a few runs per day however many events overlap there."""
    runs = merge_intervals(events, keys)
    a = _spans(anomalies).withColumn("day", F.explode(_days(F.col("_s"), F.col("_e"))))
    r = runs.withColumn("day", F.explode(_days(F.col("rs"), F.col("re"))))
    hit = (F.col("_s") <= F.col("re")) & (F.col("_e") >= F.col("rs"))
    return a.join(r, [*keys, "day"]).where(hit).select("anomaly_id").distinct()


def merge_intervals(events: DataFrame, keys: list[str]) -> DataFrame:
    """Union of closed intervals per key and day of start, as disjoint runs (rs, re) in microseconds."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*keys, "_d").orderBy("_s", "_e")
    spans = _spans(events).withColumn("_d", F.floor(F.col("_s") / DAY_US))
    # equal starts collapse before the window, so the window holds distinct starts of one day only
    spans = spans.groupBy(*keys, "_d", "_s").agg(F.max("_e").alias("_e"))
    before = F.max("_e").over(w.rowsBetween(W.unboundedPreceding, -1))
    opens = F.coalesce(F.col("_s") > F.col("_b"), F.lit(True)).cast("int")
    return (
        spans.withColumn("_b", before)
        .withColumn("_g", F.sum(opens).over(w))
        .groupBy(*keys, "_d", "_g")
        .agg(F.min("_s").alias("rs"), F.max("_e").alias("re"))
        .drop("_d", "_g")
    )


def evaluation(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    """One row of metrics; ratios are null without a denominator, truth-based counts are null without any truth."""
    e = event_hits(anomalies, events).agg(
        F.count("*").alias("injected_events"),
        F.count_if(F.col("hits") > 0).alias("detected_events"),
        F.count_if(F.col("hits") > 1).alias("split_events"),
    )
    a = anomalies.agg(F.count("*").alias("anomalies"))
    f = false_anomalies(anomalies, events).agg(
        F.count("*").alias("_false"), F.count_if("during_benign").alias("_benign")
    )
    known = events.agg((F.count("*") > 0).alias("_known"))
    ratio = F.try_divide
    rows = e.crossJoin(a).crossJoin(f).crossJoin(known)  # four single rows
    return rows.select(
        "injected_events",
        "detected_events",
        round_even(ratio(F.col("detected_events").cast("double"), F.col("injected_events")), 3).alias("event_recall"),
        "anomalies",
        F.when(F.col("_known"), F.col("anomalies") - F.col("_false")).alias("true_anomalies"),
        F.when(
            F.col("_known"), round_even(ratio((F.col("anomalies") - F.col("_false")).cast("double"), F.col("anomalies")), 3)
        ).alias("anomaly_precision"),
        F.when(F.col("_known"), F.col("_false")).alias("false_anomalies"),
        F.when(F.col("_known"), F.col("_benign")).alias("false_during_benign"),
        "split_events",
    )


def delay_by_type(anomalies: DataFrame, events: DataFrame) -> DataFrame:
    """Median detection delay in hours per event type."""
    rows = event_hits(anomalies, events).where("hits > 0")
    m = grouped_median(rows, ["event_type"], "delay_hours")
    return m.select("event_type", "n", round_even(F.col("median"), 1).alias("median_delay_hours"))


def severity_counts(anomalies: DataFrame) -> DataFrame:
    return zero_filled(anomalies, "severity", SEVERITIES)


def group_recovery(events: DataFrame, anomalies: DataFrame) -> DataFrame:
    """How a labelled group of events shows up in the clusters (anomalies carry cluster_id).

    One row: events, detected, the cluster most events fall into (smallest id on a tie), events in it, recovered.
    """
    hits = overlapping(anomalies, events, ["sensor_id"], MATCH_TOLERANCE_HOURS).join(
        anomalies.select("anomaly_id", "cluster_id"), "anomaly_id"
    )
    per_event = events.select("event_id").join(
        hits.groupBy("event_id").agg(F.min("anomaly_id").alias("_a"), F.min("cluster_id").alias("_c")), "event_id", "left"
    )
    counts = per_event.groupBy(F.col("_c").alias("cluster_id")).agg(
        F.count("*").alias("n"), F.count("_a").alias("detected")
    )
    best = F.max_by("cluster_id", F.when(F.col("cluster_id").isNotNull(), F.struct(F.col("n"), -F.col("cluster_id"))))
    in_best = F.max(F.when(F.col("cluster_id").isNotNull(), F.col("n")))
    return counts.agg(
        F.sum("n").alias("events"),
        F.sum("detected").alias("detected"),
        best.alias("cluster_id"),
        F.coalesce(in_best, F.lit(0)).alias("in_cluster"),
    ).withColumn("recovered", F.col("in_cluster") == F.col("events"))


def final_step_check(anomalies: DataFrame, events: DataFrame, end) -> DataFrame:
    """One row: is a labelled event running at the end, and are a critical and a high anomaly active then."""
    running = events.agg(
        F.coalesce(F.bool_or(F.col("is_anomaly") & (F.col("ended_at") >= F.lit(end))), F.lit(False)).alias("running")
    )
    active = anomalies.where(F.col("ended_at") >= F.lit(end)).agg(
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high")
    )
    return running.crossJoin(active).withColumn(  # two single rows
        "holds", ~F.col("running") | ((F.col("critical") > 0) & (F.col("high") > 0))
    )


def detection_summary(anomalies: DataFrame, flags: DataFrame, end) -> DataFrame:
    """Anomalies, sensors hit, active at the end, flagged readings."""
    a = anomalies.agg(
        F.count("*").alias("anomalies"),
        F.countDistinct("sensor_id").alias("sensors"),
        F.count_if(F.col("ended_at") >= F.lit(end)).alias("active_at_end"),
    )
    return a.crossJoin(flags.agg(F.count_if("flagged").alias("flagged_readings")))  # two single rows
