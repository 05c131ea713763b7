"""List and detail queries: filters, orderings, pages, histories and nested records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import rules
from ..functions.geometry import in_box, line_in_box, ring_in_box
from ..functions.rules import shown
from ..functions.timeaxis import TimeAxis, local_date
from .proximity import with_nearby_assets

def ordering(name: str) -> list[Column]:
    """Sort columns of a whitelisted ordering; ties by id."""
    table = {
        "-started_at": lambda: [F.desc("started_at")],
        "started_at": lambda: [F.asc("started_at")],
        "-anomaly_score": lambda: [F.desc("anomaly_score")],
        "severity": lambda: [F.desc(rules.severity_rank(F.col("severity")))],
    }
    if name not in table:
        raise ValueError(f"unknown ordering {name!r}; use one of {', '.join(sorted(table))}")
    return [*table[name](), F.asc("anomaly_id")]


def only(df: DataFrame, column: str, values: Sequence | None) -> DataFrame:
    """A filter that exists only when asked for, so it can reach the scan."""
    return df if values is None else df.where(F.col(column).isin(list(values)))


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page with ``total``; an empty page still has one row that carries the total (all else null)."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return total.join(rows, F.lit(True), "left")  # the left side is a single row


def anomaly_list(
    anomalies: DataFrame,
    sensors: DataFrame,
    assets: DataFrame,
    as_of,
    severity: Sequence[str] | None = None,
    sensor_type: Sequence[str] | None = None,
    asset_id: str | None = None,
    sensor_id: str | None = None,
    status: str | None = None,
    start=None,
    end=None,
    box: tuple[float, float, float, float] | None = None,
) -> DataFrame:
    """Anomalies visible at ``as_of`` with their status then; start and end test ``started_at``."""
    rows = only(only(anomalies.where(rules.visible(as_of)), "severity", severity), "sensor_type", sensor_type)
    for column, value in (("asset_id", asset_id), ("sensor_id", sensor_id)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if start is not None:
        rows = rows.where(F.col("started_at") >= F.lit(start))
    if end is not None:
        rows = rows.where(F.col("started_at") <= F.lit(end))
    if box is not None:
        rows = rows.where(in_box(F.col("lon"), F.col("lat"), box))
    rows = rows.withColumn("status_at", rules.anomaly_status(as_of))
    if status is not None:
        rows = rows.where(F.col("status_at") == status)
    return enriched(rows, sensors, assets)


def enriched(anomalies: DataFrame, sensors: DataFrame, assets: DataFrame) -> DataFrame:
    """Anomalies with placement and the asset's name and type; rows without a known sensor or asset drop out."""
    s = sensors.select("sensor_id", F.col("placement").alias("sensor_placement"))
    a = assets.select("asset_id", F.col("name").alias("asset_name"), "asset_type")
    return anomalies.join(s, "sensor_id").join(a, "asset_id")


def display_order(anomalies: DataFrame, as_of) -> DataFrame:
    """Active first, then higher severity, then newest start, then id."""
    now = rules.active(as_of)
    return anomalies.orderBy(
        F.desc(now), F.desc(rules.severity_rank(F.col("severity"))), F.desc("started_at"), F.asc("anomaly_id")
    )


def filter_display(
    anomalies: DataFrame, axis: TimeAxis, step: int, zone: str, severities=None, types=None, status=None, asset_id=None,
    day_from=None, day_to=None,
) -> DataFrame:
    """The list filter on step indexes: started by the step, sets, status then, asset, local start days."""
    rows = anomalies.withColumn("start_step", axis.first_cell_from(F.col("started_at"))).withColumn(
        "end_step", axis.last_cell_until(F.col("ended_at"))
    )
    rows = only(only(rows.where(F.col("start_step") <= step), "severity", severities), "sensor_type", types)
    if status == "active":
        rows = rows.where(F.col("end_step") >= step)
    elif status == "resolved":
        rows = rows.where(F.col("end_step") < step)
    if asset_id is not None:
        rows = rows.where(F.col("asset_id") == asset_id)
    day = local_date(F.col("started_at"), zone)
    if day_from is not None:
        rows = rows.where(day >= F.lit(day_from))
    if day_to is not None:
        rows = rows.where(day <= F.lit(day_to))
    return rows


def filter_sensors(sensors: DataFrame, sensor_type: str | None = None, asset_id: str | None = None) -> DataFrame:
    """``None`` or ``all`` is no restriction."""
    for column, value in (("sensor_type", sensor_type), ("asset_id", asset_id)):
        if value and value != "all":
            sensors = sensors.where(F.col(column) == value)
    return sensors


def asset_summary(assets: DataFrame, sensors: DataFrame, anomalies: DataFrame, health: DataFrame) -> DataFrame:
    """Every asset with sensor count and types, anomaly count and its newest health; unmonitored ones have no score."""
    s = sensors.groupBy("asset_id").agg(
        F.count("*").alias("sensor_count"), F.array_sort(F.collect_set("sensor_type")).alias("sensor_types")
    )
    n = anomalies.groupBy("asset_id").agg(F.count("*").alias("anomaly_count"))
    h = health.groupBy("asset_id").agg(
        F.max("as_of").alias("health_as_of"), F.max_by(F.struct("health_score", "status"), "as_of").alias("_h")
    )
    monitored = F.coalesce("sensor_count", F.lit(0)) > 0
    return (
        assets.join(s, "asset_id", "left")
        .join(n, "asset_id", "left")
        .join(h, "asset_id", "left")
        .withColumn("monitored", monitored)
        .withColumn("sensor_count", F.coalesce("sensor_count", F.lit(0)))
        .withColumn("sensor_types", F.coalesce("sensor_types", F.array().cast("array<string>")))
        .withColumn("anomaly_count", F.coalesce("anomaly_count", F.lit(0)))
        .withColumn("health_score", F.when(F.col("monitored"), F.col("_h.health_score")))
        .withColumn("status", F.when(F.col("monitored"), F.col("_h.status")).otherwise("not_monitored"))
        .drop("_h")
    )


def asset_list(
    summary: DataFrame, asset_type=None, category=None, monitored: bool | None = None, status=None, box=None, ids=None
) -> DataFrame:
    """Filters on the summary; the status filter applies to the derived status."""
    rows = only(only(only(summary, "asset_type", asset_type), "category", category), "asset_id", ids)
    if monitored is not None:
        rows = rows.where(F.col("monitored") == monitored)
    if box is not None:
        rows = rows.where(in_box(F.col("lon"), F.col("lat"), box))
    return only(rows, "status", status)


def active_anomalies(anomalies: DataFrame, assets: DataFrame) -> DataFrame:
    """Anomalies whose stored status is active, with their asset."""
    a = assets.select("asset_id", F.col("name").alias("asset_name"), "asset_type")
    return anomalies.where(F.col("status") == "active").join(a, "asset_id")


def sensor_list(status: DataFrame, assets: DataFrame, anomalies: DataFrame, as_of) -> DataFrame:
    """Sensors at ``as_of`` with their asset and the number of anomalies visible then (a grouped join, no subquery)."""
    counts = anomalies.where(rules.visible(as_of)).groupBy("sensor_id").agg(F.count("*").alias("visible_anomalies"))
    a = assets.select("asset_id", F.col("name").alias("asset_name"), "asset_type")
    return (
        status.join(a, "asset_id")
        .join(counts, "sensor_id", "left")
        .withColumn("visible_anomalies", F.coalesce("visible_anomalies", F.lit(0)))
    )


def reading_history(scored: DataFrame, sensor_id: str, start, end, limit: int | None = None) -> DataFrame:
    """Readings of one sensor in a closed range, oldest first.

    A limit is part of the request; its rows then say in ``truncated`` whether more were found.
    """
    rows = scored.where((F.col("sensor_id") == sensor_id) & F.col("ts").between(F.lit(start), F.lit(end))).orderBy("ts")
    if limit is None:
        return rows
    some = rows.limit(limit + 1)
    return some.limit(limit).join(some.agg((F.count("*") > limit).alias("truncated")), how="cross").orderBy("ts")


def reading_columns(cells: DataFrame, axis: TimeAxis, first: int, last: int) -> DataFrame:
    """Per sensor the values of steps first..last in order (null where empty) and the positions of flagged steps.

    ``cells`` is the gridded readings with ``flagged``; a group is one axis range long.
    """
    steps = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))
    inside = cells.where(F.col("cell").between(first, last))
    by_cell = F.map_from_entries(F.collect_list(F.struct("cell", F.struct("value", "flagged"))))
    rows = inside.groupBy("sensor_id").agg(by_cell.alias("m"))
    return rows.select(
        "sensor_id",
        F.transform(steps, lambda s: F.try_element_at(F.col("m"), s)["value"]).alias("values"),
        F.transform(
            F.filter(steps, lambda s: F.coalesce(F.try_element_at(F.col("m"), s)["flagged"], F.lit(False))),
            lambda s: s - first,
        ).alias("flagged_positions"),
    )


def health_range(health: DataFrame, first: int, last: int) -> DataFrame:
    """Per asset the scores and status characters of steps first..last; a missing step is null and ``-``."""
    from ..params import ASSET_STATUS_CHARS

    steps = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))
    entry = F.struct("step", F.struct("health_score", rules.status_chars(ASSET_STATUS_CHARS, F.col("status")).alias("c")))
    rows = health.where(F.col("step").between(first, last)).groupBy("asset_id").agg(
        F.map_from_entries(F.collect_list(entry)).alias("m")
    )
    return rows.select(
        "asset_id",
        F.transform(steps, lambda s: F.try_element_at(F.col("m"), s)["health_score"]).alias("health"),
        F.array_join(F.transform(steps, lambda s: F.coalesce(F.try_element_at(F.col("m"), s)["c"], F.lit("-"))), "").alias("status"),
    )


def sensor_head(sensors: DataFrame, thresholds: DataFrame, baselines: DataFrame) -> DataFrame:
    """Sensors with their limits and the scale, floor and domain the latest run recorded for them."""
    limits = thresholds.drop("unit")
    return sensors.join(limits, ["sensor_type", "placement"]).join(baselines, "sensor_id", "left")


def head_from_params(sensors: DataFrame, params_json: str) -> DataFrame:
    """The same baseline columns taken from the run's parameter JSON column by path."""
    found = F.from_json(
        F.expr(f"get_json_object({params_json}, concat('$.sensor_baselines.', sensor_id))"),
        "scale double, floor double, domain string",
    )
    return sensors.withColumn("_b", found).select("*", "_b.*").drop("_b")


def recent(anomalies: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """Newest ``n`` anomalies per key (all without ``n``), as an ordered array of records.

    ``n`` is part of the request. Ranking per (key, day) first keeps a key with very many anomalies from being sorted
    by one task: only n rows per key and day reach the final ranking.
    """
    order = [F.desc("started_at"), F.asc("anomaly_id")]
    if n is None:
        record = F.struct((-F.unix_micros("started_at")).alias("_r"), "anomaly_id", "severity", "started_at", "ended_at")
        return anomalies.groupBy(key).agg(F.array_sort(F.collect_list(record)).alias("_l")).select(
            key, F.transform("_l", lambda e: e.dropFields("_r")).alias("recent_anomalies")
        )
    daily = W.partitionBy(key, F.to_date("started_at")).orderBy(*order)
    few = anomalies.withColumn("_r", F.row_number().over(daily)).where(F.col("_r") <= n)
    final = W.partitionBy(key).orderBy(*order)
    top = few.withColumn("_r", F.row_number().over(final)).where(F.col("_r") <= n)
    record = F.struct("_r", "anomaly_id", "severity", "started_at", "ended_at")
    return top.groupBy(key).agg(F.array_sort(F.collect_list(record)).alias("_l")).select(
        key, F.transform("_l", lambda e: e.dropFields("_r")).alias("recent_anomalies")
    )


def asset_detail(summary: DataFrame, sensors: DataFrame, anomalies: DataFrame, n: int = 10) -> DataFrame:
    """Assets with their sensors (by id) and their newest anomalies as nested arrays."""
    mounted = sensors.groupBy("asset_id").agg(
        F.array_sort(F.collect_list(F.struct("sensor_id", "sensor_type", "placement"))).alias("sensors")
    )
    return summary.join(mounted, "asset_id", "left").join(recent(anomalies, "asset_id", n), "asset_id", "left")


def anomaly_detail(anomalies: DataFrame, assets: DataFrame, clusters: DataFrame, radius_m: float) -> DataFrame:
    """Anomalies with the nearby assets (nearest first) and their cluster record, which is joined while the rows are narrow."""
    return with_nearby_assets(anomalies.join(clusters, "cluster_id", "left"), assets, radius_m)


def cluster_records(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """Clusters with the ordered ids of their anomalies, an empty array when there are none."""
    ids = members.groupBy("cluster_id").agg(F.array_sort(F.collect_list("anomaly_id")).alias("anomaly_ids"))
    return clusters.join(ids, "cluster_id", "left").withColumn(
        "anomaly_ids", F.coalesce("anomaly_ids", F.array().cast("array<string>"))
    )


def layer_in_box(df: DataFrame, box: tuple[float, float, float, float], polygon: bool = False) -> DataFrame:
    """Lines or polygons (coords) that meet a box, edges included: bounds first, then the exact segment test."""
    test = ring_in_box if polygon else line_in_box
    return df.where(test(F.col("coords"), box))


def labelled_list(events: DataFrame, is_anomaly: bool | None = None) -> DataFrame:
    rows = events if is_anomaly is None else events.where(F.col("is_anomaly") == is_anomaly)
    return rows.orderBy("started_at", "event_id")


def type_properties(assets: DataFrame, keys: dict[str, tuple[str, ...]], properties: str = "properties") -> DataFrame:
    """Properties map reduced to the fixed keys of the asset's type plus ``addr:*``; blanks become null."""
    chosen = F.array().cast("array<string>")
    for kind, names in keys.items():
        chosen = F.when(F.col("asset_type") == kind, F.array(*[F.lit(n) for n in names])).otherwise(chosen)
    kept = F.map_filter(properties, lambda k, v: F.array_contains(chosen, k) | k.startswith("addr:"))
    return assets.withColumn(properties, F.transform_values(kept, lambda k, v: F.nullif(F.trim(v), F.lit(""))))


def provenance(assets: DataFrame, sources: DataFrame) -> DataFrame:
    """Source titles of every asset in the order of its ids; unknown ids are left out."""
    ids = assets.select("asset_id", F.posexplode("source_ids").alias("pos", "source_id"))
    found = ids.join(sources.select("source_id", "title"), "source_id")
    return found.groupBy("asset_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "title"))), lambda e: e["title"]).alias("sources")
    )


def rounded_output(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    return df.withColumns({c: shown(kind, F.col(c)) for c, kind in kinds.items()})

