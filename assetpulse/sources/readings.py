"""Readers of readings, payloads, map layers, inventories, heights and catalogues."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..params import DEFAULT_THRESHOLDS, UNITS
from ..session import fixed_table, use_utc

READINGS = "sensor_id string, ts timestamp, value double, unit string, status string, source string"
SOURCES: dict[str, Callable[..., DataFrame]] = {}


def register_source(name: str):
    """Decorator: makes a reader available by name."""

    def keep(factory):
        SOURCES[name] = factory
        return factory

    return keep


def open_source(name: str, spark: SparkSession, **options) -> DataFrame:
    if name not in SOURCES:
        raise ValueError(f"unknown sensor source {name!r}; known: {', '.join(sorted(SOURCES))}")
    return SOURCES[name](use_utc(spark), **options)


def between(df: DataFrame, start: datetime, end: datetime, ts: str = "ts") -> DataFrame:
    """Rows with start <= ts <= end; the bounds carry an offset. The literals take the stored column's type, so the
    predicate reaches the files whether times are stored with or without a zone."""
    for bound in (start, end):
        if bound.tzinfo is None:
            raise ValueError("the bounds of a read need a UTC offset")
    if end < start:
        raise ValueError("the end of a read lies before its start")
    kind = df.schema[ts].dataType.simpleString()
    low, high = (F.lit(b.astimezone(timezone.utc).replace(tzinfo=None).isoformat(" ")).cast(kind) for b in (start, end))
    return df.where(F.col(ts).between(low, high))


@register_source("parquet")
def read_readings(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if start is None or end is None else between(df, start, end)


@register_source("table")
def read_table(spark: SparkSession, name: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    df = spark.read.table(name)
    return df if start is None or end is None else between(df, start, end)


ENTRY = "sensor_id variant, ts variant, value variant, unit variant"


def _text(v: Column) -> Column:
    """The text of a JSON string; null for any other JSON value."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _number(v: Column) -> Column:
    """The value of a JSON number; null for text, booleans and the rest."""
    kind = F.schema_of_variant(v)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def parse_payloads(payloads: DataFrame, column: str = "body", keys: tuple[str, ...] = ()) -> DataFrame:
    """Readings of JSON payloads: an object with ``readings`` or a bare array of objects.

    Structural faults (not JSON, no array, an entry that is no object or lacks a field) give ``fault``; everything
    else is handed on to validation: sensor_id, ts text, value double, unit and seq (position in the payload).
    """
    body = F.try_parse_json(column)
    kind = F.schema_of_variant("_v")
    entries = F.coalesce(F.try_variant_get("_v", "$.readings", "array<variant>"), F.try_variant_get("_v", "$", "array<variant>"))
    parsed = payloads.withColumn("_v", body).withColumn("_kind", kind).withColumn("_a", entries)
    whole = F.when(F.col("_v").isNull(), "not_json").when(F.col("_a").isNull(), "no_readings_array")
    rows = parsed.withColumn("_whole", whole).select(
        *keys, "_whole", F.posexplode_outer("_a").alias("seq", "_e")
    )
    is_object = F.coalesce(F.schema_of_variant("_e").startswith("OBJECT"), F.lit(False))

    def at(name: str) -> Column:
        return F.try_variant_get("_e", f"$.{name}", "variant")

    missing = at("sensor_id").isNull() | at("ts").isNull() | at("value").isNull()
    fault = F.coalesce(
        "_whole", F.when(F.col("_e").isNotNull(), F.when(~is_object, "not_an_object").when(missing, "missing_field"))
    )
    return rows.withColumn("fault", fault).where(F.col("_whole").isNotNull() | F.col("_e").isNotNull()).select(
        *keys, F.col("seq").cast("bigint").alias("seq"), "fault",
        F.when(F.col("fault").isNull(), _text(at("sensor_id"))).alias("sensor_id"),
        F.when(F.col("fault").isNull(), _text(at("ts"))).alias("ts"),
        F.when(F.col("fault").isNull(), _number(at("value"))).alias("value"),
        F.when(F.col("fault").isNull(), _text(at("unit"))).alias("unit"),
    )


def default_units(parsed: DataFrame, sensors: DataFrame) -> DataFrame:
    """A missing unit takes the sensor's registered one."""
    known = sensors.select("sensor_id", F.col("unit").alias("_u"))
    return parsed.join(known, "sensor_id", "left").withColumn("unit", F.coalesce("unit", "_u")).drop("_u")


@register_source("payload")
def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Payload files, one JSON document each."""
    files = spark.read.option("wholetext", True).text(path).select(F.col("value").alias("body"))
    return parse_payloads(files)


# --- map layers ----------------------------------------------------------------------------------------------------------------
POINT = "struct<lon:double,lat:double>"
ELEMENT = (
    "elements array<struct<type:string,id:bigint,nodes:array<bigint>,geometry:array<struct<lat:double,lon:double>>,"
    "lat:double,lon:double,tags:map<string,string>>>"
)


def read_elements(spark: SparkSession, path: str) -> DataFrame:
    """Ways with geometry and nodes with a position from map JSON; ``pos`` is the order in the files."""
    raw = spark.read.schema(ELEMENT).option("multiLine", True).json(path)
    rows = raw.select(F.posexplode("elements").alias("pos", "e")).select("pos", "e.*")
    coords = F.transform(F.array_compact("geometry"), lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat")))
    usable = ((F.col("type") == "way") & (F.size("geometry") > 0)) | (
        (F.col("type") == "node") & F.col("lon").isNotNull() & F.col("lat").isNotNull()
    )
    return rows.where(usable & F.col("id").isNotNull()).select(
        "type", "id", "pos", "nodes", coords.alias("coords"), "lon", "lat",
        F.coalesce("tags", F.create_map().cast("map<string,string>")).alias("tags"),
    )


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """(attributes map, lon, lat) of ArcGIS features."""
    schema = "features array<struct<attributes:map<string,string>,geometry:struct<x:double,y:double>>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select(
        "f.attributes", F.col("f.geometry.x").alias("lon"), F.col("f.geometry.y").alias("lat")
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """(id, type, geometry JSON, properties JSON) of GeoJSON feature collections."""
    schema = "features array<struct<id:string,type:string,geometry:variant,properties:variant>>"
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    return raw.select(F.explode("features").alias("f")).select(
        "f.id",
        F.try_variant_get("f.geometry", "$.type", "string").alias("geom_type"),
        F.to_json("f.geometry").alias("geometry"),
        F.col("f.properties").alias("properties"),
    )


def line_coords(geometry: Column) -> Column:
    """Coordinates of a LineString geometry JSON."""
    pairs = F.from_json(F.get_json_object(geometry, "$.coordinates"), "array<array<double>>")
    return F.transform(pairs, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))


def as_multipolygon(features: DataFrame, digits: int = 7) -> DataFrame:
    """Polygon or MultiPolygon features as array of polygons of rings, rounded, without consecutive repeats."""
    from ..functions.geometry import round_coords

    text = F.get_json_object("geometry", "$.coordinates")
    polygons = F.when(
        F.col("geom_type") == "Polygon", F.array(F.from_json(text, "array<array<array<double>>>"))
    ).when(F.col("geom_type") == "MultiPolygon", F.from_json(text, "array<array<array<array<double>>>>"))
    rounded = F.transform(
        polygons,
        lambda poly: F.transform(
            poly,
            lambda ring: round_coords(
                F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))), digits
            ),
        ),
    )
    return features.where(F.col("geom_type").isin("Polygon", "MultiPolygon")).withColumn("polygons", rounded)


def read_heights(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(usable heights (osm_id, height_m), one-row report with the number ignored).

    A file without the two columns is an error; unreadable, out-of-range and repeated rows are left out, first wins.
    """
    df = spark.read.option("header", True).csv(path)
    lacking = [c for c in ("osm_id", "height_m") if c not in df.columns]
    if lacking:
        raise ValueError(f"missing column(s) {', '.join(lacking)} in the header")
    return usable_heights(df.withColumn("pos", F.monotonically_increasing_id()))


def usable_heights(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    from ..functions.tags import MEASURED_RANGE_M

    typed = df.select(
        F.trim(F.col("osm_id").cast("string")).try_cast("bigint").alias("osm_id"),
        F.trim(F.col("height_m").cast("string")).try_cast("double").alias("height_m"),
        "pos",
    )
    good = typed.where(F.col("osm_id").isNotNull() & F.col("height_m").between(*MEASURED_RANGE_M))
    first = good.groupBy("osm_id").agg(F.min_by("height_m", "pos").alias("height_m"))
    report = df.agg(F.count("*").alias("_all")).crossJoin(first.agg(F.count("*").alias("used"))).select(
        "used", (F.col("_all") - F.col("used")).alias("ignored")
    )
    return first, report


def threshold_table(spark: SparkSession) -> DataFrame:
    """The eleven default limits with their units."""
    rows = [(t, p, UNITS[t], wl, wh, cl, ch) for t, p, wl, wh, cl, ch in DEFAULT_THRESHOLDS]
    schema = "sensor_type string, placement string, unit string, warn_low double, warn_high double, crit_low double, crit_high double"
    return fixed_table(spark, rows, schema)


def source_catalogue(catalogue: DataFrame, facts: DataFrame) -> DataFrame:
    """Catalogue entries (source_id, title, optional, ...) with their recorded facts; optional ones only when present."""
    joined = catalogue.join(facts.withColumn("_present", F.lit(True)), "source_id", "left")
    return joined.where(~F.col("optional") | F.col("_present").isNotNull()).drop("_present")


def series_per_sensor(readings: DataFrame) -> DataFrame:
    """Ordered (ts, value) arrays per sensor and day; a day bounds the group, a whole history would not."""
    return readings.groupBy("sensor_id", F.to_date("ts").alias("day")).agg(
        F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("series")
    )
