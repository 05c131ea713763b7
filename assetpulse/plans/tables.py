"""How the star-schema tables stand in for a sensor network. Every view covers its whole source table."""

from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.geometry import utm_xy
from ..functions.timeaxis import TimeAxis
from ..params import Params
from ..session import fixed_table, use_utc

# Readings arrive about every 11 hours per sensor, so the grid step is 12 h and hour-based windows scale with it.
STEP_S = 43200
PARAMS = replace(
    Params(),
    step_s=STEP_S,
    rolling_hours=72.0,
    merge_gap_hours=24.0,
    short_hours=36.0,
    long_hours=144.0,
    health_reading_hours=72.0,
)
TYPES = ("temperature", "vibration", "moisture", "pressure")
PLACEMENTS = ("inner", "outer")
UNITS = ("°C", "mm/s", "%", "psi")
ASSET_TYPES = ("building", "road", "bridge", "power", "street_light")
CATEGORIES = ("Buildings", "Transportation", "Transportation", "Utilities", "Utilities")
WEST, SOUTH, WIDTH, HEIGHT = -100.03, 37.745, 0.025, 0.017
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
CENTRAL_MERIDIAN = -99.0  # UTM zone 14
BBOX = (-100.025, 37.750, -100.010, 37.758)
CENTRE = (-100.0175, 37.7535)


def pick(names: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in names]), (index + 1).cast("int"))


def code(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 7, "0"))


def lon_of(key: Column) -> Column:
    return F.lit(WEST) + F.pmod(key * 7919, F.lit(10007)) / 10007.0 * WIDTH


def lat_of(key: Column) -> Column:
    return F.lit(SOUTH) + F.pmod(key * 104729, F.lit(10009)) / 10009.0 * HEIGHT


class Plant:
    """The sensor-network views of one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = use_utc(spark)
        self.sf_dir = sf_dir
        self.params = PARAMS

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        """Events with their zone-less times read as UTC timestamps: no cast, so time filters reach the files."""
        return self.spark.read.schema(EVENTS).parquet(f"{self.sf_dir}/events.parquet")

    @cached_property
    def readings(self) -> DataFrame:
        return self.events.select(code("S", F.col("user_id")).alias("sensor_id"), "ts", "value")

    @cached_property
    def axis(self) -> TimeAxis:
        return TimeAxis.of(self.readings, STEP_S)

    @cached_property
    def sensors(self) -> DataFrame:
        n = F.col("user_id")
        asset = F.floor(n / 3)
        kind = F.pmod(n, F.lit(4))
        return self.events.groupBy("user_id").agg(F.count("*").alias("_n")).select(
            code("S", n).alias("sensor_id"),
            code("A", asset).alias("asset_id"),
            pick(TYPES, kind).alias("sensor_type"),
            pick(PLACEMENTS, F.pmod(F.floor(n / 4), F.lit(2))).alias("placement"),
            pick(UNITS, kind).alias("unit"),
            (lon_of(asset) + (F.pmod(n, F.lit(7)) - 3) * 0.00005).alias("lon"),
            (lat_of(asset) + (F.pmod(n, F.lit(5)) - 2) * 0.00005).alias("lat"),
            F.lit(STEP_S).alias("sampling_interval_s"),
        )

    @cached_property
    def thresholds(self) -> DataFrame:
        rows = [
            (t, p, u, 2.0 if t == "pressure" else None, 150.0, 0.5 if t == "pressure" else None, 250.0)
            for t, u in zip(TYPES, UNITS)
            for p in PLACEMENTS
        ]
        return fixed_table(
            self.spark,
            rows,
            "sensor_type string, placement string, unit string, warn_low double, warn_high double, "
            "crit_low double, crit_high double",
        )

    @cached_property
    def assets(self) -> DataFrame:
        key = F.col("c_custkey")
        kind = F.pmod(F.col("c_nationkey"), F.lit(5))
        return self.table("customer").select(
            code("A", key).alias("asset_id"),
            pick(ASSET_TYPES, kind).alias("asset_type"),
            pick(CATEGORIES, kind).alias("category"),
            F.col("c_name").alias("name"),
            (F.pmod(F.col("c_nationkey"), F.lit(2)) == 0).alias("is_simulated"),
            lon_of(key).alias("lon"),
            lat_of(key).alias("lat"),
            key.alias("num"),
        )

    @cached_property
    def anomalies(self) -> DataFrame:
        """Intervals from the readings above the warning limit; the end lies 0 to 47 hours later."""
        value = F.col("value")
        severity = (
            F.when(value > 250, "critical").when(value > 210, "high").when(value > 180, "medium").otherwise("low")
        )
        rows = self.events.where(value > 150).select(
            code("N", F.col("event_id")).alias("anomaly_id"),
            code("S", F.col("user_id")).alias("sensor_id"),
            F.col("ts").alias("started_at"),
            F.timestamp_micros(
                F.unix_micros("ts") + F.pmod("event_id", F.lit(48)) * F.lit(3600000000)
            ).alias("ended_at"),
            severity.alias("severity"),
            (value / 500.0).alias("anomaly_score"),
            "value",
        )
        return rows.join(
            self.sensors.select("sensor_id", "asset_id", "sensor_type", "placement", "lon", "lat"), "sensor_id"
        )

    def planar(self, df: DataFrame) -> DataFrame:
        """Adds UTM x, y (zone of the area)."""
        return df.withColumn("_u", utm_xy(F.col("lon"), F.col("lat"), CENTRAL_MERIDIAN)).select("*", "_u.x", "_u.y").drop("_u")

    @cached_property
    def utm_box(self) -> tuple[float, float, float, float]:
        """Planar bounds of all assets (one aggregate)."""
        row = self.planar(self.assets).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
        return tuple(row)

    @cached_property
    def lines(self) -> DataFrame:
        """A three-vertex line for every asset, starting at its point."""
        n = F.col("num")

        def vertex(dx, dy):
            return F.struct((F.col("lon") + dx).alias("lon"), (F.col("lat") + dy).alias("lat"))

        zero = F.lit(0.0)
        return self.assets.withColumn(
            "coords",
            F.array(
                vertex(zero, zero),
                vertex((F.pmod(n, F.lit(11)) - 5) * 0.0002, (F.pmod(n, F.lit(13)) - 6) * 0.0002),
                vertex((F.pmod(n, F.lit(17)) - 8) * 0.0002, (F.pmod(n, F.lit(7)) - 3) * 0.0002),
            ),
        )

    @cached_property
    def labelled_events(self) -> DataFrame:
        """Ground truth: abnormal events carry a sensor, benign ones act on a sensor type (or on all of them)."""
        e, value, kind = self.events, F.col("value"), F.pmod("user_id", F.lit(4))
        abnormal = F.col("event_type") != "view"
        return e.where(value > 140).select(
            F.col("event_id"),
            F.concat(F.lit("label_"), "event_type").alias("event_type"),
            abnormal.alias("is_anomaly"),
            F.timestamp_micros(F.unix_micros("ts") - F.lit(2 * 3600000000)).alias("started_at"),
            F.timestamp_micros(F.unix_micros("ts") + F.lit(3 * 3600000000)).alias("ended_at"),
            F.when(abnormal, code("S", F.col("user_id"))).alias("sensor_id"),
            F.when(kind > 0, pick(TYPES, kind)).alias("sensor_type"),
        )


def published(df: DataFrame) -> DataFrame:
    """Timestamps as microseconds since the epoch and integers as bigint, so results compare across engines."""
    columns = []
    for field in df.schema.fields:
        kind = field.dataType.simpleString()
        if kind == "timestamp":
            columns.append(F.unix_micros(field.name).alias(field.name))
        elif kind in ("int", "smallint", "tinyint"):
            columns.append(F.col(field.name).cast("bigint").alias(field.name))
        else:
            columns.append(F.col(field.name))
    return df.select(columns)
