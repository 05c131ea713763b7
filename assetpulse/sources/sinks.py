"""Writers: appends with counts, replaced runs, scores, health, sparse risk, GeoJSON lines, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..functions.rounding import round_even
from ..params import MIN_STORED_RISK


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> int:
    """Append rows and return how many; the count is observed while writing, not by a second pass."""
    seen = Observation()
    writer = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return int(seen.get["n"])


def replace_run(df: DataFrame, path: str, run_id: int) -> int:
    """Replace the rows of a run (column ``run_id``), also by none, leave other runs alone, and return how many were written.

    The run's partition goes first, so a rerun that finds nothing leaves nothing. ``df`` must not read from ``path``.
    """
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run_id={run_id}")
    old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    return append(df.where(F.col("run_id") == run_id), path, ("run_id",))


def clear_runs(paths: list[str], df: DataFrame) -> None:
    """Empty a run's tables: overwrite each path with no rows of its own schema."""
    for path in paths:
        spark = df.sparkSession
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def score_rows(scores: DataFrame, run_id: int) -> DataFrame:
    """Stored precision of the reading scores; NaN becomes null."""
    def stored(name: str, digits: int) -> Column:
        c = F.col(name) if name in scores.columns else F.lit(None).cast("double")
        return F.when(~F.isnan(c), round_even(c, digits)).alias(name)

    return scores.select(
        "sensor_id", "ts", F.lit(run_id).alias("run_id"),
        stored("expected", 4), stored("expected_low", 4), stored("expected_high", 4), stored("z", 3), stored("forest_score", 4),
        F.col("flagged"),
    )


def anomaly_rows(events: DataFrame, sensors: DataFrame, run_id: int) -> DataFrame:
    """Anomalies with the asset and the point of their sensor."""
    own = sensors.select("sensor_id", "asset_id", "lon", "lat")
    return events.drop("asset_id", "lon", "lat").join(own, "sensor_id").withColumn("run_id", F.lit(run_id))


def write_health(health: DataFrame, path: str, run_id: int) -> int:
    rows = health.withColumn("run_id", F.lit(run_id)).withColumn("day", F.to_date("as_of"))
    return append(rows, path, ("run_id", "day"))


def risk_rows(risk: DataFrame, run_id: int) -> DataFrame:
    return risk.where(F.col("risk_score") >= MIN_STORED_RISK).withColumn("run_id", F.lit(run_id))


def run_record(params_json: str, spark, run_id: int, axis, n_readings: int, n_anomalies: int) -> DataFrame:
    """One row of run lineage."""
    return spark.createDataFrame(
        [(run_id, axis.at_us(0), axis.at_us(axis.last), params_json, n_readings, n_anomalies)],
        "run_id int, window_start_us bigint, window_end_us bigint, params string, n_readings bigint, n_anomalies bigint",
    )


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))


def line_geometry(coords: Column) -> Column:
    return F.struct(
        F.lit("LineString").alias("type"), F.transform(coords, lambda p: F.array(p["lon"], p["lat"])).alias("coordinates")
    )


def feature_lines(df: DataFrame, id_column: str, geometry: Column, properties: list[str], extra: list[str] | None = None) -> DataFrame:
    """One GeoJSON Feature per row as text (``value``), with optional extra members."""
    members = [F.lit("Feature").alias("type"), F.col(id_column).alias("id"), geometry.alias("geometry"),
               F.struct(*properties).alias("properties"), *[F.col(c) for c in (extra or [])]]
    return df.select(F.to_json(F.struct(*members), {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(features: DataFrame, path: str) -> None:
    """Newline-delimited features, one file per partition: nothing is gathered into a single document."""
    features.write.mode("overwrite").text(path)
