"""Constraint audits, reconciliation, gates, parity and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import haversine
from ..functions.text import causal_words


class InputMissing(RuntimeError):
    """A stage was started without its inputs."""


def require_rows(tables: dict[str, DataFrame]) -> None:
    """Every named table must hold a row; only one row of each is looked for."""
    for name, df in tables.items():
        if df.isEmpty():
            raise InputMissing(f"no {name}: run the stage that produces them first")


def check_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of row conditions; null counts as satisfied, as with a table constraint. One scan."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
    return counts.select(F.explode(pairs).alias("r")).select("r.*")


def key_violations(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Number of key values that occur more than once."""
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("violations"))
    return n.select(F.lit(rule).alias("rule"), "violations")


def reference_violations(df: DataFrame, parent: DataFrame, on: list[str], rule: str) -> DataFrame:
    """Rows whose reference has no parent (null references are allowed)."""
    present = df
    for column in on:
        present = present.where(F.col(column).isNotNull())
    missing = present.join(parent.select(*on).distinct(), on, "left_anti")
    return missing.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def anomaly_rules() -> dict[str, Column]:
    return {
        "score_range": F.col("anomaly_score").between(0, 1),
        "severity_known": F.col("severity").isin("low", "medium", "high", "critical"),
        "interval_order": (F.col("started_at") <= F.col("peak_at")) & (F.col("peak_at") <= F.col("ended_at")),
        "status_known": F.col("status").isin("active", "resolved"),
    }


def health_rules() -> dict[str, Column]:
    return {
        "score_range": F.col("health_score").between(0, 100),
        "status_known": F.col("status").isin("normal", "watch", "at_risk", "critical"),
    }


def audit(df: DataFrame, rules: dict[str, Column], *others: DataFrame) -> DataFrame:
    out = check_rules(df, rules)
    for other in others:
        out = out.unionByName(other)
    return out


def split_geometry(df: DataFrame, wanted: tuple[str, ...], parents: DataFrame | None = None, parent_key: str = "") -> DataFrame:
    """Adds ``skip_reason`` for rows with a geometry (struct type, coords) of the wrong kind, empty or invalid,
    or without a parent; null means the row is kept."""
    from ..functions.geometry import polygon_area_m2

    kind, coords = F.col("geom.type"), F.col("geom.coords")
    reason = (
        F.when(F.col("geom").isNull() | (F.coalesce(F.size(coords), F.lit(0)) == 0), "empty")
        .when(~kind.isin(*wanted), "wrong_type")
        .when((kind == "LineString") & (F.size(coords) < 2), "invalid")
        .when((kind == "Polygon") & ((F.size(coords) < 4) | (polygon_area_m2(coords) == 0)), "invalid")
    )
    out = df.withColumn("skip_reason", reason)
    if parents is None:
        return out
    known = parents.select(parent_key).distinct().withColumn("_known", F.lit(True))
    return out.join(known, parent_key, "left").withColumn(
        "skip_reason",
        F.coalesce("skip_reason", F.when(F.col(parent_key).isNotNull() & F.col("_known").isNull(), "missing_parent")),
    ).drop("_known")


def reconcile(existing: DataFrame, incoming: DataFrame, key: str, keep: DataFrame) -> DataFrame:
    """Rows of both tables with what happens to them: removed (key not in the keep list), updated, added, kept."""
    e = existing.select(key).withColumn("_e", F.lit(True))
    i = incoming.select(key).withColumn("_i", F.lit(True))
    k = keep.select(key).distinct().withColumn("_k", F.lit(True))
    joined = e.join(i, key, "full_outer").join(k, key, "left")
    action = (
        F.when(F.col("_i").isNotNull() & F.col("_e").isNotNull(), "updated")
        .when(F.col("_i").isNotNull(), "added")
        .when(F.col("_k").isNull(), "removed")
        .otherwise("kept")
    )
    return joined.select(key, action.alias("action"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """Existing rows without a newcomer plus all newcomers."""
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def unregistered_provenance(rows: DataFrame, source_column: str, sources: DataFrame) -> DataFrame:
    """Rows that name a source the catalogue does not hold."""
    known = sources.select(F.col("source_id").alias(source_column)).distinct()
    return rows.where(F.col(source_column).isNotNull()).join(known, source_column, "left_anti")


def coordinate_check(lon: Column, lat: Column, recorded_lon: Column, recorded_lat: Column, limit_m: float = 500.0) -> Column:
    """``unverified`` without recorded coordinates, ``mismatch`` beyond the limit (at 0.1 m), else ``ok``."""
    d = F.rint(haversine(lon, lat, recorded_lon, recorded_lat) * 10) / 10
    return F.when(recorded_lon.isNull() | recorded_lat.isNull(), "unverified").when(d > limit_m, "mismatch").otherwise("ok")


def causal_texts(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text makes a causal or safety claim, with the words found."""
    return df.withColumn("words", causal_words(F.col(column))).where(F.size("words") > 0)


def parity(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row: rows compared, rows missing on either side, rows that differ (null-safe)."""
    left = a.select(*keys, F.struct(*columns).alias("_a"))
    right = b.select(*keys, F.struct(*columns).alias("_b"))
    both = left.join(right, keys, "full_outer")
    return both.agg(
        F.count("*").alias("compared"),
        F.count_if(F.col("_a").isNull() | F.col("_b").isNull()).alias("missing"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("different"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash: row count and the sum of row hashes."""
    return df.agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("hash"),
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n) of every named table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n") for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing_columns(df: DataFrame, needed: list[str]) -> list[str]:
    """Schema drift: names the data does not have."""
    return [name for name in needed if name not in df.columns]
