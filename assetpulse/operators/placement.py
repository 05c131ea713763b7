"""Choice of monitoring sites: showcase buildings, candidate pools, class tiers and spread samples.

The number of sites is a parameter of the rules (tens), so loops run once per site; each round is one aggregate over
the candidates and brings back one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.geometry import haversine
from ..functions.tags import civic, road_rank
from ..session import materialize

# --- fixed values: (sensor_type, placement, host asset type, cap) in rule order ------------------------------------------------
RULES = (
    ("vibration", "bridge_deck", "bridge", None),
    ("vibration", "building_structure", "building", 22),
    ("vibration", "road_pavement", "road", 8),
    ("moisture", "road_subgrade", "road", 22),
    ("moisture", "foundation_perimeter", "building", 8),
    ("moisture", "abutment_backfill", "bridge", None),
    ("temperature", "bridge_deck", "bridge", None),
    ("temperature", "road_surface", "road", 12),
    ("temperature", "building_envelope", "building", 12),
    ("temperature", "equipment", "power", None),
    ("pressure", "water_main", "water_main", None),
)
SENSOR_PREFIXES = {"temperature": "TMP", "vibration": "VIB", "moisture": "MST", "pressure": "PRS"}
LONG_STRUCTURE_M = 100.0
MIN_HOST_ROAD_M = 40.0
POOL_FACTOR = 4
SHOWCASE = 3
# --- end of fixed values -----------------------------------------------------------------------------------------------------------


def attribute(name: str) -> Column:
    return F.try_element_at(F.col("attributes"), F.lit(name))


def classified(assets: DataFrame) -> DataFrame:
    """Assets with is_culvert, is_substation, is_civic, class_rank, length_m and footprint_m2."""
    kind = F.col("asset_type")
    return assets.select(
        "*",
        ((kind == "bridge") & attribute("structure_kind").eqNullSafe("culvert")).alias("is_culvert"),
        ((kind == "power") & attribute("power").eqNullSafe("substation")).alias("is_substation"),
        civic(kind, F.col("name"), F.col("attributes")).alias("is_civic"),
        F.when(kind == "road", road_rank(F.coalesce(attribute("highway_class"), F.lit("")))).alias("class_rank"),
        F.coalesce(attribute("length_m").try_cast("double"), F.lit(0.0)).alias("length_m"),
        F.coalesce(attribute("footprint_m2").try_cast("double"), F.lit(0.0)).alias("footprint_m2"),
    )


def showcase(buildings: DataFrame, limit: int = SHOWCASE) -> DataFrame:
    """Largest civic footprints first, then the largest others; one per name (a top-k report)."""
    named = F.lower(F.trim(F.coalesce("name", "asset_id")))
    best = F.struct((~F.col("is_civic")).alias("a"), (-F.col("footprint_m2")).alias("b"), F.col("asset_id").alias("c"))
    chosen = buildings.withColumn("_o", best).groupBy(named.alias("_name")).agg(
        F.min_by(F.struct(*buildings.columns), "_o").alias("r"), F.min("_o").alias("_o")
    )
    return chosen.orderBy("_o").limit(limit).select("r.*")


def unused(assets: DataFrame, taken: DataFrame | None, needed: int) -> DataFrame:
    """Assets that host nothing yet, or all of them when fewer than ``needed`` are free."""
    if taken is None:
        return assets
    free = assets.join(taken.select("asset_id").distinct(), "asset_id", "left_anti")
    return free if free.limit(needed).count() >= needed else assets


def building_pool(buildings: DataFrame, cap: int, taken: DataFrame | None) -> DataFrame:
    """The ``cap x 4`` largest footprints that are free: the pool is a top-k by rule."""
    return unused(buildings, taken, cap).orderBy(F.desc("footprint_m2"), "asset_id").limit(cap * POOL_FACTOR)


def road_pool(roads: DataFrame, cap: int, taken: DataFrame | None) -> DataFrame:
    """Free road segments long enough to carry a site; the length is waived when too few are."""
    long_enough = roads.where(F.col("length_m") >= MIN_HOST_ROAD_M)
    pool = long_enough if long_enough.limit(cap).count() >= cap else roads
    return unused(pool, taken, cap)


def spread_sample(pool: DataFrame, n: int, fixed: list[Row] | None = None, seed: int = 42) -> list[Row]:
    """Greedy farthest-point sample of (asset_id, lon, lat): fixed sites first, ties go to the lowest id.

    Each round is one pass: the distance to the chosen sites is an expression over their coordinates (as many as
    sites chosen), the farthest candidate is one aggregated row. Without fixed sites the first is the smallest seeded hash.
    """
    chosen = list(fixed or [])[: max(n, 0)]
    rows = materialize(pool.select("asset_id", "lon", "lat"), "spread-pool")
    if chosen:
        rows = rows.where(~F.col("asset_id").isin([r.asset_id for r in chosen]))
    while len(chosen) < n:
        candidates = rows.where(~F.col("asset_id").isin([r.asset_id for r in chosen])) if chosen else rows
        if chosen:
            distance = F.least(
                *[haversine(F.col("lon"), F.col("lat"), F.lit(r.lon), F.lit(r.lat)) for r in chosen], F.lit(float("inf"))
            )
        else:
            distance = -F.pmod(F.xxhash64("asset_id", F.lit(seed)), F.lit(1 << 52)).cast("double")
        # largest distance, then lowest id: smallest of (-distance, id)
        best = F.min(F.struct((-distance).alias("d"), F.col("asset_id"), F.col("lon"), F.col("lat"))).alias("b")
        row = candidates.agg(best).first().b
        if row is None:
            break
        chosen.append(Row(asset_id=row.asset_id, lon=row.lon, lat=row.lat))
    return chosen


def highest_class_first(roads: DataFrame, cap: int, seed: int = 42) -> list[Row]:
    """Fill the cap class by class from the most important one down, spread within the class that does not fit."""
    ranks = [r.class_rank for r in roads.select("class_rank").distinct().orderBy(F.desc("class_rank")).collect()]
    chosen: list[Row] = []  # the classes are a dozen at most
    for rank in ranks:
        if len(chosen) >= cap:
            break
        chosen = spread_sample(roads.where(F.col("class_rank") == rank), cap, chosen, seed)
    return chosen[:cap]


def select_hosts(assets: DataFrame, seed: int = 42) -> DataFrame:
    """(sensor_type, placement, asset_id, n): the hosts of every placement rule.

    Apart from showcase buildings, a building or road serves one rule as long as free ones remain.
    """
    spark = assets.sparkSession
    rows = materialize(classified(assets), "classified")
    by_type = {kind: rows.where(F.col("asset_type") == kind) for kind in ("building", "road", "bridge", "power", "water_main")}
    first = [Row(asset_id=r.asset_id, lon=r.lon, lat=r.lat) for r in showcase(by_type["building"]).collect()]  # SHOWCASE rows
    taken: DataFrame | None = None
    out: DataFrame | None = None
    decks = F.when(~F.col("is_culvert") & (F.col("length_m") >= LONG_STRUCTURE_M), 2).otherwise(1)
    for sensor_type, placement, host, cap in RULES:
        pool = by_type[host]
        if cap is None:
            if placement == "bridge_deck":
                if sensor_type == "temperature":
                    pool = pool.where(~F.col("is_culvert"))
                hosts = pool.select("asset_id", decks.alias("n"))
            else:
                if placement == "equipment":
                    pool = pool.where("is_substation")
                hosts = pool.select("asset_id", F.lit(1).alias("n"))
        else:
            if host == "building":
                picked = spread_sample(building_pool(pool, cap, taken), cap, first[:cap], seed)
            elif placement == "road_pavement":
                picked = highest_class_first(road_pool(pool, cap, taken), cap, seed)
            else:
                picked = spread_sample(road_pool(pool, cap, taken), cap, None, seed)
            hosts = spark.createDataFrame([(r.asset_id, 1) for r in picked], "asset_id string, n int")
            taken = hosts if taken is None else taken.unionByName(hosts)
        block = hosts.select(F.lit(sensor_type).alias("sensor_type"), F.lit(placement).alias("placement"), "asset_id", "n")
        out = block if out is None else out.unionByName(block)
    return out


def number_sensors(hosts: DataFrame) -> DataFrame:
    """Sensor ids per type in rule and asset order, one row per site on a host."""
    from ..session import number_rows

    order, prefix = F.lit(None).cast("int"), F.lit(None).cast("string")
    for i, (sensor_type, placement, _, _) in enumerate(RULES):
        order = F.when((F.col("sensor_type") == sensor_type) & (F.col("placement") == placement), i).otherwise(order)
    for kind, text in SENSOR_PREFIXES.items():
        prefix = F.when(F.col("sensor_type") == kind, text).otherwise(prefix)
    sites = hosts.withColumn("site", F.explode(F.sequence(F.lit(1), "n"))).withColumn("_o", order)
    placed = number_rows(sites, ["sensor_type", "_o", "asset_id", "site"], "_n", "sites")
    first = placed.groupBy("sensor_type").agg(F.min("_n").alias("_first"))  # one row per sensor type
    return placed.join(F.broadcast(first), "sensor_type").select(
        F.format_string("%s-%03d", prefix, F.col("_n") - F.col("_first") + 1).alias("sensor_id"),
        "sensor_type", "placement", "asset_id", "site",
    )
