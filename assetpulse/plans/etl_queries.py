"""Registered queries of the registry ETL, matching, placement, zonal, payload and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tags as tg
from ..functions.rounding import round_even
from ..operators import gis, placement, proximity, zonal
from ..session import merged, scratch_dir, spread
from ..sources import readings as src
from ..sources import sinks
from ..streaming import jobs
from .catalog import plain_flags, plain_scores, query, raw_readings
from .tables import BBOX, EVENTS, Plant, code, lat_of, lon_of


@query
def line_clip(p: Plant) -> DataFrame:
    """All asset lines cut to the study box."""
    c = gis.clip_lines(spread(p.lines.select("asset_id", "coords")), BBOX)
    return c.where(F.col("clipped").isNotNull()).select(
        "asset_id", "parts", "length_m", "dropped_m", "was_clipped", F.size("clipped").alias("vertices")
    )


def way_rows(p: Plant) -> DataFrame:
    return spread(elements(p).where(F.col("type") == "way"))


def tag_map(**tags) -> Column:
    """Map of the tags that have a value."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in tags.items()])
    return F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull()))


def elements(p: Plant) -> DataFrame:
    """Map elements from the customers: one way per customer, one node per supplier, tags by nation key."""
    k = F.pmod(F.col("c_nationkey"), F.lit(8))
    n = F.col("num")
    both = merged(p.lines).join(p.table("customer").select(F.col("c_custkey").alias("num"), "c_nationkey", "c_name", "c_mktsegment"), "num")
    area = k.isin(0, 5)
    coords = F.when(area, F.concat("coords", F.slice("coords", 1, 1))).otherwise(F.col("coords"))
    name = F.when(n % 6 == 0, n.cast("string")).when(n % 7 == 0, " ").otherwise(F.col("c_name"))
    tags = tag_map(
        building=F.when(k == 0, "yes"),
        highway=F.when(k == 1, "residential").when(k == 2, "primary").when(k == 6, "proposed"),
        bridge=F.when(k == 2, "yes"),
        railway=F.when(k == 3, "rail"),
        power=F.when(k == 4, "line").when(k == 5, "substation"),
        leisure=F.when(k == 7, "park"),
        name=name,
        height=F.when(n % 5 == 0, F.concat((n % 40).cast("string"), F.lit(" ft"))),
        operator=F.col("c_mktsegment"),
    )
    last = F.when(n % 4 == 3, n + 2_000_000).otherwise(n + 1)
    ways = both.select(
        F.lit("way").alias("type"), n.alias("id"), F.lit(0).alias("pos"),
        F.when(area, F.array(n, n + 3_000_000, n + 4_000_000, n)).otherwise(F.array(n, n + 3_000_000, last)).alias("nodes"),
        coords.alias("coords"), F.lit(None).cast("double").alias("lon"), F.lit(None).cast("double").alias("lat"), tags.alias("tags"),
    )
    s = F.col("s_suppkey")
    lamp = F.when(F.pmod(F.col("s_nationkey"), F.lit(2)) == 0, F.create_map(F.lit("highway"), F.lit("street_lamp"))).otherwise(
        F.create_map(F.lit("power"), F.lit("substation"))
    )
    nodes = p.table("supplier").select(
        F.lit("node").alias("type"), s.alias("id"), F.lit(0).alias("pos"), F.lit(None).cast("array<bigint>").alias("nodes"),
        F.array().cast("array<struct<lon:double,lat:double>>").alias("coords"), lon_of(s + 17).alias("lon"),
        lat_of(s + 17).alias("lat"), lamp.alias("tags"),
    )
    return ways.unionByName(nodes)


@query
def layer_routing(p: Plant) -> DataFrame:
    a = gis.with_actions(way_rows(p), BBOX)
    return a.select("id", "layer", "action", "name")


@query
def layer_report(p: Plant) -> DataFrame:
    return gis.layer_report(gis.with_actions(way_rows(p), BBOX))


@query
def registry_build(p: Plant) -> DataFrame:
    r = gis.build_registry(elements(p), inventory_features(p), BBOX, 2024)
    return r.select("asset_id", "asset_type", "category", "name", "source_id", "geom_type", F.size("coords").alias("vertices"))


@query
def chain_merge(p: Plant) -> DataFrame:
    """Every customer line as a bridge way; runs of four share end nodes."""
    n = F.col("num")
    last = F.when(n % 4 == 3, n + 2_000_000).otherwise(n + 1)
    ways = p.lines.select(
        n.alias("id"), F.when(F.floor(n / 4) % 2 == 0, "highway:primary").otherwise("railway:rail").alias("bridge_class"),
        F.array(n, n + 3_000_000, last).alias("nodes"), "coords", F.col("name"),
    )
    c = gis.merge_chains(ways)
    ids = F.array_join(F.col("way_ids").cast("array<string>"), ",")
    return c.select(
        "chain_id", "bridge_class", ids.alias("way_ids"), F.size("coords").alias("vertices"), F.array_join("names", ";").alias("names")
    )


@query
def height_resolution(p: Plant) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size")
    s = size.cast("string")
    tag = (
        F.when(n % 6 == 0, s).when(n % 6 == 1, F.concat(s, F.lit(".5 m"))).when(n % 6 == 2, F.concat(s, F.lit("FT")))
        .when(n % 6 == 3, F.lit("tall")).when(n % 6 == 4, F.lit("0"))
    )
    levels = F.when(n % 4 == 0, (n % 9).cast("string")).when(n % 4 == 1, F.lit("many"))
    kind = F.when(n % 10 == 0, "House").when(n % 10 == 1, "shed").when(n % 10 == 2, "warehouse").when(n % 10 == 3, "storage_tank")
    tags = tag_map(**{"height": tag, "building:levels": levels, "building": kind})
    measured = F.when(n % 5 == 0, F.col("p_retailprice") / 30.0)
    h = tg.resolved_height(tags, F.col("p_retailprice"), measured)
    return p.table("part").withColumn("h", h).select("p_partkey", "h.height_m", "h.height_source")


@query
def tag_cleaning(p: Plant) -> DataFrame:
    n = F.col("p_partkey")
    name = F.when(n % 5 == 0, F.concat(F.lit("  "), "p_name", F.lit(" "))).when(n % 5 == 1, n.cast("string")).when(n % 5 == 2, "  ").otherwise(F.col("p_name"))
    lanes = F.when(n % 3 == 0, F.col("p_size").cast("string")).when(n % 3 == 1, F.concat(F.col("p_size").cast("string"), F.lit(";2")))
    oneway = F.when(n % 4 == 0, " Yes").when(n % 4 == 1, "no").when(n % 4 == 2, "-1").otherwise("reversible")
    return p.table("part").select(
        "p_partkey", tg.clean_name(name).alias("name"), tg.lanes(lanes).alias("lanes"), tg.oneway(oneway).alias("oneway"),
        tg.title_case(F.upper("p_name")).alias("title"),
    )


def inventory_features(p: Plant) -> DataFrame:
    """Inventory features from the parts: some coordinates are unusable, some disagree with the point."""
    n = F.col("p_partkey")
    lat = lat_of(n)
    lon = lon_of(n)
    minutes = F.floor((lat - 37) * 60)
    hundredths = F.floor(((lat - 37) * 60 - minutes) * 6000)
    wminutes = F.floor((-lon - 100) * 60)
    whundredths = F.floor(((-lon - 100) * 60 - wminutes) * 6000)
    lat16 = F.when(n % 17 == 0, "37755900").when(n % 19 == 0, "x").otherwise(
        F.concat(F.lit("37"), F.lpad(minutes.cast("string"), 2, "0"), F.lpad(hundredths.cast("string"), 4, "0"))
    )
    lon17 = F.concat(F.lit("100"), F.lpad(F.when(n % 23 == 0, 59).otherwise(wminutes).cast("string"), 2, "0"), F.lpad(whundredths.cast("string"), 4, "0"))
    attributes = F.create_map(
        F.lit("STRUCTURE_NUMBER_008"), F.when(n % 29 == 0, " ").otherwise(code("B", n)),
        F.lit("LAT_016"), lat16,
        F.lit("LONG_017"), lon17,
        F.lit("FACILITY_CARRIED_007"), F.upper("p_name"),
        F.lit("FEATURES_DESC_006A"), F.when(n % 3 == 0, F.upper("p_type")),
        F.lit("DATE_OF_INSPECT_090"), F.concat((n % 14).cast("string"), F.lpad((n % 100).cast("string"), 2, "0")),
        F.lit("YEAR_BUILT_027"), F.when(n % 7 == 0, "0").otherwise((n % 100 + 1900).cast("string")),
        F.lit("OWNER_022"), (n % 6).cast("string"),
        F.lit("BRIDGE_CONDITION"), F.element_at(F.array(F.lit("g"), F.lit("F"), F.lit("P"), F.lit("Z")), (n % 4 + 1).cast("int")),
        F.lit("CULVERT_COND_062"), F.when(n % 5 == 0, "7").otherwise("N"),
    )
    return p.table("part").select(attributes.alias("attributes"), lon.alias("lon"), lat.alias("lat"))


@query
def inventory_decode(p: Plant) -> DataFrame:
    d = gis.decode_inventory(inventory_features(p), 2024)
    return d.select(
        "structure_number", F.round("recorded_lon", 8).alias("recorded_lon"), F.round("recorded_lat", 8).alias("recorded_lat"),
        "location_check", "year_built", "inspection_date", "inspection_label", "owner_code", "owner", "condition_label",
        "is_culvert", "record_name",
    )


@query
def one_to_one_match(p: Plant) -> DataFrame:
    suppliers = p.table("supplier").select(
        code("B", F.col("s_suppkey")).alias("left_id"), lon_of(F.col("s_suppkey") + 5).alias("plon"), lat_of(F.col("s_suppkey") + 5).alias("plat")
    )
    assets = p.assets.select(F.col("asset_id").alias("right_id"), "lon", "lat")

    def near(radius: float, taken: DataFrame | None) -> DataFrame:
        sides = gis.free(suppliers, "left_id", taken, "left_id"), gis.free(assets, "right_id", taken, "right_id")
        return proximity.within(*sides, radius).select("left_id", "right_id", "distance")

    m = gis.one_to_one_within(near, "left_id", "right_id", 60.0)
    return m.select("left_id", "right_id", round_even(F.col("distance"), 1).alias("distance_m"))


@query
def spread_sample(p: Plant) -> DataFrame:
    rows = placement.spread_sample(p.assets, 12)
    return p.spark.createDataFrame(
        [(i, r.asset_id, r.lon, r.lat) for i, r in enumerate(rows)], "position bigint, asset_id string, lon double, lat double"
    )


def registry_assets(p: Plant) -> DataFrame:
    """Assets with the attributes the placement rules look at."""
    n = F.col("num")
    road = F.element_at(F.array(*[F.lit(v) for v in ("primary", "primary_link", "residential", "tertiary")]), (n % 4 + 1).cast("int"))
    attributes = F.map_filter(
        F.create_map(
            F.lit("length_m"), (n % 190).cast("string"),
            F.lit("footprint_m2"), (n * 37 % 3001).cast("string"),
            F.lit("highway_class"), F.when(F.col("asset_type") == "road", road),
            F.lit("structure_kind"), F.when(F.col("asset_type") == "bridge", F.when(n % 5 == 0, "culvert").otherwise("bridge")),
            F.lit("power"), F.when(F.col("asset_type") == "power", F.when(n % 3 == 0, "substation").otherwise("line")),
            F.lit("amenity"), F.when((F.col("asset_type") == "building") & (n % 9 == 0), "school"),
        ),
        lambda k, v: v.isNotNull(),
    )
    return p.assets.withColumn("attributes", attributes)


@query
def asset_classes(p: Plant) -> DataFrame:
    return placement.classified(registry_assets(p)).select(
        "asset_id", "is_culvert", "is_substation", "is_civic", "class_rank", "length_m", "footprint_m2"
    )


@query
def showcase_buildings(p: Plant) -> DataFrame:
    rows = placement.classified(registry_assets(p)).where(F.col("asset_type") == "building")
    return placement.showcase(rows, 3).select("asset_id", "is_civic", "footprint_m2")


@query
def building_pool(p: Plant) -> DataFrame:
    rows = placement.classified(registry_assets(p)).where(F.col("asset_type") == "building")
    return placement.building_pool(rows, 8, p.sensors.select("asset_id")).select("asset_id", "footprint_m2")


@query
def monitoring_sites(p: Plant) -> DataFrame:
    return placement.number_sensors(placement.select_hosts(registry_assets(p)))


# --- zonal ----------------------------------------------------------------------------------------------------------------------
PIXEL = 10.0


def pixels(p: Plant) -> DataFrame:
    """Line items as pixel centres on a 10 m raster of 600 x 600, two projects by line number."""
    col = F.pmod(F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31, F.lit(600))
    row = F.pmod(F.col("l_partkey") * 104729 + F.col("l_orderkey"), F.lit(600))
    return p.table("lineitem").select(
        F.when(F.col("l_linenumber") % 2 == 0, "new").otherwise("old").alias("project"),
        (col * PIXEL + PIXEL / 2).alias("px"), (row * PIXEL + PIXEL / 2).alias("py"),
        (F.col("l_quantity") * 1.5).alias("value"),
    )


def squares(p: Plant) -> DataFrame:
    """One square of 100 to 300 m per supplier."""
    k = F.col("s_suppkey")
    x, y = F.pmod(k * 7919, F.lit(5600)) * 1.0 + 0.25, F.pmod(k * 104729, F.lit(5600)) * 1.0 + 0.25
    side = F.pmod(k, F.lit(3)) * 100.0 + 100.5

    def at(a, b):
        return F.struct(a.alias("lon"), b.alias("lat"))

    ring = F.array(at(x, y), at(x + side, y), at(x + side, y + side), at(x, y + side))
    return p.table("supplier").select(k.alias("polygon_id"), ring.alias("ring"))


@query
def zonal_percentile(p: Plant) -> DataFrame:
    projects = p.spark.createDataFrame([("old", "2013-01-01"), ("new", "2018-01-01")], "project string, collected string")
    z = zonal.zonal_heights(squares(p), spread(pixels(p)), projects, PIXEL, 200.0)
    return z.select("polygon_id", "project", "n_pixels", F.round("p50", 6).alias("p50"), F.round("p90", 6).alias("p90"), "vmax", "status")


@query
def raster_difference(p: Plant) -> DataFrame:
    """Per pixel cell the mean of one project minus the shifted mean of the other."""
    raster = pixels(p).groupBy("project", F.floor(F.col("py") / PIXEL).alias("row"), F.floor(F.col("px") / PIXEL).alias("col")).agg(
        F.max("value").alias("value")
    )
    top = raster.where(F.col("project") == "new").drop("project")
    ground = raster.where(F.col("project") == "old").drop("project")
    return zonal.subtract(top, ground, 2, -3)


# --- payloads and heights -----------------------------------------------------------------------------------------------------------
@query
def payload_parse(p: Plant) -> DataFrame:
    """Every event as a payload of its own: objects, bare arrays and faulty ones."""
    e = F.col("event_id")
    value = F.round("value", 2).cast("string")
    entry = F.concat(
        F.lit('{"sensor_id": "'), code("S", F.col("user_id")), F.lit('", "ts": "2024-01-01T00:00:00Z", "value": '),
        F.when(e % 11 == 0, '"text"').when(e % 13 == 0, "true").otherwise(value),
        F.when(e % 3 == 0, '').otherwise(', "unit": "psi"'), F.lit("}"),
    )
    body = (
        F.when(e % 17 == 0, "not json").when(e % 19 == 0, '{"items": []}').when(e % 23 == 0, '[1, {"sensor_id": "a"}]')
        .when(e % 2 == 0, F.concat(F.lit('{"readings": ['), entry, F.lit(", "), entry, F.lit("]}")))
        .otherwise(F.concat(F.lit("["), entry, F.lit("]")))
    )
    parsed = src.parse_payloads(p.events.select("event_id", body.alias("body")), keys=("event_id",))
    return src.default_units(parsed, p.sensors).select("event_id", "seq", "fault", "sensor_id", "value", "unit")


@query
def props_json(p: Plant) -> DataFrame:
    """JSON-path access to the free properties of the events."""
    k = F.try_variant_get(F.parse_json("props"), "$.k", "bigint")
    return p.events.groupBy(k.alias("k")).agg(F.count("*").alias("n"))


@query
def measured_heights(p: Plant) -> DataFrame:
    """Part sizes as measured heights with unreadable, out-of-range and repeated rows."""
    n = F.col("p_partkey")
    rows = p.table("part").select(
        F.when(n % 9 == 0, "?").otherwise(F.floor(n / 2).cast("string")).alias("osm_id"),
        F.when(n % 7 == 0, "tall").otherwise(F.col("p_size").cast("string")).alias("height_m"), n.alias("pos"),
    )
    heights, report = src.usable_heights(rows)
    return heights.crossJoin(F.broadcast(report.select("ignored")))  # one row


@query
def source_catalogue(p: Plant) -> DataFrame:
    """Nations as catalogue entries, the nations of the suppliers as recorded facts."""
    catalogue = p.table("nation").select("n_nationkey", "n_name", (F.col("n_regionkey") > 1).alias("optional")).withColumnRenamed("n_nationkey", "source_id")
    facts = p.table("supplier").groupBy(F.col("s_nationkey").alias("source_id")).agg(F.count("*").alias("suppliers"))
    return src.source_catalogue(catalogue, facts)


@query
def geojson_features(p: Plant) -> DataFrame:
    """Assets as GeoJSON lines, read back by path."""
    f = sinks.feature_lines(p.assets, "asset_id", sinks.point_geometry(F.col("lon"), F.col("lat")), ["name", "asset_type"])
    return f.select(
        F.get_json_object("value", "$.id").alias("asset_id"), F.get_json_object("value", "$.type").alias("type"),
        F.get_json_object("value", "$.geometry.type").alias("geometry_type"),
        F.get_json_object("value", "$.properties.name").alias("name"),
    )


@query
def score_rows(p: Plant) -> DataFrame:
    s = sinks.score_rows(plain_flags(p), 1)
    return s.select("sensor_id", "ts", "expected", "z", "flagged")


@query
def run_baselines(p: Plant) -> DataFrame:
    from ..operators.baseline import sensor_baselines

    return sensor_baselines(plain_scores(p))


@query
def series_per_sensor(p: Plant) -> DataFrame:
    s = src.series_per_sensor(p.readings)
    return s.select("sensor_id", F.col("day").cast("string").alias("day"), F.size("series").alias("n"),
                    F.element_at("series", 1)["value"].alias("first_value"), F.element_at("series", -1)["value"].alias("last_value"))


# --- streaming ------------------------------------------------------------------------------------------------------------------------
def event_stream(p: Plant) -> DataFrame:
    """The events file as a stream; all of it is read and then the query stops."""
    return p.spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").parquet(p.sf_dir)


def _paths(p: Plant, *names: str) -> list[str]:
    base = f"{scratch_dir(p.spark)}/stream-{uuid.uuid4().hex}"
    return [f"{base}/{n}" for n in names]


class _StreamPlant(Plant):
    """A plant whose events come from the stream, so the same derivations apply."""

    def __init__(self, p: Plant):
        super().__init__(p.spark, p.sf_dir)
        self.__dict__["events"] = event_stream(p)


@query
def streaming_ingest(p: Plant) -> DataFrame:
    """The raw records as a stream, validated and upserted per micro-batch; the stored table is returned."""
    out, rejects, state = _paths(p, "out", "rejects", "state")
    jobs.ingest_stream(raw_readings(_StreamPlant(p)), p.sensors, out, rejects, state, "stream").awaitTermination()
    return p.spark.read.parquet(out).select("sensor_id", "ts", "value", "status")


def dealt_stream(p: Plant, rows: DataFrame) -> DataFrame:
    """Rows as a stream of four files in falling order of time, one file per micro-batch."""
    (folder,) = _paths(p, "dealt")
    rows.repartitionByRange(4, F.col(rows.columns[1]).desc()).write.parquet(folder)
    return p.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


@query
def streaming_cells(p: Plant) -> DataFrame:
    out, state = _paths(p, "out", "state")
    jobs.cells_stream(dealt_stream(p, p.readings), p.axis, out, state).awaitTermination()
    return jobs.stored_cells(p.spark, out)


@query
def streaming_sessions(p: Plant) -> DataFrame:
    """Sessions of the flagged steps, open ones included."""
    out, state = _paths(p, "out", "state")
    axis, params = p.axis, p.params
    rows = plain_flags(p).where("flagged").withColumn("at", axis.at(F.col("cell"))).select("sensor_id", "at", "z", "critical")

    def sessions(flags: DataFrame) -> DataFrame:
        return jobs.session_events(flags.dropDuplicates(["sensor_id", "at"]), axis, params.merge_gap_steps, params.min_flagged, params.z_strong)

    jobs.derived_stream(dealt_stream(p, rows), "sensor_id", sessions, out, state).awaitTermination()
    return jobs.derived(p.spark, "sensor_id", out)


@query
def streaming_offline(p: Plant) -> DataFrame:
    """When sensors fell silent for twelve hours and came back, and which are silent at the end."""
    out, state = _paths(p, "out", "state")
    interval = 43200
    jobs.derived_stream(dealt_stream(p, p.readings), "sensor_id", lambda rows: jobs.silent_times(rows, interval), out, state).awaitTermination()
    return jobs.silences(jobs.derived(p.spark, "sensor_id", out), interval)
