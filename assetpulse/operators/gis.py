"""Registry ETL over map elements: routing, clipping, buildings, lines, points, chains, numbered assets, report.

Elements are rows (type, id, pos, nodes, coords, lon, lat, tags). Geometry work is done per row in higher-order
functions, so routing and clipping need no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tags as tg
from ..functions.geometry import (
    clip_range,
    drop_repeats,
    in_box,
    line_length,
    point_along,
    polygon_area_m2,
    polygon_centroid,
    round_coords,
    segments,
    signed_area_deg,
)
from ..session import materialize, number_rows, spread
from .components import connected_components

# --- fixed values -------------------------------------------------------------------------------------------------------
COORD_DIGITS = 7
MIN_BUILDING_M2 = 25.0
MIN_PART_M = 5.0
NOT_ROADS = ("proposed", "construction", "abandoned", "razed", "platform", "rest_area", "services", "elevator",
             "corridor", "bus_stop", "street_lamp")
ROAD_CLASSES = ("motorway", "trunk", "primary", "secondary", "tertiary", "motorway_link", "trunk_link", "primary_link",
                "secondary_link", "tertiary_link", "unclassified", "residential")
POWER_LINES = ("line", "minor_line")
ID_FORMATS = {"building": "BLD-%04d", "road": "RD-%04d", "bridge": "BRG-%03d", "rail": "RAIL-%03d", "power": "PWR-%03d",
              "street_light": "SL-%03d", "water_main": "WM-%03d"}
CATEGORIES = {"building": "Buildings", "road": "Transportation", "bridge": "Transportation", "rail": "Transportation",
              "power": "Utilities", "street_light": "Utilities", "water_main": "Simulated network"}
TAG_KEYS = {
    "building": ("amenity", "office", "operator"),
    "road": ("surface", "maxspeed", "ref"),
    "rail": ("operator", "usage", "service"),
    "power": ("operator", "voltage", "substation", "cables"),
    "street_light": ("lamp_type", "lamp_mount", "light:method", "light:count", "operator", "ref"),
}
FEW_PAIRS = 200_000  # pairs of a matching that one task may take
# --- end of fixed values --------------------------------------------------------------------------------------------------

Box = tuple[float, float, float, float]


def tag(name: str) -> Column:
    return F.try_element_at(F.col("tags"), F.lit(name))


def first_of_each(elements: DataFrame) -> DataFrame:
    """First occurrence of every (type, id): a grouped ``min_by``, combined before the shuffle."""
    others = [c for c in elements.columns if c not in ("type", "id")]
    first = F.min_by(F.struct(*others), "pos").alias("e")
    return elements.groupBy("type", "id").agg(first).select("type", "id", "e.*")


def bridge_class() -> Column:
    """``highway:<class>`` or ``railway:rail`` of a bridge candidate, else null."""
    yes = tag("bridge").isNotNull() & (tag("bridge") != "no") & ~tag("area").eqNullSafe("yes")
    return F.when(yes & (tag("highway") != "") & ~tag("highway").isin(*NOT_ROADS), F.concat(F.lit("highway:"), tag("highway"))).when(
        yes & (tag("railway") == "rail"), F.lit("railway:rail")
    )


def layer() -> Column:
    """The one layer a way belongs to; the order of the rules decides."""
    return (
        F.when(tag("building").isNotNull() & (tag("building") != "no"), "building")
        .when(tag("power") == "substation", "substation")
        .when(tag("power").isin(*POWER_LINES), "power_line")
        .when(tag("highway") != "", "highway")
        .when((tag("railway") == "rail") & bridge_class().isNull(), "rail")
        .when(bridge_class().isNotNull(), "bridge_only")
        .otherwise("unused")
    )


def usable_ring(coords: Column, ring: Column) -> Column:
    """The rounded ring of a closed way; null when the way is not a usable polygon."""
    def shut(c):
        return (F.size(c) >= 4) & (F.try_element_at(c, F.lit(1)) == F.try_element_at(c, F.lit(-1)))

    return F.when(shut(coords) & shut(ring), ring)


def counter_clockwise(ring: Column) -> Column:
    return F.when(signed_area_deg(ring) < 0, F.reverse(ring)).otherwise(ring)


def clip_lines(lines: DataFrame, box: Box) -> DataFrame:
    """Adds clipped (coords), length_m, parts, dropped_m and was_clipped; ``clipped`` is null when nothing remains.

    The parts of a line inside the box are measured after rounding; those of at least 5 m count, the longest is kept.
    """
    west, south, east, north = box

    def ranged(s):  # the segment with its parameter range inside the box
        return F.struct(
            *[s[c].alias(c) for c in ("ax", "ay", "bx", "by")],
            clip_range(s["ax"], s["ay"], s["bx"], s["by"], box).alias("r"),
        )

    def inside(s):
        t0, t1 = s["r"]["t0"], s["r"]["t1"]

        def at(t):
            x = F.least(F.greatest(s["ax"] + (s["bx"] - s["ax"]) * t, F.lit(west)), F.lit(east))
            y = F.least(F.greatest(s["ay"] + (s["by"] - s["ay"]) * t, F.lit(south)), F.lit(north))
            a = F.struct(s["ax"].alias("lon"), s["ay"].alias("lat"))
            b = F.struct(s["bx"].alias("lon"), s["by"].alias("lat"))
            return F.when(t <= 0, a).when(t >= 1, b).otherwise(F.struct(x.alias("lon"), y.alias("lat")))

        return F.struct(t0.alias("t0"), t1.alias("t1"), at(t0).alias("p"), at(t1).alias("q"))

    # part number: a new part opens where the line enters the box or after it has left
    start = F.struct(
        F.lit(0).alias("part"), F.lit(False).alias("open"),
        F.array().cast("array<struct<part:int,p:struct<lon:double,lat:double>,q:struct<lon:double,lat:double>>>").alias("pieces"),
    )

    def fold(acc, s):
        hit = s["t0"].isNotNull()
        part = F.when(hit & ((s["t0"] > 0) | ~acc["open"]), acc["part"] + 1).otherwise(acc["part"])
        piece = F.struct(part.alias("part"), s["p"].alias("p"), s["q"].alias("q"))
        return F.struct(
            part.alias("part"),
            F.coalesce(hit & (s["t1"] >= 1), F.lit(False)).alias("open"),
            F.when(hit, F.concat(acc["pieces"], F.array(piece))).otherwise(acc["pieces"]).alias("pieces"),
        )

    folded = F.aggregate(F.transform(F.transform(segments(F.col("coords")), ranged), inside), start, fold)
    one_part = lambda k: F.filter(F.col("_f.pieces"), lambda x: x["part"] == k)
    numbers = F.when(F.col("_f.part") > 0, F.sequence(F.lit(1), F.col("_f.part"))).otherwise(F.array().cast("array<int>"))
    raw_parts = F.transform(
        numbers, lambda k: F.concat(F.transform(F.slice(one_part(k), 1, 1), lambda x: x["p"]), F.transform(one_part(k), lambda x: x["q"]))
    )
    keep_inside = lambda c: F.transform(
        round_coords(c, COORD_DIGITS),
        lambda v: F.struct(
            F.least(F.greatest(v["lon"], F.lit(west)), F.lit(east)).alias("lon"),
            F.least(F.greatest(v["lat"], F.lit(south)), F.lit(north)).alias("lat"),
        ),
    )
    measured = F.transform(
        F.filter(F.transform(F.col("_raw"), lambda c: drop_repeats(keep_inside(c))), lambda c: F.size(c) >= 2),
        lambda c: F.struct(line_length(c).alias("m"), c.alias("c")),
    )
    longest = F.aggregate(
        F.col("_kept"), F.struct(F.lit(-1.0).alias("m"), F.col("coords").alias("c")),
        lambda acc, x: F.when(x["m"] > acc["m"], x).otherwise(acc),
    )
    total = F.aggregate(F.col("_all"), F.lit(0.0), lambda acc, x: acc + x["m"])
    any_kept = F.size("_kept") > 0
    r1 = lambda c: F.rint(c * 10) / 10
    return (
        lines.withColumn("_f", folded)
        .withColumn("_raw", raw_parts)
        .withColumn("_all", measured)
        .withColumn("_kept", F.filter("_all", lambda x: x["m"] >= MIN_PART_M))
        .withColumn("_best", F.when(any_kept, longest))
        .withColumn("clipped", F.col("_best.c"))
        .withColumn("length_m", r1(F.col("_best.m")))
        .withColumn("parts", F.when(any_kept, F.size("_kept")))
        .withColumn("dropped_m", F.when(any_kept, r1(total - F.col("_best.m"))))
        .withColumn("was_clipped", F.abs(line_length(F.col("coords")) - F.col("_best.m")) > 0.05)
        .drop("_f", "_raw", "_all", "_kept", "_best")
    )


def with_actions(ways: DataFrame, box: Box, heights: DataFrame | None = None) -> DataFrame:
    """Every way with its layer, the action taken on it and the derived columns of its layer, in one pass."""
    rows = ways.withColumn("layer", layer()).withColumn("bridge_class", bridge_class())
    if heights is not None:
        rows = rows.join(heights.select(F.col("osm_id").alias("id"), F.col("height_m").alias("measured_m")), "id", "left")
    else:
        rows = rows.withColumn("measured_m", F.lit(None).cast("double"))
    is_area = F.col("layer").isin("building", "substation")
    rows = rows.withColumn("_r", F.when(is_area, round_coords(F.col("coords"), COORD_DIGITS)))
    rows = rows.withColumn("ring", usable_ring(F.col("coords"), F.col("_r"))).drop("_r")
    rows = rows.withColumn("ring", counter_clockwise(F.col("ring"))).withColumn("footprint_m2", polygon_area_m2(F.col("ring")))
    rows = rows.withColumn("centre", polygon_centroid(F.coalesce("ring", "coords")))
    rows = clip_lines(rows, box)
    outside_box = ~in_box(F.col("centre.lon"), F.col("centre.lat"), box)
    building = (
        F.when(F.col("ring").isNull(), "dropped_not_closed")
        .when(F.col("footprint_m2") < MIN_BUILDING_M2, "dropped_small")
        .when(outside_box, "dropped_centroid_outside")
        .otherwise("kept")
    )
    line = F.when(F.size("coords") < 2, "dropped_degenerate").when(F.col("clipped").isNull(), "dropped_outside_or_short").otherwise("kept")
    action = (
        F.when(F.col("layer") == "building", building)
        .when(F.col("layer") == "substation", F.when(outside_box, "dropped_outside").otherwise("kept"))
        .when((F.col("layer") == "highway") & tag("highway").isin(*NOT_ROADS), "skipped_class")
        .when((F.col("layer") == "highway") & (tag("area") == "yes"), "skipped_area")
        .when(F.col("layer").isin("highway", "rail", "power_line"), line)
        .otherwise("not_used")
    )
    height = tg.resolved_height(F.col("tags"), F.col("footprint_m2"), F.col("measured_m"))
    is_building = F.col("layer") == "building"
    return (
        rows.withColumn("action", action)
        .withColumn("name", tg.clean_name(tag("name")))
        .withColumn("height", F.when(is_building, height))
        .withColumn("levels", F.when(is_building, tg.levels(tag("building:levels"))))
        .withColumn("lanes", tg.lanes(tag("lanes")))
        .withColumn("oneway", tg.oneway(tag("oneway")))
        .withColumn("footprint_m2", F.rint(F.col("footprint_m2") * 10) / 10)
    )


def layer_report(actions: DataFrame) -> DataFrame:
    """Counts per layer and action with the clipped and multi-part lines among the kept ones."""
    line = F.col("layer").isin("highway", "rail", "power_line") & (F.col("action") == "kept")
    return actions.groupBy("layer", "action").agg(
        F.count("*").alias("ways"),
        F.count_if(line & F.col("was_clipped")).alias("clipped"),
        F.count_if(line & (F.col("parts") > 1)).alias("multi_part"),
    )


PENDING = ["asset_type", "sort_text", "sort_id", "name", "source_id", "geom_type", "coords", "lon", "lat", "attributes", "link_id"]


def _pending(df: DataFrame, kind: str | Column, geom_type, coords: Column, point: Column, attributes: Column, link: Column | None = None,
             rank: Column | None = None, source: str = "osm") -> DataFrame:
    kind_col = F.lit(kind) if isinstance(kind, str) else kind
    scale = float(10**COORD_DIGITS)
    return df.select(
        kind_col.alias("asset_type"),
        (F.lit("") if rank is None else rank).alias("sort_text"),
        F.col("id").cast("bigint").alias("sort_id"),
        "name",
        F.lit(source).alias("source_id"),
        F.lit(geom_type).alias("geom_type"),
        coords.alias("coords"),
        (F.rint(point["lon"] * scale) / scale).alias("lon"),
        (F.rint(point["lat"] * scale) / scale).alias("lat"),
        attributes.alias("attributes"),
        (F.lit(None).cast("bigint") if link is None else link).alias("link_id"),
    )


def _attributes(kind: str, **extra: Column) -> Column:
    """Map of the tags of interest and the derived values that are present."""
    picked = tg.tags_of_interest(F.col("tags"), TAG_KEYS[kind], kind == "building")
    if not extra:
        return picked
    derived = F.map_from_entries(
        F.filter(
            F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in extra.items()]),
            lambda e: e["value"].isNotNull(),
        )
    )
    names = list(extra)
    plain = F.map_filter(picked, lambda k, v: ~k.isin(*names))
    return F.map_concat(derived, plain)


def way_assets(actions: DataFrame) -> DataFrame:
    """Pending assets of the kept ways except bridges."""
    kept = actions.where(F.col("action") == "kept")
    mid = point_along(F.col("clipped"))
    b = kept.where(F.col("layer") == "building")
    s = kept.where(F.col("layer") == "substation")
    road = kept.where((F.col("layer") == "highway") & tag("highway").isin(*ROAD_CLASSES) & F.col("bridge_class").isNull())
    one = lambda c: F.array(F.struct(c["lon"].alias("lon"), c["lat"].alias("lat")))
    parts = [
        _pending(b, "building", "Polygon", F.col("ring"), F.col("centre"), _attributes(
            "building", building_type=tag("building"), levels=F.col("levels"), height_m=F.col("height.height_m"),
            height_source=F.col("height.height_source"), footprint_m2=F.col("footprint_m2")), F.col("id")),
        _pending(s, "power", "Point", one(F.col("centre")), F.col("centre"), _attributes(
            "power", power=tag("power"), footprint_m2=F.col("footprint_m2")), rank=F.lit("way")),
        _pending(kept.where(F.col("layer") == "power_line"), "power", "LineString", F.col("clipped"), mid, _attributes(
            "power", power=tag("power"), length_m=F.col("length_m")), rank=F.lit("way")),
        _pending(road, "road", "LineString", F.col("clipped"), mid, _attributes(
            "road", highway_class=tag("highway"), lanes=F.col("lanes"), oneway=F.col("oneway"), length_m=F.col("length_m")), F.col("id")),
        _pending(kept.where(F.col("layer") == "rail"), "rail", "LineString", F.col("clipped"), mid, _attributes(
            "rail", railway=tag("railway"), length_m=F.col("length_m"))),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def node_assets(nodes: DataFrame, box: Box) -> DataFrame:
    """Street lamps and substation nodes inside the box."""
    rows = nodes.where(in_box(F.col("lon"), F.col("lat"), box)).withColumn("name", tg.clean_name(tag("name")))
    point = F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat"))
    lamps = rows.where(tag("highway") == "street_lamp")
    stations = rows.where((tag("power") == "substation") & ~tag("highway").eqNullSafe("street_lamp"))
    return _pending(lamps, "street_light", "Point", F.array(point), point, _attributes("street_light")).unionByName(
        _pending(stations, "power", "Point", F.array(point), point, _attributes("power", power=tag("power")), rank=F.lit("node"))
    )


def _first_names(names: list, before: list[int], first: int, behind: list[int]) -> list[str]:
    """Names of a chain without repeats: where a name occurs on both sides, that behind the first way stays."""
    later = list(dict.fromkeys(n for i in (first, *behind) if (n := names[i])))
    outward = list(dict.fromkeys(n for i in reversed(before) if (n := names[i]) and n not in later))
    return outward[::-1] + later


def _walk_chains(heads, tails, names) -> list[dict]:
    """The chains of ways in the order of their ids: paths of places from 1 (negative: from tail to head), and their names."""
    at_node: dict[str, list[int]] = {}
    for i in range(len(heads) - 1, -1, -1):  # the lowest id of a node is the last of its list
        for node in {heads[i], tails[i]}:
            at_node.setdefault(node, []).append(i)
    free = dict.fromkeys(range(len(heads)))

    def walk(node: str) -> list[tuple[int, bool]]:
        """Free ways from a node onwards, each with whether it is walked from its head to its tail."""
        steps = []
        while True:
            here = at_node[node]
            while here and here[-1] not in free:
                here.pop()
            if not here:
                return steps
            i = here.pop()
            del free[i]
            ahead = heads[i] == node
            node = tails[i] if ahead else heads[i]
            steps.append((i, ahead))

    found = []
    while free:
        first = next(iter(free))
        del free[first]
        behind = walk(tails[first])
        before = [(i, not ahead) for i, ahead in reversed(walk(heads[first]))]
        path = [i + 1 if ahead else -i - 1 for i, ahead in (*before, (first, True), *behind)]
        named = _first_names(names, [i for i, _ in before], first, [i for i, _ in behind])
        found.append({"path": path, "names": named})
    return found


def _chain_walks(heads: pd.Series, tails: pd.Series, names: pd.Series) -> pd.Series:
    return pd.Series([_walk_chains(h, t, n) for h, t, n in zip(heads, tails, names)])


def merge_chains(ways: DataFrame) -> DataFrame:
    """Bridge ways (id, bridge_class, nodes, coords, name) of one class that share end nodes, as one line each.

    (chain_id = lowest way id, bridge_class, way_ids, coords, names). The shared ends are found by an equality join and
    the chains by connected components; only the order within one chain is decided in a task.
    """
    usable = ways.where(F.col("bridge_class").isNotNull() & (F.size("coords") >= 2))
    by_node = F.size("nodes") == F.size("coords")

    def key(i: int) -> Column:
        at = F.element_at("coords", i)
        return F.when(by_node, F.concat(F.lit("n"), F.try_element_at("nodes", F.lit(i)).cast("string"))).otherwise(
            F.concat_ws(",", F.lit("c"), at["lon"].cast("string"), at["lat"].cast("string"))
        )

    ends = materialize(
        usable.select("id", "bridge_class", "coords", "name", key(1).alias("head"), key(-1).alias("tail")), "bridge-ways"
    )
    touching = ends.select("bridge_class", "id", F.explode(F.array("head", "tail")).alias("end"))
    # every end is linked to its lowest way: a star, never all pairs of the ways that meet there
    lowest = touching.groupBy("bridge_class", "end").agg(F.min("id").alias("dst"))
    edges = touching.join(lowest, ["bridge_class", "end"]).where("id <> dst").select(F.col("id").alias("src"), "dst")
    component = connected_components(ends.select("id"), edges)

    # a chain's ways in one row, by id; the task sees no coordinates and answers with places in that row
    way = F.struct("id", "head", "tail", "name", "bridge_class", "coords")
    whole = ends.join(component, "id").groupBy("component").agg(F.array_sort(F.collect_list(way)).alias("ways"))
    listed = F.transform("ways", lambda w: F.struct(w["head"].alias("head"), w["tail"].alias("tail"), w["name"].alias("name")))
    walk = F.pandas_udf(_chain_walks, "array<struct<path:array<int>,names:array<string>>>")
    walked = whole.withColumn("chain", F.explode(walk(listed["head"], listed["tail"], listed["name"])))
    at = lambda step: F.element_at("ways", F.abs(step).cast("int"))

    def points(step: Column, i: Column) -> Column:
        """Vertices of a way as walked, without the one it shares with the way before."""
        line = at(step)["coords"]
        line = F.when(step > 0, line).otherwise(F.reverse(line))
        return F.when(i == 0, line).otherwise(F.slice(line, F.lit(2), F.size(line)))

    path = F.col("chain.path")
    ids = F.transform(path, lambda step: at(step)["id"])
    return walked.select(
        F.array_min(ids).alias("chain_id"), at(path[0])["bridge_class"].alias("bridge_class"), ids.alias("way_ids"),
        F.flatten(F.transform(path, points)).alias("coords"), F.col("chain.names").alias("names"),
    )


def _in_order(pairs: DataFrame, left: str, right: str, distance: str) -> DataFrame:
    """Greedy matching of few pairs: one task takes them in their order."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used: tuple[set, set] = set(), set()
        for batch in batches:
            kept = []
            for i, pair in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if None not in pair and pair[0] not in used[0] and pair[1] not in used[1]:
                    used[0].add(pair[0])
                    used[1].add(pair[1])
                    kept.append(i)
            yield batch.take(pa.array(kept, pa.int64()))

    rows = pairs.select(left, right, distance)
    return rows.repartition(1).sortWithinPartitions(distance, left, right).mapInArrow(take, rows.schema)


def one_to_one(pairs: DataFrame, left: str, right: str, distance: str = "distance") -> DataFrame:
    """Nearest-first matching in which each side is used once: (left, right, distance).

    Sorting all pairs and taking them greedily equals repeating: accept the pairs that are first for both their sides,
    drop everything those sides take part in. Every round is a set of grouped minima. The last ``FEW_PAIRS`` are taken in one
    task: a chain in which each pair waits for the one before would ask for a round a pair.
    """
    order = F.struct(distance, left, right)
    rest = materialize(pairs.select(left, right, distance), "match-pairs")
    taken: DataFrame | None = None
    while rest.count() > FEW_PAIRS:
        ranked = rest.withColumn("_o", order)
        by_left = ranked.groupBy(left).agg(F.min("_o").alias("_bl"))
        by_right = ranked.groupBy(right).agg(F.min("_o").alias("_br"))
        best = materialize(
            ranked.join(by_left, left).join(by_right, right)
            .where((F.col("_o") == F.col("_bl")) & (F.col("_o") == F.col("_br"))).select(left, right, distance),
            "match-best",
        )
        taken = best if taken is None else taken.unionByName(best)
        rest = materialize(
            rest.join(best.select(left), left, "left_anti").join(best.select(right), right, "left_anti"), "match-pairs"
        )
    last = materialize(_in_order(rest, left, right, distance), "match-best")
    return last if taken is None else taken.unionByName(last)


def one_to_one_within(near, left: str, right: str, radius_m: float, bands: int = 4) -> DataFrame:
    """``one_to_one`` of all pairs within a radius, which are formed only as far as the matching needs them.

    ``near(radius, taken)`` gives the pairs (left, right, distance) at most a radius apart whose sides are not in ``taken``
    (None at first). Radii grow fourfold to the whole one: a shorter pair is always taken before a longer one, so the matching
    within a smaller radius is a part of the whole one, and what it took meets nobody any more.
    """
    taken: DataFrame | None = None
    for k in reversed(range(bands)):
        found = one_to_one(near(radius_m / 4.0**k, taken), left, right)
        taken = found if taken is None else materialize(taken.unionByName(found), "matched")
    return taken


def free(df: DataFrame, column: str, taken: DataFrame | None, side: str) -> DataFrame:
    """Rows whose column is not among a side of the matched pairs."""
    return df if taken is None else df.join(taken.select(F.col(side).alias(column)), column, "left_anti")


def decode_inventory(features: DataFrame, pivot_year: int) -> DataFrame:
    """Typed bridge records from (attributes map, lon, lat); rows without identifier or point are dropped."""
    from .quality import coordinate_check

    def a(name: str) -> Column:
        return tg.text_or_null(F.try_element_at(F.col("attributes"), F.lit(name)))

    number = a("STRUCTURE_NUMBER_008")
    rec = tg.dms_point(a("LAT_016"), a("LONG_017"))
    when = tg.inspection_month(a("DATE_OF_INSPECT_090"), pivot_year)
    facility, over = a("FACILITY_CARRIED_007"), a("FEATURES_DESC_006A")
    whole = lambda c: c.try_cast("double").cast("bigint")
    rows = features.where(number.isNotNull() & F.col("lon").isNotNull() & F.col("lat").isNotNull())
    return rows.withColumn("_rec", rec).withColumn("_when", when).select(
        number.alias("structure_number"), "lon", "lat",
        F.col("_rec.lon").alias("recorded_lon"), F.col("_rec.lat").alias("recorded_lat"),
        coordinate_check(F.col("lon"), F.col("lat"), F.col("_rec.lon"), F.col("_rec.lat")).alias("location_check"),
        facility.alias("facility_carried"), over.alias("features_intersected"),
        a("LOCATION_009").alias("location"),
        tg.owner_code(a("OWNER_022")).alias("owner_code"),
        tg.owner_label(tg.owner_code(a("OWNER_022"))).alias("owner"),
        F.nullif(whole(a("YEAR_BUILT_027")), F.lit(0)).alias("year_built"),
        F.nullif(whole(a("YEAR_RECONSTRUCTED_106")), F.lit(0)).alias("year_reconstructed"),
        whole(a("ADT_029")).alias("adt"),
        F.nullif(whole(a("YEAR_ADT_030")), F.lit(0)).alias("adt_year"),
        F.upper(a("DECK_COND_058")).alias("deck_condition"),
        F.upper(a("SUPERSTRUCTURE_COND_059")).alias("superstructure_condition"),
        F.upper(a("SUBSTRUCTURE_COND_060")).alias("substructure_condition"),
        whole(a("LOWEST_RATING")).alias("lowest_rating"),
        a("STRUCTURE_LEN_MT_049").try_cast("double").alias("structure_length_m"),
        F.format_string("%04d-%02d", F.col("_when.year"), F.col("_when.month")).alias("_date"),
        F.col("_when").isNotNull().alias("_dated"),
        tg.inspection_label(F.col("_when")).alias("_label"),
        F.upper(a("CULVERT_COND_062")).alias("culvert_condition"),
        F.upper(a("BRIDGE_CONDITION")).alias("bridge_condition"),
        tg.condition_label(a("BRIDGE_CONDITION")).alias("condition_label"),
        F.when(over.isNotNull() & facility.isNotNull(), F.concat(tg.title_case(facility), F.lit(" over "), tg.title_case(over)))
        .otherwise(tg.title_case(facility)).alias("record_name"),
        F.coalesce(F.upper(a("CULVERT_COND_062")) != "N", F.lit(False)).alias("is_culvert"),
    ).withColumn("inspection_date", F.when(F.col("_dated"), F.col("_date"))).withColumn(
        "inspection_label", F.when(F.col("_dated"), F.col("_label"))
    ).drop("_date", "_dated", "_label")


def attach_inventory(records: DataFrame, chains: DataFrame, box: Box, radius_m: float = 60.0) -> DataFrame:
    """Every record with its outcome: matched (with chain and distance), point_asset, mismatch, unverified, outside."""
    from .proximity import points_near_lines

    # every radius and every free list reads the records: decoded in each of their filters, the plans alone would fill the driver
    records = materialize(records, "inventory")
    inside = in_box(F.col("lon"), F.col("lat"), box)
    usable = records.where((F.col("location_check") == "ok") & inside)
    points = usable.select(F.col("structure_number").alias("point_id"), "lon", "lat")
    lines = chains.where(F.col("bridge_class").startswith("highway:")).select(F.col("chain_id").alias("line_id"), "coords")

    def near(radius: float, taken: DataFrame | None) -> DataFrame:
        return points_near_lines(free(points, "point_id", taken, "point_id"), free(lines, "line_id", taken, "line_id"), radius)

    matched = one_to_one_within(near, "point_id", "line_id", radius_m).select(
        F.col("point_id").alias("structure_number"), F.col("line_id").alias("chain_id"),
        (F.rint(F.col("distance") * 10) / 10).alias("match_distance_m"),
    )
    outcome = (
        F.when(F.col("location_check") != "ok", F.col("location_check"))
        .when(~inside, "outside")
        .when(F.col("chain_id").isNotNull(), "matched")
        .otherwise("point_asset")
    )
    return records.join(matched, "structure_number", "left").withColumn("outcome", outcome)


def bridge_assets(chains: DataFrame, attached: DataFrame, box: Box) -> DataFrame:
    """Pending bridge assets: clipped chains (with the record's name when matched) and unmatched records as points."""
    c = clip_lines(chains, box).where(F.col("clipped").isNotNull()).withColumnRenamed("chain_id", "id")
    by_record = attached.where(F.col("outcome") == "matched").select(
        F.col("chain_id").alias("id"), F.col("record_name").alias("_rn"), "structure_number"
    )
    c = c.join(by_record, "id", "left").withColumn(
        "name", F.coalesce("_rn", F.nullif(F.array_join("names", " / "), F.lit("")))
    )
    single = (F.size("way_ids") == 1) & F.col("bridge_class").startswith("highway:")
    kind = F.substring_index("bridge_class", ":", -1)
    entries = F.create_map(
        F.lit("structure_kind"), F.lit("bridge"), F.lit("class"), kind,
        F.lit("length_m"), F.col("length_m").cast("string"),
        F.lit("osm_way_ids"), F.array_join(F.array_sort(F.col("way_ids")).cast("array<string>"), ","),
        F.lit("inventory"), F.col("structure_number"),
    )
    lines = _pending(
        c, "bridge", "LineString", F.col("clipped"), point_along(F.col("clipped")),
        F.map_filter(entries, lambda k, v: v.isNotNull()), F.when(single, F.col("way_ids")[0]), rank=F.lit("0"),
    )
    p = attached.where(F.col("outcome") == "point_asset").withColumn("id", F.lit(0).cast("bigint")).withColumn("name", F.col("record_name"))
    at = F.struct(F.col("lon").alias("lon"), F.col("lat").alias("lat"))
    points = _pending(
        p, "bridge", "Point", F.array(at), at,
        F.create_map(F.lit("structure_kind"), F.when(F.col("is_culvert"), "culvert").otherwise("bridge"), F.lit("inventory"), F.col("structure_number")),
        rank=F.concat(F.lit("1"), F.col("structure_number")), source="nbi",
    )
    return lines.unionByName(points)


def number_assets(pending: DataFrame) -> DataFrame:
    """Asset ids per type in source-key order, zero padded; category from the type."""
    # bridges sort by (line or point, key), everything else by (id, text)
    keyed = pending.withColumn("_k0", F.when(F.col("asset_type") == "bridge", F.col("sort_text")).otherwise("")).withColumn(
        "_k1", F.col("sort_id")
    ).withColumn("_k2", F.col("sort_text"))
    placed = number_rows(keyed, ["asset_type", "_k0", "_k1", "_k2"], "_n", "assets")
    first = placed.groupBy("asset_type").agg(F.min("_n").alias("_first"))  # one row per asset type
    n = F.col("_n") - F.col("_first") + 1
    ident, category = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, pattern in ID_FORMATS.items():
        ident = F.when(F.col("asset_type") == kind, F.format_string(pattern, n)).otherwise(ident)
        category = F.when(F.col("asset_type") == kind, CATEGORIES[kind]).otherwise(category)
    return placed.join(F.broadcast(first), "asset_type").select(
        ident.alias("asset_id"), "asset_type", category.alias("category"), "name", F.lit(False).alias("is_simulated"),
        "source_id", "link_id", "geom_type", "coords", "lon", "lat", "attributes",
    )


def build_registry(elements: DataFrame, inventory: DataFrame | None, box: Box, pivot_year: int, heights: DataFrame | None = None) -> DataFrame:
    """Elements and inventory features to the numbered asset registry."""
    unique = materialize(first_of_each(elements), "elements")
    # five layers and the bridge chains read the actions: clip and measure once
    actions = materialize(with_actions(unique.where((F.col("type") == "way") & (F.size("coords") > 0)), box, heights), "actions")
    chains = materialize(merge_chains(actions.select("id", "bridge_class", "nodes", "coords", "name")), "chains")
    spark = elements.sparkSession
    records = (
        decode_inventory(spread(inventory), pivot_year)
        if inventory is not None
        else decode_inventory(spark.createDataFrame([], "attributes map<string,string>, lon double, lat double"), pivot_year)
    )
    attached = materialize(attach_inventory(records, chains, box), "attached")
    pending = way_assets(actions).unionByName(node_assets(unique.where(F.col("type") == "node"), box)).unionByName(
        bridge_assets(chains, attached, box)
    )
    return number_assets(pending)


def linked(assets: DataFrame, buildings: DataFrame, roads: DataFrame) -> DataFrame:
    """Assets with building_id (buildings only) and road_id (roads and bridges only) found through link_id."""
    b = buildings.select(F.col("osm_id").alias("_b"), "building_id")
    r = roads.select(F.col("osm_id").alias("_r"), "road_id")
    on_building = (F.col("asset_type") == "building") & (F.col("link_id") == F.col("_b"))
    on_road = F.col("asset_type").isin("road", "bridge") & (F.col("link_id") == F.col("_r"))
    return assets.join(b, on_building, "left").join(r, on_road, "left").drop("_b", "_r")


def largest_part(df: DataFrame, parts: str = "parts") -> DataFrame:
    """Keeps the largest ring of every multi-part geometry (array of rings), the first on a tie."""
    areas = F.transform(parts, lambda ring, i: F.struct(polygon_area_m2(ring).alias("a"), (-i).alias("i"), ring.alias("ring")))
    best = F.array_max(F.transform(areas, lambda e: F.struct(e["a"].alias("a"), e["i"].alias("i"))))
    return df.withColumn("_i", -best["i"]).withColumn("ring", F.get(F.col(parts), F.col("_i"))).drop("_i")
