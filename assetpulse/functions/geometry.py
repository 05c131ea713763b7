"""Geometry as column expressions: sphere and local-plane distances, lines, rings, UTM, hexagon cells, clipping.

Coordinates are ``array<struct<lon, lat>>`` for lines and rings; planar variants use ``x`` and ``y``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from ..params import EARTH_RADIUS_M, METRES_PER_DEGREE_LAT, METRES_PER_DEGREE_LON


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the sphere."""
    a = F.radians(lat1)
    b = F.radians(lat2)
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.sqrt(F.least(h, F.lit(1.0)))) * (2 * EARTH_RADIUS_M)


def ellipsoidal(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the WGS84 spheroid for short distances (local radii of curvature at the middle latitude)."""
    a, e2 = 6378137.0, 0.0066943799901413165
    mid = F.radians((lat1 + lat2) / 2)
    w = 1 - F.pow(F.sin(mid), 2) * e2
    north = F.radians(lat2 - lat1) * (a * (1 - e2)) / F.pow(w, 1.5)
    east = F.radians(lon2 - lon1) * F.cos(mid) * a / F.sqrt(w)
    return F.hypot(north, east)


#: metres beyond which distances are taken on the sphere
SPHEROID_REACH_M = 100_000.0


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the spheroid up to 100 km, on the sphere beyond; the longitudes are less than half a turn apart."""
    far = haversine(lon1, lat1, lon2, lat2)
    return F.when(far <= SPHEROID_REACH_M, ellipsoidal(lon1, lat1, lon2, lat2)).otherwise(far)


def local_scale(py) -> Column:
    """Metres per degree east over metres per degree north."""
    e2 = 0.0066943799901413165
    w = 1 - F.pow(F.sin(F.radians(py)), 2) * e2
    return F.cos(F.radians(py)) * w / (1 - e2)


def foot_of(px, py, s: Column, scale: Column | None = None) -> Column:
    """struct(lon, lat): the point of a segment (ax, ay, bx, by) nearest to a point, by the local scale at that point.

    The segment is first turned by whole turns next to the point, so it may lie across 180 degrees.
    """
    scale = local_scale(py) if scale is None else scale
    turn = F.rint((s["ax"] - px) / 360.0) * 360.0
    dx, dy = s["bx"] - s["ax"], s["by"] - s["ay"]
    east, north = (px + turn - s["ax"]) * scale, py - s["ay"]
    length = F.pow(dx * scale, 2) + F.pow(dy, 2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce((east * dx * scale + north * dy) / F.nullif(length, F.lit(0.0)), F.lit(0.0))))
    return F.struct((s["ax"] - turn + t * dx).alias("lon"), (s["ay"] + t * dy).alias("lat"))


def unbroken(coords: Column) -> Column:
    """Vertices by longitudes that do not jump at 180 degrees, the smallest at least -180; shapes up to half a turn wide."""
    first = F.element_at(coords, 1)["lon"]

    def near_first(c: Column) -> Column:
        return F.when(F.abs(c["lon"] - first) > 180.0, c["lon"] + F.signum(first - c["lon"]) * 360.0).otherwise(c["lon"])

    joined = F.transform(coords, lambda c: F.struct(near_first(c).alias("lon"), c["lat"].alias("lat")))
    west = F.array_min(F.transform(joined, lambda c: c["lon"])) < -180.0

    def turned(one: Column) -> Column:
        return F.transform(one["joined"], lambda c: F.struct(F.when(one["west"], c["lon"] + 360.0).otherwise(c["lon"]).alias("lon"), c["lat"].alias("lat")))

    # an array of one: the vertices and their west end are computed once, not for every vertex
    return F.get(F.transform(F.array(F.struct(joined.alias("joined"), west.alias("west"))), turned), F.lit(0))


def is_ring(coords: Column) -> Column:
    return (F.size(coords) >= 4) & (F.element_at(coords, 1) == F.element_at(coords, -1))


def shape_segments(coords: Column) -> Column:
    """Segments of a point, line or ring; a single vertex is a segment of no length."""
    return segments(F.when(F.size(coords) == 1, F.concat(coords, coords)).otherwise(coords))


def shape_distance(lon: Column, lat: Column, coords: Column) -> Column:
    """Metres on the spheroid from a point to a point, line or area (a closed ring, 0 inside)."""

    def of(shape: Column) -> Column:
        feet = F.transform(shape_segments(shape), lambda s: foot_of(lon, lat, s))
        edge = F.array_min(F.transform(feet, lambda f: geodesic(lon, lat, f["lon"], f["lat"])))
        inside = point_in_ring(lon, lat, shape) | point_in_ring(lon + 360.0, lat, shape)
        return F.when(is_ring(shape) & inside, 0.0).otherwise(edge)

    return F.get(F.transform(F.array(unbroken(coords)), of), F.lit(0))


def mx(lat: Column) -> Column:
    """Metres per degree of longitude at a latitude (local plane)."""
    return F.cos(F.radians(lat)) * METRES_PER_DEGREE_LON


def point_to_segment(px, py, ax, ay, bx, by) -> Column:
    """Metres from a point to a segment in the local plane at the point's latitude."""
    sx, sy = mx(py), METRES_PER_DEGREE_LAT
    dx, dy = (bx - ax) * sx, (by - ay) * sy
    ex, ey = (px - ax) * sx, (py - ay) * sy
    l2 = dx * dx + dy * dy
    t = F.when(l2 == 0, 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (ex * dx + ey * dy) / F.nullif(l2, F.lit(0.0))))
    )
    return F.sqrt(F.pow(ex - t * dx, 2) + F.pow(ey - t * dy, 2))


def segments(coords: Column) -> Column:
    """Array of struct(ax, ay, bx, by) of consecutive vertices."""
    head = F.slice(coords, F.lit(1), F.greatest(F.size(coords) - 1, F.lit(0)))
    tail = F.slice(coords, F.lit(2), F.greatest(F.size(coords) - 1, F.lit(0)))
    return F.zip_with(
        head,
        tail,
        lambda p, q: F.struct(
            p["lon"].alias("ax"), p["lat"].alias("ay"), q["lon"].alias("bx"), q["lat"].alias("by")
        ),
    )


def sum_over(array: Column, term) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, item: acc + term(item))


def line_length(coords: Column) -> Column:
    return sum_over(segments(coords), lambda s: haversine(s["ax"], s["ay"], s["bx"], s["by"]))


def closed(coords: Column) -> Column:
    """The ring with its first vertex repeated at the end when it is open."""
    first, last = F.element_at(coords, 1), F.element_at(coords, -1)
    return F.when(first == last, coords).otherwise(F.concat(coords, F.array(first)))


def signed_area_deg(coords: Column) -> Column:
    """Square degrees, positive when counter-clockwise."""
    return sum_over(segments(closed(coords)), lambda s: s["ax"] * s["by"] - s["bx"] * s["ay"]) / 2


def polygon_area_m2(coords: Column) -> Column:
    """Local-plane area at the latitude of the first vertex."""
    return F.abs(signed_area_deg(coords)) * mx(F.element_at(coords, 1)["lat"]) * METRES_PER_DEGREE_LAT


def polygon_centroid(coords: Column) -> Column:
    """Area-weighted centroid; the vertex mean when the ring has no area. One fold over the ring's segments."""
    origin = F.element_at(coords, 1)
    zero = F.lit(0.0)
    start = F.struct(
        *[zero.alias(n) for n in ("twice", "cx", "cy", "sx", "sy", "n")], origin["lon"].alias("x0"), origin["lat"].alias("y0")
    )

    def step(acc, s):
        ax, ay, bx, by = s["ax"] - acc["x0"], s["ay"] - acc["y0"], s["bx"] - acc["x0"], s["by"] - acc["y0"]
        cross = ax * by - bx * ay
        return F.struct(
            (acc["twice"] + cross).alias("twice"),
            (acc["cx"] + (ax + bx) * cross).alias("cx"),
            (acc["cy"] + (ay + by) * cross).alias("cy"),
            (acc["sx"] + s["ax"]).alias("sx"),
            (acc["sy"] + s["ay"]).alias("sy"),
            (acc["n"] + 1.0).alias("n"),
            acc["x0"].alias("x0"),
            acc["y0"].alias("y0"),
        )

    def finish(t):
        area = F.nullif(t["twice"] * 3, zero)
        return F.when(
            t["twice"] == 0, F.struct((t["sx"] / t["n"]).alias("lon"), (t["sy"] / t["n"]).alias("lat"))
        ).otherwise(F.struct((t["x0"] + t["cx"] / area).alias("lon"), (t["y0"] + t["cy"] / area).alias("lat")))

    return F.aggregate(segments(closed(coords)), start, step, finish)


def point_along(coords: Column, fraction: float = 0.5) -> Column:
    """Point at a fraction of the length of a line."""
    target = line_length(coords) * fraction
    start = F.struct(F.lit(0.0).alias("walked"), F.element_at(coords, 1).alias("at"), F.lit(False).alias("done"))

    def step(acc, s):
        length = haversine(s["ax"], s["ay"], s["bx"], s["by"])
        hit = ~acc["done"] & (length > 0) & (acc["walked"] + length >= target)
        t = (target - acc["walked"]) / F.nullif(length, F.lit(0.0))
        here = F.struct(
            (s["ax"] + (s["bx"] - s["ax"]) * t).alias("lon"), (s["ay"] + (s["by"] - s["ay"]) * t).alias("lat")
        )
        end = F.struct(s["bx"].alias("lon"), s["by"].alias("lat"))
        at = F.when(acc["done"], acc["at"]).when(hit, here).otherwise(end)
        return F.struct((acc["walked"] + length).alias("walked"), at.alias("at"), (acc["done"] | hit).alias("done"))

    walked = F.aggregate(segments(coords), start, step)
    return F.when(line_length(coords) == 0, F.element_at(coords, 1)).otherwise(walked["at"])


def point_in_segments(lon: Column, lat: Column, ring_segments: Column) -> Column:
    """Even-odd rule over the segments of a closed ring."""
    def crosses(s):
        spans = (s["ay"] > lat) != (s["by"] > lat)
        x = (s["bx"] - s["ax"]) * (lat - s["ay"]) / F.nullif(s["by"] - s["ay"], F.lit(0.0)) + s["ax"]
        return spans & (lon < x)

    return F.pmod(F.size(F.filter(ring_segments, crosses)), F.lit(2)) == 1


def point_in_ring(lon: Column, lat: Column, coords: Column) -> Column:
    return point_in_segments(lon, lat, segments(closed(coords)))


def round_coords(coords: Column, digits: int) -> Column:
    """Rounded vertices without consecutive repeats."""
    scale = float(10**digits)
    rounded = F.transform(
        coords,
        lambda p: F.struct((F.rint(p["lon"] * scale) / scale).alias("lon"), (F.rint(p["lat"] * scale) / scale).alias("lat")),
    )
    return drop_repeats(rounded)


def drop_repeats(coords: Column) -> Column:
    """Without consecutive repeats; a fold, so the array expression is evaluated once."""
    none = F.array().cast("array<struct<lon:double,lat:double>>")
    return F.aggregate(
        coords,
        none,
        lambda acc, p: F.when(F.try_element_at(acc, F.lit(-1)).eqNullSafe(p), acc).otherwise(F.concat(acc, F.array(p))),
    )


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)


def clip_range(ax, ay, bx, by, box) -> Column:
    """Parameter range struct(t0, t1) of the part of a segment inside the box; null when nothing is inside."""
    west, south, east, north = box
    dx, dy = bx - ax, by - ay
    zero = F.lit(0.0)
    inside = F.lit(True)
    enters, leaves = [zero], [F.lit(1.0)]
    for p, q in ((-dx, ax - west), (dx, east - ax), (-dy, ay - south), (dy, north - ay)):
        inside = inside & ((p != 0) | (q >= 0))
        t = q / F.nullif(p, zero)
        enters.append(F.when(p < 0, t))
        leaves.append(F.when(p > 0, t))
    t0, t1 = F.greatest(*enters), F.least(*leaves)
    return F.when(inside & (t0 <= t1), F.struct(t0.alias("t0"), t1.alias("t1")))


def line_in_box(coords: Column, box) -> Column:
    """Some segment of the line meets the box; lines whose bounds miss it are decided by comparisons alone."""
    west, south, east, north = box
    lon, lat = F.transform(coords, lambda p: p["lon"]), F.transform(coords, lambda p: p["lat"])
    near = (F.array_max(lon) >= west) & (F.array_min(lon) <= east) & (F.array_max(lat) >= south) & (F.array_min(lat) <= north)
    return near & F.exists(segments(coords), lambda s: clip_range(s["ax"], s["ay"], s["bx"], s["by"], box).isNotNull())


def ring_in_box(coords: Column, box) -> Column:
    """The outline meets the box or the polygon contains it."""
    west, south, _, _ = box
    return line_in_box(closed(coords), box) | point_in_ring(F.lit(float(west)), F.lit(float(south)), coords)


def utm_xy(lon: Column, lat: Column, central_meridian: float) -> Column:
    """UTM easting and northing (northern hemisphere) as struct(x, y), by the usual series."""
    a, e2, k0 = 6378137.0, 0.0066943799901413165, 0.9996
    ep2 = e2 / (1 - e2)
    phi = F.radians(lat)
    s, c = F.sin(phi), F.cos(phi)
    n = a / F.sqrt(1 - s * s * e2)
    t = F.pow(F.tan(phi), 2)
    cc = c * c * ep2
    aa = F.radians(lon - central_meridian) * c
    m = (
        phi * (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256)
        - F.sin(phi * 2) * (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024)
        + F.sin(phi * 4) * (15 * e2**2 / 256 + 45 * e2**3 / 1024)
        - F.sin(phi * 6) * (35 * e2**3 / 3072)
    ) * a
    x = n * k0 * (aa + (1 - t + cc) * F.pow(aa, 3) / 6 + (5 - t * 18 + t * t + cc * 72 - 58 * ep2) * F.pow(aa, 5) / 120)
    y = k0 * (
        m
        + n
        * F.tan(phi)
        * (
            aa * aa / 2
            + (5 - t + cc * 9 + cc * cc * 4) * F.pow(aa, 4) / 24
            + (61 - t * 58 + t * t + cc * 600 - 330 * ep2) * F.pow(aa, 6) / 720
        )
    )
    return F.struct((x + 500000.0).alias("x"), y.alias("y"))


# --- hexagons: flat top, edge e, columns 1.5 e apart, odd columns shifted up by half a cell ----------------------------
def hex_width(edge: float) -> float:
    return 1.5 * edge


def hex_height(edge: float) -> float:
    return math.sqrt(3.0) * edge


def hex_centre(i: Column, j: Column, edge: float) -> Column:
    return F.struct(
        (i * hex_width(edge)).alias("x"), ((j + F.pmod(i, F.lit(2)) * 0.5) * hex_height(edge)).alias("y")
    )


def hex_cell(x: Column, y: Column, edge: float) -> Column:
    """struct(i, j) of the cell holding a point: the nearer centre of the two candidate columns."""
    w, h = hex_width(edge), hex_height(edge)

    def candidate(i):
        shift = F.pmod(i, F.lit(2)) * 0.5
        j = F.floor(y / h - shift + 0.5)
        d = F.pow(x - i * w, 2) + F.pow(y - (j + shift) * h, 2)
        return j, d

    i0 = F.floor(x / w)
    i1 = i0 + 1
    (j0, d0), (j1, d1) = candidate(i0), candidate(i1)
    nearer = d0 <= d1
    return F.struct(F.when(nearer, i0).otherwise(i1).alias("i"), F.when(nearer, j0).otherwise(j1).alias("j"))


def hex_id(cell: Column) -> Column:
    return F.concat_ws("_", cell["i"].cast("string"), cell["j"].cast("string"))


def hex_ring(centre: Column, edge: float) -> Column:
    """The six corners, counter-clockwise, as array<struct<x, y>>."""
    corners = [
        F.struct(
            (centre["x"] + edge * math.cos(math.pi / 3 * k)).alias("x"),
            (centre["y"] + edge * math.sin(math.pi / 3 * k)).alias("y"),
        )
        for k in range(6)
    ]
    return F.array(*corners)


def clip_convex(ring: Column, area: list[tuple[float, float]]) -> Column:
    """A ring cut by every edge of a convex counter-clockwise polygon (planar coordinates, open rings).

    The edges are folded over, so the expression does not grow with their number.
    """
    edges = F.array(
        *[
            F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x1", "y1", "x2", "y2"), (*p, *q))])
            for p, q in zip(area, area[1:] + area[:1])
        ]
    )
    return F.aggregate(edges, ring, _cut)


def _cut(ring: Column, edge: Column) -> Column:
    def side(p):
        return (p["y"] - edge["y1"]) * (edge["x2"] - edge["x1"]) - (p["x"] - edge["x1"]) * (edge["y2"] - edge["y1"])

    def pieces(p, i):
        q = F.get(ring, F.pmod(i + 1, F.size(ring)))
        a, b = side(p), side(q)
        t = a / F.nullif(a - b, F.lit(0.0))
        at = F.struct((p["x"] + (q["x"] - p["x"]) * t).alias("x"), (p["y"] + (q["y"] - p["y"]) * t).alias("y"))
        crossing = ((a >= 0) != (b >= 0)) & (a != b)
        return F.filter(F.array(F.when(a >= 0, p), F.when(crossing, at)), lambda v: v.isNotNull())

    return F.flatten(F.transform(ring, pieces))


def planar_area(ring: Column) -> Column:
    def term(p, i):
        q = F.get(ring, F.pmod(i + 1, F.size(ring)))
        return p["x"] * q["y"] - q["x"] * p["y"]

    return F.abs(F.aggregate(F.transform(ring, term), F.lit(0.0), lambda acc, v: acc + v)) / 2
