"""Distance joins, neighbours, hexagons, clusters, hulls and geometry against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from assetpulse.functions import geometry as geo
from assetpulse.operators import cluster, components, gis, placement, proximity, risk, tiles
from assetpulse.session import dealt

R = 6371008.8


def hav(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(h))


def scatter(n, seed, lon=-100.0, lat=37.75, size=0.02, hot=0.34):
    """Points of which a third share one place."""
    rng = random.Random(seed)
    return [
        (lon + 0.001, lat + 0.001) if rng.random() < hot else (lon + rng.random() * size, lat + rng.random() * size)
        for _ in range(n)
    ]


@pytest.mark.parametrize("radius, salt", [(50.0, 10), (400.0, 100_000)])
@pytest.mark.parametrize("lat", [37.75, -0.01, 84.0])
def test_within_equals_cross_join(spark, radius, salt, lat):
    a, b = scatter(120, 1, lat=lat), scatter(150, 2, lat=lat)
    p = spark.createDataFrame([(i, *v) for i, v in enumerate(a)], "i int, plon double, plat double")
    q = spark.createDataFrame([(i, *v) for i, v in enumerate(b)], "j int, lon double, lat double")
    got = sorted((r.i, r.j) for r in proximity.within(p, q, radius, salt_rows=salt).collect())
    assert got == sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if hav(x, y) <= radius)


def test_metres_not_degrees(spark):
    assets = spark.createDataFrame(
        [("A", "road", "n", -100.5, 37.501), ("B", "road", "e", -100.5 + 0.00115, 37.5)],
        "asset_id string, asset_type string, name string, lon double, lat double",
    )
    assert proximity.nearest_to_point(assets, -100.5, 37.5).first().asset_id == "B"
    got = proximity.assets_within_radius(assets, -100.5, 37.5, 105.0).collect()
    assert [r.asset_id for r in got] == ["B"]
    d = assets.select(geo.ellipsoidal(F.lit(-100.5), F.lit(37.5), F.col("lon"), F.col("lat")).alias("d")).collect()
    # on the spheroid a degree of longitude at 37.5 N is 88.42 km: 0.00115 degrees are 101.69 m
    assert [r.d for r in d] == pytest.approx([111.0, 101.69], abs=0.05)


def spheroid(a, b):
    """Metres between near places by the radii of curvature at the middle latitude, on the sphere beyond 100 km."""
    if hav(a, b) > 100_000:
        return hav(a, b)
    mid, e2 = math.radians((a[1] + b[1]) / 2), 0.0066943799901413165
    w = 1 - e2 * math.sin(mid) ** 2
    north = math.radians(b[1] - a[1]) * 6378137.0 * (1 - e2) / w**1.5
    return math.hypot(north, math.radians(b[0] - a[0]) * math.cos(mid) * 6378137.0 / math.sqrt(w))


def to_shape(p, coords):
    """Distance of a place to a shape whose vertices do not jump: the best of many points along each side, 0 inside."""
    turns = [(p[0] + k, p[1]) for k in (-360.0, 0.0, 360.0)]
    if len(coords) >= 4 and coords[0] == coords[-1]:
        for x, y in turns:
            sides = [(a, b) for a, b in zip(coords, coords[1:]) if (a[1] > y) != (b[1] > y)]
            if sum(x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in sides) % 2:
                return 0.0
    sides = list(zip(coords, coords[1:])) or [(coords[0], coords[0])]
    along = lambda a, b, t: (a[0] + (b[0] - a[0]) * t, a[1] + (b[1] - a[1]) * t)
    best = math.inf
    for a, b in sides:
        low, high = 0.0, 1.0
        for _ in range(7):  # the distance along a side has one minimum
            step = (high - low) / 20
            t = min((low + step * i for i in range(21)), key=lambda t: min(spheroid(q, along(a, b, t)) for q in turns))
            low, high = max(0.0, t - step), min(1.0, t + step)
        best = min(best, min(spheroid(q, along(a, b, t)) for q in turns))
    return best


@pytest.mark.parametrize("lon, lat", [(-100.0, 37.75), (179.9995, 10.0), (20.0, -71.0)])
def test_shapes_equal_brute_force(spark, lon, lat):
    """Points, lines and areas around places, at 180 degrees too; missing shapes and places are near nothing."""
    rng = random.Random(12)
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    shapes = {}
    for i in range(24):
        x, y, size = lon + rng.uniform(-1, 1) * 0.01, lat + rng.uniform(-1, 1) * 0.01, rng.choice([0.0002, 0.003])
        ring = [(x + size, y), (x, y + size), (x - size, y), (x, y + size / 4), (x, y - size)]  # not convex
        shapes[f"s{i:02d}"] = [[(x, y)], ring[:3], ring + ring[:1]][i % 3]
    shapes["long"] = [(lon - 0.5, lat - 0.2), (lon + 0.5, lat + 0.2)]
    places = [(lon + rng.uniform(-1, 1) * 0.012, lat + rng.uniform(-1, 1) * 0.012) for _ in range(25)]
    rows = [(k, [(wrap(x), y) for x, y in v]) for k, v in shapes.items()] + [("null", None), ("empty", [])]
    df = spark.createDataFrame(rows, "target_id string, coords array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(i, wrap(x), y) for i, (x, y) in enumerate(places)] + [(98, None, lat), (99, lon, None)], "point_id int, plon double, plat double")
    want = {(i, k): to_shape(p, v) for i, p in enumerate(places) for k, v in shapes.items()}
    found = points.join(proximity.shapes_near(points, df, 300.0, salt_rows=5), ["plon", "plat"]).collect()
    assert {(r.point_id, r.target_id): r.distance for r in found} == pytest.approx({k: d for k, d in want.items() if d <= 300}, abs=0.01)
    assert any(r.distance == 0 for r in found)
    best = {r.point_id: r for r in proximity.nearest_join(points.where("point_id < 90"), df, 20.0).collect()}
    assert sorted(best) == list(range(25))
    for i, r in best.items():
        assert r.distance == pytest.approx(min(want[i, k] for k in shapes), abs=0.01)
        assert want[i, r.target_id] == pytest.approx(r.distance, abs=0.01)
    one = {r.target_id: r.distance for r in proximity.from_point(df.where(F.size("coords") > 0), wrap(places[0][0]), places[0][1]).collect()}
    assert one == pytest.approx({k: want[0, k] for k in shapes}, abs=0.01)


@pytest.mark.parametrize("lon, lat, radius", [(179.9995, 10.0, 250.0), (-180.0, -3.0, 400.0), (20.0, 89.97, 8000.0), (20.0, -89.999, 3e6), (5.0, 60.0, 2.1e7), (5.0, 60.0, 500.0)])
def test_radius_reaches_across_the_globe(spark, lon, lat, radius):
    """Equal to the distance of every asset, at 180 degrees, over a pole and around the globe."""
    rng = random.Random(6)
    places = [((lon + d + 180.0) % 360.0 - 180.0, max(-90.0, min(90.0, lat + rng.uniform(-1, 1) * radius / 111_000))) for d in (rng.uniform(-1, 1) * s for s in (0.002, 0.01, 180.0) for _ in range(60))]
    places += [(-179.9995, 10.0), (-160.0, 89.97), (180.0, -3.0), (-180.0, -3.0)]
    rows = [(f"a{i:03d}", *v) for i, v in enumerate(places)] + [("null", None, 1.0)]
    assets = spark.createDataFrame(rows, "asset_id string, lon double, lat double")
    got = [r.asset_id for r in proximity.assets_within_radius(assets, lon, lat, radius).collect()]
    assert sorted(got) == [i for i, *v in rows[:-1] if hav((lon, lat), v) <= radius] and got


def test_shapes_within_radius(spark):
    """Lines, areas and single vertices, also across 180 degrees, against every segment's distance."""

    def plane(p, a, b):
        sx, sy = math.cos(math.radians(p[1])) * geo.METRES_PER_DEGREE_LON, geo.METRES_PER_DEGREE_LAT
        dx, dy, ex, ey = (b[0] - a[0]) * sx, (b[1] - a[1]) * sy, (p[0] - a[0]) * sx, (p[1] - a[1]) * sy
        l2 = dx * dx + dy * dy
        t = max(0.0, min(1.0, (ex * dx + ey * dy) / l2)) if l2 else 0.0
        return math.hypot(ex - t * dx, ey - t * dy)

    rng, radius = random.Random(8), 900.0
    for lon, lat in ((-100.0, 37.0), (179.999, 37.0)):
        shapes = []
        for k in range(80):
            x, y = lon + rng.uniform(-0.02, 0.02), lat + rng.uniform(-0.02, 0.02)
            line = [(x + rng.uniform(-0.004, 0.004), y + rng.uniform(-0.004, 0.004)) for _ in range(rng.randint(1, 5))]
            shapes.append((f"l{k:02d}", line))
        square = [(-0.01, -0.01), (0.01, -0.01), (0.01, 0.01), (-0.01, 0.01), (-0.01, -0.01)]
        shapes += [("area", [(lon + x, lat + y) for x, y in square]), ("open", [(lon + x, lat + y) for x, y in square[:-1]]), ("none", [])]
        wrapped = [(i, [((x + 180.0) % 360.0 - 180.0, y) for x, y in c]) for i, c in shapes]
        df = spark.createDataFrame(wrapped, "asset_id string, coords array<struct<lon:double,lat:double>>")
        got = {r.asset_id: (r.distance_m, r.inside) for r in proximity.shapes_within_radius(df, lon, lat, radius).collect()}
        want = {i: min(plane((lon, lat), a, b) for a, b in zip(c, c[1:] or c)) for i, c in shapes if c}
        want = {i: d for i, d in want.items() if d <= radius} | {"area": 0.0}
        assert set(got) == set(want) and len(want) > 5 and got["area"] == (0.0, True) and not any(inside for i, (_, inside) in got.items() if i != "area")
        assert all(got[i][0] == pytest.approx(d, abs=0.06) for i, d in want.items())


def test_nearest_join_grows_its_radius(spark):
    points = scatter(80, 3) + [(-99.0, 38.5), (20.0, -30.0)]
    targets = scatter(60, 4)
    p = spark.createDataFrame([(f"p{i:03d}", *v) for i, v in enumerate(points)], "point_id string, plon double, plat double")
    t = spark.createDataFrame([(f"t{i:03d}", *v) for i, v in enumerate(targets)], "target_id string, lon double, lat double")
    got = {r.point_id: r.target_id for r in proximity.nearest_join(p, t, 20.0).collect()}
    for i, x in enumerate(points):
        want = min((round(hav(x, y), 6), f"t{j:03d}") for j, y in enumerate(targets))
        assert got[f"p{i:03d}"] == want[1]


def test_every_point_lies_in_its_hexagon(spark):
    pts = spark.range(2000).select(
        (F.pmod(F.col("id") * 7919, F.lit(10007)) / 10.0 - 500).alias("x"), (F.pmod(F.col("id") * 104729, F.lit(10009)) / 10.0 - 500).alias("y")
    )
    cell = pts.withColumn("c", geo.hex_cell(F.col("x"), F.col("y"), 50.0)).withColumn("m", geo.hex_centre(F.col("c.i"), F.col("c.j"), 50.0))
    far = cell.agg(F.max(F.hypot(F.col("x") - F.col("m.x"), F.col("y") - F.col("m.y")))).first()[0]
    assert far <= 50.0 + 1e-9


def test_clipped_grid_covers_the_area_once(spark):
    area = [(0.0, 0.0), (1000.0, 0.0), (1400.0, 700.0), (0.0, 900.0)]
    total = risk.hex_grid(spark, area, 90.0, min_area_m2=0.0).agg(F.sum("area_m2")).first()[0]
    want = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(area, area[1:] + area[:1]))) / 2
    assert total == pytest.approx(want, rel=1e-9)


def test_risk_levels_of_single_anomalies(spark):
    """One active anomaly at a cell centre: critical 50, high 29, medium 14, low 7."""
    from datetime import datetime, timezone

    from assetpulse.functions.timeaxis import TimeAxis
    from assetpulse.params import Params

    axis = TimeAxis(0, 3, 3600)
    cells = risk.hex_cover(spark, (-400.0, -400.0, 400.0, 400.0), 150.0)
    for severity, want in (("critical", 50.0), ("high", 28.57), ("medium", 14.29), ("low", 7.14)):
        t = datetime(1970, 1, 1, tzinfo=timezone.utc)
        an = spark.createDataFrame([(0.0, 0.0, severity, t, t.replace(hour=2))], "x double, y double, severity string, started_at timestamp, ended_at timestamp")
        got = risk.risk_surface(cells, an, axis, Params()).where("cell_id = '0_0' AND step = 1").first()
        assert got.risk_score == want and got.anomaly_count == 1


def brute_dbscan(points, eps_m, eps_h, minimum):
    def near(a, b):
        d = math.hypot(a[1] - b[1], a[2] - b[2]) / eps_m
        gap = max(max(a[3], b[3]) - min(a[4], b[4]), 0) / (eps_h * 3600)
        return d <= 1 and gap <= 1

    n = {a[0]: [b[0] for b in points if near(a, b)] for a in points}
    core = {k for k, v in n.items() if len(v) >= minimum}
    label = {}
    for c in sorted(core):
        if c in label:
            continue
        stack = [c]
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = c
                stack += [y for y in n[x] if y in core and y not in label]
    for k, v in n.items():
        if k not in core and any(y in core for y in v):
            label[k] = min(label[y] for y in v if y in core)
    return label


@pytest.mark.parametrize("seed, eps, minimum", [(1, 60.0, 3), (2, 25.0, 4), (3, 150.0, 6), (4, 40.0, 1)])
def test_dbscan_equals_brute_force(spark, seed, eps, minimum):
    rng = random.Random(seed)
    pts = []
    for i in range(260):
        x, y = (100.0, 100.0) if rng.random() < 0.3 else (rng.random() * 900, rng.random() * 900)
        s = rng.random() * 20 * 86400
        pts.append((i, x, y, s, s + rng.choice([0, 3600, 5 * 86400]) * rng.random()))
    df = spark.createDataFrame(pts, "id bigint, x double, y double, s double, e double")
    got = {r.id: r.label for r in cluster.dbscan(df, eps, 24.0, minimum).collect()}
    assert got == brute_dbscan(pts, eps, 24.0, minimum)


def test_components_of_chain_star_and_singles(spark):
    edges = [(i, i + 1) for i in range(0, 63)] + [(100, i) for i in range(101, 160)]
    nodes = spark.createDataFrame([(i,) for i in range(200)], "id bigint")
    got = {r.id: r.component for r in components.connected_components(nodes, spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert all(got[i] == 0 for i in range(64)) and all(got[i] == 100 for i in range(100, 160)) and got[199] == 199


def test_hull_area(spark):
    square = [(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (50.0, 50.0), (100.0, 50.0)]
    rows = [(1, x, y) for x, y in square] * 3 + [(2, 0.0, 0.0), (2, 100.0, 0.0), (2, 50.0, 0.0)] + [(3, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "cluster_id bigint, x double, y double")
    got = {r.cluster_id: (len(r.hull), r.hull_hectares) for r in cluster.cluster_hulls(df, part_rows=2).collect()}
    circle = math.pi * 1600
    assert got[1] == (4, round((10000 + 400 * 40 + circle) / 1e4, 2))
    assert got[2][1] == round((200 * 40 + circle) / 1e4, 2) and got[3][1] == round(circle / 1e4, 2)


def test_one_to_one_equals_greedy(spark):
    rng = random.Random(5)
    pairs = [(f"l{rng.randrange(30)}", f"r{rng.randrange(25)}", round(rng.random() * 60, 2)) for _ in range(300)]
    pairs = list({(a, b): (a, b, d) for a, b, d in pairs}.values())
    used, want = set(), set()
    for d, a, b in sorted((d, a, b) for a, b, d in pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    df = spark.createDataFrame(pairs, "l string, r string, distance double")
    assert {(r.l, r.r) for r in gis.one_to_one(df, "l", "r").collect()} == want


def test_spread_sample_is_farthest_first(spark):
    pts = scatter(60, 9, hot=0.0)
    pool = spark.createDataFrame([(f"a{i:02d}", *v) for i, v in enumerate(pts)], "asset_id string, lon double, lat double")
    got = placement.spread_sample(pool, 6)
    by_id = {f"a{i:02d}": v for i, v in enumerate(pts)}
    chosen = [by_id[got[0].asset_id]]
    for row in got[1:]:
        best = max(sorted(by_id), key=lambda k: min(hav(by_id[k], c) for c in chosen))
        assert row.asset_id == best
        chosen.append(by_id[best])


def test_geometry_measures(spark):
    ring = [(-100.0, 37.0), (-100.0 + 0.01, 37.0), (-100.0 + 0.01, 37.01), (-100.0, 37.01)]
    df = spark.createDataFrame([([{"lon": x, "lat": y} for x, y in ring],)], "c array<struct<lon:double,lat:double>>")
    r = df.select(
        geo.polygon_area_m2(F.col("c")).alias("a"), geo.polygon_centroid(F.col("c")).alias("m"), geo.line_length(F.col("c")).alias("l"),
        geo.point_along(F.col("c"), 0.5).alias("h"), geo.point_in_ring(F.lit(-99.995), F.lit(37.005), F.col("c")).alias("i"),
        geo.point_in_ring(F.lit(-100.005), F.lit(37.005), F.col("c")).alias("o"), geo.signed_area_deg(F.col("c")).alias("s"),
        geo.utm_xy(F.lit(-99.0), F.lit(0.0), -99.0).alias("u"),
    ).first()
    assert r.a == pytest.approx(111320 * math.cos(math.radians(37.0)) * 0.01 * 110540 * 0.01)
    assert (r.m.lon, r.m.lat) == pytest.approx((-99.995, 37.005)) and r.s > 0
    assert r.l == pytest.approx(sum(hav(a, b) for a, b in zip(ring, ring[1:])))
    assert r.i and not r.o and (r.u.x, r.u.y) == pytest.approx((500000.0, 0.0))
    assert r.h.lon == pytest.approx(-99.99, abs=1e-6) and 37.0 < r.h.lat < 37.01


def test_clip_parts(spark):
    box = (-100.0, 37.0, -99.99, 37.01)

    def line(*pts):
        return [{"lon": float(x), "lat": float(y)} for x, y in pts]

    rows = [
        (1, line((-99.999, 37.005), (-99.991, 37.005))),  # inside
        (2, line((-100.1, 37.005), (-100.05, 37.005))),  # outside
        (3, line((-100.005, 37.005), (-99.995, 37.005))),  # enters
        (4, line((-99.998, 37.005), (-99.998, 37.02), (-99.992, 37.02), (-99.992, 37.001))),  # leaves and returns
        (5, line((-99.99002, 37.005), (-99.98, 37.005))),  # less than 5 m remain
    ]
    got = {r.id: r for r in gis.clip_lines(spark.createDataFrame(rows, "id int, coords array<struct<lon:double,lat:double>>"), box).collect()}
    assert not got[1].was_clipped and got[1].parts == 1
    assert got[2].clipped is None and got[5].clipped is None
    assert got[3].clipped[0].lon == -100.0 and got[3].was_clipped
    assert got[4].parts == 2 and got[4].length_m == pytest.approx(hav((-99.992, 37.01), (-99.992, 37.001)), abs=0.1)
    assert got[4].dropped_m == pytest.approx(hav((-99.998, 37.005), (-99.998, 37.01)), abs=0.1)


def test_within_crosses_the_date_line_and_the_poles(spark):
    """Equal to the cross join also where longitudes wrap."""
    import random

    from assetpulse.functions.geometry import haversine
    from assetpulse.operators import proximity

    rng = random.Random(5)
    places = [(rng.choice([179.999, -179.999, 0.0, 90.0]) + rng.uniform(-0.002, 0.0009), rng.choice([0.0, 60.0, 88.9, 89.9995, -89.9995]) + rng.uniform(-0.0004, 0.0004)) for _ in range(120)]
    df = spark.createDataFrame([(i, max(-180.0, x), y) for i, (x, y) in enumerate(places)], "id int, lon double, lat double")
    probe = df.selectExpr("id AS pid", "lon AS plon", "lat AS plat")
    got = {(r.pid, r.id) for r in proximity.within(probe, df, 120.0).collect()}
    cross = probe.crossJoin(df).where(haversine(F.col("plon"), F.col("plat"), F.col("lon"), F.col("lat")) <= 120.0)
    want = {(r.pid, r.id) for r in cross.collect()}
    assert got == want and len(want) > 150


def test_sensor_inside_an_area_has_distance_zero(spark):
    from assetpulse.operators import proximity

    ring = [(10.0, 50.0), (10.014, 50.0), (10.014, 50.009), (10.0, 50.009), (10.0, 50.0)]
    areas = spark.createDataFrame([("a", ring), ("line", ring[:3])], "asset_id string, coords array<struct<lon:double,lat:double>>")
    sensors = spark.createDataFrame(
        [("mid", "a", "t", "p", 10.007, 50.0045), ("edge", "x", "t", "p", 10.0141, 50.004), ("far", "x", "t", "p", 10.02, 50.02)],
        "sensor_id string, asset_id string, sensor_type string, placement string, lon double, lat double",
    )
    got = {(r.asset_id, r.sensor_id): r.distance_m for r in proximity.sensors_in_asset_areas(sensors, areas).collect()}
    assert got[("a", "mid")] == 0.0 and 0 < got[("a", "edge")] <= 25 and set(got) == {("a", "mid"), ("a", "edge"), ("line", "edge")}


def test_quantile_repeats_where_the_bracket_fails(spark, monkeypatch):
    """A bracket from a useless sketch does not hold the rank; the counts tell, and the group is done again."""
    from assetpulse.operators import medians

    df = spark.range(5000).select((F.col("id") % 2).alias("k"), (F.col("id") * 7919 % 5003).cast("double").alias("v"))
    want = {r.k: r.m for r in df.groupBy("k").agg(F.percentile("v", F.lit(0.5)).alias("m")).collect()}
    plain = F.percentile_approx
    monkeypatch.setattr(medians.F, "percentile_approx", lambda c, q, a: plain(c, [min(1.0, x + 0.3) for x in q], a))
    got = {r.k: r.m for r in medians.grouped_quantile(df, ["k"], "v", 0.5, "m", accuracy=100).collect()}
    assert got == pytest.approx(want)


def test_nearest_cell_of_points_outside(spark):
    edge, area = 100.0, [(0.0, 0.0), (900.0, 0.0), (900.0, 700.0), (0.0, 700.0)]
    cells = risk.hex_grid(spark, area, edge)
    kept = {r.cell_id: (r.x, r.y) for r in cells.collect()}
    rng = random.Random(4)
    points = [(i, rng.uniform(-400, 1300), rng.uniform(-400, 1100)) for i in range(150)]
    points += [(150, 50_000.0, -3.0), (151, 50_000.0, -3.0), (152, None, 1.0), (153, float("nan"), 1.0), (154, 1.0, float("inf"))]
    df = spark.createDataFrame(points, "point_id bigint, x double, y double")
    own = {r.point_id: r.cell_id for r in risk.with_cell(df.where("point_id <= 151"), edge).collect()}
    got = {r.point_id: r.cell_id for r in risk.nearest_cell_fallback(df, cells, edge).collect()}
    assert len(got) == len(points) and [got[i] for i in (152, 153, 154)] == [None] * 3
    for i, x, y in points[:152]:
        want = own[i] if own[i] in kept else min(kept, key=lambda c: ((x - kept[c][0]) ** 2 + (y - kept[c][1]) ** 2, c))
        assert got[i] == want
    assert {r.cell_id for r in risk.nearest_cell_fallback(df, cells.limit(0), edge).collect()} == {None}


def test_buckets_of_level_and_steep_segments(spark):
    rng = random.Random(5)
    ends = [(-100.0, 37.75, -99.98, 37.75), (-100.0, 37.75, -100.0, 37.73), (-100.0, 37.75, -99.99, 37.76), (-100.0, 37.75, -100.0, 37.75), (-100.0, float("nan"), 0.0, 0.0)]
    seg = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, ax double, ay double, bx double, by double")
    b = proximity.Buckets(40.0)
    rows = [(r.i, r.cx, r.cy) for r in proximity.cells_along(seg, b).collect()]
    assert len(rows) == len(set(rows)) and not any(i == 4 for i, _, _ in rows)
    # every place within the radius of a segment lies in one of its buckets
    near = []
    for i, (ax, ay, bx, by) in enumerate(ends[:4]):
        for _ in range(200):
            t, turn, far = rng.random(), rng.random() * 2 * math.pi, rng.random() * 39.9
            lat = ay + t * (by - ay) + far * math.sin(turn) / 111195.0
            near.append((i, ax + t * (bx - ax) + far * math.cos(turn) / (111195.0 * math.cos(math.radians(lat))), lat))
    p = spark.createDataFrame(near, "i int, lon double, lat double")
    visited = p.select("i", b.of(F.col("lon"), F.col("lat")).alias("b")).select("i", "b.cx", "b.cy").collect()
    assert {(r.i, r.cx, r.cy) for r in visited} <= set(rows)


def test_nearest_join_of_dense_targets_starts_small(spark):
    rng = random.Random(7)
    targets = [(f"T{i:04d}", -100.0 + rng.random() * 0.002, 37.75 + rng.random() * 0.002) for i in range(2000)]
    points = [(i, -100.0 + rng.random() * 0.002, 37.75 + rng.random() * 0.002) for i in range(100)] + [(100, -99.9, 37.9)]
    t = spark.createDataFrame(targets, "target_id string, lon double, lat double")
    p = spark.createDataFrame(points, "point_id int, plon double, plat double")
    assert proximity.first_radius(t, 200.0) < 10.0
    assert proximity.first_radius(t.limit(1), 200.0) == 200.0
    got = {r.point_id: (r.distance, r.target_id) for r in proximity.nearest_join(p, t, 200.0).collect()}
    assert len(got) == len(points)
    for i, *at in points:
        d, target = min((hav(at, c), name) for name, *c in targets)
        assert got[i][1] == target and abs(got[i][0] - d) < 1e-6


def test_shapes_within_radius_reach_the_plane_and_not_the_sphere(spark):
    # 399.9 m north in the local plane, 402.3 m on the sphere
    line = [(-100.0, 37.7535 + 399.9 / 110540.0), (-100.0, 37.77)]
    shapes = spark.createDataFrame([("a", line)], "asset_id string, coords array<struct<lon:double,lat:double>>")
    assert [tuple(r) for r in proximity.shapes_within_radius(shapes, -100.0, 37.7535, 400.0).collect()] == [("a", 399.9, False)]


def test_anomalies_travel_with_their_places(spark, monkeypatch):
    monkeypatch.setattr(proximity, "PLACE_ROWS", 4)
    an = [(f"N{i:03d}", f"A{i % 3}", -100.0 + (i % 2) * 0.0005, 37.75) for i in range(40)]
    assets = [(f"A{i}", "road", f"n{i}", -100.0 + i * 0.0004, 37.75) for i in range(5)]
    a = spark.createDataFrame(an, "anomaly_id string, asset_id string, lon double, lat double")
    t = spark.createDataFrame(assets, "asset_id string, asset_type string, name string, lon double, lat double")
    near = proximity.assets_near_anomalies(a, t, 60.0)
    want = sorted((n, x) for n, host, *p in an for x, _, _, *q in assets if hav(p, q) <= 60.0 and x != host)
    assert sorted((r.anomaly_id, r.near_asset_id) for r in near.collect()) == want
    plan = near._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert 0 < plan.index("ASIN") < plan.index("Exchange")  # pairs are not shuffled after the distance test


def test_tiles_equal_pairs_of_shapes(spark, monkeypatch):
    """Counts, weights and lists by tiles are those of single pairs, across 180 degrees, with crowded tiles in parts and wide shapes."""
    from assetpulse.operators import tiles

    monkeypatch.setattr(tiles, "LIST_PLACES", 5)
    monkeypatch.setattr(tiles.Tiling.__init__, "__defaults__", (6, 10))
    rng, lon, lat = random.Random(3), 179.9999, 37.75
    wrap = lambda x: (x + 180.0) % 360.0 - 180.0
    shapes = {}
    for i in range(30):
        x, y = lon + rng.uniform(-1, 1) * 0.004, lat + rng.uniform(-1, 1) * 0.003
        ring = [(x, y), (x + 0.002, y + 0.0005), (x + 0.0005, y + 0.002)]
        shapes[f"A{i:02d}"] = [ring[:1], ring, ring + ring[:1]][i % 3]
    shapes["A90"] = [(lon - 0.3, lat), (lon + 0.3, lat + 0.001)]
    rows = [(k, "road", f"n{k}", False, [(wrap(x), y) for x, y in v]) for k, v in shapes.items()]
    assets = spark.createDataFrame(rows, "asset_id string, asset_type string, name string, is_simulated boolean, coords array<struct<lon:double,lat:double>>")
    an = [(f"N{i:02d}", f"A{i % 30:02d}", lon + rng.uniform(-1, 1) * 0.004, lat + rng.uniform(-1, 1) * 0.003) for i in range(24)]
    an += [("N90", "A01", *an[0][2:]), ("N91", "A02", None, lat)]
    a = spark.createDataFrame([(*r[:2], None if r[2] is None else wrap(r[2]), r[3]) for r in an], "anomaly_id string, asset_id string, lon double, lat double")
    want = {(n, k): to_shape(p, v) for n, _, *p in an if p[0] is not None for k, v in shapes.items()}
    hosts = {n: host for n, host, *_ in an}
    pairs = {(n, k): d for (n, k), d in want.items() if d <= 150.0 and hosts[n] != k}
    got = proximity.assets_near_anomalies(a, assets, 150.0).collect()
    assert {(r.anomaly_id, r.near_asset_id): r.distance_m for r in got} == pytest.approx(pairs, abs=0.06) and len(got) == len(pairs)
    counts = {r.anomaly_id: r.nearby_assets for r in proximity.nearby_asset_counts(a, assets, 150.0).collect()}
    assert counts == {n: sum(1 for m, _ in pairs if m == n) for n in hosts} and max(counts.values()) > 1
    lists = {r.anomaly_id: r.nearby for r in proximity.with_nearby_assets(a, assets, 150.0).collect()}
    assert {n: sorted(x.near_asset_id for x in v or []) for n, v in lists.items()} == {n: sorted(k for m, k in pairs if m == n) for n in hosts}
    assert all(v is None or [x.distance_m for x in v] == sorted(x.distance_m for x in v) for v in lists.values())


def test_pairs_near_places_are_not_shuffled(spark):
    """What leaves a tile is a row a place: no exchange above the distances of lists, none of pairs anywhere."""
    a = spark.createDataFrame([(f"N{i}", f"A{i}", -100.0 + i * 0.0002, 37.75) for i in range(9)], "anomaly_id string, asset_id string, lon double, lat double")
    assets = spark.createDataFrame([(f"A{i}", -100.0 + i * 0.0002, 37.75) for i in range(9)], "asset_id string, lon double, lat double")
    plan = proximity.with_nearby_assets(a, assets, 60.0)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in plan and "Exchange" not in plan[: plan.index("CoGroup")]


def test_matching_of_a_chain_takes_few_rounds(spark, monkeypatch):
    """Each pair of the chain waits for the one before; rounds of grouped minima take the start, one task the rest."""
    stored, store = [], gis.materialize
    monkeypatch.setattr(gis, "materialize", lambda *args: (stored.append(args[1]), store(*args))[1])
    pairs = [(f"l{i:03}", f"r{i:03}", float(2 * i)) for i in range(60)] + [(f"l{i + 1:03}", f"r{i:03}", float(2 * i + 1)) for i in range(59)]
    df = spark.createDataFrame(pairs, "l string, r string, distance double")
    want = {(f"l{i:03}", f"r{i:03}") for i in range(60)}
    assert {(r.l, r.r) for r in gis.one_to_one(df, "l", "r").collect()} == want
    assert len(stored) <= 2
    monkeypatch.setattr(gis, "FEW_PAIRS", 115)
    assert {(r.l, r.r) for r in gis.one_to_one(df, "l", "r").collect()} == want
    assert gis.one_to_one(df.where("false"), "l", "r").count() == 0


def test_buckets_of_lines_are_not_broadcast_by_a_guess(spark, monkeypatch):
    """A line of a kilometre has thousands of buckets, and Spark takes them for one row."""
    rng = random.Random(2)
    lines = [(i, [(-100.0 + rng.random() * 0.01, 37.7 + rng.random() * 0.01) for _ in range(3)]) for i in range(6)]
    lines = spark.createDataFrame(lines, "line_id int, coords array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([(i, -100.0 + rng.random() * 0.01, 37.7 + rng.random() * 0.01) for i in range(400)], "point_id int, lon double, lat double")
    few = {(r.line_id, r.point_id): r.distance for r in proximity.points_near_lines(points, lines, 20.0).collect()}
    monkeypatch.setattr(proximity, "SALT_ROWS", 100)
    near = proximity.points_near_lines(points, lines, 20.0)
    assert {(r.line_id, r.point_id): r.distance for r in near.collect()} == few and few
    assert "ShuffledHashJoin" in near._jdf.queryExecution().executedPlan().toString()


def test_inventory_is_decoded_once(spark, monkeypatch):
    """Every radius reads the decoded records; a plan that decodes them in its filters has megabytes."""
    plans, store = {}, gis.materialize
    def kept(df, label, *args):
        plans.setdefault(label, []).append(df._jdf.queryExecution().executedPlan().toString())
        return store(df, label, *args)
    monkeypatch.setattr(gis, "materialize", kept)
    entries = {"STRUCTURE_NUMBER_008": "B1", "LAT_016": "37450600", "LONG_017": "100005400", "FACILITY_CARRIED_007": "MAIN ST"}
    features = spark.createDataFrame([(entries, -100.015, 37.7518)], "attributes map<string,string>, lon double, lat double")
    chains = spark.createDataFrame([(7, "highway:primary", [(-100.016, 37.7518), (-100.014, 37.7518)])], "chain_id bigint, bridge_class string, coords array<struct<lon:double,lat:double>>")
    found = gis.attach_inventory(gis.decode_inventory(features, 2024), chains, (-100.1, 37.7, -100.0, 37.8))
    assert [(r.outcome, r.chain_id) for r in found.collect()] == [("matched", 7)]
    assert max(len(p) for p in plans["match-pairs"]) < 50_000


def test_sensors_in_areas_are_the_same_in_parts_and_pairs_are_not_shuffled(spark, monkeypatch):
    rng = random.Random(12)
    spot = lambda: (-100.0 + rng.random() * 0.004, 37.7 + rng.random() * 0.003)
    areas = []
    for i in range(30):
        line = [spot() for _ in range(3)]
        areas.append((f"A{i:02}", line + line[:1] if i % 3 == 0 else line))
    areas = spark.createDataFrame(areas, "asset_id string, coords array<struct<lon:double,lat:double>>")
    sensors = spark.createDataFrame([(f"S{i:03}", f"A{i % 30:02}", "t", "p", *spot()) for i in range(300)], "sensor_id string, asset_id string, sensor_type string, placement string, lon double, lat double")
    shapes, points = areas.withColumnRenamed("asset_id", "line_id"), sensors.withColumnRenamed("sensor_id", "point_id")
    want = {(r.line_id, r.point_id): r.distance for r in proximity.points_near_lines(points, shapes, 25.0).collect()}
    want |= {(r.line_id, r.point_id): 0.0 for r in proximity.points_in_rings(points, shapes).collect()}
    for rows in (100_000, 100, 10):  # at once, in four parts, by buckets
        monkeypatch.setattr(proximity, "SALT_ROWS", rows)
        found = proximity.sensors_in_asset_areas(sensors, areas).collect()
        assert {(r.asset_id, r.sensor_id) for r in found} == set(want) and len(found) == len(want) > 300
        assert all(abs(r.distance_m - want[(r.asset_id, r.sensor_id)]) <= 0.0501 and r.mounted_on_this_asset == (r.host_asset_id == r.asset_id) for r in found)
    monkeypatch.setattr(proximity, "SALT_ROWS", 100_000)
    plan = proximity.points_near_lines(points, shapes, 25.0)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "hashpartitioning(line_id" in plan
    assert not [x for x in plan.splitlines() if "hashpartitioning(line_id" in x and "point_id" in x]


def test_crowds_of_pairs_are_spread(spark):
    """A few kilobytes of places bring many pairs: they are not gathered in one task for their size."""
    rng = random.Random(3)
    assets = spark.createDataFrame([(f"A{i:03}", "road", "n", -100.0 + rng.random() * 0.002, 37.7) for i in range(200)], "asset_id string, asset_type string, name string, lon double, lat double")
    anomalies = spark.createDataFrame([(f"N{i:03}", "A000", -100.0 + rng.random() * 0.002, 37.7) for i in range(200)], "anomaly_id string, asset_id string, lon double, lat double")
    near = proximity.assets_near_anomalies(anomalies, assets, 500.0)
    assert near.count() == 200 * 199
    assert "REPARTITION_BY_NUM" in near._jdf.queryExecution().executedPlan().toString()


def test_matching_forms_few_pairs(spark):
    """Matching in growing radii is the matching of all pairs, and dense sides meet only as far as they must."""
    rng = random.Random(8)
    a = spark.createDataFrame([(i, -100.0 + rng.random() * 0.002, 37.75 + rng.random() * 0.001) for i in range(40)], "i int, plon double, plat double")
    b = spark.createDataFrame([(j, -100.0 + rng.random() * 0.002, 37.75 + rng.random() * 0.001) for j in range(90)], "j int, lon double, lat double")
    formed = []

    def near(radius, taken):
        pairs = proximity.within(gis.free(a, "i", taken, "i"), gis.free(b, "j", taken, "j"), radius).select("i", "j", "distance")
        formed.append(pairs.count())
        return pairs

    whole = proximity.within(a, b, 60.0).select("i", "j", "distance")
    got = sorted(tuple(r) for r in gis.one_to_one_within(near, "i", "j", 60.0).collect())
    assert got == sorted(tuple(r) for r in gis.one_to_one(whole, "i", "j").collect()) and got
    assert sum(formed) < whole.count() / 2


def test_dense_units_are_linked_by_their_outermost_members(spark):
    rng = random.Random(7)
    blob = lambda x0, n: [(x0 + rng.random() * 60, rng.random() * 60) for _ in range(n)]
    places = blob(0, 120) + blob(75, 120) + blob(400, 60)
    pts = [(i, x, y, 0.0, 0.0) for i, (x, y) in enumerate(places)]
    df = spark.createDataFrame(pts, "id bigint, x double, y double, s double, e double")
    placed = cluster.place_in_units(df, 100.0, 3600.0)
    assert max(r["count"] for r in cluster.outermost(placed).groupBy("unit").count().collect()) <= 8
    assert dealt(spark.createDataFrame([("a", "b")], "u string, v string"), "u", "v").rdd.getNumPartitions() > 1
    labels = {r.id: r.label for r in cluster.dbscan(df, 100.0, 1.0, 3).collect()}
    assert labels == {i: 0 if i < 240 else 240 for i in range(300)}


def test_chains_are_walked_without_a_task_call_per_chain(spark):
    at = lambda *xs: [(float(x), 0.0) for x in xs]
    rows = [
        (5, "a", [1, 9, 2], at(0, 1, 2), "west"), (2, "a", [3, 8, 2], at(4, 3, 2), "mid"), (9, "a", [3, 7, 4], at(4, 5, 6), "west"),
        (7, "b", [4, 6], at(6, 7), None), (11, "a", [20, 21, 20], at(9, 10, 9), "loop"),
    ]
    ways = spark.createDataFrame(rows, "id bigint, bridge_class string, nodes array<bigint>, coords array<struct<lon:double,lat:double>>, name string")
    df = gis.merge_chains(ways)
    got = {r.chain_id: (r.bridge_class, r.way_ids, [c.lon for c in r.coords], r.names) for r in df.collect()}
    assert got == {
        2: ("a", [9, 2, 5], [6.0, 5.0, 4.0, 3.0, 2.0, 1.0, 0.0], ["mid", "west"]),
        7: ("b", [7], [6.0, 7.0], []),
        11: ("a", [11], [9.0, 10.0, 9.0], ["loop"]),
    }
    assert "FlatMapGroups" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("accuracy", [3, 10_000])
def test_counted_quantiles_equal_those_of_single_rows(spark, accuracy):
    from assetpulse.operators import medians

    rng = random.Random(3)
    rows = [("ab"[i % 2], float(rng.randrange(9)), rng.randrange(1, 2500)) for i in range(40)] + [("c", 4.0, 1), ("d", None, 2), ("d", math.nan, 2)]
    df = spark.createDataFrame(rows, "k string, v double, n bigint")
    wanted = {"p50": 0.5, "p90": 0.9}
    singles = df.withColumn("_", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int")))).drop("_")
    want = sorted(map(tuple, medians.grouped_quantiles(singles, ["k"], "v", wanted, top="top").collect()))
    got = sorted(map(tuple, medians.counted_quantiles(df, ["k"], "v", "n", wanted, top="top", accuracy=accuracy).collect()))
    assert got == want and len(got) == 3


def test_zonal_heights_take_equal_pixels_and_equal_rings_once(spark):
    from assetpulse.operators import zonal

    def square(k, x, side):
        return (k, [(x, 0.0), (x + side, 0.0), (x + side, side), (x, side)])

    polygons = spark.createDataFrame([square(1, 0.5, 39.0), square(2, 0.5, 39.0), square(3, 500.0, 9.0)], "polygon_id bigint, ring array<struct<lon:double,lat:double>>")
    pixels = [("old", 15.0, 15.0, 7.0)] + [("new", 5.0 + 10 * (i % 4), 5.0, 3.0 + i % 2) for i in range(400)] + [("new", 5.0, 5.0, None)]
    df = spark.createDataFrame(pixels, "project string, px double, py double, value double")
    assert zonal.stacked(df).count() == 5
    projects = spark.createDataFrame([("old", "2013"), ("new", "2018")], "project string, collected string")
    got = {r.polygon_id: tuple(r)[1:] for r in zonal.zonal_heights(polygons, df, projects, 10.0, 200.0).collect()}
    one = ("new", 400, 3.5, 4.0, 4.0, "ok")
    assert got == {1: one, 2: one, 3: (None, 0, None, None, None, "no_coverage")}


def test_nearest_shape_takes_areas_first_and_the_smallest_id_at_zero(spark):
    rng = random.Random(5)
    shapes = []
    for k in range(300):
        x, y, a = -100.0 + rng.random() * 0.01, 37.75 + rng.random() * 0.01, 0.0005 + rng.random() * 0.002
        ring = [(x, y), (x + a, y), (x + a, y + a), (x, y)]
        shapes.append((f"T{k:03d}", [ring, ring[:3], ring[:1]][k % 3]))
    far = [("Z1", [(179.9, 10.0), (-179.9, 10.0), (-179.9, 10.1), (179.9, 10.0)])]
    places = [(i, -100.002 + rng.random() * 0.014, 37.748 + rng.random() * 0.014) for i in range(80)]
    places += [(80 + i, *shapes[3 * i + 2][1][0]) for i in range(20)] + [(100, -179.95, 10.01), (101, 180.0, 10.0), (102, -99.5, 37.7)]
    t = spark.createDataFrame(shapes + far, "target_id string, coords array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame(places, "point_id bigint, plon double, plat double")
    at = tiles.first_touching(p.select("plon", "plat").distinct(), proximity.stored_shapes(t)).count()
    d = geo.shape_distance(F.col("plon"), F.col("plat"), F.col("coords"))
    want = p.crossJoin(t).withColumn("d", d).groupBy("point_id").agg(F.min(F.struct("d", "target_id")).alias("b")).select("point_id", "b.*")
    want = {r.point_id: r for r in want.collect()}
    assert at == sum(r.d == 0 for r in want.values()) > 20
    got = {r.point_id: r for r in proximity.nearest_join(p, t, 50.0).collect()}
    assert {k: r.target_id for k, r in got.items()} == {k: r.target_id for k, r in want.items()}
    assert all(abs(got[k].distance - want[k].d) < 1e-6 for k in want if want[k].d < 50_000)
    assert tiles.first_touching(p.select("plon", "plat"), t.where("size(coords) = 1")) is None


def test_distances_to_shapes_from_one_point_use_all_cores(spark):
    one = spark.createDataFrame([(f"A{i}", [(i * 0.001, 0.0)]) for i in range(9)], "asset_id string, coords array<struct<lon:double,lat:double>>").coalesce(1)
    df = proximity.from_point(one, 0.0, 0.0)
    assert df.rdd.getNumPartitions() > 1
    assert df.orderBy("distance").first().asset_id == "A0"


def test_points_near_lines_reach_the_radius_of_the_local_plane_without_a_distinct(spark):
    lines = spark.createDataFrame([("L", [(0.0, 0.0), (0.001, 0.0), (0.001, 0.001)])], "line_id string, coords array<struct<lon:double,lat:double>>")
    points = spark.createDataFrame([("P", 0.0009, 0.0001), ("Q", 0.0, 30.1 / 110540.0), ("R", 0.0, 29.99 / 110540.0)], "point_id string, lon double, lat double")
    near = proximity.points_near_lines(points, lines, 30.0)
    assert sorted((r.point_id, round(r.distance, 2)) for r in near.collect()) == [("P", 11.05), ("R", 29.99)]
    assert near._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [line_id") == 1  # the pairs alone
