"""Check statements of the proximity, grid, risk, cluster and evaluation queries: brute force over all pairs."""

from __future__ import annotations

from .oracle import STEP_US, cte, even, med, oracle, up

R = 6371008.8


def hav(a: str, b: str, lon: str = "lon", lat: str = "lat") -> str:
    return (
        f"2 * {R} * asin(sqrt(least(pow(sin(radians({b}.{lat} - {a}.{lat}) / 2), 2) + cos(radians({a}.{lat})) * "
        f"cos(radians({b}.{lat})) * pow(sin(radians({b}.{lon} - {a}.{lon}) / 2), 2), 1.0)))"
    )


def utm(name: str, source: str) -> None:
    """A table of ``source`` rows with UTM x, y."""
    a, e2 = 6378137.0, 0.0066943799901413165
    ep2 = e2 / (1 - e2)
    cte(f"{name}1", f"""
    SELECT *, radians(lat) AS phi, {a} / sqrt(1 - {e2} * pow(sin(radians(lat)), 2)) AS nn,
           pow(tan(radians(lat)), 2) AS tt, {ep2} * pow(cos(radians(lat)), 2) AS cc,
           radians(lon + 99.0) * cos(radians(lat)) AS aa FROM {source}
    """)
    cte(f"{name}2", f"""
    SELECT *, {a} * ({1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256!r} * phi
           - {3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024!r} * sin(2 * phi)
           + {15 * e2**2 / 256 + 45 * e2**3 / 1024!r} * sin(4 * phi) - {35 * e2**3 / 3072!r} * sin(6 * phi)) AS mm
    FROM {name}1
    """)
    cte(name, f"""
    SELECT *, 500000.0 + 0.9996 * nn * (aa + (1 - tt + cc) * pow(aa, 3) / 6
               + (5 - 18 * tt + tt * tt + 72 * cc - {58 * ep2!r}) * pow(aa, 5) / 120) AS x,
           0.9996 * (mm + nn * tan(phi) * (aa * aa / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * pow(aa, 4) / 24
               + (61 - 58 * tt + tt * tt + 600 * cc - {330 * ep2!r}) * pow(aa, 6) / 720)) AS y
    FROM {name}2
    """)


cte("ctr", "SELECT -100.0175 AS lon, 37.7535 AS lat")
cte("dist", f"SELECT assets.*, {hav('ctr', 'assets')} AS d FROM assets, ctr")
oracle("assets_within_radius", f"SELECT asset_id, asset_type, name, {up('d', 1)} AS distance_m FROM dist WHERE d <= 400")
oracle("radius_summary", f"""
SELECT asset_type, count(*) AS assets, min({up('d', 1)}) AS nearest_m, max({up('d', 1)}) AS farthest_m
FROM dist WHERE d <= 400 GROUP BY asset_type
""")
cte("near", f"""
SELECT an.anomaly_id, an.asset_id, an.s_us, an.e_us, an.rk, a.asset_id AS near_id, a.asset_type, a.name, a.is_simulated,
       {hav('an', 'a')} AS d FROM an, assets a
""")
oracle("assets_near_anomaly", f"""
SELECT anomaly_id, near_id AS near_asset_id, asset_type, {up('d', 1)} AS distance_m FROM near
WHERE d <= 100 AND near_id <> asset_id
""")
oracle("assets_near_top_anomaly", f"""
SELECT anomaly_id, near_id AS near_asset_id, near_id = asset_id AS is_host_asset, {up('d', 1)} AS distance_m FROM near
WHERE d <= 300 AND anomaly_id = (SELECT anomaly_id FROM an ORDER BY anomaly_score DESC, anomaly_id LIMIT 1)
""")
oracle("nearby_counts", """
SELECT anomaly_id, count(*) FILTER (WHERE d <= 100 AND near_id <> asset_id) AS nearby_assets FROM near GROUP BY anomaly_id
""")
oracle("assets_near_active", f"""
SELECT near_id AS asset_id, name, asset_type, is_simulated, count(*) AS active_anomalies,
       ['low', 'medium', 'high', 'critical'][max(rk)] AS max_severity, arg_min(anomaly_id, (d, anomaly_id)) AS nearest_anomaly_id,
       {up('min(d)', 1)} AS distance_m
FROM near, now WHERE d <= 300 AND s_us <= now.us AND e_us >= now.us GROUP BY 1, 2, 3, 4
""")
cte("sa", f"SELECT s.sensor_id, a.asset_id AS aid, a.asset_type, {hav('s', 'a')} AS d FROM sn s, assets a")
oracle("nearest_asset", f"""
SELECT sensor_id AS point_id, arg_min(aid, (d, aid)) AS target_id, {up('min(d)', 1)} AS distance_m FROM sa GROUP BY sensor_id
""")
oracle("nearest_asset_by_type", f"""
SELECT sensor_id AS point_id, asset_type, arg_min(aid, (d, aid)) AS target_id, {up('min(d)', 1)} AS distance_m
FROM sa GROUP BY sensor_id, asset_type
""")
oracle("nearest_per_type", f"""
SELECT searched_type, asset_id, asset_type, name, {up('d', 1)} AS distance_m FROM (
  SELECT *, row_number() OVER (PARTITION BY searched_type ORDER BY d, asset_id) AS rn FROM (
    SELECT asset_type AS searched_type, * FROM dist UNION ALL SELECT 'any type', * FROM dist)) WHERE rn = 1
""")
oracle("five_nearest", f"""
SELECT asset_id, asset_type, name, {up('d', 1)} AS distance_m FROM dist ORDER BY d, asset_id LIMIT 5
""")
cte("vtx", """
SELECT *, lon + ((num % 11) - 5) * 0.0002::DOUBLE AS lon2, lat + ((num % 13) - 6) * 0.0002::DOUBLE AS lat2,
       lon + ((num % 17) - 8) * 0.0002::DOUBLE AS lon3, lat + ((num % 7) - 3) * 0.0002::DOUBLE AS lat3 FROM assets
""")
cte("seg", """
SELECT asset_id, asset_type, lon AS ax, lat AS ay, lon2 AS bx, lat2 AS byy FROM vtx
UNION ALL SELECT asset_id, asset_type, lon2, lat2, lon3, lat3 FROM vtx
""")
cte("sgd", """
SELECT s.sensor_id, s.asset_id AS host, s.sensor_type, s.placement, g.asset_id, g.asset_type,
       (s.lon - g.ax) * 111320.0 * cos(radians(s.lat)) AS ex, (s.lat - g.ay) * 110540.0 AS ey,
       (g.bx - g.ax) * 111320.0 * cos(radians(s.lat)) AS dx, (g.byy - g.ay) * 110540.0 AS dy FROM sn s, seg g
""")
cte("sgt", """
SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0
          ELSE greatest(0.0, least(1.0, (ex * dx + ey * dy) / (dx * dx + dy * dy))) END AS t FROM sgd
""")
cte("sl", """
SELECT sensor_id, host, sensor_type, placement, asset_id, asset_type,
       min(sqrt(pow(ex - t * dx, 2) + pow(ey - t * dy, 2))) AS d FROM sgt GROUP BY 1, 2, 3, 4, 5, 6
""")
for name, radius, extra in (
    ("sensors_in_asset_area", 25, ""),
    ("sensors_of_top_asset", 100,
     "AND asset_id = (SELECT asset_id FROM sn GROUP BY asset_id ORDER BY count(*) DESC, asset_id LIMIT 1)"),
):
    oracle(name, f"""
    SELECT asset_id, sensor_id, host AS host_asset_id, sensor_type, placement, host = asset_id AS mounted_on_this_asset,
           d <= 0.5 AS on_asset_geometry, {up('d', 1)} AS distance_m FROM sl WHERE d <= {radius} {extra}
    """)
cte("edge", f"""
SELECT asset_id, false AS ring, ax, ay, bx, byy FROM seg
UNION ALL SELECT 'ring-' || asset_id, true, ax, ay, bx, byy FROM seg
UNION ALL SELECT 'ring-' || asset_id, true, lon3, lat3, lon, lat FROM vtx
""")
cte("edged", """
SELECT e.asset_id, ring, (c.lon - ax) * 111320.0 * cos(radians(c.lat)) AS ex, (c.lat - ay) * 110540.0 AS ey,
       (bx - ax) * 111320.0 * cos(radians(c.lat)) AS dx, (byy - ay) * 110540.0 AS dy FROM edge e, ctr c
""")
cte("shaped", """
SELECT asset_id, ring AND (bool_and(dx * ey - dy * ex > 0) OR bool_and(dx * ey - dy * ex < 0)) AS inside,
       min(sqrt(pow(ex - t * dx, 2) + pow(ey - t * dy, 2))) AS edge_m
FROM (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0
                ELSE greatest(0.0, least(1.0, (ex * dx + ey * dy) / (dx * dx + dy * dy))) END AS t FROM edged)
GROUP BY asset_id, ring
""")
oracle("shapes_within_radius", f"""
SELECT asset_id, {up('d', 1)} AS distance_m, inside FROM (SELECT *, CASE WHEN inside THEN 0.0 ELSE edge_m END AS d FROM shaped) WHERE d <= 400
""")
# points, lines and areas on the spheroid: every place against every side
A_M, E2 = 6378137.0, 0.0066943799901413165
cte("side", """
SELECT asset_id, num % 3 = 2 AS ring, lon AS ax, lat AS ay, lon AS bx, lat AS byy FROM vtx WHERE num % 3 = 0
UNION ALL SELECT asset_id, num % 3 = 2, lon, lat, lon2, lat2 FROM vtx WHERE num % 3 > 0
UNION ALL SELECT asset_id, num % 3 = 2, lon2, lat2, lon3, lat3 FROM vtx WHERE num % 3 > 0
UNION ALL SELECT asset_id, true, lon3, lat3, lon, lat FROM vtx WHERE num % 3 = 2
""")
cte("spot", "SELECT DISTINCT lon AS px, lat AS py FROM sn UNION SELECT lon, lat FROM ctr")
cte("sided", f"""
SELECT px, py, asset_id, ring, ax, ay, bx - ax AS dx, byy - ay AS dy, px - ax AS ex, py - ay AS ey,
       cos(radians(py)) * (1 - {E2} * pow(sin(radians(py)), 2)) / {1 - E2!r} AS k FROM spot, side
""")
cte("foot", """
SELECT *, ax + t * dx AS fx, ay + t * dy AS fy FROM (
  SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0.0
            ELSE greatest(0.0, least(1.0, (ex * dx * k * k + ey * dy) / (pow(dx * k, 2) + dy * dy))) END AS t FROM sided)
""")
cte("reached", f"""
SELECT px, py, asset_id, CASE WHEN bool_and(ring) AND (bool_and(dx * ey - dy * ex > 0) OR bool_and(dx * ey - dy * ex < 0)) THEN 0.0
       ELSE min(sqrt(pow(radians(fy - py) * {A_M * (1 - E2)!r} / pow(1 - {E2} * pow(sin(radians((py + fy) / 2)), 2), 1.5), 2)
         + pow(radians(fx - px) * cos(radians((py + fy) / 2)) * {A_M} / sqrt(1 - {E2} * pow(sin(radians((py + fy) / 2)), 2)), 2))) END AS d
FROM foot GROUP BY px, py, asset_id
""")
cte("shape_near", """
SELECT an.anomaly_id, an.asset_id, an.s_us, an.e_us, an.rk, a.asset_id AS near_id, a.asset_type, a.name, a.is_simulated, r.d
FROM an JOIN reached r ON r.px = an.lon AND r.py = an.lat JOIN assets a ON a.asset_id = r.asset_id WHERE r.d <= 300
""")
oracle("shapes_near_anomaly", f"""
SELECT anomaly_id, near_id AS near_asset_id, asset_type, {up('d', 1)} AS distance_m FROM shape_near WHERE d <= 100 AND near_id <> asset_id
""")
oracle("nearby_shape_counts", """
SELECT anomaly_id, (SELECT count(*) FROM shape_near s WHERE s.anomaly_id = an.anomaly_id AND d <= 100 AND near_id <> an.asset_id) AS nearby_assets FROM an
""")
oracle("shapes_near_active", f"""
SELECT near_id AS asset_id, name, asset_type, is_simulated, count(*) AS active_anomalies,
       ['low', 'medium', 'high', 'critical'][max(rk)] AS max_severity, arg_min(anomaly_id, (d, anomaly_id)) AS nearest_anomaly_id,
       {up('min(d)', 1)} AS distance_m
FROM shape_near, now WHERE s_us <= now.us AND e_us >= now.us GROUP BY 1, 2, 3, 4
""")
oracle("nearest_shape", f"""
SELECT sensor_id AS point_id, arg_min(r.asset_id, (d, r.asset_id)) AS target_id, {up('min(d)', 1)} AS distance_m FROM sn JOIN reached r ON px = lon AND py = lat GROUP BY sensor_id
""")
oracle("nearest_shape_by_type", f"""
SELECT sensor_id AS point_id, a.asset_type, arg_min(a.asset_id, (d, a.asset_id)) AS target_id, {up('min(d)', 1)} AS distance_m
FROM sn JOIN reached r ON px = sn.lon AND py = sn.lat JOIN assets a ON a.asset_id = r.asset_id GROUP BY 1, 2
""")
cte("shaped_types", """
SELECT a.*, d FROM reached r JOIN ctr ON px = ctr.lon AND py = ctr.lat JOIN assets a ON a.asset_id = r.asset_id
""")
oracle("nearest_shape_per_type", f"""
SELECT searched_type, asset_id, asset_type, name, {up('d', 1)} AS distance_m FROM (
  SELECT *, row_number() OVER (PARTITION BY searched_type ORDER BY d, asset_id) AS rn FROM (
    SELECT asset_type AS searched_type, * FROM shaped_types UNION ALL SELECT 'any type', * FROM shaped_types)) WHERE rn = 1
""")
oracle("road_proximity_rollup", """
SELECT l.asset_id AS line_id, count(*) AS sensors_nearby, CAST(coalesce(sum(n), 0) AS BIGINT) AS anomalies_nearby,
       CAST(coalesce(sum(act), 0) AS BIGINT) AS active_anomalies, CAST(coalesce(sum(w), 0) AS DOUBLE) AS weighted_severity
FROM sl l LEFT JOIN (SELECT sensor_id, count(*) AS n, count(*) FILTER (WHERE e_us >= now.us) AS act, sum(w) AS w
                     FROM an, now GROUP BY sensor_id) k ON k.sensor_id = l.sensor_id
WHERE l.d <= 30 AND l.asset_type = 'road' GROUP BY l.asset_id HAVING coalesce(sum(n), 0) > 0
ORDER BY weighted_severity DESC, anomalies_nearby DESC, line_id LIMIT 25
""")
oracle("outside_area", """
SELECT sensor_id, lon, lat FROM sn WHERE NOT (lon BETWEEN -100.027 AND -100.008 AND lat BETWEEN 37.747 AND 37.760)
""")
# --- hexagons and risk -------------------------------------------------------------------------------------------------
W, H, E = 225.0, 150.0 * 3**0.5, 150.0


def hexed(name: str, source: str) -> None:
    cte(f"{name}a", f"""
    SELECT *, floor(x / {W}) AS i0, floor(x / {W}) + 1 AS i1,
           floor(y / {H!r} - ((CAST(floor(x / {W}) AS BIGINT) % 2 + 2) % 2) * 0.5 + 0.5) AS j0,
           floor(y / {H!r} - (((CAST(floor(x / {W}) AS BIGINT) + 1) % 2 + 2) % 2) * 0.5 + 0.5) AS j1 FROM {source}
    """)
    cte(f"{name}b", f"""
    SELECT *, pow(x - i0 * {W}, 2) + pow(y - (j0 + ((CAST(i0 AS BIGINT) % 2 + 2) % 2) * 0.5) * {H!r}, 2) AS d0,
           pow(x - i1 * {W}, 2) + pow(y - (j1 + ((CAST(i1 AS BIGINT) % 2 + 2) % 2) * 0.5) * {H!r}, 2) AS d1 FROM {name}a
    """)
    cte(name, f"""
    SELECT *, CASE WHEN d0 <= d1 THEN CAST(i0 AS BIGINT) || '_' || CAST(j0 AS BIGINT)
              ELSE CAST(i1 AS BIGINT) || '_' || CAST(j1 AS BIGINT) END AS cell_id FROM {name}b
    """)


utm("ua", "assets")
utm("un", "an")
hexed("ha_cell", "ua")
hexed("hn", "un")
oracle("hex_cells", "SELECT asset_id, cell_id FROM ha_cell")
cte("bx", "SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM ua")
cte("hx", f"""
SELECT i, j, i || '_' || j AS cell_id, i * {W} AS x, (j + (i % 2) * 0.5) * {H!r} AS y FROM bx,
  unnest(range(CAST(ceil((x0 - {E}) / {W}) AS BIGINT), CAST(floor((x1 + {E}) / {W}) AS BIGINT) + 1)) AS u(i),
  unnest(range(CAST(floor((y0 - {E}) / {H!r}) AS BIGINT) - 1, CAST(ceil((y1 + {E}) / {H!r}) AS BIGINT) + 2)) AS v(j)
WHERE (j + (i % 2) * 0.5) * {H!r} BETWEEN y0 - {E} AND y1 + {E}
""")
oracle("anomaly_density", f"""
SELECT hx.cell_id, count(n.anomaly_id) AS anomaly_count, CAST(coalesce(sum(n.w), 0) AS BIGINT) AS weighted_severity,
       {even(f'count(n.anomaly_id) / ({1.5 * 3**0.5 * E * E!r} / 10000.0)', 3)} AS anomalies_per_hectare
FROM hx LEFT JOIN (SELECT hn.* FROM hn, now WHERE hn.s_us <= now.us) n ON n.cell_id = hx.cell_id GROUP BY hx.cell_id
""")
oracle("anomalies_per_asset_type", """
SELECT a.asset_type, count(*) AS anomaly_count, count(DISTINCT an.asset_id) AS assets_with_anomalies,
       CAST(sum(w) AS BIGINT) AS weighted_severity FROM an JOIN assets a ON a.asset_id = an.asset_id GROUP BY a.asset_type
""")
cte("rw", """
SELECT un.x, un.y, st.step, sum(un.w * CASE WHEN e_us >= st.us THEN 1.0
       ELSE pow(0.5, (st.us - e_us) / 3600000000.0 / 72.0) END) AS sw
FROM un, st WHERE s_us <= st.us AND st.us - e_us <= 14 * 24 * 3600000000 GROUP BY 1, 2, 3
""")
cte("rk0", f"""
SELECT hx.cell_id, rw.step, least(100.0, 100.0 / 14.0 * sum(rw.sw * exp(-(pow(hx.x - rw.x, 2) + pow(hx.y - rw.y, 2))
       / (2.0 * 250.0 * 250.0)))) AS raw FROM hx, rw GROUP BY 1, 2
""")
cte("rk1", f"SELECT cell_id, step, {even('raw', 2)} AS risk_score FROM rk0")
cte("rka", """
SELECT cell_id, step, count(*) AS k FROM hn, st WHERE s_us <= st.us AND e_us >= st.us GROUP BY 1, 2
""")
cte("rks", """
SELECT r.cell_id, r.step, r.risk_score, CASE WHEN risk_score >= 75 THEN 'very_high' WHEN risk_score >= 50 THEN 'high'
       WHEN risk_score >= 25 THEN 'moderate' ELSE 'low' END AS risk_level, coalesce(k, 0) AS anomaly_count
FROM rk1 r LEFT JOIN rka USING (cell_id, step) WHERE risk_score >= 0.5
""")
oracle("risk_surface", "SELECT * FROM rks")
cte("rknow", """
SELECT hx.cell_id, coalesce(r.risk_score, 0.0) AS risk_score, coalesce(r.risk_level, 'low') AS risk_level,
       coalesce(r.anomaly_count, 0) AS anomaly_count
FROM hx CROSS JOIN now LEFT JOIN rks r ON r.cell_id = hx.cell_id AND r.step = now.step
""")
oracle("risk_asof", "SELECT * FROM rknow")
oracle("risk_series", """
SELECT c.cell_id, st.step, CAST(floor(coalesce(r.risk_score, 0.0) + 0.5) AS BIGINT) AS risk
FROM (SELECT DISTINCT cell_id FROM rks) c CROSS JOIN st LEFT JOIN rks r ON r.cell_id = c.cell_id AND r.step = st.step
""")
oracle("risk_summary", """
SELECT b.risk_level, count(e.cell_id) AS n, (SELECT count(*) FROM rks) AS score_rows,
       (SELECT max(risk_score) FROM rks) AS max_score_overall,
       (SELECT coalesce(max(risk_score), 0.0) FROM rks, ax WHERE step = ax.n - 1) AS max_score_at_end
FROM (VALUES ('low'), ('moderate'), ('high'), ('very_high')) b(risk_level)
LEFT JOIN (SELECT hx.cell_id, coalesce(r.risk_level, 'low') AS risk_level FROM hx CROSS JOIN ax
           LEFT JOIN rks r ON r.cell_id = hx.cell_id AND r.step = ax.n - 1) e ON e.risk_level = b.risk_level
GROUP BY b.risk_level
""")


# --- clusters -------------------------------------------------------------------------------------------------------------
def dbscan(name: str, points: str, eps_m: float, eps_s: float, minimum: int) -> None:
    """``name``: (id, label) of the clustered points of (id, x, y, s, e)."""
    cte(f"{name}_p", points)
    cte(f"{name}_n", f"""
    SELECT a.id AS a, b.id AS b FROM {name}_p a, {name}_p b
    WHERE sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) / {eps_m} <= 1
      AND greatest(greatest(a.s, b.s) - least(a.e, b.e), 0.0) / {eps_s} <= 1
    """)
    cte(f"{name}_c", f"SELECT a AS id FROM {name}_n GROUP BY a HAVING count(*) >= {minimum}")
    cte(f"{name}_e", f"""
    SELECT n.a, n.b FROM {name}_n n JOIN {name}_c x ON x.id = n.a JOIN {name}_c y ON y.id = n.b
    """)
    cte(f"{name}_r", f"""
    SELECT id, id AS root FROM {name}_c UNION SELECT e.b, r.root FROM {name}_r r JOIN {name}_e e ON e.a = r.id
    """)
    cte(f"{name}_l", f"SELECT id, min(root) AS label FROM {name}_r GROUP BY id")
    cte(name, f"""
    SELECT id, label FROM {name}_l UNION ALL
    SELECT n.a, min(l.label) FROM {name}_n n JOIN {name}_l l ON l.id = n.b
    WHERE n.a NOT IN (SELECT id FROM {name}_c) GROUP BY n.a
    """)


dbscan("db_st", "SELECT anomaly_id AS id, x, y, s_us / 1e6 AS s, e_us / 1e6 AS e FROM un", 200.0, 48 * 3600.0, 3)
dbscan("db_em", "SELECT asset_id AS id, lon * 1000 AS x, lat * 1000 AS y, 0.0 AS s, 0.0 AS e FROM assets", 0.3, 3600.0, 3)
dbscan("db_sp", "SELECT anomaly_id AS id, x, y, 0.0 AS s, 0.0 AS e FROM un", 60.0, 3600.0, 3)
oracle("dbscan_space_time", "SELECT id, label FROM db_st")
oracle("dbscan_space", "SELECT id, label FROM db_em")
oracle("space_cluster_summary", """
SELECT label, count(*) AS n_anomalies, count(DISTINCT sensor_id) AS n_sensors, count(DISTINCT asset_id) AS n_assets,
       min(s_us) AS first_started_at, max(e_us) AS last_ended_at FROM db_sp JOIN an ON an.anomaly_id = db_sp.id GROUP BY label
""")
cte("cl", """
SELECT m.*, dense_rank() OVER (ORDER BY k.first_id) AS cluster_id FROM (SELECT d.id, d.label, an.* FROM db_st d
  JOIN an ON an.anomaly_id = d.id) m
JOIN (SELECT d.label, min(d.id) AS first_id FROM db_st d JOIN an ON an.anomaly_id = d.id GROUP BY d.label
      HAVING count(DISTINCT an.sensor_id) >= 3) k ON k.label = m.label
""")
oracle("cluster_members", "SELECT id, cluster_id FROM cl")
oracle("cluster_stats", """
SELECT cluster_id, count(*) AS n_anomalies, count(DISTINCT sensor_id) AS n_sensors, count(DISTINCT asset_id) AS n_assets,
       string_agg(DISTINCT sensor_type, ',' ORDER BY sensor_type) AS sensor_types,
       ['low', 'medium', 'high', 'critical'][max(rk)] AS max_severity, min(s_us) AS first_started_at,
       max(e_us) AS last_ended_at, round(avg(lon), 9) AS lon, round(avg(lat), 9) AS lat FROM cl GROUP BY cluster_id
""")
oracle("cluster_records", """
SELECT cluster_id, count(*) AS n_anomalies, string_agg(anomaly_id, ',' ORDER BY anomaly_id) AS anomaly_ids
FROM cl GROUP BY cluster_id
""")
# --- evaluation -----------------------------------------------------------------------------------------------------------
cte("mt", """
SELECT an.anomaly_id, le.event_id, an.s_us FROM an JOIN le ON le.sensor_id = an.sensor_id AND le.is_anomaly
 AND an.s_us <= le.e_us + 2 * 3600000000 AND an.e_us >= le.s_us - 2 * 3600000000
""")
cte("eh", """
SELECT le.event_id, le.event_type, count(mt.event_id) AS hits, (min(mt.s_us) - le.s_us) / 3600000000.0 AS delay
FROM le LEFT JOIN mt ON mt.event_id = le.event_id WHERE le.is_anomaly GROUP BY le.event_id, le.event_type, le.s_us
""")
cte("fa", """
SELECT an.anomaly_id, EXISTS (SELECT 1 FROM le WHERE NOT le.is_anomaly AND (le.sensor_type IS NULL OR
       le.sensor_type = an.sensor_type) AND an.s_us <= le.e_us AND an.e_us >= le.s_us) AS during_benign
FROM an WHERE anomaly_id NOT IN (SELECT anomaly_id FROM mt)
""")
oracle("event_hits", "SELECT event_id, event_type, hits, round(delay, 6) AS delay_hours FROM eh")
oracle("false_anomalies", "SELECT anomaly_id, during_benign FROM fa")
oracle("detection_delays", f"""
SELECT event_type, count(*) AS n, {even(med('delay'), 1)} AS median_delay_hours FROM eh WHERE hits > 0 GROUP BY event_type
""")
oracle("detection_evaluation", f"""
SELECT e.n AS injected_events, e.d AS detected_events, {even('e.d / e.n', 3)} AS event_recall, a.n AS anomalies,
       a.n - f.n AS true_anomalies, {even('(a.n - f.n) / a.n', 3)} AS anomaly_precision, f.n AS false_anomalies,
       f.b AS false_during_benign, e.s AS split_events
FROM (SELECT count(*) AS n, count(*) FILTER (WHERE hits > 0) AS d, count(*) FILTER (WHERE hits > 1) AS s FROM eh) e,
     (SELECT count(*) AS n FROM an) a, (SELECT count(*) AS n, count(*) FILTER (WHERE during_benign) AS b FROM fa) f
""")
oracle("severity_counts", """
SELECT b.severity, count(an.severity) AS n FROM (VALUES ('low'), ('medium'), ('high'), ('critical')) b(severity)
LEFT JOIN an ON an.severity = b.severity GROUP BY b.severity
""")
oracle("final_step_check", """
SELECT r.running, a.critical, a.high, NOT r.running OR (a.critical > 0 AND a.high > 0) AS holds
FROM (SELECT coalesce(bool_or(is_anomaly AND e_us >= now.us), false) AS running FROM le, now) r,
     (SELECT count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high
      FROM an, now WHERE e_us >= now.us) a
""")
cte("gv", """
SELECT le.event_id, min(an.anomaly_id) AS a, min(cl.cluster_id) AS c FROM le LEFT JOIN an ON an.sensor_id = le.sensor_id
 AND an.s_us <= le.e_us + 2 * 3600000000 AND an.e_us >= le.s_us - 2 * 3600000000
LEFT JOIN cl ON cl.id = an.anomaly_id WHERE le.event_type = 'label_error' GROUP BY le.event_id
""")
oracle("group_recovery", """
SELECT (SELECT count(*) FROM gv) AS events, (SELECT count(a) FROM gv) AS detected, b.c AS cluster_id,
       coalesce(b.n, 0) AS in_cluster, coalesce(b.n, 0) = (SELECT count(*) FROM gv) AS recovered
FROM (SELECT 1) LEFT JOIN (SELECT c, count(*) AS n FROM gv WHERE c IS NOT NULL GROUP BY c ORDER BY n DESC, c LIMIT 1) b ON true
""")
