"""Check statements of the registry ETL, matching, zonal, payload and streaming queries."""

from __future__ import annotations

from .oracle import STEP_US, cte, even, oracle
from .oracle_spatial import R, hav

W, S, E, N = -100.025, 37.750, -100.010, 37.758


def clip_cte(name: str, source: str) -> None:
    """Line clipping of two-segment lines (lon, lat) .. (lon3, lat3): one row per line with its parts."""
    cte(f"{name}s", f"""
    SELECT id, 1 AS k, lon AS ax, lat AS ay, lon2 AS bx, lat2 AS byy FROM {source}
    UNION ALL SELECT id, 2, lon2, lat2, lon3, lat3 FROM {source}
    """)
    cte(f"{name}t", f"""
    SELECT *, greatest(0.0, CASE WHEN bx > ax THEN ({W} - ax) / (bx - ax) WHEN bx < ax THEN ({E} - ax) / (bx - ax) END,
           CASE WHEN byy > ay THEN ({S} - ay) / (byy - ay) WHEN byy < ay THEN ({N} - ay) / (byy - ay) END) AS t0,
           least(1.0, CASE WHEN bx > ax THEN ({E} - ax) / (bx - ax) WHEN bx < ax THEN ({W} - ax) / (bx - ax) END,
           CASE WHEN byy > ay THEN ({N} - ay) / (byy - ay) WHEN byy < ay THEN ({S} - ay) / (byy - ay) END) AS t1,
           (bx <> ax OR ax BETWEEN {W} AND {E}) AND (byy <> ay OR ay BETWEEN {S} AND {N}) AS par FROM {name}s
    """)
    cte(f"{name}p", f"""
    SELECT id, k, par AND t0 <= t1 AS hit, t0, t1,
      {even(f'least(greatest(CASE WHEN t0 <= 0 THEN ax ELSE ax + (bx - ax) * t0 END, {W}), {E})', 7)} AS px,
      {even(f'least(greatest(CASE WHEN t0 <= 0 THEN ay ELSE ay + (byy - ay) * t0 END, {S}), {N})', 7)} AS py,
      {even(f'least(greatest(CASE WHEN t1 >= 1 THEN bx ELSE ax + (bx - ax) * t1 END, {W}), {E})', 7)} AS qx,
      {even(f'least(greatest(CASE WHEN t1 >= 1 THEN byy ELSE ay + (byy - ay) * t1 END, {S}), {N})', 7)} AS qy,
      2 * {R} * asin(sqrt(pow(sin(radians(byy - ay) / 2), 2) + cos(radians(ay)) * cos(radians(byy))
        * pow(sin(radians(bx - ax) / 2), 2))) AS full_m FROM {name}t
    """)
    cte(f"{name}h", f"""
    SELECT *, 2 * {R} * asin(sqrt(pow(sin(radians(qy - py) / 2), 2) + cos(radians(py)) * cos(radians(qy))
        * pow(sin(radians(qx - px) / 2), 2))) AS m, (px <> qx OR py <> qy) AS moves FROM {name}p
    """)
    cte(f"{name}j", f"""
    SELECT a.id, a.full_m + b.full_m AS original,
           (a.hit AND b.hit AND a.t1 >= 1 AND b.t0 <= 0) AS joined,
           CASE WHEN a.hit AND a.moves THEN a.m END AS m1, CASE WHEN b.hit AND b.moves THEN b.m END AS m2,
           CASE WHEN a.hit AND a.moves THEN 1 ELSE 0 END AS e1, CASE WHEN b.hit AND b.moves THEN 1 ELSE 0 END AS e2
    FROM {name}h a JOIN {name}h b ON b.id = a.id AND a.k = 1 AND b.k = 2
    """)
    cte(f"{name}r", f"""
    SELECT id, original, unnest(CASE WHEN joined THEN [coalesce(m1, 0) + coalesce(m2, 0)] ELSE [m1, m2] END) AS m,
           unnest(CASE WHEN joined THEN [e1 + e2] ELSE [e1, e2] END) AS moved FROM {name}j
    """)
    cte(name, f"""
    SELECT id, CAST(count(*) FILTER (WHERE m >= 5) AS BIGINT) AS parts, {even('max(m) FILTER (WHERE m >= 5)', 1)} AS length_m,
           {even('sum(m) - max(m) FILTER (WHERE m >= 5)', 1)} AS dropped_m,
           abs(original - max(m) FILTER (WHERE m >= 5)) > 0.05 AS was_clipped,
           arg_max(moved, m) + 1 AS vertices
    FROM {name}r WHERE m IS NOT NULL AND moved > 0 GROUP BY id, original HAVING count(*) FILTER (WHERE m >= 5) > 0
    """)


cte("ln", "SELECT num AS id, * FROM vtx")
clip_cte("clp", "ln")
oracle("line_clip", """
SELECT v.asset_id, parts, length_m, dropped_m, was_clipped, CAST(vertices AS BIGINT) AS vertices FROM clp
JOIN vtx v ON v.num = clp.id
""")
cte("el", f"""
SELECT v.*, c.c_nationkey % 8 AS k, {even('v.lon', 7)} AS r1, {even('v.lat', 7)} AS q1, {even('v.lon2', 7)} AS r2,
       {even('v.lat2', 7)} AS q2, {even('v.lon3', 7)} AS r3, {even('v.lat3', 7)} AS q3,
       CASE WHEN num % 6 = 0 OR num % 7 = 0 THEN NULL ELSE c_name END AS nm
FROM vtx v JOIN customer c ON c.c_custkey = v.num
""")
cte("ela", """
SELECT *, CASE k WHEN 0 THEN 'building' WHEN 1 THEN 'highway' WHEN 2 THEN 'highway' WHEN 3 THEN 'rail' WHEN 4 THEN 'power_line'
          WHEN 5 THEN 'substation' WHEN 6 THEN 'highway' ELSE 'unused' END AS layer,
       abs((r1 * q2 - r2 * q1) + (r2 * q3 - r3 * q2) + (r3 * q1 - r1 * q3)) / 2 AS deg,
       (r1 = r2 AND q1 = q2) OR (r2 = r3 AND q2 = q3) OR (r1 = r3 AND q1 = q3) AS degenerate,
       (r1 + r2 + r3) / 3 AS cx, (q1 + q2 + q3) / 3 AS cy FROM el
""")
cte("rt", f"""
SELECT e.num AS id, e.layer, e.nm AS name, CASE
  WHEN k = 0 THEN CASE WHEN degenerate THEN 'dropped_not_closed'
       WHEN deg * 111320.0 * cos(radians(q1)) * 110540.0 < 25 THEN 'dropped_small'
       WHEN NOT (cx BETWEEN {W} AND {E} AND cy BETWEEN {S} AND {N}) THEN 'dropped_centroid_outside' ELSE 'kept' END
  WHEN k = 5 THEN CASE WHEN cx BETWEEN {W} AND {E} AND cy BETWEEN {S} AND {N} THEN 'kept' ELSE 'dropped_outside' END
  WHEN k = 6 THEN 'skipped_class' WHEN k = 7 THEN 'not_used'
  WHEN c.id IS NULL THEN 'dropped_outside_or_short' ELSE 'kept' END AS action, k, c.was_clipped, c.parts
FROM ela e LEFT JOIN clp c ON c.id = e.num
""")
oracle("layer_routing", "SELECT id, layer, action, name FROM rt")
oracle("layer_report", """
SELECT layer, action, count(*) AS ways, count(*) FILTER (WHERE k BETWEEN 1 AND 4 AND action = 'kept' AND was_clipped) AS clipped,
       count(*) FILTER (WHERE k BETWEEN 1 AND 4 AND action = 'kept' AND parts > 1) AS multi_part FROM rt GROUP BY layer, action
""")
oracle("chain_merge", """
SELECT (num // 4) * 4 AS chain_id, CASE WHEN (num // 4) % 2 = 0 THEN 'highway:primary' ELSE 'railway:rail' END AS bridge_class,
       string_agg(CAST(num AS VARCHAR), ',' ORDER BY num) AS way_ids, count(*) * 2 + 1 AS vertices,
       string_agg(name, ';' ORDER BY num) AS names
FROM assets GROUP BY num // 4
""")
oracle("height_resolution", f"""
SELECT p_partkey, CASE WHEN tagged IS NOT NULL THEN {even('tagged', 1)} WHEN meas IS NOT NULL THEN {even('meas', 1)}
       WHEN lev IS NOT NULL THEN {even('lev * 3.6', 1)}
       ELSE CASE p_partkey % 10 WHEN 0 THEN 5.0 WHEN 1 THEN 3.5 WHEN 2 THEN 9.0 WHEN 3 THEN 10.0
            ELSE CASE WHEN p_retailprice < 400 THEN 4.5 WHEN p_retailprice < 1500 THEN 6.0 ELSE 8.0 END END END AS height_m,
       CASE WHEN tagged IS NOT NULL THEN 'osm_height' WHEN meas IS NOT NULL THEN 'lidar_3dep' WHEN lev IS NOT NULL
            THEN 'osm_levels' ELSE 'estimated' END AS height_source
FROM (SELECT *, CASE p_partkey % 6 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size + 0.5::DOUBLE WHEN 2 THEN p_size * 0.3048::DOUBLE END
             AS tagged,
             CASE WHEN p_partkey % 5 = 0 AND p_retailprice / 30.0 BETWEEN 2.5 AND 60 THEN p_retailprice / 30.0 END AS meas,
             CASE WHEN p_partkey % 4 = 0 AND p_partkey % 9 > 0 THEN (p_partkey % 9)::DOUBLE END AS lev FROM part)
""")
oracle("tag_cleaning", """
SELECT p_partkey, CASE WHEN p_partkey % 5 IN (0, 3, 4) THEN p_name END AS name,
       CASE WHEN p_partkey % 3 = 0 AND p_size BETWEEN 1 AND 20 THEN p_size::BIGINT END AS lanes,
       CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true END AS oneway,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS title
FROM part
""")
cte("pl", """
SELECT p_partkey AS n, p_name, p_type, 37.745 + ((p_partkey * 104729) % 10009) / 10009.0::DOUBLE * 0.017::DOUBLE AS lat,
       -100.03 + ((p_partkey * 7919) % 10007) / 10007.0::DOUBLE * 0.025::DOUBLE AS lon FROM part
""")
cte("pd", """
SELECT *, floor((lat - 37) * 60) AS mi, floor((-lon - 100) * 60) AS wm FROM pl
""")
cte("pr", """
SELECT *, CASE WHEN n % 17 = 0 OR n % 19 = 0 THEN NULL
          ELSE 37 + mi / 60.0 + floor(((lat - 37) * 60 - mi) * 6000) / 100.0 / 3600.0 END AS rlat,
       CASE WHEN n % 17 = 0 OR n % 19 = 0 THEN NULL
          ELSE -(100 + CASE WHEN n % 23 = 0 THEN 59 ELSE wm END / 60.0 + floor(((-lon - 100) * 60 - wm) * 6000) / 100.0 / 3600.0)
          END AS rlon FROM pd
""")
cte("pq", """SELECT *, CASE WHEN rlat IS NOT NULL THEN (SELECT """ + hav("a", "b") + """ FROM (SELECT pr.lon AS lon, pr.lat AS lat) a,
 (SELECT pr.rlon AS lon, pr.rlat AS lat) b) END AS d, n % 14 AS mo, n % 100 AS yy FROM pr WHERE n % 29 <> 0""")
oracle("inventory_decode", f"""
SELECT 'B' || lpad(CAST(n AS VARCHAR), 7, '0') AS structure_number, round(rlon, 8) AS recorded_lon, round(rlat, 8) AS recorded_lat,
       CASE WHEN d IS NULL THEN 'unverified' WHEN {even('d', 1)} > 500 THEN 'mismatch' ELSE 'ok' END AS location_check,
       CASE WHEN n % 7 = 0 THEN NULL ELSE n % 100 + 1900 END AS year_built,
       CASE WHEN mo BETWEEN 1 AND 12 THEN CAST(CASE WHEN yy > 24 THEN 1900 + yy ELSE 2000 + yy END AS VARCHAR) || '-'
            || lpad(CAST(mo AS VARCHAR), 2, '0') END AS inspection_date,
       CASE WHEN mo BETWEEN 1 AND 12 THEN ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August',
            'September', 'October', 'November', 'December'][mo] || ' '
            || CAST(CASE WHEN yy > 24 THEN 1900 + yy ELSE 2000 + yy END AS VARCHAR) END AS inspection_label,
       '0' || CAST(n % 6 AS VARCHAR) AS owner_code,
       CASE n % 6 WHEN 1 THEN 'State Highway Agency' WHEN 4 THEN 'City or Municipal Highway Agency'
            ELSE 'Owner code 0' || CAST(n % 6 AS VARCHAR) END AS owner,
       CASE n % 4 WHEN 0 THEN 'Good' WHEN 1 THEN 'Fair' WHEN 2 THEN 'Poor' END
            || ' (FHWA classification from the lowest component rating)' AS condition_label,
       n % 5 = 0 AS is_culvert,
       array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')
         || CASE WHEN n % 3 = 0 THEN ' over '
         || array_to_string(list_transform(string_split(p_type, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') ELSE '' END
         AS record_name
FROM pq
""")
cte("spt", """
SELECT 'B' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0') AS sid,
       -100.03 + (((s_suppkey + 5) * 7919) % 10007) / 10007.0::DOUBLE * 0.025::DOUBLE AS lon,
       37.745 + (((s_suppkey + 5) * 104729) % 10009) / 10009.0::DOUBLE * 0.017::DOUBLE AS lat FROM supplier
""")
cte("cp", f"""
SELECT sid, asset_id AS aid, d, row_number() OVER (ORDER BY d, sid, asset_id) AS rn
FROM (SELECT s.sid, a.asset_id, {hav('s', 'a')} AS d FROM spt s, assets a) WHERE d <= 60
""")
cte("grd", """
SELECT 0::BIGINT AS rn, []::VARCHAR[] AS us, []::VARCHAR[] AS ua, false AS hit
UNION ALL
SELECT c.rn, CASE WHEN list_contains(g.us, c.sid) OR list_contains(g.ua, c.aid) THEN g.us ELSE list_append(g.us, c.sid) END,
       CASE WHEN list_contains(g.us, c.sid) OR list_contains(g.ua, c.aid) THEN g.ua ELSE list_append(g.ua, c.aid) END,
       NOT (list_contains(g.us, c.sid) OR list_contains(g.ua, c.aid))
FROM grd g JOIN cp c ON c.rn = g.rn + 1
""")
oracle("one_to_one_match", f"""
SELECT c.sid AS left_id, c.aid AS right_id, {even('c.d', 1)} AS distance_m FROM grd g JOIN cp c ON c.rn = g.rn WHERE g.hit
""")
cte("ra_", """
SELECT *, (num % 190)::DOUBLE AS length_m, (num * 37 % 3001)::DOUBLE AS footprint_m2,
       asset_type = 'building' AND num % 9 = 0 AS is_civic FROM assets
""")
oracle("asset_classes", """
SELECT asset_id, asset_type = 'bridge' AND num % 5 = 0 AS is_culvert, asset_type = 'power' AND num % 3 = 0 AS is_substation,
       is_civic, CAST(CASE WHEN asset_type = 'road' THEN CASE num % 4 WHEN 0 THEN 4.0 WHEN 1 THEN 3.5 WHEN 2 THEN 1.0 ELSE 2.0 END END
       AS DOUBLE)
       AS class_rank, length_m, footprint_m2 FROM ra_
""")
oracle("showcase_buildings", """
SELECT asset_id, is_civic, footprint_m2 FROM ra_ WHERE asset_type = 'building'
ORDER BY is_civic DESC, footprint_m2 DESC, asset_id LIMIT 3
""")
oracle("building_pool", """
SELECT asset_id, footprint_m2 FROM ra_ WHERE asset_type = 'building' AND asset_id NOT IN (SELECT asset_id FROM sn)
ORDER BY footprint_m2 DESC, asset_id LIMIT 32
""")
cte("px", """
SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'new' ELSE 'old' END AS project,
       ((l_orderkey * 7919 + l_linenumber * 31) % 600) * 10.0::DOUBLE + 5 AS x,
       ((l_partkey * 104729 + l_orderkey) % 600) * 10.0::DOUBLE + 5 AS y, l_quantity * 1.5::DOUBLE AS v FROM lineitem
""")
cte("sq", """
SELECT s_suppkey AS id, (s_suppkey * 7919 % 5600) + 0.25::DOUBLE AS x0, (s_suppkey * 104729 % 5600) + 0.25::DOUBLE AS y0,
       (s_suppkey % 3) * 100.0::DOUBLE + 100.5 AS side FROM supplier
""")
cte("zt", """
SELECT sq.id, px.project, px.v, x > x0 AND x < x0 + side AND y > y0 AND y < y0 + side AS inside
FROM sq JOIN px ON x + 5 >= x0 AND x - 5 <= x0 + side AND y + 5 >= y0 AND y - 5 <= y0 + side
""")
cte("zp", "SELECT id, CASE WHEN bool_or(project = 'new') THEN 'new' ELSE 'old' END AS project FROM zt GROUP BY id")
cte("zv", """
SELECT zt.id, count(*) AS n, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.9) AS p90, max(v) AS vmax
FROM zt JOIN zp ON zp.id = zt.id AND zp.project = zt.project WHERE inside GROUP BY zt.id
""")
oracle("zonal_percentile", """
SELECT sq.id AS polygon_id, zp.project, coalesce(n, 0) AS n_pixels, round(p50, 6) AS p50, round(p90, 6) AS p90, vmax,
       CASE WHEN zp.project IS NULL THEN 'no_coverage' WHEN coalesce(n, 0) < 4 THEN 'too_few' WHEN p90 < 2.5 THEN 'below'
            WHEN p90 > 60 THEN 'above' ELSE 'ok' END AS status
FROM sq LEFT JOIN zp ON zp.id = sq.id LEFT JOIN zv ON zv.id = sq.id
""")
cte("rs_", """
SELECT project, CAST(floor(y / 10) AS BIGINT) AS r, CAST(floor(x / 10) AS BIGINT) AS c, max(v) AS v FROM px GROUP BY 1, 2, 3
""")
oracle("raster_difference", """
SELECT a.r AS "row", a.c AS col, a.v - b.v AS value FROM rs_ a JOIN rs_ b ON a.project = 'new' AND b.project = 'old'
  AND a.r = b.r + 2 AND a.c = b.c - 3
""")
oracle("payload_parse", """
SELECT event_id, s.seq, CASE WHEN event_id % 17 = 0 THEN 'not_json' WHEN event_id % 19 = 0 THEN 'no_readings_array'
       WHEN event_id % 23 = 0 THEN CASE s.seq WHEN 0 THEN 'not_an_object' ELSE 'missing_field' END END AS fault,
       CASE WHEN ok THEN sensor_id END AS sensor_id, CASE WHEN ok AND event_id % 11 <> 0 AND event_id % 13 <> 0
       THEN round(value, 2) END AS value,
       CASE WHEN ok THEN CASE WHEN event_id % 3 <> 0 THEN 'psi' ELSE CASE user_id % 4 WHEN 0 THEN '°C' WHEN 1 THEN 'mm/s'
            WHEN 2 THEN '%' ELSE 'psi' END END END AS unit
FROM (SELECT *, NOT (event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 23 = 0) AS ok FROM rd) r
JOIN (VALUES (NULL::BIGINT, 0), (0, 1), (1, 1)) s(seq, lst) ON CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 THEN s.lst = 0
  WHEN event_id % 23 = 0 OR event_id % 2 = 0 THEN s.lst = 1 ELSE s.seq = 0 END
""")
oracle("props_json", """
SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1
""")
cte("mh", """
SELECT p_partkey // 2 AS osm_id, p_size::DOUBLE AS h, p_partkey AS pos FROM part
WHERE p_partkey % 9 <> 0 AND p_partkey % 7 <> 0 AND p_size BETWEEN 2.5 AND 60
""")
oracle("measured_heights", """
SELECT osm_id, arg_min(h, pos) AS height_m, (SELECT count(*) FROM part) - (SELECT count(DISTINCT osm_id) FROM mh) AS ignored
FROM mh GROUP BY osm_id
""")
oracle("source_catalogue", """
SELECT n_nationkey::BIGINT AS source_id, n_name, n_regionkey > 1 AS optional, f.suppliers FROM nation
LEFT JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) f ON f.s_nationkey = n_nationkey
WHERE n_regionkey <= 1 OR f.suppliers IS NOT NULL
""")
oracle("geojson_features", """
SELECT asset_id, 'Feature' AS type, 'Point' AS geometry_type, name FROM assets
""")
oracle("score_rows", f"""
SELECT sensor_id, us AS ts, {even('expected', 4)} AS expected, z, flagged FROM flg
""")
oracle("run_baselines", "SELECT * FROM sb")
oracle("series_per_sensor", """
SELECT sensor_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n, arg_min(value, ts) AS first_value,
       arg_max(value, ts) AS last_value FROM rd GROUP BY 1, 2
""")
# --- streaming: the stream must end where the batch form ends -----------------------------------------------------------
oracle("streaming_ingest", """
SELECT sid AS sensor_id, tus AS ts, v AS value, CASE WHEN plaus THEN 'ok' ELSE 'suspect' END AS status FROM kept
""")
oracle("streaming_cells", "SELECT sensor_id, cell, us AS ts, value FROM gr")
oracle("streaming_sessions", f"""
SELECT sensor_id, s0 + min(cell) * {STEP_US} AS started_at, s0 + max(cell) * {STEP_US} AS ended_at, count(*) AS flagged_steps,
       max(abs(z)) AS peak_abs_z, bool_or(critical) AS critical FROM isl, ax
GROUP BY sensor_id, island, s0 HAVING max(abs(z)) >= 6 OR count(*) >= 3 OR bool_or(critical)
""")
cte("seen_at", """
SELECT sensor_id, us, lead(us) OVER (PARTITION BY sensor_id ORDER BY us) AS nxt FROM (SELECT DISTINCT sensor_id, us FROM rd)
""")
oracle("streaming_offline", """
SELECT sensor_id, us AS last_us, 'offline' AS kind FROM seen_at WHERE nxt - us > 43200000000
UNION ALL SELECT sensor_id, nxt, 'online' FROM seen_at WHERE nxt - us > 43200000000
UNION ALL SELECT sensor_id, us, 'offline' FROM seen_at WHERE nxt IS NULL AND (SELECT max(us) FROM rd) - us > 43200000000
""")

oracle("layer_in_box", """
SELECT asset_id, asset_type FROM vtx WHERE num IN (SELECT id FROM clpp WHERE hit)
""")
