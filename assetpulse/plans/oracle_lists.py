"""Check statements of the list, detail, breakdown, playback and quality queries."""

from __future__ import annotations

from .oracle import STEP_US, cte, even, oracle, up
from .oracle_spatial import R

cte("vis", """
SELECT an.*, CASE WHEN e_us >= now.us THEN 'active' ELSE 'resolved' END AS status_at, a.name AS asset_name, a.asset_type
FROM an CROSS JOIN now JOIN assets a ON a.asset_id = an.asset_id WHERE s_us <= now.us
""")
cte("lp", """
SELECT * FROM vis WHERE severity IN ('high', 'critical', 'medium') AND sensor_type IN ('temperature', 'moisture', 'pressure')
  AND lon BETWEEN -100.025 AND -100.010 AND lat BETWEEN 37.750 AND 37.758
""")
oracle("anomaly_list_page", """
SELECT t.total, p.* FROM (SELECT count(*) AS total FROM lp) t LEFT JOIN (
  SELECT anomaly_id, sensor_id, severity, status_at, asset_name, asset_type, placement AS sensor_placement
  FROM lp ORDER BY rk DESC, anomaly_id LIMIT 10 OFFSET 5) p ON true
""")
oracle("anomaly_list_filtered", """
SELECT anomaly_id, asset_id, severity, status_at, asset_name FROM vis WHERE status_at = 'active'
""")
cte("ix", f"""
SELECT an.*, CAST(greatest(ceil((s_us - s0) / {STEP_US}.0), 0) AS BIGINT) AS a,
       CAST(least(floor((e_us - s0) / {STEP_US}.0), n - 1) AS BIGINT) AS b FROM an, ax
""")
oracle("anomaly_display", """
SELECT anomaly_id, a AS start_step, b AS end_step, severity FROM ix, now
WHERE a <= now.step AND b < now.step AND severity IN ('low', 'critical')
  AND sensor_type IN ('temperature', 'vibration', 'moisture')
  AND CAST(make_timestamp(s_us) - INTERVAL 6 HOUR AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-15'
""")
oracle("anomaly_display_order", """
SELECT anomaly_id, severity, s_us AS started_at FROM an, now
ORDER BY (s_us <= now.us AND e_us >= now.us) DESC, rk DESC, s_us DESC, anomaly_id
""")
cte("sm", """
SELECT a.*, coalesce(s.c, 0) AS sensor_count, coalesce(s.t, '') AS sensor_types, coalesce(s.c, 0) > 0 AS monitored,
       coalesce(k.c, 0) AS anomaly_count, h.health_score, coalesce(h.status, 'not_monitored') AS status
FROM assets a
LEFT JOIN (SELECT asset_id, count(*) AS c, string_agg(DISTINCT sensor_type, ',' ORDER BY sensor_type) AS t FROM sn
           GROUP BY asset_id) s ON s.asset_id = a.asset_id
LEFT JOIN (SELECT asset_id, count(*) AS c FROM an GROUP BY asset_id) k ON k.asset_id = a.asset_id
LEFT JOIN (SELECT hh.* FROM hh, ax WHERE step = ax.n - 1) h ON h.asset_id = a.asset_id
""")
oracle("asset_summary", """
SELECT asset_id, asset_type, sensor_count, sensor_types, monitored, anomaly_count, health_score, status FROM sm
""")
cte("al", """
SELECT * FROM sm WHERE asset_type IN ('road', 'bridge') AND status IN ('not_monitored', 'watch', 'normal')
  AND lon BETWEEN -100.025 AND -100.010 AND lat BETWEEN 37.750 AND 37.758
""")
oracle("asset_list_page", """
SELECT t.total, p.* FROM (SELECT count(*) AS total FROM al) t LEFT JOIN (
  SELECT asset_id, asset_type, status, sensor_count FROM al ORDER BY asset_id LIMIT 15 OFFSET 10) p ON true
""")
oracle("active_anomalies", """
SELECT anomaly_id, asset_name, asset_type, severity FROM vis WHERE status_at = 'active'
""")
oracle("sensor_list", """
SELECT c.sensor_id, c.asset_id, a.name AS asset_name, c.status,
       (SELECT count(*) FROM an, now WHERE an.sensor_id = c.sensor_id AND an.s_us <= now.us) AS visible_anomalies
FROM curst c JOIN assets a ON a.asset_id = c.asset_id
""")
oracle("reading_history", """
SELECT sensor_id, us AS ts, value, value > 100 AS flagged FROM rd
WHERE sensor_id = (SELECT sensor_id FROM rd GROUP BY sensor_id ORDER BY count(*) DESC, sensor_id LIMIT 1)
  AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'
""")
oracle("reading_columns", """
SELECT s.sensor_id, string_agg(coalesce(CAST(CAST(round(g.value * 100) AS BIGINT) AS VARCHAR), '-'), ',' ORDER BY st.step)
         AS values,
       coalesce(string_agg(CASE WHEN g.value > 100 THEN CAST(st.step - 10 AS VARCHAR) END, ',' ORDER BY st.step), '')
         AS flagged_positions
FROM (SELECT DISTINCT sensor_id FROM gr WHERE cell BETWEEN 10 AND 29) s CROSS JOIN st
LEFT JOIN gr g ON g.sensor_id = s.sensor_id AND g.cell = st.step WHERE st.step BETWEEN 10 AND 29 GROUP BY s.sensor_id
""")
oracle("health_range", """
SELECT asset_id, string_agg(CAST(health_score AS VARCHAR), ',' ORDER BY step) AS health,
       string_agg(CASE status WHEN 'normal' THEN 'n' WHEN 'watch' THEN 'w' WHEN 'at_risk' THEN 'r' ELSE 'c' END, ''
                  ORDER BY step) AS status
FROM hh WHERE step BETWEEN 5 AND 24 GROUP BY asset_id
""")
cte("sb", f"""
SELECT sensor_id, {even('max(scale)', 4)} AS scale, CAST(max(floor) AS DOUBLE) AS floor,
       CASE WHEN max(sensor_type) = 'vibration' THEN 'ln' ELSE 'native' END AS domain FROM scl GROUP BY sensor_id
""")
cte("hd", """
SELECT s.sensor_id, CAST(th.warn_low AS DOUBLE) AS warn_low, CAST(th.warn_high AS DOUBLE) AS warn_high,
       CAST(th.crit_low AS DOUBLE) AS crit_low, CAST(th.crit_high AS DOUBLE) AS crit_high, b.scale, b.floor, b.domain
FROM sn s JOIN th ON th.sensor_type = s.sensor_type AND th.placement = s.placement LEFT JOIN sb b ON b.sensor_id = s.sensor_id
""")
oracle("sensor_head", "SELECT * FROM hd")
cte("ra", """
SELECT asset_id, string_agg(anomaly_id, ',' ORDER BY s_us DESC, anomaly_id) AS ids FROM (
  SELECT an.*, row_number() OVER (PARTITION BY asset_id ORDER BY s_us DESC, anomaly_id) AS rn FROM an, now WHERE s_us <= now.us)
WHERE rn <= 10 GROUP BY 1
""")
oracle("asset_detail", """
SELECT sm.asset_id, sm.status, (SELECT string_agg(sensor_id, ',' ORDER BY sensor_id) FROM sn WHERE sn.asset_id = sm.asset_id)
       AS sensors, ra.ids AS recent FROM sm LEFT JOIN ra ON ra.asset_id = sm.asset_id WHERE sm.monitored
""")
oracle("sensor_detail", """
SELECT hd.sensor_id, hd.warn_high, hd.scale, r.ids AS recent FROM hd LEFT JOIN (
  SELECT sensor_id, string_agg(anomaly_id, ',' ORDER BY s_us DESC, anomaly_id) AS ids FROM an GROUP BY 1) r ON r.sensor_id = hd.sensor_id
""")
oracle("anomaly_detail", f"""
SELECT an.anomaly_id, an.severity, coalesce(string_agg(n.near_id, ',' ORDER BY n.dm, n.near_id), '') AS nearby
FROM an LEFT JOIN (SELECT anomaly_id, near_id, {up('d', 1)} AS dm FROM near WHERE d <= 100 AND near_id <> asset_id) n
       ON n.anomaly_id = an.anomaly_id GROUP BY 1, 2
""")
oracle("labelled_list", """
SELECT event_id, event_type, sensor_id, s_us AS started_at, e_us AS ended_at FROM le WHERE is_anomaly
""")
oracle("asset_properties", """
SELECT asset_id, array_to_string(list_sort(list_filter([
    'addr:city=' || CASE WHEN num % 4 = 0 THEN 'null' ELSE 'Town' END,
    CASE WHEN asset_type IN ('building', 'power') THEN 'operator=' || c_mktsegment END,
    CASE WHEN asset_type = 'road' THEN 'surface=' || CASE WHEN num % 3 = 0 THEN 'null' ELSE 'paved' END END,
    CASE WHEN asset_type = 'power' THEN 'voltage=' || c_nationkey END], lambda x: x IS NOT NULL)), ';') AS properties
FROM assets JOIN customer ON c_custkey = num
""")
oracle("provenance", """
SELECT a.asset_id, string_agg(n.n_name, ',' ORDER BY i.pos) AS sources
FROM assets a CROSS JOIN (VALUES (0), (2)) i(pos)
JOIN nation n ON n.n_nationkey = CASE i.pos WHEN 0 THEN a.num % 25 ELSE (a.num * 7 + 3) % 25 END GROUP BY a.asset_id
""")
# --- breakdowns -----------------------------------------------------------------------------------------------------------
cte("td", "SELECT an.* FROM an, now WHERE s_us <= now.us")
oracle("statistics_asof", """
SELECT 'severity' AS dimension, b.k AS key, count(t.severity) AS n FROM (VALUES ('low'), ('medium'), ('high'), ('critical'))
  b(k) LEFT JOIN td t ON t.severity = b.k GROUP BY b.k
UNION ALL SELECT 'sensor_type', b.k, count(t.sensor_type) FROM (VALUES ('temperature'), ('vibration'), ('moisture'), ('pressure'))
  b(k) LEFT JOIN td t ON t.sensor_type = b.k GROUP BY b.k
UNION ALL SELECT 'total', 'all', count(*) FROM td
""")
oracle("health_bands", """
SELECT b.status, count(sm.asset_id) AS n FROM (VALUES ('normal'), ('watch'), ('at_risk'), ('critical'), ('not_monitored'))
  b(status) LEFT JOIN sm ON sm.status = b.status GROUP BY b.status
""")
cte("len", f"""
SELECT asset_id, sum(2 * {R} * asin(sqrt(pow(sin(radians(byy - ay) / 2), 2) + cos(radians(ay)) * cos(radians(byy))
       * pow(sin(radians(bx - ax) / 2), 2)))) AS m FROM seg GROUP BY asset_id
""")
cte("are", """
SELECT asset_id, abs((lon * lat2 - lon2 * lat) + (lon2 * lat3 - lon3 * lat2) + (lon3 * lat - lon * lat3)) / 2
       * 111320.0 * cos(radians(lat)) * 110540.0 AS m2 FROM vtx
""")
oracle("asset_type_rollup", f"""
SELECT asset_type, count(*) AS assets, count(*) FILTER (WHERE is_simulated) AS simulated_assets,
       count(*) FILTER (WHERE monitored) AS monitored_assets, CAST(sum(sensor_count) AS BIGINT) AS sensors,
       CAST(sum(anomaly_count) AS BIGINT) AS anomalies,
       {up("sum(CASE WHEN asset_type IN ('road', 'bridge', 'power') THEN m END) / 1000.0", 2)} AS total_length_km,
       {up("sum(CASE WHEN asset_type NOT IN ('road', 'bridge', 'power') THEN m2 END) / 10000.0", 2)} AS total_footprint_ha
FROM sm JOIN len USING (asset_id) JOIN are USING (asset_id) GROUP BY asset_type
""")
oracle("network_summary", """
SELECT sensor_type, placement, count(*) AS sensors, count(DISTINCT asset_id) AS assets FROM sn GROUP BY 1, 2
""")
oracle("extent", """
SELECT min(least(lon, lon2, lon3)) AS west, min(least(lat, lat2, lat3)) AS south, max(greatest(lon, lon2, lon3)) AS east,
       max(greatest(lat, lat2, lat3)) AS north FROM vtx
""")
oracle("dataset_metadata", """
SELECT min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north,
       round((min(lon) + max(lon)) / 2, 9) AS centre_lon, round((min(lat) + max(lat)) / 2, 9) AS centre_lat,
       count(*) AS assets, (SELECT count(*) FROM sn) AS sensors, (SELECT count(*) FROM events) AS readings,
       (SELECT count(*) FROM an) AS anomalies, 'moisture,pressure,temperature,vibration' AS sensor_types FROM assets
""")
oracle("detection_summary", """
SELECT (SELECT count(*) FROM ev) AS anomalies, (SELECT count(DISTINCT sensor_id) FROM ev) AS sensors,
       (SELECT count(*) FROM ev, now WHERE ev.e_us >= now.us) AS active_at_end,
       (SELECT count(*) FROM flg WHERE flagged) AS flagged_readings
""")
# --- series -----------------------------------------------------------------------------------------------------------------
oracle("trend_24h", """
SELECT sensor_id, cell, CASE WHEN p IS NULL THEN NULL WHEN v = p THEN 'steady'
  WHEN CASE WHEN sensor_type = 'vibration' AND v > 0 AND p > 0 THEN abs(ln(v / p)) <= 0.1 WHEN sensor_type = 'vibration'
       THEN abs(v - p) <= 0.1 ELSE abs(v - p) <= 0.5 END THEN 'steady' WHEN v > p THEN 'rising' ELSE 'falling' END AS trend
FROM (SELECT g.sensor_id, g.cell, g.value AS v, q.value AS p, s.sensor_type FROM gr g JOIN sn s ON s.sensor_id = g.sensor_id
      LEFT JOIN gr q ON q.sensor_id = g.sensor_id AND q.cell = g.cell - 2)
""")
oracle("change_counter", """
SELECT st.step, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM ix WHERE ix.a = st.step OR ix.b + 1 = st.step) THEN 1 ELSE 0 END)
       OVER (ORDER BY st.step) AS BIGINT) AS version FROM st
""")
oracle("calendar_days", """
SELECT CAST(CAST(make_timestamp(us) - INTERVAL 6 HOUR AS DATE) AS VARCHAR) AS day, min(step) AS first_step,
       max(step) AS last_step FROM st GROUP BY 1
""")
oracle("attention_counts", """
SELECT st.step, count(hh.asset_id) AS needing_attention FROM st LEFT JOIN hh ON hh.step = st.step AND health_score < 90
GROUP BY st.step
""")
oracle("playback_series", f"""
SELECT sensor_id, string_agg(CASE status WHEN 'normal' THEN 'n' WHEN 'warning' THEN 'w' WHEN 'anomaly' THEN 'a' ELSE 'o' END,
       '' ORDER BY step) AS status, count(*) AS steps, round(coalesce(sum({even('value', 3)}), 0), 3) AS value_sum
FROM sst GROUP BY sensor_id
""")
oracle("risk_playback", """
SELECT c.cell_id, string_agg(CAST(CAST(floor(coalesce(r.risk_score, 0.0) + 0.5) AS BIGINT) AS VARCHAR), ',' ORDER BY st.step)
       AS risk
FROM (SELECT DISTINCT cell_id FROM rks) c CROSS JOIN st LEFT JOIN rks r ON r.cell_id = c.cell_id AND r.step = st.step
GROUP BY c.cell_id
""")
# --- quality ----------------------------------------------------------------------------------------------------------------
oracle("constraint_audit", """
SELECT 'status_known' AS rule, count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O')) AS violations FROM orders
UNION ALL SELECT 'price_range', count(*) FILTER (WHERE o_totalprice NOT BETWEEN 1000 AND 400000) FROM orders
UNION ALL SELECT 'priority_known', count(*) FILTER (WHERE o_orderpriority = '5-LOW') FROM orders
UNION ALL SELECT 'orders_key', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
UNION ALL SELECT 'lineitem_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'supply_once', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1)
UNION ALL SELECT 'orders_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'doubled_key', count(*) FROM lineitem WHERE l_orderkey * 2 NOT IN (SELECT o_orderkey FROM orders)
""")
oracle("source_reconcile", """
SELECT coalesce(e.k, i.k) AS c_custkey, CASE WHEN i.k IS NOT NULL AND e.k IS NOT NULL THEN 'updated'
       WHEN i.k IS NOT NULL THEN 'added' WHEN e.nk < 15 THEN 'kept' ELSE 'removed' END AS action
FROM (SELECT c_custkey AS k, c_nationkey AS nk FROM customer) e
FULL JOIN (SELECT DISTINCT o_custkey * 2 AS k FROM orders) i ON i.k = e.k
""")
oracle("status_parity", "SELECT count(*) AS compared, 0::BIGINT AS missing, 0::BIGINT AS different FROM sn")
oracle("causal_texts", """
SELECT doc_id, array_to_string(w, ',') AS words FROM (SELECT doc_id, list_filter(['fail', 'unsafe', 'damage', 'leak', 'break',
  'collapse', 'danger', 'caused', 'because', 'due to'], lambda x: contains(lower(text), x)) AS w FROM documents) WHERE len(w) > 0
""")
oracle("row_counts", "\nUNION ALL ".join(
    f"SELECT '{t}' AS \"table\", count(*) AS n FROM {t}" for t in ("customer", "events", "lineitem", "orders", "part", "supplier")
))
oracle("geometry_split", """
SELECT v.asset_id, CASE WHEN num % 11 <> 0 AND num % 13 = 0 THEN 'empty' WHEN num % 7 = 0 THEN 'wrong_type'
       WHEN num % 11 = 0 THEN 'invalid' WHEN num % 2 = 0 AND m2 = 0 THEN 'invalid'
       WHEN num % 40 >= 25 THEN 'missing_parent' ELSE 'kept' END AS outcome
FROM vtx v JOIN are ON are.asset_id = v.asset_id
""")

# --- single operators over given tables --------------------------------------------------------------------------
cte("ema_series", """
SELECT c.sensor_type, c.placement, st.step, m.v FROM (SELECT DISTINCT sensor_type, placement FROM sn JOIN gr USING (sensor_id)) c CROSS JOIN st
LEFT JOIN (SELECT sensor_type, placement, cell, round(avg(value), 6) AS v FROM gr JOIN sn USING (sensor_id) GROUP BY ALL) m
       ON m.sensor_type = c.sensor_type AND m.placement = c.placement AND m.cell = st.step
""")
cte("ema_past", """
SELECT *, coalesce(list(v) FILTER (WHERE v IS NOT NULL AND step > 0) OVER (PARTITION BY sensor_type, placement ORDER BY step), []) AS past,
       dense_rank() OVER (PARTITION BY sensor_type ORDER BY placement) - 1 AS class FROM ema_series
""")
oracle("ema", """
SELECT sensor_type, step AS cell, (class * CASE sensor_type WHEN 'moisture' THEN 3 ELSE 1 END + k)::BIGINT AS pos,
       round(CASE WHEN k = 0 THEN coalesce(v, 0)
                  ELSE list_reduce(list_prepend(0.0::DOUBLE, past), lambda a, x: a + (1 - exp(-12.0 / (CASE k WHEN 1 THEN 24 ELSE 72 END))) * (x - a)) END, 6) AS feature
FROM ema_past, (SELECT unnest([0, 1, 2]) AS k) WHERE k = 0 OR sensor_type = 'moisture'
""")
oracle("sampling_mode", """
SELECT ((length(sensor_type) % 3 + 1) * 600)::BIGINT AS step_s FROM sn GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
""")
oracle("readings_between", """
SELECT event_id, user_id, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'
""")
oracle("scored_readings", """
SELECT sensor_id, us AS ts, value, CASE WHEN value > 30 THEN (value - 50) / 20.0 END AS z, value > 100 AS flagged FROM rd
""")
oracle("filtered_sensors", "SELECT sensor_id, asset_id, placement FROM sn WHERE sensor_type = 'moisture'")
oracle("unknown_provenance", """
SELECT s_suppkey, s_nationkey::BIGINT AS s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)
""")
cte("measured", """
SELECT CASE WHEN p_size < 5 THEN 'too_few' WHEN p_size < 10 THEN 'below' WHEN p_size > 45 THEN 'above' ELSE 'ok' END AS status, p_retailprice / 100 AS h FROM part
""")
oracle("measurement_summary", """
SELECT s.status, (SELECT count(*) FROM measured m WHERE m.status = s.status) AS n,
       CASE s.status WHEN 'ok' THEN (SELECT round(quantile_cont(h, 0.1), 6) FROM measured WHERE status = 'ok') END AS p10,
       CASE s.status WHEN 'ok' THEN (SELECT round(quantile_cont(h, 0.5), 6) FROM measured WHERE status = 'ok') END AS p50,
       CASE s.status WHEN 'ok' THEN (SELECT round(quantile_cont(h, 0.9), 6) FROM measured WHERE status = 'ok') END AS p90
FROM (SELECT unnest(['ok', 'too_few', 'below', 'above', 'no_coverage']) AS status) s
""")
