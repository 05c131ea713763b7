"""The same results as plain SQL, written independently of the DataFrame code, for checking."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
SQL: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def oracle(name: str, sql: str) -> None:
    SQL[name] = sql.strip()


def needed(sql: str) -> list[str]:
    """Names of the common tables a statement uses, directly or through others, in definition order."""
    found: set[str] = set()
    queue = [sql]
    while queue:
        words = set(re.findall(r"[a-z_][a-z_0-9]*", queue.pop()))
        for name in words & CTES.keys() - found:
            found.add(name)
            queue.append(CTES[name])
    return [name for name in CTES if name in found]


def statements() -> dict[str, str]:
    out = {}
    for name, sql in SQL.items():
        names = needed(sql)
        head = "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n]})" for n in names) + "\n" if names else ""
        out[name] = head + sql
    return out


def even(x: str, digits: int) -> str:
    """Scale, round half to even, scale back."""
    s = f"{10**digits}.0"
    return f"(CAST(round_even(CAST(({x}) * {s} AS DOUBLE), 0) AS DOUBLE) / {s})"


def up(x: str, digits: int) -> str:
    s = f"{10**digits}.0"
    return f"(floor(CAST(({x}) AS DOUBLE) * {s} + 0.5) / {s})"


def med(x: str, over: str = "") -> str:
    """Median as the mean of the two middle values of the sorted list."""
    values = f"list_sort(list({x}) FILTER (WHERE ({x}) IS NOT NULL) {over})"
    n = f"(count({x}) {over})"
    return f"({values}[({n} + 1) // 2] * 0.5 + {values}[{n} // 2 + 1] * 0.5)"


STEP_US = "43200000000"
# --- the sensor network in terms of the tables ---------------------------------------------------------------------
cte("rd", """
SELECT 'S' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS sensor_id, user_id, event_id, event_type,
       epoch_us(ts) AS us, ts, value FROM events
""")
cte("sn", """
SELECT 'S' || lpad(CAST(user_id AS VARCHAR), 7, '0') AS sensor_id, user_id,
       'A' || lpad(CAST(user_id // 3 AS VARCHAR), 7, '0') AS asset_id,
       CASE user_id % 4 WHEN 0 THEN 'temperature' WHEN 1 THEN 'vibration' WHEN 2 THEN 'moisture' ELSE 'pressure' END
           AS sensor_type,
       CASE (user_id // 4) % 2 WHEN 0 THEN 'inner' ELSE 'outer' END AS placement,
       CASE user_id % 4 WHEN 0 THEN '°C' WHEN 1 THEN 'mm/s' WHEN 2 THEN '%' ELSE 'psi' END AS unit,
       -100.03 + (((user_id // 3) * 7919) % 10007) / 10007.0::DOUBLE * 0.025::DOUBLE
           + ((user_id % 7) - 3) * 0.00005::DOUBLE AS lon,
       37.745 + (((user_id // 3) * 104729) % 10009) / 10009.0::DOUBLE * 0.017::DOUBLE
           + ((user_id % 5) - 2) * 0.00005::DOUBLE AS lat
FROM (SELECT DISTINCT user_id FROM events)
""")
cte("th", """
SELECT t.sensor_type, p.placement, CASE WHEN t.sensor_type = 'pressure' THEN 2.0 END AS warn_low, 150.0 AS warn_high,
       CASE WHEN t.sensor_type = 'pressure' THEN 0.5 END AS crit_low, 250.0 AS crit_high
FROM (VALUES ('temperature'), ('vibration'), ('moisture'), ('pressure')) t(sensor_type),
     (VALUES ('inner'), ('outer')) p(placement)
""")
cte("assets", """
SELECT 'A' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS asset_id, c_custkey AS num, c_name AS name,
       c_nationkey % 2 = 0 AS is_simulated,
       ['building', 'road', 'bridge', 'power', 'street_light'][c_nationkey % 5 + 1] AS asset_type,
       ['Buildings', 'Transportation', 'Transportation', 'Utilities', 'Utilities'][c_nationkey % 5 + 1] AS category,
       -100.03 + ((c_custkey * 7919) % 10007) / 10007.0::DOUBLE * 0.025::DOUBLE AS lon,
       37.745 + ((c_custkey * 104729) % 10009) / 10009.0::DOUBLE * 0.017::DOUBLE AS lat
FROM customer
""")
cte("an", """
SELECT 'N' || lpad(CAST(r.event_id AS VARCHAR), 7, '0') AS anomaly_id, r.sensor_id, s.asset_id, s.sensor_type,
       s.placement, r.us AS s_us, r.us + (r.event_id % 48) * 3600000000 AS e_us, r.value, r.value / 500.0 AS anomaly_score,
       CASE WHEN r.value > 250 THEN 'critical' WHEN r.value > 210 THEN 'high' WHEN r.value > 180 THEN 'medium'
            ELSE 'low' END AS severity,
       CASE WHEN r.value > 250 THEN 7 WHEN r.value > 210 THEN 4 WHEN r.value > 180 THEN 2 ELSE 1 END AS w,
       CASE WHEN r.value > 250 THEN 4 WHEN r.value > 210 THEN 3 WHEN r.value > 180 THEN 2 ELSE 1 END AS rk,
       s.lon, s.lat
FROM rd r JOIN sn s ON s.sensor_id = r.sensor_id WHERE r.value > 150
""")
cte("le", """
SELECT event_id, 'label_' || event_type AS event_type, event_type <> 'view' AS is_anomaly,
       us - 2 * 3600000000 AS s_us, us + 3 * 3600000000 AS e_us,
       CASE WHEN event_type <> 'view' THEN sensor_id END AS sensor_id,
       CASE user_id % 4 WHEN 1 THEN 'vibration' WHEN 2 THEN 'moisture' WHEN 3 THEN 'pressure' END AS sensor_type
FROM rd WHERE value > 140
""")
cte("ax", f"""
SELECT min(us) AS s0, CAST(floor((max(us) - min(us)) / {STEP_US}.0 + 1e-6) AS BIGINT) + 1 AS n FROM rd
""")
cte("st", f"SELECT u.i AS step, ax.s0 + u.i * {STEP_US} AS us FROM ax, unnest(range(ax.n)) AS u(i)")
cte("now", f"""
SELECT greatest(least((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - s0) // {STEP_US}, n - 1), 0) AS step,
       s0 + greatest(least((epoch_us(TIMESTAMP '2024-01-20 00:00:00') - s0) // {STEP_US}, n - 1), 0) * {STEP_US} AS us
FROM ax
""")
cte("placed", f"""
SELECT r.*, CAST(ceil((r.us - ax.s0) / {STEP_US}.0 - 1e-6) AS BIGINT) AS cell FROM rd r, ax
""")
cte("gr", """
SELECT sensor_id, cell, max(us) AS us, arg_max(value, us) AS value FROM placed, ax
WHERE cell BETWEEN 0 AND ax.n - 1 GROUP BY sensor_id, cell
""")
# --- ingestion ---------------------------------------------------------------------------------------------------
cte("raw", """
SELECT CASE WHEN event_id % 31 = 0 THEN '' WHEN event_id % 37 = 0 THEN 'X' || event_id ELSE sensor_id END AS sid,
       CASE WHEN event_id % 41 = 0 THEN 'naive' WHEN event_id % 43 = 0 THEN 'bad' ELSE 'ok' END AS tk,
       CASE WHEN event_id % 5 = 0 THEN us // 86400000000 * 86400000000 ELSE us // 1000000 * 1000000 END AS tus,
       CASE WHEN event_id % 47 = 0 THEN 'nan' WHEN event_id % 53 = 0 THEN 'null' WHEN event_id % 59 = 0 THEN 'inf'
            ELSE 'num' END AS vk,
       CASE WHEN event_id % 7 = 0 THEN -value ELSE value END AS v, event_id % 61 = 0 AS wrong_unit, event_id AS seq
FROM rd
""")
cte("checked", """
SELECT raw.*, s.sensor_type, CASE WHEN sid = '' THEN 'invalid_record' WHEN tk = 'bad' OR vk = 'null' THEN 'invalid_record'
       WHEN s.sensor_id IS NULL THEN 'unknown_sensor' WHEN tk = 'naive' THEN 'naive_timestamp'
       WHEN vk <> 'num' THEN 'non_finite_value' WHEN wrong_unit THEN 'unit_mismatch' END AS reason,
       CASE s.sensor_type WHEN 'temperature' THEN v BETWEEN -60 AND 150 WHEN 'moisture' THEN v BETWEEN 0 AND 100
            ELSE v BETWEEN 0 AND 500 END AS plaus
FROM raw LEFT JOIN sn s ON s.sensor_id = raw.sid
""")
cte("kept", """
SELECT sid, tus, arg_max(v, seq) AS v, arg_max(plaus, seq) AS plaus, count(*) - 1 AS dup
FROM checked WHERE reason IS NULL GROUP BY sid, tus
""")
oracle("ingest_validate", """
SELECT seq, coalesce(reason, 'accepted') AS reason,
       CASE WHEN reason IS NULL THEN CASE WHEN plaus THEN 'ok' ELSE 'suspect' END END AS status FROM checked
""")
oracle("ingest_dedup_upsert", """
SELECT sid AS sensor_id, tus AS ts, v AS value, CASE WHEN plaus THEN 'ok' ELSE 'suspect' END AS status, 'batch' AS source
FROM kept
UNION ALL
SELECT r.sensor_id, r.us, r.value, 'ok', 'stored' FROM rd r
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.sid = r.sensor_id AND k.tus = r.us)
""")
oracle("ingest_result", """
SELECT (SELECT count(*) FROM kept) AS accepted, (SELECT count(*) FROM kept WHERE NOT plaus) AS suspect,
       CAST(sum(n) AS BIGINT) AS rejected, string_agg(reason || '=' || n, ',' ORDER BY reason) AS reasons
FROM (SELECT reason, count(*) AS n FROM checked WHERE reason IS NOT NULL GROUP BY reason
      UNION ALL SELECT * FROM (SELECT 'duplicate_reading', CAST(sum(dup) AS BIGINT) AS d FROM kept) WHERE d > 0)
""")
# --- axis and grid -----------------------------------------------------------------------------------------------
oracle("reading_cells", "SELECT sensor_id, cell, us AS ts, value FROM gr")
oracle("grid_report", """
SELECT count(*) FILTER (WHERE i) AS n_readings, CAST(coalesce(sum(c - 1) FILTER (WHERE i), 0) AS BIGINT) AS n_superseded,
       CAST(coalesce(sum(c) FILTER (WHERE NOT i), 0) AS BIGINT) AS n_outside
FROM (SELECT sensor_id, cell, cell BETWEEN 0 AND max(ax.n) - 1 AS i, count(*) AS c FROM placed, ax GROUP BY 1, 2)
""")
oracle("asof_resolve", f"""
SELECT event_id, CAST(greatest(least(floor((us + ((event_id % 81) - 40) * 24 * 3600000000 - s0) / {STEP_US}.0), n - 1), 0)
       AS BIGINT) AS step FROM rd, ax
""")
oracle("local_profile_keys", """
SELECT event_id, CAST(hour(ts - INTERVAL 6 HOUR) AS BIGINT) AS hour, isodow(ts - INTERVAL 6 HOUR) >= 6 AS weekend,
       strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events
""")
oracle("sampling_step", """
SELECT gap, count(*) AS n FROM (
  SELECT date_diff('day', lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), o_orderdate)
         AS gap FROM orders)
WHERE gap IS NOT NULL GROUP BY gap ORDER BY n DESC, gap LIMIT 1
""")
# --- status ------------------------------------------------------------------------------------------------------
oracle("sensor_latest", """
SELECT s.sensor_id, s.asset_id, s.sensor_type, r.us AS ts, r.value
FROM sn s LEFT JOIN LATERAL (SELECT us, value FROM rd WHERE rd.sensor_id = s.sensor_id ORDER BY us DESC LIMIT 1) r ON true
""")
cte("cur", f"""
SELECT s.*, th.warn_low, th.warn_high, r.us, r.value,
       EXISTS (SELECT 1 FROM an WHERE an.sensor_id = s.sensor_id AND an.s_us <= now.us AND an.e_us >= now.us) AS ina
FROM sn s CROSS JOIN now JOIN th ON th.sensor_type = s.sensor_type AND th.placement = s.placement
LEFT JOIN LATERAL (SELECT us, value FROM rd WHERE rd.sensor_id = s.sensor_id AND rd.us <= now.us
                   AND rd.us > now.us - {STEP_US} ORDER BY us DESC LIMIT 1) r ON true
""")
cte("curst", """
SELECT *, CASE WHEN us IS NULL THEN 'offline' WHEN ina THEN 'anomaly'
               WHEN value > 100 OR value < warn_low OR value > warn_high THEN 'warning' ELSE 'normal' END AS status
FROM cur
""")
oracle("sensor_status_asof", """
SELECT sensor_id, asset_id, sensor_type, status, us AS ts, value, coalesce(value > 100, false) AS flagged FROM curst
""")
cte("ser", """
SELECT s.sensor_id, s.asset_id, s.sensor_type, st.step, g.value IS NOT NULL AS reporting, g.value,
       (g.value - 50) / 20.0 AS z, coalesce(g.value > 100, false) AS flagged,
       coalesce(g.value < th.warn_low, false) OR coalesce(g.value > th.warn_high, false) AS outside_warn,
       EXISTS (SELECT 1 FROM an WHERE an.sensor_id = s.sensor_id AND an.s_us <= st.us AND an.e_us >= st.us) AS anomaly_active
FROM sn s CROSS JOIN st JOIN th ON th.sensor_type = s.sensor_type AND th.placement = s.placement
LEFT JOIN gr g ON g.sensor_id = s.sensor_id AND g.cell = st.step
""")
cte("sst", """
SELECT *, CASE WHEN NOT reporting THEN 'offline' WHEN anomaly_active THEN 'anomaly' WHEN flagged OR outside_warn
          THEN 'warning' ELSE 'normal' END AS status FROM ser
""")
oracle("sensor_status_series", """
SELECT sensor_id, step, value, reporting, flagged, outside_warn, anomaly_active, status FROM sst
""")
# --- health ------------------------------------------------------------------------------------------------------
cte("hz", f"""
SELECT sensor_id, asset_id, step, reporting,
       {med('abs(z)', 'OVER (PARTITION BY sensor_id ORDER BY step RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)')} AS recent
FROM ser
""")
cte("hs", """
SELECT asset_id, step, count(*) AS tot, count(*) FILTER (WHERE reporting) AS rep,
       sum(CASE WHEN reporting THEN least(greatest(coalesce(recent, 0) - 3, 0), 5) ELSE 0 END) AS excess
FROM hz GROUP BY asset_id, step
""")
cte("ha", """
SELECT an.asset_id, st.step, an.w AS sev, CASE WHEN an.e_us >= st.us THEN 1.0
       ELSE pow(0.5, (st.us - an.e_us) / 3600000000.0 / 48.0) END AS wt, an.e_us >= st.us AS act
FROM an, st WHERE an.s_us <= st.us AND st.us - an.e_us <= 168 * 3600000000
""")
cte("hg", """
SELECT asset_id, step, sum(wt) AS sw, sum(wt * sev) AS sws, count(*) AS inw, count(*) FILTER (WHERE act) AS act
FROM ha GROUP BY asset_id, step
""")
cte("hp", """
SELECT hs.asset_id, hs.step, hs.tot, hs.rep, coalesce(hg.inw, 0) AS inw, coalesce(hg.act, 0) AS act,
       least(20.0, 6.0 * coalesce(sw, 0)) AS f, least(45.0, 6.0 * coalesce(sws, 0)) AS s,
       least(10.0, 2.0 * CASE WHEN rep > 0 THEN excess / rep ELSE 0 END) AS r, 20.0 * (tot - rep) / tot AS o
FROM hs LEFT JOIN hg ON hg.asset_id = hs.asset_id AND hg.step = hs.step
""")
cte("hl", f"""
SELECT asset_id, step, tot AS sensors_total, rep AS sensors_reporting, inw AS anomalies_in_window, act AS active_anomalies,
       {even('f', 3)} AS frequency_penalty, {even('s', 3)} AS severity_penalty, {even('r', 3)} AS reading_penalty,
       {even('o', 3)} AS sensor_penalty,
       CAST(least(greatest(floor(100.0 - (f + s + r + o) + 0.5), 0), 100) AS BIGINT) AS health_score FROM hp
""")
cte("hh", """
SELECT *, CASE WHEN health_score >= 90 THEN 'normal' WHEN health_score >= 70 THEN 'watch'
               WHEN health_score >= 45 THEN 'at_risk' ELSE 'critical' END AS status FROM hl
""")
oracle("asset_health_series", "SELECT * FROM hh")
oracle("asset_health_latest", f"""
SELECT asset_id, s0 + step * {STEP_US} AS as_of, health_score, status FROM hh, ax WHERE step = n - 1
""")
oracle("needs_attention", """
SELECT h.asset_id, h.health_score, h.status, a.name, a.asset_type, coalesce(c.k, 0) AS active_count
FROM hh h JOIN now ON h.step = now.step LEFT JOIN assets a ON a.asset_id = h.asset_id
LEFT JOIN (SELECT asset_id, count(*) AS k FROM an, now WHERE s_us <= now.us AND e_us >= now.us GROUP BY 1) c
       ON c.asset_id = h.asset_id
WHERE h.health_score < 90 ORDER BY h.health_score, active_count DESC, h.asset_id LIMIT 12
""")
oracle("health_summary", """
SELECT b.status, count(h.asset_id) AS n, (SELECT count(*) FROM hh, ax WHERE step = n - 1) AS monitored_assets,
       (SELECT count(*) FROM hh, ax WHERE step = n - 1 AND health_score < 70) AS assets_at_risk
FROM (VALUES ('normal'), ('watch'), ('at_risk'), ('critical')) b(status)
LEFT JOIN (SELECT hh.* FROM hh, ax WHERE step = ax.n - 1) h ON h.status = b.status GROUP BY b.status
""")
oracle("health_strings", """
SELECT asset_id, string_agg(CAST(health_score AS VARCHAR), ',' ORDER BY step) AS health,
       string_agg(CASE status WHEN 'normal' THEN 'n' WHEN 'watch' THEN 'w' WHEN 'at_risk' THEN 'r' ELSE 'c' END, ''
                  ORDER BY step) AS status
FROM hh GROUP BY asset_id
""")
oracle("kpis_asof", """
SELECT (SELECT count(*) FROM assets) AS total_assets, (SELECT count(*) FROM assets WHERE NOT is_simulated) AS real_assets,
       (SELECT count(*) FROM assets WHERE is_simulated) AS simulated_assets,
       (SELECT count(DISTINCT asset_id) FROM sn) AS monitored_assets, (SELECT count(*) FROM curst) AS total_sensors,
       (SELECT count(*) FROM curst WHERE status <> 'offline') AS active_sensors,
       (SELECT count(*) FROM curst WHERE status = 'offline') AS offline_sensors,
       (SELECT count(*) FROM curst WHERE status = 'warning') AS warning_sensors,
       (SELECT count(*) FROM an, now WHERE s_us <= now.us AND e_us >= now.us) AS active_anomalies,
       (SELECT count(*) FROM an, now WHERE s_us <= now.us AND e_us >= now.us AND severity = 'critical') AS critical_alerts,
       (SELECT count(*) FROM hh, now WHERE hh.step = now.step AND health_score < 70) AS assets_at_risk
""")
oracle("kpi_series", """
SELECT st.step, (SELECT count(*) FROM sst x WHERE x.step = st.step AND status <> 'offline') AS active_sensors,
       (SELECT count(*) FROM sst x WHERE x.step = st.step AND status = 'offline') AS offline_sensors,
       (SELECT count(*) FROM sst x WHERE x.step = st.step AND status = 'warning') AS warning_sensors,
       (SELECT count(*) FROM an WHERE s_us <= st.us AND e_us >= st.us) AS active_anomalies,
       (SELECT count(*) FROM an WHERE s_us <= st.us AND e_us >= st.us AND severity = 'critical') AS critical_alerts,
       (SELECT count(*) FROM hh WHERE hh.step = st.step AND health_score < 70) AS assets_at_risk
FROM st
""")
# --- baseline ----------------------------------------------------------------------------------------------------
cte("wk", f"""
SELECT g.sensor_id, g.cell, g.us, g.value, s.asset_id, s.sensor_type, s.placement, s.unit,
       count(*) OVER (PARTITION BY s.sensor_type, s.placement) AS rows_in_class,
       CASE WHEN s.sensor_type = 'vibration' THEN ln(greatest(g.value, 1e-3)) ELSE g.value END AS work,
       CAST(hour(make_timestamp(ax.s0 + g.cell * {STEP_US}) - INTERVAL 6 HOUR) AS BIGINT) AS hour,
       s.sensor_type = 'vibration' AND isodow(make_timestamp(ax.s0 + g.cell * {STEP_US}) - INTERVAL 6 HOUR) >= 6 AS weekpart
FROM gr g JOIN sn s ON s.sensor_id = g.sensor_id CROSS JOIN ax
""")
oracle("hourly_profile", f"""
SELECT o.sensor_id, CAST(h.h AS BIGINT) AS hour, p.p AS weekpart, round(coalesce(f.m, o.m), 9) AS profile
FROM (SELECT sensor_id, sensor_type, {med('work')} AS m FROM wk GROUP BY 1, 2) o
CROSS JOIN (SELECT unnest(range(24)) AS h) h
JOIN (VALUES (false), (true)) p(p) ON o.sensor_type = 'vibration' OR NOT p.p
LEFT JOIN (SELECT sensor_id, hour, weekpart, {med('work')} AS m FROM wk GROUP BY 1, 2, 3) f
       ON f.sensor_id = o.sensor_id AND f.hour = h.h AND f.weekpart = p.p
""")
oracle("robust_scale", f"""
SELECT sensor_id, round(c, 9) AS center, round({med('abs(work - c)')} * 1.4826, 9) AS sigma
FROM (SELECT sensor_id, work, {med('work', 'OVER (PARTITION BY sensor_id)')} AS c FROM wk) GROUP BY sensor_id, c
""")
cte("rs", f"""
SELECT *, work - {med('work', 'OVER (PARTITION BY sensor_id, hour, weekpart)')} AS residual,
       {med('work', 'OVER (PARTITION BY sensor_id, hour, weekpart)')} AS profile FROM wk
""")
cte("ct", f"SELECT *, {med('residual', 'OVER (PARTITION BY sensor_id)')} AS center FROM rs")
cte("csz", "SELECT sensor_type, placement, count(*) AS size FROM sn GROUP BY 1, 2")
cte("flr", """
SELECT ct.*, csz.size, CASE ct.sensor_type WHEN 'vibration' THEN 0.1 WHEN 'temperature' THEN
       CASE WHEN csz.size < 4 THEN 1.5 ELSE 0.5 END ELSE 0.5 END AS floor
FROM ct JOIN csz ON csz.sensor_type = ct.sensor_type AND csz.placement = ct.placement
""")
cte("scl", f"""
SELECT *, greatest({med('abs(residual - center)', 'OVER (PARTITION BY sensor_id)')} * 1.4826, floor) AS scale FROM flr
""")
cte("sc", f"""
SELECT *, {even('(residual - center) / scale', 3)} AS z, profile + center AS ew FROM scl
""")
cte("sce", """
SELECT *, CASE WHEN sensor_type = 'vibration' THEN exp(ew) ELSE ew END AS expected,
       CASE WHEN sensor_type = 'vibration' THEN exp(ew - 3 * scale) ELSE ew - 3 * scale END AS expected_low,
       CASE WHEN sensor_type = 'vibration' THEN exp(ew + 3 * scale) ELSE ew + 3 * scale END AS expected_high FROM sc
""")
oracle("robust_z", """
SELECT sensor_id, cell, z, CAST(floor AS DOUBLE) AS floor, round(scale, 8) AS scale, round(expected, 8) AS expected,
       round(expected_low, 8) AS expected_low, round(expected_high, 8) AS expected_high FROM sce
""")
oracle("class_median", f"""
SELECT sensor_type, placement, cell, count(*) AS n, round({med('x')}, 8) AS class_median
FROM (SELECT sensor_type, placement, cell, residual / greatest(s, fl) AS x FROM (
        SELECT *, CASE sensor_type WHEN 'vibration' THEN 0.1 ELSE 0.5 END AS fl,
               {med('abs(residual - center)', 'OVER (PARTITION BY sensor_id)')} * 1.4826 AS s FROM flr WHERE size >= 4))
GROUP BY 1, 2, 3
""")
oracle("price_medians", f"""
SELECT l_returnflag, l_linestatus, count(*) AS n, round({med('l_extendedprice / l_quantity')}, 6) AS median
FROM lineitem GROUP BY 1, 2
""")
W6 = "(PARTITION BY sensor_id ORDER BY cell RANGE BETWEEN 5 PRECEDING AND CURRENT ROW)"
W3 = "(PARTITION BY sensor_id ORDER BY cell RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)"
W12 = "(PARTITION BY sensor_id ORDER BY cell RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)"
cte("rol", f"""
SELECT *, CASE WHEN count(z) OVER {W6} >= 4 THEN {med('z', 'OVER ' + W6)} END AS tz FROM sce
""")
oracle("rolling_median_flags", """
SELECT sensor_id, cell, round(tz, 6) AS trailing_z, coalesce(abs(tz) >= 3, false) AS rolling FROM rol
""")
oracle("short_features", f"""
SELECT sensor_id, cell, round(coalesce(z - (SELECT p.z FROM sce p WHERE p.sensor_id = q.sensor_id AND p.cell = q.cell - 1),
       0), 6) AS delta_z, round(avg(z) OVER {W3}, 6) AS mean_short, round(stddev_pop(z) OVER {W3}, 6) AS std_short,
       round(avg(z) OVER {W12}, 6) AS mean_long FROM sce q
""")
cte("fl", """
SELECT rol.*, th.warn_low, th.warn_high, th.crit_low, th.crit_high,
       coalesce(value < crit_low, false) OR coalesce(value > crit_high, false) AS critical, abs(z) >= 6 AS strong,
       coalesce(abs(tz) >= 3, false) AS rolling, abs(z) >= 3 AS moderate
FROM rol JOIN th ON th.sensor_type = rol.sensor_type AND th.placement = rol.placement
""")
cte("flg", "SELECT *, critical OR strong OR rolling OR moderate AS flagged, moderate OR critical AS core FROM fl")
oracle("hour_flags", """
SELECT sensor_id, cell, z, critical, strong, rolling, moderate, flagged, core FROM flg
""")
cte("isl", """
SELECT *, sum(CASE WHEN prev IS NULL OR cell - prev > 3 THEN 1 ELSE 0 END)
          OVER (PARTITION BY sensor_id ORDER BY cell ROWS UNBOUNDED PRECEDING) AS island
FROM (SELECT *, lag(cell) OVER (PARTITION BY sensor_id ORDER BY cell) AS prev FROM flg WHERE flagged)
""")
oracle("flag_islands", """
SELECT sensor_id, CAST(island AS BIGINT) AS island, min(cell) AS first_cell, max(cell) AS last_cell,
       count(*) AS flagged_steps FROM isl GROUP BY 1, 2
""")
cte("spn", """
SELECT sensor_id, island, min(cell) FILTER (WHERE core) AS a, max(cell) FILTER (WHERE core) AS b FROM isl
GROUP BY 1, 2 HAVING count(*) FILTER (WHERE core) > 0
""")
cte("pk", """
SELECT sensor_id, island, arg_min(cell, (-abs(z), cell)) AS peak, count(*) AS nf FROM isl JOIN spn USING (sensor_id, island)
WHERE cell BETWEEN a AND b GROUP BY 1, 2
""")
cte("agg", """
SELECT s.sensor_id, s.island, s.a, s.b, min(f.us) AS s_us, max(f.us) AS e_us, min(f.value) AS lo, max(f.value) AS hi,
       bool_or(critical) AS crit, bool_or(strong) AS strong, bool_or(rolling) AS rolling,
       any_value(warn_low) AS wl, any_value(warn_high) AS wh, any_value(crit_low) AS cl, any_value(crit_high) AS ch,
       any_value(sensor_type) AS sensor_type, any_value(asset_id) AS asset_id
FROM spn s JOIN flg f ON f.sensor_id = s.sensor_id AND f.cell BETWEEN s.a AND s.b GROUP BY 1, 2, 3, 4
""")
cte("ev0", f"""
SELECT agg.*, p.peak, p.nf, f.us AS p_us, f.z, f.value AS obs, {even('f.expected', 4)} AS exp4,
       CAST(round_even(CAST((b - a) * 12 AS DOUBLE), 0) AS BIGINT) + 1 AS dur,
       CASE WHEN lo < cl OR hi > ch THEN 'critical' WHEN lo < wl OR hi > wh THEN 'warning' END AS lvl,
       CASE WHEN lo < cl THEN 'below' WHEN hi > ch THEN 'above' WHEN lo < wl THEN 'below' WHEN hi > wh THEN 'above' END
           AS side,
       CASE WHEN lo < cl THEN cl WHEN hi > ch THEN ch WHEN lo < wl THEN wl WHEN hi > wh THEN wh END AS lim,
       CASE WHEN lo < cl THEN lo WHEN hi > ch THEN hi WHEN lo < wl THEN lo WHEN hi > wh THEN hi END AS extr
FROM agg JOIN pk p ON p.sensor_id = agg.sensor_id AND p.island = agg.island
JOIN flg f ON f.sensor_id = agg.sensor_id AND f.cell = p.peak
WHERE abs(f.z) >= 6 OR p.nf >= 3 OR agg.crit
""")
cte("ev1", f"""
SELECT ev0.*, ax.s0 + (ax.n - 1) * {STEP_US} AS end_us,
       CASE WHEN z = 0 THEN 0.0 ELSE least(greatest(log2(abs(z) / 3.0) / 4.0, 0.0), 1.0) END AS m,
       least(greatest(ln(1.0 + dur) / ln(97.0), 0.0), 1.0) AS d,
       CASE lvl WHEN 'critical' THEN 1.0 WHEN 'warning' THEN 0.5 ELSE 0.0 END AS t FROM ev0, ax
""")
cte("ev2", f"SELECT *, {even('m * 0.5 + d * 0.25 + t * 0.25', 3)} AS score FROM ev1")
cte("ev", """
SELECT *, CASE WHEN score >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'high' WHEN score >= 0.3 THEN 'medium'
               ELSE 'low' END AS severity,
       CASE sensor_type
         WHEN 'vibration' THEN CASE WHEN z <= 0 THEN 'vibration_drop' WHEN dur <= 3 THEN 'vibration_spike'
                                    ELSE 'sustained_high_vibration' END
         WHEN 'moisture' THEN CASE WHEN z > 0 THEN 'moisture_increase' ELSE 'moisture_decrease' END
         WHEN 'pressure' THEN CASE WHEN z > 0 THEN 'pressure_spike' WHEN dur >= 36 THEN 'pressure_decline'
                                   ELSE 'pressure_drop' END
         ELSE CASE WHEN dur >= 24 THEN 'temperature_drift' WHEN z > 0 THEN 'temperature_spike'
                   ELSE 'temperature_drop' END END AS anomaly_type,
       concat_ws('+', CASE WHEN crit THEN 'threshold' END,
                 CASE WHEN strong OR NOT (crit OR strong OR rolling) THEN 'robust_zscore' END,
                 CASE WHEN rolling THEN 'rolling_median' END) AS method,
       CASE WHEN e_us >= end_us THEN 'active' ELSE 'resolved' END AS status
FROM ev2
""")
oracle("anomaly_events", """
SELECT sensor_id, s_us AS started_at, e_us AS ended_at, p_us AS peak_at, a AS start_cell, b AS end_cell, peak AS peak_cell,
       nf AS flagged_steps, dur AS duration_hours, z AS robust_z, obs AS observed_value, exp4 AS expected_value, status
FROM ev
""")
oracle("event_scores", f"""
SELECT sensor_id, a AS start_cell, score AS anomaly_score, severity, anomaly_type, {even('m', 3)} AS magnitude,
       {even('d', 3)} AS duration, CAST(t AS DOUBLE) AS threshold FROM ev
""")
oracle("event_methods", """
SELECT sensor_id, a AS start_cell, method AS detection_method, lvl AS breach_level, side AS breach_side,
       CAST(lim AS DOUBLE) AS breach_limit, extr AS breach_extreme FROM ev
""")
oracle("detect_anomalies", """
SELECT 'ANM-' || lpad(CAST(row_number() OVER (ORDER BY s_us, sensor_id) AS VARCHAR), 4, '0') AS anomaly_id, sensor_id,
       asset_id, sensor_type, anomaly_type, s_us AS started_at, e_us AS ended_at, p_us AS peak_at, dur AS duration_hours,
       obs AS observed_value, z AS robust_z, score AS anomaly_score, severity, method AS detection_method, status
FROM ev
""")


def shown(x: str) -> str:
    """A reading with a precision that suits its size."""
    return (
        f"CASE WHEN abs({x}) >= 100 THEN printf('%.0f', {x}) WHEN abs({x}) >= 1 THEN printf('%.1f', {x}) "
        f"ELSE printf('%.2f', {x}) END"
    )


def short(x: str, digits: int) -> str:
    return f"regexp_replace(printf('%.{digits}f', {x}), '0$', '')"


cte("tx", f"""
SELECT ev.*, s.placement, s.unit, lim::DOUBLE AS limd, {even('m', 3)} AS m3, {even('d', 3)} AS d3, t::DOUBLE AS t3,
       list_filter([CASE WHEN contains(method, 'threshold') THEN 'critical threshold' END,
                    CASE WHEN contains(method, 'robust_zscore') THEN 'robust z-score' END,
                    CASE WHEN contains(method, 'rolling_median') THEN 'rolling median' END], lambda x: x IS NOT NULL) AS names,
       CASE anomaly_type WHEN 'vibration_spike' THEN 'Short elevated vibration'
            WHEN 'sustained_high_vibration' THEN 'Sustained high vibration' WHEN 'vibration_drop' THEN 'Unusually low vibration'
            WHEN 'moisture_increase' THEN 'Unusual moisture increase' WHEN 'moisture_decrease' THEN 'Unusual moisture decrease'
            WHEN 'pressure_drop' THEN 'Pressure drop' WHEN 'pressure_spike' THEN 'Short pressure excursion'
            WHEN 'pressure_decline' THEN 'Gradual pressure decline' WHEN 'temperature_spike' THEN 'Abnormal temperature rise'
            WHEN 'temperature_drift' THEN 'Temperature drift' ELSE 'Abnormal temperature drop' END AS label
FROM ev JOIN sn s ON s.sensor_id = ev.sensor_id
""")
oracle("anomaly_explanations", f"""
SELECT sensor_id, a AS start_cell, 0::BIGINT AS causal,
  label || ' on ' || sensor_id || ' (' || placement || '): ' || {shown('obs')} || ' ' || unit || ' at peak versus an expected '
  || {shown('exp4')} || ' ' || unit || ' for that hour — ' || printf('%.1f', abs(z)) || ' robust standard deviations'
  || CASE WHEN sensor_type = 'vibration' THEN ' (log scale)' ELSE '' END || CASE WHEN z > 0 THEN ' above' ELSE ' below' END
  || ' this sensor''s baseline, '
  || CASE WHEN sensor_type = 'vibration' AND exp4 > 0 THEN printf('%.1f', obs / exp4) || '× the expected level'
     ELSE 'a difference of ' || {shown('abs(obs - exp4)')} || ' ' || unit END
  || ', lasting ' || dur || ' h' || CASE WHEN status = 'active' THEN ' and still present at the end of the analysed window' ELSE '' END
  || '.' || CASE WHEN lvl IS NULL THEN '' ELSE ' The ' || CASE WHEN side = 'below' THEN 'lowest' ELSE 'highest' END
     || ' reading of the event, ' || {shown('extr')} || ' ' || unit || ', is ' || side || ' the ' || lvl || ' limit of '
     || {shown('limd')} || ' ' || unit || '.' END
  || ' Flagged by ' || CASE len(names) WHEN 1 THEN names[1] WHEN 2 THEN names[1] || ' and ' || names[2]
     ELSE names[1] || ', ' || names[2] || ' and ' || names[3] END || '.'
  || ' Severity ' || severity || ' (score ' || {short('score', 3)} || ': magnitude ' || {short('m3', 2)} || ', duration '
  || {short('d3', 2)} || ', threshold ' || {short('t3', 2)} || ').' AS explanation
FROM tx
""")
