"""Time axis, cells, carry-forward, status, recency, health and medians against small independent computations."""

import random
import statistics
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from assetpulse.functions import rules, timeaxis
from assetpulse.functions.timeaxis import TimeAxis
from assetpulse.operators import asof, baseline, grid, health, medians, quality
from assetpulse.params import Params

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
AXIS = TimeAxis(int(START.timestamp()) * 1_000_000, 721, 3600)


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_cells_and_as_of(spark):
    offsets = [0, 1, 3599, 3600, 3601, 7200, -1, 720 * 3600]
    df = spark.createDataFrame([(i, at(o)) for i, o in enumerate(offsets)], "i int, ts timestamp")
    got = [r.c for r in df.select("i", AXIS.cell(F.col("ts")).alias("c")).orderBy("i").collect()]
    assert got == [0, 1, 1, 1, 2, 2, 0, 720]
    assert AXIS.index_of(at(12 * 3600 + 3599)) == 12
    assert AXIS.index_of(datetime(2024, 1, 1, 12, 30)) == 12
    assert AXIS.index_of(datetime(2020, 1, 1)) == 0 and AXIS.index_of(datetime(2030, 1, 1)) == 720 and AXIS.index_of(None) == 720
    cols = [r.c for r in df.select("i", AXIS.as_of_index(F.col("ts")).alias("c")).orderBy("i").collect()]
    assert cols == [0, 0, 0, 1, 1, 2, 0, 720]
    with pytest.raises(ValueError):
        AXIS.range_of(at(7200), at(0))


def test_parse_request_time(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00 02:00",), ("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("x",)], "t string")
    got = [r.v for r in df.select(timeaxis.iso_z(timeaxis.parse_request_time(F.col("t"))).alias("v")).collect()]
    assert got == ["2023-12-31T22:00:00Z", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00Z", None]


@pytest.mark.parametrize("window, expected", [(1, [0, -1, -1, 3, 4, -1]), (3, [0, 0, 0, 3, 4, 4])])
def test_carry_forward(spark, window, expected):
    axis = TimeAxis(AXIS.start_us, 6, 3600)
    sensors = spark.createDataFrame([("s", window * 3600), ("silent", 3600)], "sensor_id string, sampling_interval_s int")
    cells = spark.createDataFrame([("s", c, float(c)) for c in (0, 3, 4)], "sensor_id string, cell bigint, value double")
    rows = grid.carry_forward(cells, sensors, axis, ["value"]).orderBy("sensor_id", "step").collect()
    assert [(-1 if r.cell is None else r.cell) for r in rows if r.sensor_id == "s"] == expected
    assert [r.reporting for r in rows if r.sensor_id == "silent"] == [False] * 6


def test_status_priority(spark):
    rows = [(r, a, f, w) for r in (0, 1) for a in (0, 1) for f in (0, 1) for w in (0, 1)]
    df = spark.createDataFrame([tuple(map(bool, r)) for r in rows], "r boolean, a boolean, f boolean, w boolean")
    got = df.select("*", rules.sensor_status(F.col("r"), F.col("a"), F.col("f") | F.col("w")).alias("s")).collect()
    for x in got:
        want = "offline" if not x.r else "anomaly" if x.a else "warning" if x.f or x.w else "normal"
        assert x.s == want


def test_recency(spark):
    hours = [9, 10, 20, 44, 68, 188, 189]
    df = spark.createDataFrame([(i, float(h - 20)) for i, h in enumerate(hours)], "i int, age double")
    got = [r.w for r in df.select("i", rules.recency_weight(F.col("age"), 48.0, 168.0).alias("w")).orderBy("i").collect()]
    assert got[1:] == pytest.approx([1, 1, 0.5**0.5, 0.5, 0.5**3.5, 0])


def expected_health(anomalies, t, sensors):
    """The health formula written out for one asset at hour t."""
    weights = {"low": 1, "medium": 2, "high": 4, "critical": 7}
    sw = sws = 0.0
    for start, end, severity in anomalies:
        if start <= t and t - end <= 168:
            w = 1.0 if end >= t else 0.5 ** ((t - end) / 48.0)
            sw, sws = sw + w, sws + w * weights[severity]
    levels = []
    for z in sensors:
        if z.get(t) is not None:
            recent = [abs(z[i]) for i in range(t - 5, t + 1) if z.get(i) is not None]
            levels.append(min(max(statistics.median(recent) - 3, 0), 5))
    reading = min(10, 2 * sum(levels) / len(levels)) if levels else 0.0
    off = 20 * (len(sensors) - len(levels)) / len(sensors)
    total = 100 - min(20, 6 * sw) - min(45, 6 * sws) - reading - off
    return int(min(max((total + 0.5) // 1, 0), 100))


def test_health_equals_the_formula(spark):
    rng = random.Random(7)
    axis = TimeAxis(AXIS.start_us, 300, 3600)
    zs = {f"s{i}": {t: (rng.gauss(0, 4) if rng.random() > 0.2 else None) for t in range(300)} for i in range(6)}
    anomalies = []
    for i in range(8):
        a = rng.randrange(0, 280)
        anomalies.append((f"a{i % 3}", a, a + rng.randrange(0, 30), rng.choice(["low", "medium", "high", "critical"])))
    rows = [(f"a{int(s[1]) % 3}", s, t, z, z is not None) for s, zz in zs.items() for t, z in zz.items()]
    series = spark.createDataFrame(rows, "asset_id string, sensor_id string, step bigint, z double, reporting boolean")
    an = spark.createDataFrame(
        [(a, s, at(b * 3600), at(e * 3600)) for a, b, e, s in anomalies],
        "asset_id string, severity string, started_at timestamp, ended_at timestamp",
    )
    got = {(r.asset_id, r.step): r.health_score for r in health.asset_health(series, an, axis, Params()).collect()}
    assert len(got) == 900
    for (asset, t), score in got.items():
        own = [(b, e, s) for a, b, e, s in anomalies if a == asset]
        assert score == expected_health(own, t, [zs[s] for s in zs if int(s[1]) % 3 == int(asset[1])]), (asset, t)


@pytest.mark.parametrize("n", [1, 2, 3, 10, 20_001, 30_000])
@pytest.mark.parametrize("q", [0.1, 0.5, 0.9])
def test_grouped_quantile_is_exact(spark, n, q):
    df = spark.range(n).select(F.lit("k").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(10007)) / 7.0).alias("v"))
    import numpy as np

    want = float(np.percentile([((i * 7919) % 10007) / 7.0 for i in range(n)], q * 100))
    got = medians.grouped_quantile(df, ["k"], "v", q, "m").first()
    assert got.n == n and got.m == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("accuracy", [20, 200, 10_000])
def test_several_quantiles_share_two_passes(spark, accuracy):
    """Small, large, constant and one-valued groups; nulls and NaN take no part; a large group keeps only its brackets."""
    import numpy as np

    groups = {
        "one": [4.0], "two": [1.0, 9.0], "same": [2.5] * 700, "large": [((i * 7919) % 3001) / 7.0 for i in range(3000)],
        "skew": [0.0] * 900 + [float(i) for i in range(100)], "wide": [(-1.0) ** i * 1.5 ** (i % 90) for i in range(1500)],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("two", float("nan")), ("none", None)]
    wanted = {"low": 0.0, "p10": 0.1, "p11": 0.11, "p50": 0.5, "p90": 0.9, "high": 1.0}
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {r.k: r for r in medians.grouped_quantiles(df, ["k"], "v", wanted, top="most", accuracy=accuracy).collect()}
    assert sorted(got) == sorted(groups)
    for k, vs in groups.items():
        assert got[k].n == len(vs) and got[k].most == max(vs)
        assert [got[k][c] for c in wanted] == pytest.approx([float(np.percentile(vs, q * 100)) for q in wanted.values()], rel=1e-12)
    assert medians.grouped_quantiles(df.limit(0), ["k"], "v", wanted).count() == 0


def test_decayed_means_and_peer_coefficients():
    import numpy as np

    out = baseline.decayed_means(np.array([5.0, np.nan, 1.0, 1.0]), 24.0, 1.0)
    a = 1 - np.exp(-1 / 24)
    assert out == pytest.approx([0, 0, a, a + a * (1 - a)])
    values = np.random.default_rng(1).normal(size=1000)
    values[::7] = np.nan
    level, want = 0.0, []
    for i, v in enumerate(values):
        level = level if i == 0 or np.isnan(v) else (1 - a) * level + a * v
        want.append(level)
    assert baseline.decayed_means(values, 24.0, 1.0) == pytest.approx(want)
    x = np.column_stack([np.arange(50.0), np.ones(50)])
    y = x @ np.array([2.0, -1.0])
    y[::10] += 500
    assert baseline.peer_coefficients(x, y) == pytest.approx([2.0, -1.0], abs=0.05)
    assert (baseline.peer_coefficients(x[:2], y[:2]) == 0).all()


def test_peer_adjustment_removes_what_a_class_shares(spark):
    """Eight sensors follow one common drift; one also jumps. With peers only the jump is unusual."""
    import numpy as np

    rng = np.random.default_rng(3)
    steps = 240
    drift = np.cumsum(rng.normal(0, 1, steps))
    rows = []
    for i in range(8):
        values = 20 + drift * (0.8 + 0.05 * i) + rng.normal(0, 0.2, steps)
        if i == 3:
            values[100:110] += 12
        rows += [(f"T{i}", at(int(t) * 3600), float(v)) for t, v in enumerate(values)]
    readings = spark.createDataFrame(rows, "sensor_id string, ts timestamp, value double")
    sensors = spark.createDataFrame(
        [(f"T{i}", "A1", "temperature", "bridge_deck", "°C", 0.0, 0.0, 3600) for i in range(8)],
        "sensor_id string, asset_id string, sensor_type string, placement string, unit string, lon double, lat double, "
        "sampling_interval_s int",
    )
    axis = TimeAxis.of(readings, 3600)
    cells = grid.to_cells(readings, axis)
    z = baseline.fit_baseline(cells, sensors, axis, Params(), peers=True)
    strong = {(r.sensor_id, r.cell) for r in z.where(F.abs("z") >= 6).collect()}
    assert strong == {("T3", c) for c in range(100, 110)}
    assert z.where("peer_adjusted").count() == 8 * steps


def test_gates_and_fingerprint(spark):
    with pytest.raises(quality.InputMissing):
        quality.require_rows({"readings": spark.range(0)})
    a = spark.range(100).withColumn("v", F.col("id") * 2)
    assert quality.fingerprint(a).first() == quality.fingerprint(a.repartition(7).orderBy(F.desc("id"))).first()
    assert quality.fingerprint(a).first() != quality.fingerprint(a.where("id > 0")).first()


def test_sensor_status_at_equals_series(spark):
    rows = [("s1", at(h * 3600), float(h)) for h in (0, 1, 2, 5, 6)] + [("s2", at(h * 3600), 500.0) for h in range(7)]
    scored = spark.createDataFrame(rows, "sensor_id string, ts timestamp, value double").withColumn("flagged", F.lit(False))
    sensors = spark.createDataFrame(
        [("s1", "a", "t", "p", 3600), ("s2", "a", "t", "p", 3600), ("s3", "b", "t", "p", 3600)],
        "sensor_id string, asset_id string, sensor_type string, placement string, sampling_interval_s int",
    )
    limits = spark.createDataFrame([("t", "p", None, 100.0)], "sensor_type string, placement string, warn_low double, warn_high double")
    an = spark.createDataFrame([("s1", at(3600), at(7200))], "sensor_id string, started_at timestamp, ended_at timestamp")
    axis = TimeAxis(AXIS.start_us, 7, 3600)
    series = {(r.sensor_id, r.step): r.status for r in asof.sensor_status_series(sensors, limits, scored, an, axis).collect()}
    for step in range(7):
        one = asof.sensor_status_at(sensors, limits, scored, an, at(step * 3600)).collect()
        assert {r.sensor_id: r.status for r in one} == {s: series[(s, step)] for s in ("s1", "s2", "s3")}
    assert [series[("s1", t)] for t in range(7)] == ["normal", "anomaly", "anomaly", "offline", "offline", "normal", "normal"]


@pytest.mark.parametrize("values", [(1.0, 9.0), (9.0, 1.0)])
def test_readings_of_equal_time_give_one_answer_in_any_order(spark, values):
    from assetpulse.streaming.jobs import cell_windows

    at = datetime(2024, 1, 1, 6)
    rows = [("S1", datetime(2024, 1, 1), 5.0), *[("S1", at, v) for v in values]]
    readings = spark.createDataFrame(rows, "sensor_id string, ts timestamp, value double").coalesce(1)
    axis = TimeAxis.of(readings, 3600)
    assert asof.latest_per_sensor(readings).first()["value"] == 9.0
    for cells in (grid.to_cells(readings, axis), cell_windows(readings, axis)):
        assert [r["value"] for r in cells.orderBy("cell").collect()][-1] == 9.0


#: microseconds behind a grid point: an hour's cell takes in readings up to 3,600 behind it
BEHIND = (-1, 0, 1, 3_599, 3_600, 3_601, 40_000)


def late_readings(spark):
    rows = [("S", at(0), 1.0), ("S", at(6 * 3600), 2.0)]
    rows += [(f"S{i}", at(2 * 3600) + timedelta(microseconds=us), 10.0 + i) for i, us in enumerate(BEHIND)]
    rows += [(f"S{i}", at(3 * 3600) + timedelta(microseconds=us), 30.0 + i) for i, us in enumerate(BEHIND)]
    return spark.createDataFrame(rows, "sensor_id string, ts timestamp, value double")


def test_stream_windows_take_in_what_the_cells_do(spark):
    from assetpulse.streaming.jobs import cell_windows

    readings = late_readings(spark)
    axis = TimeAxis.of(readings, 3600)
    want = sorted(map(tuple, grid.to_cells(readings, axis).collect()))
    assert {r[1] for r in want if r[0] == "S4"} == {2, 3} and {r[1] for r in want if r[0] == "S5"} == {3, 4}
    assert sorted(map(tuple, cell_windows(readings, axis).select("sensor_id", "cell", "ts", "value").collect())) == want


def test_status_at_one_time_of_gridded_readings_equals_the_series(spark, monkeypatch, tmp_path):
    """The parity query on readings just behind the as-of step and the step before it."""
    from assetpulse.plans import list_queries
    from assetpulse.plans.tables import Plant, STEP_S

    step = datetime(2024, 1, 20)
    rows = [(0, step - timedelta(days=5), 7, 20.0), (1, step + timedelta(days=5), 7, 20.0)]
    for i, us in enumerate((-1, 0, 1, 43_199, 43_201, 90_000)):
        for k in (0, 1):
            rows.append((2 + 2 * i + k, step - timedelta(seconds=k * STEP_S) + timedelta(microseconds=us), 10 + i, 120.0 - 100 * k))
    events = [(e, t.replace(tzinfo=timezone.utc), u, "view", v, "") for e, t, u, v in rows]
    spark.createDataFrame(events, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    assert tuple(list_queries.status_parity(Plant(spark, str(tmp_path))).first()) == (7, 0, 0)
