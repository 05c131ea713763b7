"""Detector and event rules on hand-made z series (48 steps, z = 0 and value 60 unless stated)."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from assetpulse.functions import rules, text
from assetpulse.functions.timeaxis import TimeAxis
from assetpulse.operators import detectors, events, grid
from assetpulse.params import Params

P = Params()
AXIS = TimeAxis(0, 48, 3600)
LIMITS = "sensor_type string, placement string, warn_low double, warn_high double, crit_low double, crit_high double"


def scores(spark, z, value=None, steps=48, kind="pressure"):
    z, value = dict(z), dict(value or {})
    rows = [
        ("P1", i, kind, "water_main", "A1", "psi", 0.0, 0.0, False, float(value.get(i, 60.0)), float(z.get(i, 0.0)), 60.0)
        for i in range(steps)
        if z.get(i, 0.0) is not None
    ]
    df = spark.createDataFrame(
        rows,
        "sensor_id string, cell bigint, sensor_type string, placement string, asset_id string, unit string, lon double, "
        "lat double, peer_adjusted boolean, value double, z double, expected double",
    )
    return df.withColumn("ts", AXIS.at(F.col("cell")))


def found(spark, z, value=None):
    limits = spark.createDataFrame([("pressure", "water_main", 40.0, 90.0, 20.0, 110.0)], LIMITS)
    flags = detectors.with_flags(scores(spark, z, value), limits, P)
    return flags, events.find_events(flags, AXIS, P).orderBy("start_cell")


@pytest.mark.parametrize(
    "z, spans",
    [
        ({10: 4.0, 11: 4.0, 14: 4.0}, [(10, 14)]),
        ({10: 7.0, 11: 4.0, 15: 7.0}, [(10, 11), (15, 15)]),
        ({i: 5.0 for i in range(20, 30)}, [(20, 29)]),
        ({10: 5.9}, []),
        ({10: 4.0, 11: 4.0}, []),
        ({10: 3.0, 13: -5.5}, []),
    ],
)
def test_event_spans(spark, z, spans):
    rows = found(spark, z)[1].collect()
    assert [(r.start_cell, r.end_cell) for r in rows] == spans


def test_peak_sign_and_methods(spark):
    r = found(spark, {10: 4.0, 11: -9.5, 12: 7.0})[1].first()
    assert (r.peak_cell, r.robust_z) == (11, -9.5)
    r = found(spark, {10: 3.2, 11: -3.1, 12: 3.4})[1].first()
    assert r.detection_method == "robust_zscore" and r.flagged_steps == 3


def test_limits_decide(spark):
    r = found(spark, {10: 1.0}, {10: 115.0})[1].first()
    assert r.detection_method == "threshold"
    assert (r.breach.level, r.breach.side, r.breach.limit, r.breach.extreme) == ("critical", "above", 110.0, 115.0)
    assert found(spark, {10: 1.0}, {10: 95.0})[1].count() == 0


def test_rolling_flags_outlast_the_shift(spark):
    z = {5: 50.0, **{i: 3.4 for i in range(20, 30)}}
    rows = detectors.with_rolling(scores(spark, z), P).where("rolling").orderBy("cell").collect()
    assert [r.cell for r in rows] == list(range(23, 32))


def test_rolling_needs_four_readings(spark):
    z = {0: None, 1: None, 2: None, 8: None, **{i: 5.0 for i in (3, 4, 5, 6, 7, 9)}}
    rows = detectors.with_rolling(scores(spark, z, steps=10), P).where("rolling").collect()
    assert sorted(r.cell for r in rows) == [6, 7, 9]


def test_short_features(spark):
    z = {0: 1.0, 1: 3.0, 2: None, 3: 2.0, 4: 6.0}
    rows = detectors.with_short_features(scores(spark, z, steps=5), P).orderBy("cell").collect()
    got = [(r.z, r.delta_z, r.mean_short, r.std_short, r.mean_long) for r in rows]
    assert got == [(1, 0, 1, 0, 1), (3, 2, 2, 1, 2), (2, 0, 2.5, 0.5, 2), (6, 4, 4, 2, 3)]


@pytest.mark.parametrize(
    "z, hours, level, score",
    [(7.4, 19, None, 0.327), (6.0, 1, None, 0.163), (48.0, 96, "critical", 1.0), (3.0, 0, "warning", 0.125)],
)
def test_score(spark, z, hours, level, score):
    df = spark.createDataFrame([(z, hours, level)], "z double, h int, l string")
    got = df.select(
        events.score_of(events.magnitude(F.col("z")), events.duration_part(F.col("h")), events.threshold_part(F.col("l"))).alias("s")
    ).first().s
    assert got == pytest.approx(score, abs=5e-4)


def test_severity_bands(spark):
    df = spark.createDataFrame([(0.299,), (0.30,), (0.499,), (0.50,), (0.699,), (0.70,)], "s double")
    got = [r.v for r in df.select(rules.severity_of(F.col("s")).alias("v")).collect()]
    assert got == ["low", "medium", "medium", "high", "high", "critical"]


@pytest.mark.parametrize(
    "kind, z, hours, name",
    [
        ("vibration", 5.0, 3, "vibration_spike"), ("vibration", 5.0, 4, "sustained_high_vibration"),
        ("vibration", -5.0, 4, "vibration_drop"), ("pressure", -9.0, 35, "pressure_drop"),
        ("pressure", -9.0, 36, "pressure_decline"), ("pressure", 9.0, 36, "pressure_spike"),
        ("temperature", 4.0, 23, "temperature_spike"), ("temperature", -4.0, 23, "temperature_drop"),
        ("temperature", -4.0, 24, "temperature_drift"), ("moisture", 4.0, 1, "moisture_increase"),
        ("moisture", -4.0, 1, "moisture_decrease"), ("wind", 1.0, 1, "wind_anomaly"),
    ],
)
def test_signature(spark, kind, z, hours, name):
    df = spark.createDataFrame([(kind, z, hours)], "k string, z double, h int")
    assert df.select(events.anomaly_type(F.col("k"), F.col("z"), F.col("h")).alias("v")).first().v == name


def test_explanation_and_causal_words(spark):
    e = events.with_explanation(found(spark, {10: 1.0}, {10: 115.0})[1]).first().explanation
    assert e.startswith("Short pressure excursion on P1 (water main): 115 psi at peak versus an expected 60.0 psi")
    assert "The highest reading of the event, 115 psi, is above the critical limit of 110 psi." in e
    assert "Flagged by critical threshold." in e and "threshold 1.0)" in e
    df = spark.createDataFrame([("It LEAKS due to age",), ("Sustained high vibration",)], "t string")
    got = [r.w for r in df.select(text.causal_words(F.col("t")).alias("w")).collect()]
    assert got == [["leak", "due to"], []]


def test_islands_merge_by_index_difference(spark):
    df = spark.createDataFrame([("s", i, i in (1, 4, 8)) for i in range(10)], "sensor_id string, cell bigint, f boolean")
    rows = grid.with_islands(df, ["sensor_id"], F.col("f"), 2).where("f").orderBy("cell").collect()
    assert [r.island for r in rows] == [1, 1, 2]


def test_numbering_follows_start_and_sensor(spark):
    from assetpulse.session import number_rows

    df = spark.range(1000).select(F.pmod(F.col("id") * 7919, F.lit(1009)).alias("k"))
    rows = number_rows(df, ["k"], "n").orderBy("k").collect()
    assert [r.n for r in rows] == list(range(1, 1001))


def test_merge_gap_in_steps():
    assert replace(P, step_s=1800).merge_gap_steps == 4 and P.merge_gap_steps == 2 and P.steps(6.0) == 6
