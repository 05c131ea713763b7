"""The two batch jobs on planted anomalies: quality of the detection, outputs, and the same result when run again."""

from datetime import datetime, timedelta, timezone

import numpy as np
from pyspark.sql import functions as F

from assetpulse.functions import geometry as geo
from assetpulse.operators import evaluate, gis, quality
from assetpulse.params import Params
from assetpulse.plans import pipeline
from assetpulse.sources.readings import threshold_table

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
HOURS = 24 * 20


def network(spark):
    """Pressure sensors in two groups with a daily cycle; five of the first group drop together, one spikes alone."""
    rng = np.random.default_rng(1)
    rows, truth, sensors = [], [], []
    for i in range(12):
        sensors.append((f"PRS-{i:02d}", f"A{i % 4}", "pressure", "water_main", "psi", -100.02 + 0.0002 * i, 37.75, 3600))
        v = 65 + 3 * np.sin(np.arange(HOURS) / 24 * 2 * np.pi) + rng.normal(0, 0.8, HOURS)
        if i < 5:
            v[300:310] -= 15
            truth.append((i, f"PRS-{i:02d}", "drop", 300, 309))
        if i == 9:
            v[120] += 30
            truth.append((9, "PRS-09", "spike", 120, 120))
        rows += [(f"PRS-{i:02d}", START + timedelta(hours=int(h)), float(x)) for h, x in enumerate(v) if rng.random() > 0.02 or h == 0]
    readings = spark.createDataFrame(rows, "sensor_id string, ts timestamp, value double")
    reg = spark.createDataFrame(
        sensors,
        "sensor_id string, asset_id string, sensor_type string, placement string, unit string, lon double, lat double, "
        "sampling_interval_s int",
    )
    labels = spark.createDataFrame(
        [(i, s, k, True, START + timedelta(hours=a), START + timedelta(hours=b), "pressure") for i, s, k, a, b in truth],
        "event_id int, sensor_id string, event_type string, is_anomaly boolean, started_at timestamp, ended_at timestamp, sensor_type string",
    )
    return readings, reg, labels


def test_pipeline_twice(spark, tmp_path):
    readings, sensors, labels = network(spark)
    params, out = Params(forest_trees=20), str(tmp_path)
    prints = []
    for _ in range(2):
        axis = pipeline.run_detection(spark, readings, sensors, threshold_table(spark), params, out, 1)
        plain = [spark.read.parquet(f"{out}/{t}").drop("score_components", "breach") for t in ("reading_scores", "anomalies")]
        prints.append([tuple(quality.fingerprint(f).first()) for f in plain])
    assert prints[0] == prints[1]
    pipeline.run_analysis(spark, readings, sensors, threshold_table(spark), params, axis, out, 1, -99.0)
    frames = {t: spark.read.parquet(f"{out}/{t}") for t in ("anomalies", "anomaly_clusters", "asset_health")}
    e = evaluate.evaluation(frames["anomalies"], labels).first()
    assert e.event_recall >= 0.9 and e.anomaly_precision >= 0.85, e
    assert frames["asset_health"].count() == 4 * axis.count
    c = frames["anomaly_clusters"].orderBy(F.desc("n_sensors")).first()
    assert c.n_sensors >= 5 and c.hull_hectares > 0
    audit = {r.rule: r.violations for r in quality.audit(frames["anomalies"], quality.anomaly_rules()).collect()}
    assert set(audit.values()) == {0}
    assert quality.causal_texts(frames["anomalies"], "explanation").count() == 0
    assets = spark.createDataFrame([(f"A{i}", "water_main", f"n{i}") for i in range(4)], "asset_id string, asset_type string, name string")
    pipeline.register_views(assets, sensors, readings, frames["anomalies"], frames["asset_health"])
    assert spark.table("v_asset_summary").where("monitored").count() == 4
    assert spark.table("v_sensor_latest").count() == 12


def test_links_parts_and_boxes(spark):
    assets = spark.createDataFrame([("building", 1), ("road", 1), ("bridge", 2), ("rail", 1)], "asset_type string, link_id bigint")
    got = gis.linked(assets, spark.createDataFrame([(1, 10)], "osm_id bigint, building_id int"), spark.createDataFrame([(1, 20), (2, 21)], "osm_id bigint, road_id int"))
    assert {(r.asset_type, r.building_id, r.road_id) for r in got.collect()} == {("building", 10, None), ("road", None, 20), ("bridge", None, 21), ("rail", None, None)}

    def ring(x, s):
        return [{"lon": x, "lat": 0.0}, {"lon": x + s, "lat": 0.0}, {"lon": x + s, "lat": s}, {"lon": x, "lat": s}]

    df = spark.createDataFrame([([ring(0.0, 1.0), ring(5.0, 2.0)],)], "parts array<array<struct<lon:double,lat:double>>>")
    assert gis.largest_part(df).first().ring[0].lon == 5.0
    big = spark.createDataFrame([(ring(-5.0, 20.0),)], "c array<struct<lon:double,lat:double>>").select(
        geo.ring_in_box(F.col("c"), (1.0, 1.0, 2.0, 2.0)).alias("holds"), geo.line_in_box(F.col("c"), (1.0, 1.0, 2.0, 2.0)).alias("meets"),
        geo.line_in_box(F.col("c"), (-6.0, 1.0, 2.0, 2.0)).alias("open_line"),
        geo.ring_in_box(F.col("c"), (-6.0, 1.0, 2.0, 2.0)).alias("cuts"),
    ).first()
    assert tuple(big) == (True, False, False, True)  # only the closing edge passes the last box
