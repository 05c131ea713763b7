"""Validation reasons, upserts, readers, writers and the streaming forms."""

import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from assetpulse.operators import gis, ingest
from assetpulse.sources import datasource, readings as src, sinks
from assetpulse.streaming import jobs

NAN, INF = float("nan"), float("inf")
RAW = "sensor_id string, ts string, value double, unit string, seq bigint"
OK = "2024-01-01T00:00:00Z"


@pytest.fixture(scope="module")
def sensors(spark):
    rows = [("TMP-1", "temperature", "°C"), ("VIB-1", "vibration", "mm/s"), ("MST-1", "moisture", "%"), ("PRS-1", "pressure", "psi")]
    return spark.createDataFrame(rows, "sensor_id string, sensor_type string, unit string")


def test_reasons_in_order(spark, sensors):
    cases = [
        ("TMP-1", OK, 20.0, "°C", None), ("TMP-1", "2024-01-01T01:00:00+01:00", 21.0, "°C", None),
        ("VIB-1", "2024-01-01 00:00:00Z", 0.5, "mm/s", None), ("X-1", OK, 1.0, "psi", "unknown_sensor"),
        ("TMP-1", "2024-01-01T00:00:00", 1.0, "°C", "naive_timestamp"), ("TMP-1", OK, NAN, "°C", "non_finite_value"),
        ("TMP-1", OK, INF, "°C", "non_finite_value"), ("TMP-1", OK, -INF, "°C", "non_finite_value"),
        ("TMP-1", OK, 1.0, "psi", "unit_mismatch"), ("TMP-1", OK, 1.0, "°C ", "unit_mismatch"),
        ("TMP-1", OK, 1.0, None, "unit_mismatch"), ("", OK, 1.0, "°C", "invalid_record"), (None, OK, 1.0, "°C", "invalid_record"),
        ("TMP-1", "yesterday", 1.0, "°C", "invalid_record"), ("TMP-1", None, 1.0, "°C", "invalid_record"),
        ("TMP-1", OK, None, "°C", "invalid_record"), ("X-1", "2024-01-01T00:00:00", NAN, None, "unknown_sensor"),
    ]
    df = spark.createDataFrame([(*c[:4], i) for i, c in enumerate(cases)], RAW)
    got = {r.seq: r.reason for r in ingest.validate_readings(df, sensors).collect()}
    assert [got[i] for i in range(len(cases))] == [c[4] for c in cases]
    result = ingest.ingest_result(ingest.validate_readings(df, sensors)).first()
    assert result.accepted == 2 and result.rejected == 15  # two accepted readings share one instant
    assert result.reasons["duplicate_reading"] == 1
    keys = ingest.ingest_result(ingest.validate_readings(df, sensors)).select(F.map_keys("reasons")).first()[0]
    assert keys == sorted(keys)


def test_plausibility_is_inclusive(spark, sensors):
    cases = [("TMP-1", -60.0, "ok"), ("TMP-1", 150.0, "ok"), ("TMP-1", 150.1, "suspect"), ("VIB-1", -0.1, "suspect"),
             ("MST-1", 100.5, "suspect"), ("PRS-1", 900.0, "suspect")]
    units = {"TMP-1": "°C", "VIB-1": "mm/s", "MST-1": "%", "PRS-1": "psi"}
    df = spark.createDataFrame([(s, OK, v, units[s], i) for i, (s, v, _) in enumerate(cases)], RAW)
    got = {r.seq: r.status for r in ingest.validate_readings(df, sensors).collect()}
    assert [got[i] for i in range(len(cases))] == [c[2] for c in cases]


def batch(spark, rows):
    return spark.createDataFrame(
        [(s, datetime(2024, 1, d, tzinfo=timezone.utc), v, "psi", "ok", "t", i) for i, (s, d, v) in enumerate(rows)],
        "sensor_id string, ts timestamp, value double, unit string, status string, source string, seq bigint",
    )


def test_upsert_replaces_and_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "readings")
    ingest.upsert_readings(path, batch(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("b", 2, 3.0)]))
    for _ in range(2):
        ingest.upsert_readings(path, batch(spark, [("a", 2, 9.0), ("c", 3, 4.0), ("c", 3, 5.0)]))
        got = sorted((r.sensor_id, r.day.day, r.value) for r in spark.read.parquet(path).collect())
        assert got == [("a", 1, 1.0), ("a", 2, 9.0), ("b", 2, 3.0), ("c", 3, 5.0)]


def test_payload_files_and_data_source(spark, sensors, tmp_path):
    entry = {"sensor_id": "PRS-1", "ts": OK, "value": 60}
    (tmp_path / "a.json").write_text(json.dumps({"readings": [entry, {**entry, "value": "60"}]}))
    (tmp_path / "b.json").write_text(json.dumps([{**entry, "value": 61.5, "unit": "psi"}]))
    got = src.default_units(src.open_source("payload", spark, path=str(tmp_path)), sensors)
    assert sorted(((r.value, r.unit) for r in got.collect()), key=str) == [(60.0, "psi"), (61.5, "psi"), (None, "psi")]
    (tmp_path / "c.json").write_text("{")
    assert src.open_source("payload", spark, path=str(tmp_path)).where("fault = 'not_json'").count() == 1
    datasource.register(spark)
    own = spark.read.format("readings_payload").load(str(tmp_path / "[ab].json"))
    assert sorted(((r.seq, r.value) for r in own.collect()), key=str) == [(0, 60.0), (0, 61.5), (1, None)]
    with pytest.raises(ValueError):
        src.open_source("nothing", spark)


def test_range_reads_push_down(spark, tmp_path):
    path = str(tmp_path / "r")
    batch(spark, [("a", d, float(d)) for d in range(1, 20)]).write.parquet(path)
    low, high = (datetime(2024, 1, d, tzinfo=timezone.utc) for d in (5, 7))
    df = src.open_source("parquet", spark, path=path, start=low, end=high)
    assert df.count() == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThanOrEqual(ts" in plan
    with pytest.raises(ValueError):
        src.between(df, high, low)
    with pytest.raises(ValueError):
        src.between(df, low.replace(tzinfo=None), high)


def test_heights_csv(spark, tmp_path):
    good = tmp_path / "h.csv"
    good.write_text("osm_id,height_m,n_pixels\n1,10.5,9\n1,11,9\n2,x,9\n3,61,9\n4,2.5,1\n")
    heights, report = src.read_heights(spark, str(good))
    assert {(r.osm_id, r.height_m) for r in heights.collect()} == {(1, 10.5), (4, 2.5)}
    assert tuple(report.first()) == (2, 3)
    bad = tmp_path / "bad.csv"
    bad.write_text("id,height\n1,2\n")
    with pytest.raises(ValueError):
        src.read_heights(spark, str(bad))


def test_boundaries_become_multipolygons(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 0.00000001], [1, 1], [0, 0]]
    features = [
        {"type": "Feature", "id": "1", "geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"n": 1}},
        {"type": "Feature", "id": "2", "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, "properties": {}},
    ]
    (tmp_path / "b.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    got = {r.id: r.polygons for r in src.as_multipolygon(src.read_features(spark, str(tmp_path / "b.geojson"))).collect()}
    assert len(got["1"]) == 1 and len(got["2"]) == 2 and len(got["1"][0][0]) == 4


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "runs")
    df = spark.range(10).withColumn("run_id", F.lit(1))
    assert sinks.replace_run(df, path, 1) == 10
    sinks.replace_run(spark.range(3).withColumn("run_id", F.lit(2)), path, 2)
    sinks.replace_run(spark.range(4).withColumn("run_id", F.lit(1)), path, 1)
    assert {(r.run_id, r["count"]) for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {(1, 4), (2, 3)}
    assert sinks.replace_run(df.limit(0), path, 1) == 0  # a rerun that finds nothing leaves nothing
    assert {(r.run_id, r["count"]) for r in spark.read.parquet(path).groupBy("run_id").count().collect()} == {(2, 3)}
    assert sinks.append(spark.range(7), str(tmp_path / "a")) == 7
    out = str(tmp_path / "g")
    rows = spark.createDataFrame([("x", 1.5, 2.5, None)], "id string, lon double, lat double, name string")
    sinks.write_geojson(sinks.feature_lines(rows, "id", sinks.point_geometry(F.col("lon"), F.col("lat")), ["name"]), out)
    doc = json.loads(spark.read.text(out).first().value)
    assert doc == {"type": "Feature", "id": "x", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"name": None}}


def test_stream_ingest_over_two_runs(spark, sensors, tmp_path):
    out, rejects, state, feed = (str(tmp_path / n) for n in ("out", "rej", "state", "feed"))
    rows = [[("PRS-1", OK, 50.0, "psi", 0), ("PRS-1", "x", 1.0, "psi", 1)], [("PRS-1", OK, 70.0, "psi", 2)]]
    for part in rows:
        spark.createDataFrame(part, RAW).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(RAW).parquet(feed)
        jobs.ingest_stream(stream, sensors, out, rejects, state, "s").awaitTermination()
    assert [r.value for r in spark.read.parquet(out).collect()] == [70.0]
    assert [r.reason for r in spark.read.parquet(rejects).collect()] == ["invalid_record"]


def test_registry_from_hand_made_elements(spark, tmp_path):
    """Routing, clipping, chains, inventory and numbering on a small map."""
    box = (-100.0, 37.0, -99.99, 37.01)

    def way(i, nodes, pts, **tags):
        return {"type": "way", "id": i, "nodes": nodes, "tags": tags, "geometry": [{"lon": x, "lat": y} for x, y in pts]}

    def square(x, y, s):
        return [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]

    elements = [
        way(7, [1, 2, 3, 4, 1], square(-99.999, 37.001, 0.0004), building="yes", name="Court House", height="12 m"),
        way(5, [1, 2, 3, 4, 1], square(-99.997, 37.001, 0.0004), building="house", name="17"),
        way(7, [1, 2], [(-99.9, 37.0), (-99.8, 37.0)], building="no"),  # repeated id: the first one counts
        way(8, [1, 2, 3, 4, 1], square(-99.997, 37.001, 0.00002), building="yes"),  # too small
        way(9, [1, 2, 3], [(-99.999, 37.002), (-99.998, 37.002), (-99.997, 37.002)], building="yes"),  # open
        way(20, [1, 2], [(-99.999, 37.005), (-99.995, 37.005)], highway="primary", lanes="2", oneway="yes", surface="asphalt"),
        way(21, [1, 2], [(-99.999, 37.006), (-99.995, 37.006)], highway="footway"),
        way(22, [1, 2], [(-99.999, 37.006), (-99.995, 37.006)], highway="proposed"),
        way(31, [50, 51], [(-99.998, 37.008), (-99.997, 37.008)], highway="primary", bridge="yes", name="North"),
        way(30, [52, 51], [(-99.996, 37.008), (-99.997, 37.008)], highway="primary", bridge="yes", name="South"),
        way(33, [60, 61], [(-99.994, 37.008), (-99.993, 37.008)], highway="secondary", bridge="yes"),
        way(40, [1, 2], [(-99.999, 37.009), (-99.98, 37.009)], railway="rail"),
        way(50, [1, 2], [(-99.999, 37.0095), (-99.995, 37.0095)], power="line"),
        {"type": "node", "id": 90, "lon": -99.995, "lat": 37.004, "tags": {"highway": "street_lamp"}},
        {"type": "node", "id": 91, "lon": -99.994, "lat": 37.004, "tags": {"power": "substation"}},
        {"type": "node", "id": 92, "lon": -98.0, "lat": 37.004, "tags": {"highway": "street_lamp"}},
    ]

    def record(number, x, y, lat16, lon17, **extra):
        return {"attributes": {"STRUCTURE_NUMBER_008": number, "LAT_016": lat16, "LONG_017": lon17, **extra}, "geometry": {"x": x, "y": y}}

    inventory = [
        record("B1", -99.997, 37.0081, "37002916", "099594920", FACILITY_CARRIED_007="2ND AVE", FEATURES_DESC_006A="DRY CREEK"),
        record("B2", -99.991, 37.003, "37001080", "099592760", CULVERT_COND_062="7", FACILITY_CARRIED_007="ROAD"),
        record("B3", -99.991, 37.003, "38001080", "099592760"),
        record("B4", -99.991, 37.003, None, None),
        record(" ", -99.991, 37.003, None, None),
    ]
    (tmp_path / "m.json").write_text(json.dumps({"elements": elements}))
    (tmp_path / "i.json").write_text(json.dumps({"features": inventory}))
    e, i = src.read_elements(spark, str(tmp_path / "m.json")), src.read_inventory(spark, str(tmp_path / "i.json"))
    got = {r.asset_id: r for r in gis.build_registry(e, i, box, 2024).collect()}
    assert set(got) == {"BLD-0001", "BLD-0002", "RD-0001", "BRG-001", "BRG-002", "BRG-003", "RAIL-001", "PWR-001", "PWR-002", "SL-001"}
    assert got["BLD-0001"].link_id == 5 and got["BLD-0001"].name is None
    assert got["BLD-0002"].name == "Court House" and got["BLD-0002"].attributes["height_m"] == "12.0"
    assert got["BRG-001"].attributes["osm_way_ids"] == "30,31" and got["BRG-001"].name == "2nd Ave over Dry Creek"
    assert got["BRG-001"].link_id is None and got["BRG-002"].link_id == 33
    assert got["BRG-003"].geom_type == "Point" and got["BRG-003"].attributes["structure_kind"] == "culvert"
    assert got["RAIL-001"].coords[-1].lon == -99.99 and got["RD-0001"].attributes["lanes"] == "2"
    report = {(r.layer, r.action): r.ways for r in gis.layer_report(gis.with_actions(gis.first_of_each(e).where("type = 'way'"), box)).collect()}
    assert report[("building", "dropped_small")] == 1 and report[("building", "dropped_not_closed")] == 1
    assert report[("highway", "skipped_class")] == 1 and report[("highway", "kept")] == 5


def test_streams_lose_nothing_when_the_newest_comes_first(spark, tmp_path):
    """Four files, one per trigger, newest first, the last one with a reading in a gap: equal to the batch forms."""
    import datetime
    import os

    from assetpulse.functions.timeaxis import TimeAxis

    start = datetime.datetime(2024, 1, 1)
    rows = [(f"s{s}", start + datetime.timedelta(hours=h), float(h)) for s in range(3) for h in (1, 2, 3, 9, 10, 30, 31, 32, 60) if (s, h) != (1, 60)]
    rows += [("s2", start + datetime.timedelta(minutes=90), 7.5)]
    rows.sort(key=lambda r: r[1], reverse=True)
    rows.insert(len(rows), rows.pop(5))
    schema, feed = "sensor_id string, ts timestamp, value double", str(tmp_path / "feed")
    os.mkdir(feed)
    for i in range(4):
        spark.createDataFrame(rows[i * 7 : i * 7 + 7], schema).coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        (part,) = [f for f in os.listdir(tmp_path / f"part{i}") if f.startswith("part-")]
        os.rename(tmp_path / f"part{i}" / part, f"{feed}/{i}.parquet")
        os.utime(f"{feed}/{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    batch = spark.createDataFrame(rows, schema)
    axis = TimeAxis.of(batch, 3600)
    read = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(feed)
    out = [str(tmp_path / n) for n in ("cells", "c1", "offline", "c2", "sessions", "c3")]
    jobs.cells_stream(read(), axis, out[0], out[1]).awaitTermination()
    assert sorted(jobs.stored_cells(spark, out[0]).collect()) == sorted(jobs.cell_windows(batch, axis).collect())
    jobs.derived_stream(read(), "sensor_id", lambda r: jobs.silent_times(r, 18000), out[2], out[3]).awaitTermination()
    got = sorted(tuple(r) for r in jobs.silences(jobs.derived(spark, "sensor_id", out[2]), 18000).collect())
    assert got == sorted(tuple(r) for r in jobs.silences(jobs.silent_times(batch, 18000), 18000).collect())
    assert [k for s, _, k in got if s == "s1"].count("offline") == 3 and [k for s, _, k in got if s == "s0"].count("offline") == 3
    flagged = lambda r: jobs.session_events(r.selectExpr("sensor_id", "ts AS at", "value AS z", "false AS critical"), axis, 2, 2, 100.0)
    jobs.derived_stream(read(), "sensor_id", flagged, out[4], out[5]).awaitTermination()
    assert sorted(jobs.derived(spark, "sensor_id", out[4]).select("sensor_id", "started_at", "ended_at", "flagged_steps").collect()) == sorted(
        flagged(batch).select("sensor_id", "started_at", "ended_at", "flagged_steps").collect()
    )
