import json
import random

import pytest
from pyspark.sql import functions as F

from tarmac.config import DAY_MS, HOUR_MS, DatasetConfig
from tarmac.functions.stats import INPUT_COLUMNS, all_stats
from tarmac.operators import alerts, asof, checks, ingest, labels, metrics, serving, upserts, windows
from tarmac.sources import sinks
from tarmac.sources.readers import dtc_registry, vehicle_context
from tests.test_functions import RECORD, record

T0 = 1_704_067_200_000


def test_window_bounds_and_empty_hours(spark):
    data = [record(T0 + 600_000, 1, speed_kmh=10.0), record(T0 + HOUR_MS, 2, speed_kmh=20.0), record(T0 + 4 * HOUR_MS + 5000, 3, speed_kmh=30.0)]
    got = windows.snapshots(spark.createDataFrame(data, RECORD), {w: ["n_events", "speed_sum"] for w in ("5m", "1h", "24h")}).orderBy("feature_ts_ms").collect()
    assert [(r.feature_ts_ms - T0) // HOUR_MS for r in got] == [1, 2, 3, 4]
    assert [r["1h_n_events"] for r in got] == [1, 1, 0, 0]  # the event at exactly one hour belongs to the next snapshot
    assert [r["24h_n_events"] for r in got] == [1, 2, 2, 2]
    assert all(r["5m_n_events"] == 0 for r in got)


def test_no_snapshot_without_a_passed_boundary(spark):
    assert windows.snapshots(spark.createDataFrame([record(T0 + 1, 1)], RECORD), {"1h": ["n_events"]}).count() == 0


def test_snapshots_do_not_see_the_future(spark):
    rnd = random.Random(5)
    data = [record(T0 + rnd.randrange(3 * DAY_MS), i, speed_kmh=rnd.uniform(0, 99), soc_pct=rnd.uniform(0, 99)) for i in range(300)]
    cutoff = T0 + 36 * HOUR_MS
    whole = windows.snapshots(spark.createDataFrame(data, RECORD), {"24h": ["n_events", "speed_sum", "soc_last"]}).where(F.col("feature_ts_ms") <= cutoff)
    kept = [r for r in data if r[1] < cutoff] + [record(cutoff + 1, 10_000, speed_kmh=1e6)]
    cut = windows.snapshots(spark.createDataFrame(kept, RECORD), {"24h": ["n_events", "speed_sum", "soc_last"]}).where(F.col("feature_ts_ms") <= cutoff)
    key = lambda r: r["feature_ts_ms"]
    assert [tuple(map(str, r)) for r in sorted(whole.collect(), key=key)] == [tuple(map(str, r)) for r in sorted(cut.collect(), key=key)]
    assert checks.forbidden_columns(whole) == [] and checks.forbidden_columns(whole.withColumn("wear_level", F.lit(1))) == ["wear_level"]
    assert set(INPUT_COLUMNS) <= {x.split()[0] for x in RECORD.split(", ")}


def test_only_listed_columns_influence_features(spark):
    """A statistic of another column of the telemetry doesn't resolve."""
    from pyspark.errors import AnalysisException

    from tarmac.functions.stats import Merge, Stat

    df = spark.createDataFrame([record(T0 + 1, 1, speed_kmh=5.0)], RECORD).withColumn("wear_level", F.lit(3.0))
    assert windows.hour_blocks(df, {"odo_max": all_stats()["odo_max"]}).count() == 1
    for make in (lambda s: windows.hour_blocks(df, s), lambda s: windows.buckets(df, 60, s), lambda s: windows.snapshots(df, {"24h": ["x"]}, s)):
        with pytest.raises(AnalysisException):
            make({"x": Stat("x", Merge.GREATEST, F.col("wear_level"))}).schema


def test_dense_hours_and_windows_of_buckets(spark):
    """Every hour of three days full, and the windows of buckets at odd times, against sums over the events."""
    rnd = random.Random(11)
    data = [record(T0 + h * HOUR_MS + rnd.randrange(HOUR_MS), 100 * h + i, speed_kmh=float(rnd.randrange(2, 90)), soc_pct=float(rnd.randrange(100))) for h in range(75) for i in range(rnd.randrange(1, 5))]
    df, stats = spark.createDataFrame(data, RECORD), {n: all_stats()[n] for n in ("n_events", "speed_sum", "soc_first", "soc_last", "soc_min")}
    at = {n: i for i, n in enumerate(x.split()[0] for x in RECORD.split(", "))}

    def brute(a, z):
        rows = sorted((r[at["ts_ms"]], r[at["seq"]], r[at["speed_kmh"]], r[at["soc_pct"]]) for r in data if a <= r[at["ts_ms"]] < z)
        return len(rows), sum(r[2] for r in rows), *((rows[0][3], rows[-1][3], min(r[3] for r in rows)) if rows else (None,) * 3)

    plain = lambda r, w: (r[f"{w}_n_events"], r[f"{w}_speed_sum"], *((r[f"{w}_{n}"] or {"value": None})["value"] for n in ("soc_first", "soc_last")), r[f"{w}_soc_min"])
    got = windows.snapshots(df, {w: list(stats) for w in ("5m", "1h", "24h")}, stats).collect()
    assert len(got) == 74
    for r in got:
        for w, ms in (("5m", 300_000), ("1h", HOUR_MS), ("24h", DAY_MS)):
            assert plain(r.asDict(), w) == brute(r.feature_ts_ms - ms, r.feature_ts_ms), (w, r.feature_ts_ms)
    points = spark.createDataFrame([("v", T0 + rnd.randrange(80 * HOUR_MS)) for _ in range(40)], "vehicle_id string, feature_ts_ms long")
    points = points.withColumn("vehicle_id", F.lit(data[0][0]))
    found = windows.bucket_snapshots(df, points, {w: list(stats) for w in windows.BANDS}, stats).collect()
    assert len(found) == 40
    for r in found:
        for w, (width, n) in windows.BANDS.items():
            end = r.feature_ts_ms // (width * 1000)
            assert plain(r.asDict(), w) == brute((end - n) * width * 1000, end * width * 1000), (w, r.feature_ts_ms)


SNAP, EVENT = "vehicle_component_id string, feature_ts_ms long", "vehicle_component_id string, event_id string, event_type string, ts_ms long"


def label(spark, times, events, end=90):
    rows = labels.label_snapshots(spark.createDataFrame([("c", t) for t in times], SNAP), spark.createDataFrame([("c", f"e{i}", k, t) for i, (k, t) in enumerate(events)], EVENT), end * DAY_MS)
    return rows.orderBy("feature_ts_ms").collect()


@pytest.mark.parametrize("at, want", [(0, (0, True)), (7 * DAY_MS, (1, False)), (7 * DAY_MS + 1, (0, False))])
def test_label_bounds(spark, at, want):
    r = label(spark, [DAY_MS], [("FAILURE", DAY_MS + at)])[0]
    assert (r.label_7d, r.in_gap) == want
    assert (r.label_hours_to_event == 168.0) == (at == 7 * DAY_MS)


def test_gap_service_and_tail(spark):
    got = label(spark, [0, 2 * DAY_MS, 3 * DAY_MS, 4 * DAY_MS], [("MAINTENANCE_REQUIRED", DAY_MS), ("SERVICE_COMPLETED", 3 * DAY_MS)])
    assert [(r.in_gap, r.label_7d) for r in got] == [(False, 1), (True, 0), (False, 0), (False, 0)]
    same = label(spark, [DAY_MS], [("SERVICE_COMPLETED", DAY_MS), ("FAILURE", DAY_MS)])
    assert same[0].in_gap is False  # at equal times the service stands last
    assert [r.tail for r in label(spark, [83 * DAY_MS, 83 * DAY_MS + HOUR_MS], [])] == [False, True]


def test_labels_against_brute_force(spark):
    rnd = random.Random(3)
    keys = ["a", "b", "c"]
    snaps = [(rnd.choice(keys), rnd.randrange(0, 40) * DAY_MS // 2) for _ in range(300)]
    events = [(rnd.choice(keys), f"e{i}", rnd.choice(["FAILURE", "MAINTENANCE_REQUIRED", "SERVICE_COMPLETED"]), rnd.randrange(0, 40) * DAY_MS // 2) for i in range(60)]
    got = labels.label_snapshots(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(events, EVENT), 20 * DAY_MS).collect()
    assert len(got) == len(snaps)
    for r in got:
        mine = sorted((t, k, e) for c, e, k, t in events if c == r.vehicle_component_id)
        nxt = [x for x in mine if x[1] != "SERVICE_COMPLETED" and r.feature_ts_ms < x[0] <= r.feature_ts_ms + 7 * DAY_MS]
        last = [x for x in mine if x[0] <= r.feature_ts_ms]
        assert (r.label_7d, r.label_next_event_id) == ((1, nxt[0][2]) if nxt else (0, None))
        assert r.in_gap == bool(last and last[-1][1] != "SERVICE_COMPLETED")


def test_around_sorts_the_left_rows_once(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("k", 9), ("k", None), ("n", 5), (None, 5)], "k string, t long")
    right = spark.createDataFrame([("k", 5, "x"), ("k", 7, "y"), ("k", 7, "z"), ("k", None, "w"), ("o", 1, "x"), (None, 6, "y")], "k string, s long, v string")
    found = asof.around(left, right, ["k"], "t", "s", F.col("v") != "y", [F.col("v")], 3)
    got = {(r.k, r.t): (r.last_s, r.last_v, r.next_s, r.next_v) for r in found.collect()}
    assert got == {
        ("k", 1): (None, None, 5, "x"), ("k", 5): (5, "x", 7, "z"), ("k", 9): (7, "z", None, None), ("k", None): (None, None, 5, "x"),
        ("n", 5): (None,) * 4, (None, 5): (None,) * 4,
    }
    wide = left.withColumn("wide", F.lit("w"))
    plan = asof.around(wide, right, ["k"], "t", "s", F.col("v") != "y", [F.col("v")])._jdf.queryExecution().executedPlan().toString()
    assert sum("wide" in line or "__left" in line for line in plan.splitlines() if " Sort [" in line or " Window [" in line) <= 1


def test_dataset_partitions_grow_with_the_snapshots(spark, monkeypatch):
    monkeypatch.setattr(labels, "ROWS_A_TASK", 3, raising=False)
    snaps = [("v", "BRAKE", d * DAY_MS, True, 1.0) for d in range(90)]
    feats = spark.createDataFrame(snaps, "vehicle_id string, component string, feature_ts_ms long, window_complete boolean, w24h_events double")
    parts = spark.createDataFrame([("v", "BRAKE", "c", "EV")], "vehicle_id string, component string, vehicle_component_id string, vehicle_type string")
    rows, _ = labels.build_dataset(feats, parts, spark.createDataFrame([], EVENT), 0, 90 * DAY_MS)
    assert rows.rdd.getNumPartitions() == 30 and rows.count() == 52 + 5 + 4 + 8  # the days of the splits


def test_asof_without_matches(spark):
    left = spark.createDataFrame([("k", 5)], "k string, t long")
    right = spark.createDataFrame([("k", 9, "x")], "k string, s long, v string")
    assert asof.backward(left, right, ["k"], "t", "s", "r_").first()["r_v"] is None
    assert asof.forward(left, right, ["k"], "t", "s", "r_").first()["r_v"] == "x"


def test_dataset(spark):
    snaps = [("v", "BRAKE", d * DAY_MS, d > 1, 1.0 * d) for d in range(0, 30)]
    feats = spark.createDataFrame(snaps, "vehicle_id string, component string, feature_ts_ms long, window_complete boolean, w24h_events double")
    parts = spark.createDataFrame([("v", "BRAKE", "c", "EV")], "vehicle_id string, component string, vehicle_component_id string, vehicle_type string")
    events = spark.createDataFrame([("c", "e1", "FAILURE", 10 * DAY_MS), ("c", "e2", "SERVICE_COMPLETED", 12 * DAY_MS)], EVENT)
    config = DatasetConfig(splits={"train": (1, 9), "test": (15, 20)})
    rows, funnel = labels.build_dataset(feats, parts, events, 0, 30 * DAY_MS, config)
    f = funnel.first()
    assert f.snapshots_total == 30 == f.excluded_warmup + f.excluded_in_gap + f.excluded_tail + f.excluded_outside_splits + f.rows_kept
    assert f.excluded_in_gap == 2 and rows.count() == f.rows_kept
    assert {c for c in rows.columns if c.startswith("f_")} == {"f_w24h_events"}
    assert rows.where("meta_split = 'train' and label_7d = 1").count() == 6
    counts = labels.dataset_counts(rows)
    assert counts.where("meta_split = 'train'").first().positive_events == 1
    with pytest.raises(ValueError):
        labels.build_dataset(feats, parts.union(parts), events, 0, 30 * DAY_MS, config)
    with pytest.raises(ValueError):
        labels.build_dataset(feats, parts.where("false"), events, 0, 30 * DAY_MS, config)


VIN = "1HGCM82633A004352"


def envelopes(spark):
    a = {"vin": VIN, "ts": "2024-01-01T00:00:00Z", "lat": 1.0, "lng": 2.0, "vehicleSpeed": 80.47, "mileageKm": 16.093, "batteryLevel": 50, "batteryVoltage": 400, "batteryCurrent": 10, "batteryTemp": 25.0, "engineRpm": 2000, "motorTemperature": 30, "faultCodes": ["P0301"], "longitudinalAccel": 9.81, "event": "HARSH_BRAKE", "sequence": 1}
    b = {"vehicle": {"vin": VIN}, "timestamp_epoch_ms": 1704067200000, "sequence_no": 2, "position": {"latitude": 1.0, "longitude": 2.0}, "motion": {"speed_mph": 50.0, "odometer_miles": 10.0, "accel_g": 1.0}, "energy": {"soc_percent": 50, "pack_voltage": 400, "pack_current": 10, "pack_temp_f": 77.0, "charging": False}, "engine": {"rpm": 2000}, "motor": {"temp_f": 86.0, "power_kw": 4.0}, "diagnostics": {"dtcs": ["P0301"]}, "events": ["HARSH_BRAKING"]}
    rows = [("t", "OEM_A", "1.0", json.dumps(a)), ("t", "OEM_B", "2.0", json.dumps(b)), ("t", "OEM_C", "9", json.dumps(a)), ("t", "OEM_A", "1.0", "{}"), ("t", "OEM_A", "1.0", json.dumps(a | {"vin": "X"})), ("t", "OEM_A", "1.0", json.dumps(a | {"vin": "11111111111111111"})), ("t", "OEM_A", "1.0", json.dumps(a | {"sequence": -1}))]
    return spark.createDataFrame(rows, "received_at string, oem_id string, schema_version string, payload string")


def test_ingest(spark):
    fleet = spark.createDataFrame([(VIN, "v1", "HYBRID")], "vin string, vehicle_id string, vehicle_type string")
    known, dead = ingest.resolve(envelopes(spark), fleet)
    assert sorted(r.reason for r in dead.collect()) == ["INVALID_VIN", "MISSING_VIN", "UNKNOWN_VIN"]
    checked = ingest.violations(ingest.normalise(known))
    good = {r.oem_id: r for r in checked.where(F.size("violations") == 0).collect()}
    assert [r.violations for r in checked.where(F.size("violations") > 0).collect()] == [["seq:minimum"]]
    a, b = good["OEM_A"], good["OEM_B"]
    for x, y in ((a.speed_kmh, b.speed_kmh), (a.odometer_km, b.odometer_km), (a.acceleration_ms2, b.acceleration_ms2), (a.battery.temperature_c, b.battery.temperature_c), (a.powertrain.motor_temp_c, b.powertrain.motor_temp_c), (a.powertrain.power_kw, b.powertrain.power_kw)):
        assert x == pytest.approx(y, abs=0.02)
    assert a.event_ts == b.event_ts == "2024-01-01T00:00:00.000Z" and a.brakes.harsh_brake and b.brakes.harsh_brake and a.battery.charging is False
    flat = ingest.flatten(checked)
    assert flat.where("seq = 2").first().ts_ms == 1704067200000 and "charging" not in flat.columns


def test_alerts(spark):
    codes = [("v1", 2, 1, ["P0301", "NOPE"]), ("v1", 1, 2, ["P0301"]), ("v2", 3, 3, ["BATT_TEMP_HIGH"])]
    events = spark.createDataFrame(codes, "vehicle_id string, ts_ms long, seq long, dtc_codes array<string>")
    parts = spark.createDataFrame([("v1", "POWERTRAIN", "c1", "ACTIVE"), ("v2", "BATTERY", "c2", "NOT_APPLICABLE")], "vehicle_id string, component string, vehicle_component_id string, status string")
    hits, unknown = alerts.rule_hits(events, dtc_registry(spark))
    assert [tuple(r) for r in unknown.collect()] == [("NOPE", 1)]
    schema = "vehicle_component_id string, alert_type string, status string"
    new = alerts.raise_alerts(alerts.candidate_alerts(hits, parts), spark.createDataFrame([], schema)).collect()
    assert [(r.vehicle_component_id, r.alert_type, r.ts_ms, r.severity) for r in new] == [("c1", "DTC_P0301", 1, "CRITICAL")]
    for status, raised in (("ACTIVE", 0), ("ACKNOWLEDGED", 1)):
        old = spark.createDataFrame([("c1", "DTC_P0301", status)], schema)
        assert alerts.raise_alerts(alerts.candidate_alerts(hits, parts), old).count() == raised
    scores = spark.createDataFrame([("c1", "BRAKE", 0.9, 0.3, 5), ("c2", "BRAKE", 0.1, 0.3, 5)], "vehicle_component_id string, component string, p7d double, threshold double, feature_ts_ms long")
    old = spark.createDataFrame([("c2", "ML_RISK_7D", "ACTIVE")], schema)
    raised, resolved = alerts.score_alerts(scores, old)
    r = raised.first()
    assert (r.severity, r.message) == ("CRITICAL", "BRAKE: 90% probability of maintenance or failure within 7 days")
    assert [(x.vehicle_component_id, x.status) for x in resolved.collect()] == [("c2", "RESOLVED")]
    owned = spark.createDataFrame([("c1", 1)], "vehicle_component_id string, tenant_id long")
    assert alerts.audit(raised, "ALERT_CREATED", "ml-scorer", owned).first().tenant_id == 1
    table = spark.createDataFrame([(7, "c1", "ACTIVE"), (8, "c2", "ACTIVE")], "alert_id long, vehicle_component_id string, status string")
    for wanted, status in ((7, "ACKNOWLEDGED"), (8, "ACTIVE")):
        assert alerts.acknowledge(table, F.lit(wanted), owned).where(F.col("alert_id") == wanted).first().status == status


def test_upserts(spark):
    schema = "k string, version long, p double"
    old = spark.createDataFrame([("a", 5, 0.1), ("b", 5, 0.1)], schema)
    new = spark.createDataFrame([("a", 5, 0.2), ("b", 4, 0.9), ("c", 1, 0.3)], schema)
    assert sorted(tuple(r) for r in upserts.newest_wins(old, new, ["k"], "version").collect()) == [("a", 5, 0.2), ("b", 5, 0.1), ("c", 1, 0.3)]
    assert sorted(r.k for r in upserts.accepted(old, new, ["k"], "version").collect()) == ["a", "c"]
    assert [tuple(r) for r in upserts.first_write_wins(old, new.union(new), ["k"]).collect()] == [("c", 1, 0.3)]
    assert sorted(r.p for r in upserts.replace_by_key(old, new.where("k = 'a'"), ["k"]).collect()) == [0.1, 0.2]


def test_sinks_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 1, 0.6), ("b", 1, 0.7)], "k string, version long, p double")
    for _ in range(2):
        sinks.append_new(df, f"{tmp_path}/t", ["k", "version"], ["p"])
        sinks.write_batch(df, f"{tmp_path}/b", 3)
        sinks.upsert_newest(df.dropDuplicates(["k"]), f"{tmp_path}/u", ["k"], "version")
    assert [spark.read.parquet(f"{tmp_path}/{x}").count() for x in "tb"] == [2, 3] and sinks.read_table(spark, f"{tmp_path}/u").count() == 2
    assert spark.read.parquet(f"{tmp_path}/t").where("k = 'a'").first().p == 0.5


def test_pages_are_disjoint_and_ordered(spark):
    df = spark.createDataFrame([(i, float(i // 3), i % 2) for i in range(20)], "id long, v double, tenant_id long")
    keys, seen, cursor = [serving.Key("v"), serving.Key("id")], [], None
    while True:
        got = serving.cut(serving.page(df, keys, 6, cursor), keys, 6)
        seen += [r["id"] for r in got["items"]]
        cursor = got["next_cursor"]
        if not cursor:
            break
    assert seen == list(range(19, -1, -1))
    assert serving.scoped(df, 1).count() == 10 and serving.scoped(df, None).count() == 20
    with pytest.raises(ValueError):
        serving.page(df, keys, 5, "nonsense")
    assert len(serving.cut(serving.page(df, keys, 10_000), keys, 10_000)["items"]) == 20


def test_erasure_and_context(spark):
    drivers = spark.createDataFrame([(1, "Ann", "x"), (2, "Bo", "y")], "driver_id long, name string, licence string")
    trips = spark.createDataFrame([("t1", 1), ("t2", 2)], "trip_id string, driver_id long")
    d, t = serving.erase_driver(drivers, trips, 1, ["name", "licence"])
    assert [tuple(r) for r in d.orderBy("driver_id").collect()] == [(1, None, None), (2, "Bo", "y")]
    assert [tuple(r) for r in t.orderBy("trip_id").collect()] == [("t1", None), ("t2", 2)]
    v = spark.createDataFrame([("v1",), ("v2",)], "vehicle_id string")
    c = spark.createDataFrame([("v1", "B", "ACTIVE"), ("v1", "A", "ACTIVE"), ("v1", "C", "NOT_APPLICABLE")], "vehicle_id string, component string, status string")
    assert {r.vehicle_id: r.components for r in vehicle_context(v, c).collect()} == {"v1": ["A", "B"], "v2": []}


def test_metrics_fixture(spark):
    y, p = [0, 0, 0, 1, 1, 0, 1, 0], [0.1, 0.2, 0.3, 0.8, 0.7, 0.4, 0.9, 0.05]
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "y int, p double")
    assert metrics.best_f1(df).first().threshold == 0.7
    at = metrics.at_threshold(df, 0.7).first()
    assert (at.precision, at.recall, at.alerts) == (1.0, 1.0, 3)
    assert metrics.average_precision(df).first()[0] == pytest.approx(1.0) and metrics.roc_auc(df).first()[0] == pytest.approx(1.0)


def test_auc_against_pairs(spark):
    rnd = random.Random(2)
    data = [(int(rnd.random() < 0.3), round(rnd.random(), 1)) for _ in range(200)]
    pairs = [(a[1] > b[1]) + 0.5 * (a[1] == b[1]) for a in data if a[0] for b in data if not b[0]]
    got = metrics.roc_auc(spark.createDataFrame(data, "y int, p double")).first()[0]
    assert got == pytest.approx(sum(pairs) / len(pairs))


def test_value_comparison(spark):
    a = spark.createDataFrame([(1, 1.0), (2, None)], "k long, x double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (2, None)], "k long, x double")
    assert tuple(checks.compare_values(a, b, ["k"], ["x"]).first())[:2] == (2, 0)
    assert checks.compare_values(a, b.withColumn("x", F.lit(2.0)), ["k"], ["x"]).first().mismatches == 2
    assert len(all_stats()) == 70


def test_forward_asof_over_one_long_key(spark):
    """A key of 100,000 rows takes seconds, and gives what a search by hand gives."""
    import bisect
    import time

    n = 50_000
    left = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 3).alias("t"))
    right = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 2 + 1).alias("s"), F.col("id").alias("v"))
    began = time.monotonic()
    got = {r.t: (r.r_s, r.r_v) for r in asof.forward(left, right, ["k"], "t", "s", "r_").collect()}
    assert time.monotonic() - began < 30
    times = [i * 2 + 1 for i in range(n)]
    for t in range(0, 3 * n, 3):
        at = bisect.bisect_right(times, t)
        assert got[t] == ((times[at], at) if at < n else (None, None))


def test_forward_asof_ties(spark):
    left = spark.createDataFrame([("k", 5), ("k", 6), ("j", 1)], "k string, t long")
    right = spark.createDataFrame([("k", 6, "b"), ("k", 6, "a"), ("k", 5, "same time"), ("k", 9, "z")], "k string, s long, v string")
    got = {(r.k, r.t): r.r_v for r in asof.forward(left, right, ["k"], "t", "s", "r_", [F.col("v")]).collect()}
    assert got == {("k", 5): "a", ("k", 6): "z", ("j", 1): None}


def test_precision_at_top_with_ties(spark):
    rnd = random.Random(4)
    data = [(i, int(rnd.random() < 0.4), round(rnd.random(), 1)) for i in range(500)]
    df = spark.createDataFrame(data, "id long, y int, p double")
    for fraction in (0.001, 0.01, 0.07, 0.5, 1.0):
        k = max(1, int(500 * fraction))
        top = sorted(data, key=lambda r: (-r[2], r[0]))[:k]
        assert tuple(metrics.precision_at_top(df, fraction, "id").first()) == (k, pytest.approx(sum(r[1] for r in top) / k))
    assert metrics.precision_at_top(df.where("false")).first().k == 0


def test_curve_of_crowded_scores(spark):
    """Scores that crowd near zero are spread over the ranges."""
    df = spark.range(2000).select((F.col("id") % 3 == 0).cast("int").alias("y"), F.pow(F.lit(10.0), -F.col("id") / 100).alias("p"))
    curve = {r.p: r.above_n for r in metrics.score_curve(df, 8).collect()}
    assert [curve[p] for p in sorted(curve, reverse=True)] == list(range(1, 2001))


def test_versioned_tables_survive_a_crash(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, version long")
    path = f"{tmp_path}/v"
    assert sinks.current_version(spark, path) is None and sinks.read_table(spark, path, df.schema).count() == 0
    for _ in range(3):
        sinks.publish(df, path)
    (tmp_path / "v" / "version=000000000009").mkdir()  # a write that did not end
    assert sinks.read_table(spark, path).count() == 2 and len(list((tmp_path / "v").glob("version=*"))) == 3
    sinks.delete_keys(path, spark.createDataFrame([("a",)], "k string"))
    assert [r.k for r in sinks.read_table(spark, path).collect()] == ["b"]
    for v in (1, 3, 2):
        sinks.upsert_newest(df.withColumn("version", F.lit(v).cast("long")), f"{tmp_path}/b", ["k"], "version", buckets=4)
    assert sorted(tuple(r) for r in sinks.read_buckets(spark, f"{tmp_path}/b", df.schema).collect()) == [("a", 3), ("b", 3)]


def test_append_reads_only_the_partitions_of_the_batch(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "d1"), ("b", 2, "d2")], "k string, seq long, day string")
    sinks.append_new(df, f"{tmp_path}/t", ["k", "seq"], partition_by=["day"])
    (next((tmp_path / "t" / "day=d1").glob("*.parquet"))).write_bytes(b"not to be read")
    sinks.append_new(df.where("day = 'd2'").union(spark.createDataFrame([("c", 3, "d2")], df.schema)), f"{tmp_path}/t", ["k", "seq"], partition_by=["day"])
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/t/day=d2").collect()) == ["b", "c"]


def test_notifications_audit_and_retry(spark, tmp_path):
    rows = spark.range(4).select(F.col("id").alias("vehicle_id"), F.lit("BRAKE").alias("component"), F.col("id").alias("feature_ts_ms"))
    for b in range(4):
        sinks.notify(rows, f"{tmp_path}/n", b, most=8)
    assert sorted(r.batch for r in sinks.read_notifications(spark, f"{tmp_path}/n").select("batch").distinct().collect()) == [2, 3]
    assert {r.batch for r in sinks.read_notifications(spark, f"{tmp_path}/n", most=1).collect()} == {2}
    sinks.flush_audit(rows.coalesce(1), f"{tmp_path}/a", 0, most=2)
    assert len(list((tmp_path / "a" / "batch=000000000000").glob("*.parquet"))) == 2
    tried, waits = [], []

    def action():
        tried.append(1)
        if len(tried) < 7:
            raise OSError
        return "done"

    assert sinks.retry(action, sleep=waits.append) == "done" and waits == [1, 2, 4, 8, 16, 30]
    with pytest.raises(OSError):
        tried.clear()
        sinks.retry(action, attempts=2, sleep=waits.append)


def test_manifest_and_report(spark, tmp_path):
    from tarmac.operators.ml import report

    rows = spark.createDataFrame([("v", "BRAKE", "calibration", "dev", 1, "e1", 2.0)], "meta_vehicle_id string, meta_component string, meta_split string, meta_vehicle_group string, label_7d int, label_next_event_id string, f_x double")
    m = labels.manifest(rows, spark.createDataFrame([(3, 1)], "snapshots_total long, rows_kept long"), 0, DAY_MS, versions={"dataset_version": "d1"})
    sinks.write_dataset(rows, f"{tmp_path}/d", m)
    assert sinks.read_manifest(spark, f"{tmp_path}/d") == json.loads(json.dumps(m)) and spark.read.parquet(f"{tmp_path}/d").count() == 1
    assert m["counts"]["BRAKE"]["calibration"]["positives"] == 1 and len(m["guardrail_warnings"]) == 1 and m["model_input_columns"] == ["f_x"]
    sinks.write_parts(rows, f"{tmp_path}/p")
    sinks.write_parts(rows, f"{tmp_path}/p")
    assert len(list((tmp_path / "p").glob("version=*"))) == 1
    shown = report({"BRAKE": {"selected": "boosted", "test": {"boosted": {"pr_auc": 0.5, "prevalence": 0.1}, "logistic": {"pr_auc": 0.4}}, "holdout": {"pr_auc": 0.3}, "rows": 7, "features_used": 2, "top_features": list("abcdefg")}}, {"model_version": "m1"})
    c = shown["components"][0]
    assert (c["served_model"], c["pr_auc_logistic"], c["pr_auc_boosted"], c["holdout_pr_auc"], c["prevalence"], c["top_features"]) == ("Gradient boosting", 0.4, 0.5, 0.3, 0.1, list("abcde"))
    assert [serving.clamp(x, serving.ASSISTANT_LIMIT) for x in (0, 5, 99)] == [1, 5, 20]


def test_rounding_is_pythons(spark):
    from tarmac.functions.scalars import py_round

    rnd = random.Random(1)
    values = [2.675, 0.125, 0.375, -2.675, 1.005, 0.5, 1.5, 2.5, 0.0, None, 1e15, 12345.675] + [round(rnd.uniform(-500, 500), 3) for _ in range(3000)] + [rnd.uniform(-5, 5) for _ in range(500)] + [k / 8 for k in range(-100, 100)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 2, 3):
        assert [r[0] for r in df.select(py_round(F.col("x"), digits)).collect()] == [None if v is None else round(v, digits) for v in values]


def test_payloads_are_parsed_once(spark):
    """Conditions on parsed fields stay above parsing: they were put into it, each field with a parse of its own."""
    envelopes = spark.createDataFrame([("1", "OEM_A", "1.0", '{"vin": "1HGCM82633A004352", "sequence": 5, "vehicleSpeed": 3.0}'), ("2", "OEM_B", "2.0", '{"vehicle": {"vin": "1HGCM82633A004352"}, "sequence_no": 6}')], "received_at string, oem_id string, schema_version string, payload string").repartition(2)
    vehicles = spark.createDataFrame([("1HGCM82633A004352", "7", "EV")], "vin string, vehicle_id string, vehicle_type string")
    found = ingest.violations(ingest.normalise(ingest.resolve(envelopes, vehicles)[0])).where(F.size("violations") > 0).select("seq", "violations")
    assert sorted(r.seq for r in found.collect()) == [5, 6]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("from_json("), plan.count("get_json_object(")) == (2, 4)


def test_spells_hold_snapshots_that_agree(spark, sf):
    """A row for snapshots that follow each other and agree in all windows, fewer than snapshots; spread out they are these."""
    from tarmac.plans.telemetry import telemetry

    stats = {n: s for n, s in all_stats().items() if n in ("n_events", "speed_sum")}
    found = windows.spells(telemetry(spark, sf), stats=stats).collect()
    hours = [(r.vehicle_id, h) for r in found for h in r.hours]
    assert len(hours) == len(set(hours)) > 2 * len(found)
    assert max(len(r.hours) for r in found if r["1h_n_events"]) == 1
    ends = telemetry(spark, sf).groupBy("vehicle_id").agg(F.min("ts_ms").alias("a"), F.max("ts_ms").alias("b")).collect()
    assert sorted(hours) == sorted((r.vehicle_id, h) for r in ends for h in range(r.a // HOUR_MS + 1, r.b // HOUR_MS + 1))


def test_statistics_merged_in_arrow_tasks_are_sparks(spark):
    """Ranges of sorted rows, empty ones, nulls, NaN, structs and whole columns of nulls, against Spark's aggregates."""
    import numpy as np
    import pyarrow as pa

    from tarmac.functions.stats import Merge, merge
    from tarmac.operators.blocks import merged

    rnd = random.Random(4)
    x = [rnd.choice([None, float("nan"), -0.5, 2.0, rnd.uniform(-9, 9)]) for _ in range(60)]
    ends = [None if v is None else {"ts": rnd.randrange(3), "seq": rnd.choice([None, 1, 2]), "value": v} for v in x]
    low = np.array([0, 0, 5, 5, 9, 20, 30, 59, 60])
    high = np.array([3, 60, 5, 40, 10, 24, 60, 60, 60])
    kind = pa.struct([("ts", pa.int64()), ("seq", pa.int64()), ("value", pa.float64())])
    columns = {Merge.TALLY: (pa.array([None if v is None else 1 for v in x], pa.int64()), "long"), Merge.TOTAL: (pa.array(x, pa.float64()), "double"), Merge.LEAST: (pa.array(x, pa.float64()), "double"), Merge.GREATEST: (pa.array(x, pa.float64()), "double"), Merge.EARLIEST: (pa.array(ends, kind), "struct<ts: long, seq: long, value: double>"), Merge.LATEST: (pa.array(ends, kind), "struct<ts: long, seq: long, value: double>")}
    for op, (column, ddl) in columns.items():
        for of in (column, pa.nulls(60, column.type)):
            rows = [(i, v) for i, (a, b) in enumerate(zip(low, high)) for v in of.to_pylist()[a:b]]
            df = spark.createDataFrame(rows, f"i long, v {ddl}").groupBy("i").agg(merge(op, F.col("v")).alias("v"))
            want = {r.i: r.v for r in df.collect()}
            for i, got in enumerate(merged(op, of, low, high).to_pylist()):
                expect = want.get(i, 0 if op.adds else None)
                expect = expect.asDict() if hasattr(expect, "asDict") else expect
                assert str(got) == str(expect) or got == pytest.approx(expect), (op, i)


def test_blocks_in_parts_give_the_same_windows(spark):
    """However events are dealt out and cut into Arrow batches, the same snapshots; halves are rounded as SQL rounds them."""
    import numpy as np

    from tarmac.operators.blocks import _hundredths

    rnd = random.Random(8)
    data = [(f"v{i % 3}", *record(T0 + rnd.randrange(20 * DAY_MS), i, speed_kmh=rnd.uniform(0, 99), soc_pct=float(rnd.randrange(9)))[1:]) for i in range(600)]
    stats = {n: all_stats()[n] for n in ("n_events", "speed_sum", "soc_min", "soc_last")}
    df, found = spark.createDataFrame(data, RECORD), []
    for parts, rows in ((1, 10_000), (7, 16)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
        try:
            got = windows.snapshots(df.repartition(parts), {w: list(stats) for w in ("5m", "1h", "24h")}, stats).collect()
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        found.append(sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in got))
    assert len(found[0]) > 1000 and found[0] == found[1]
    assert _hundredths(np.array([0.125, -0.125, 2.5, 0.0, np.nan, np.inf, 1e307]))[:4].tolist() == [0.13, -0.13, 2.5, 0.0]
