import random

import pytest
from pyspark.sql import functions as F

from tarmac.config import DAY_MS, HOUR_MS
from tarmac.functions.stats import all_stats
from tarmac.operators import ingest, windows
from tarmac.operators.checks import compare_keys, compare_values
from tarmac.sources.commits import Change, Commits
from tarmac.sources.readers import dtc_registry
from tarmac.streaming.dedup import dedup
from tarmac.streaming.pipeline import Live
from tarmac.streaming import snapshots as snapshots_module
from tarmac.streaming.snapshots import Snapshots, per_component, with_lateness
from tests.test_functions import RECORD, record
from tests.test_operators import VIN, envelopes

T0 = 1_704_067_200_000
KEYS = ["vehicle_id", "feature_ts_ms"]


def history(n=300, vehicles=3):
    rnd = random.Random(9)
    maybe = lambda x: None if rnd.random() < 0.2 else x
    out = []
    for i in range(n):
        r = record(T0 + rnd.randrange(60 * HOUR_MS), i, speed_kmh=maybe(rnd.uniform(0, 120)), odometer_km=maybe(rnd.uniform(0, 9)), acceleration_ms2=maybe(rnd.uniform(-5, 5)), harsh_brake=maybe(rnd.random() < 0.2), soc_pct=maybe(rnd.uniform(0, 100)), current_a=maybe(rnd.uniform(-200, 50)), dtc_codes=maybe(["P0301", "X"]))
        out.append((f"v{i % vehicles}", *r[1:]))
    return sorted(out, key=lambda r: r[1])


def frame(spark, rows):
    return spark.createDataFrame(rows, RECORD)


def flat(df):
    return df.withColumns({c: F.col(f"`{c}`.value") for c in df.columns if c.endswith(("soc_first", "soc_last"))})


def same(got, want):
    assert tuple(compare_keys(got, want, KEYS).first())[1:] == (0, 0)
    values = [c for c in want.columns if c not in KEYS]
    assert len(values) == 211
    result = compare_values(flat(got), flat(want), KEYS, values, 1e-6).first()
    assert result.compared == want.count() * len(values) and result.mismatches == 0


@pytest.mark.parametrize("variant", ["clean", "repeated"])
def test_stream_equals_batch_in_all_statistics(spark, tmp_path, variant):
    rows = history()
    size = -(-len(rows) // 3)
    for i in range(3):  # each file is a micro-batch; repeated deliveries come a batch later
        part = rows[i * size : (i + 1) * size]
        again = [r for r in rows[max(0, i - 1) * size : i * size] if r[2] % 7 == 0] if variant == "repeated" else []
        frame(spark, part + again).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema(RECORD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("event_ts", F.timestamp_millis("ts_ms"))
    engine = Snapshots(f"{tmp_path}/state")
    engine.start(dedup(src, horizon="25 hours").drop("event_ts")).awaitTermination()
    same(engine.read(spark), windows.snapshots(frame(spark, rows)))
    assert engine.counters(spark).first().applied == len(rows)
    assert any("@" in w for w in Commits(spark, f"{tmp_path}/state").state().writers)  # batches count within a query's checkpoint


def test_repeated_batch_and_restart_change_nothing(spark, tmp_path):
    rows, engine = history(120), Snapshots(f"{tmp_path}/state")
    engine.batch(frame(spark, rows[:60]), 0)
    for _ in range(2):
        Snapshots(f"{tmp_path}/state").batch(frame(spark, rows[60:]), 1)  # as after a crash before the commit
    same(engine.read(spark), windows.snapshots(frame(spark, rows)))


def test_catch_up_late_events_and_pruning(spark, tmp_path):
    one = lambda ts, seq: record(ts, seq, speed_kmh=10.0)
    engine, read = Snapshots(f"{tmp_path}/s"), lambda: {(r.feature_ts_ms - T0) // HOUR_MS: r for r in Snapshots(f"{tmp_path}/s").read(spark).collect()}
    engine.batch(frame(spark, [one(T0 + 600_000, 1)]), 0)
    assert read() == {}
    engine.batch(frame(spark, [one(T0 + 4 * HOUR_MS + 5000, 2)]), 1)
    got = read()
    assert sorted(got) == [1, 2, 3, 4] and [got[h]["1h_n_events"] for h in (1, 2, 3, 4)] == [1, 0, 0, 0] and got[4]["24h_n_events"] == 1
    engine.batch(frame(spark, [one(T0 + 60 * HOUR_MS, 3)]), 2)
    engine.batch(frame(spark, [one(T0 + 10 * HOUR_MS, 4)]), 3)  # 50 hours behind: counted, not applied
    c = engine.counters(spark).first()
    assert (c.vehicles, c.applied, c.late) == (1, 3, 1) and max(read()) == 60
    log = Commits(spark, f"{tmp_path}/s")
    assert log.read("blocks").count() == 1 and len(log.state().tables["blocks"]) == 1
    assert log.vacuum(0) > 0 and log.read("blocks").count() == 1 and max(read()) == 60


def brute_late(rows, lateness):
    """(vehicle, seq) of the rows that are behind the running maximum of their vehicle, in order of arrival."""
    top, late = {}, set()
    for v, ts, seq in rows:
        if ts < top.get(v, ts) - lateness:
            late.add((v, seq))
        top[v] = max(top.get(v, ts), ts)
    return late


def test_lateness_follows_the_order_of_arrival(spark, tmp_path, monkeypatch):
    """One batch or ten: the same events are late; runs of four arrivals, so that all steps of the running maximum are used."""
    monkeypatch.setattr(snapshots_module, "RUN", 4)
    rnd = random.Random(5)
    rows = [(f"v{min(2, rnd.randrange(9))}", T0 + rnd.randrange(100 * HOUR_MS), i) for i in range(200)]
    want = brute_late(rows, 25 * HOUR_MS)
    assert 10 < len(want) < 190
    df = spark.createDataFrame([(*r, r[2]) for r in rows], "vehicle_id string, ts_ms long, seq long, arrival long").repartition(5)
    none = spark.createDataFrame([], "vehicle_id string, max_event_ts_ms long")
    found = with_lateness(df, none, 25 * HOUR_MS).where("__late").collect()
    assert {(r.vehicle_id, r.seq) for r in found} == want and found[0].asDict().keys() == {*df.columns, "__late"}
    stats = {"n_events": all_stats()["n_events"]}
    records = [(r[0], *record(r[1], r[2])[1:], r[2]) for r in rows]
    totals = []
    for parts in (1, 10):
        engine = Snapshots(f"{tmp_path}/{parts}", stats, {"24h": ["n_events"]}, buckets=4)
        for i in range(parts):
            engine.batch(spark.createDataFrame(records[i * 200 // parts : (i + 1) * 200 // parts], RECORD + ", arrival long"), i)
        c = engine.counters(spark).first()
        totals.append((c.applied, c.late))
    assert totals == [(200 - len(want), len(want))] * 2


def test_state_written_follows_the_vehicles_of_a_batch(spark, tmp_path):
    """Ten batches with repeats equal one; a batch of one vehicle leaves the other buckets' files alone."""
    rows = [(f"v{i % 30}", *r[1:]) for i, r in enumerate(history(400))]
    stats = {n: s for n, s in all_stats().items() if n in ("n_events", "speed_sum", "odo_min", "soc_first")}
    windows_of = {w: list(stats) for w in ("5m", "1h", "24h")}
    engine, log = Snapshots(f"{tmp_path}/s", stats, windows_of, buckets=16), Commits(spark, f"{tmp_path}/s")
    for i in range(10):
        for _ in range(2 if i % 3 == 0 else 1):
            engine.batch(frame(spark, rows[i * 40 : (i + 1) * 40]), i)
    want = windows.snapshots(frame(spark, rows), windows_of, stats)
    values = [c for c in want.columns if c not in KEYS]
    plain = lambda df: df.withColumns({c: F.col(f"`{c}`.value") for c in df.columns if c.endswith("soc_first")})
    assert tuple(compare_keys(engine.read(spark), want, KEYS).first())[1:] == (0, 0)
    assert compare_values(plain(engine.read(spark)), plain(want), KEYS, values, 1e-6).first().mismatches == 0
    files = lambda: {e["bucket"]: e["path"] for e in log.state().tables["progress"]}
    before = files()
    engine.batch(frame(spark, [("v7", *record(T0 + 70 * HOUR_MS, 1000)[1:])]), 10)
    assert len(before) > 8 and sum(before.get(b) != p for b, p in files().items()) <= 2


def test_wall_clock_dedup(spark, tmp_path):
    """Identities count for 900 seconds of the clock, whatever the events' times; a repeated batch changes nothing."""
    from tarmac.streaming.dedup import Deliveries

    now = [0.0]
    gate = Deliveries(f"{tmp_path}/d", 900, clock=lambda: now[0])
    send = lambda b, *rows: gate.batch(spark.createDataFrame(rows, "vehicle_id string, seq long, ts_ms long"), b)
    send(0, ("a", 1, 50), ("a", 1, 40), ("a", 2, 10 * DAY_MS))
    for at, b in ((600, 1), (900, 2), (901, 3), (1500, 4)):
        now[0] = at
        for _ in range(2):
            send(b, ("a", 1, 40), ("b", b, 0))
    got = sorted((r.vehicle_id, r.seq, r.accepted_batch) for r in gate.accepted(spark).collect())
    assert got == [("a", 1, 0), ("a", 1, 3), ("a", 2, 0), ("b", 1, 1), ("b", 2, 2), ("b", 3, 3), ("b", 4, 4)]
    kept = Commits(spark, f"{tmp_path}/d").state().tables["seen"]
    assert [e["at"] for e in kept] == [600, 900, 901, 1500]


def test_warm_up_continues_from_history(spark, tmp_path):
    rows = history()
    cut = T0 + 30 * HOUR_MS
    engine = Snapshots(f"{tmp_path}/state")
    engine.warm_up(frame(spark, [r for r in rows if r[1] < cut]))
    engine.batch(frame(spark, [r for r in rows if r[1] >= cut]), 1)
    want = windows.snapshots(frame(spark, rows))
    got = engine.read(spark)
    first = got.agg(F.min("feature_ts_ms")).first()[0]
    assert first > T0 + 25 * HOUR_MS
    same(got, want.join(got.select(*KEYS), KEYS, "left_semi"))


def test_untouched_vehicles_are_forgotten(spark, tmp_path):
    engine = Snapshots(f"{tmp_path}/state", ttl_seconds=0)
    engine.batch(frame(spark, history(30)), 0)
    assert engine.counters(spark).first().vehicles == 0


def test_rows_of_active_components(spark, tmp_path):
    snaps = windows.snapshots(frame(spark, history(60)))
    fleet = spark.createDataFrame([("v0", "EV", None, ["BATTERY", "BRAKE"]), ("v1", "ICE", 0, ["POWERTRAIN"])], "vehicle_id string, vehicle_type string, manufacture_date_ms long, components array<string>")
    rows = per_component(snaps, fleet)
    n = {v: snaps.where(F.col("vehicle_id") == v).count() for v in ("v0", "v1")}
    assert {(r.vehicle_id, r.component): r["count"] for r in rows.groupBy("vehicle_id", "component").count().collect()} == {("v0", "BATTERY"): n["v0"], ("v0", "BRAKE"): n["v0"], ("v1", "POWERTRAIN"): n["v1"]}


def test_scores_follow_snapshots(spark, tmp_path):
    """Risk, alerts, audit rows, notifications and the view of two batches; a stale score changes nothing."""
    from tarmac.operators.alerts import ALERTS
    from tarmac.streaming.scoring import RISK, Scorer

    class Model:
        kind, threshold = "fixed", 0.5

        def score(self, df):
            return df.withColumn("p7d", F.when(F.col("feature_ts_ms") == 1, 0.9).otherwise(0.1))

    parts = spark.createDataFrame([("v", "BRAKE", "c1", "ACTIVE"), ("v", "BATTERY", "c2", "NOT_APPLICABLE")], "vehicle_id string, component string, vehicle_component_id string, status string")
    owners, ticks = spark.createDataFrame([("c1", 5)], "vehicle_component_id string, tenant_id long"), iter([0.0, 5.0, 20.0])
    scorer = Scorer(f"{tmp_path}", Model(), lambda s: s, lambda: parts, lambda: owners, lambda risk: risk.select("vehicle_component_id", "p7d"), clock=lambda: next(ticks))
    rows = lambda ts: spark.createDataFrame([("v", "BRAKE", ts), ("v", "BATTERY", ts)], "vehicle_id string, component string, feature_ts_ms long")
    log = Commits(spark, f"{tmp_path}")
    scorer.on_snapshots(rows(1), 0)
    view = lambda: log.read("view").first().p7d
    assert view() == 0.9 and [r.status for r in log.read("alerts", ALERTS).collect()] == ["ACTIVE"]
    scorer.on_snapshots(rows(2), 1)
    assert view() == 0.9  # not ten seconds old
    scorer.on_snapshots(rows(0), 2)  # stale
    assert view() == 0.1
    risk = log.read("risk", RISK).first()
    assert (risk.vehicle_component_id, risk.p7d, risk.feature_ts_ms) == ("c1", 0.1, 2)
    assert [r.status for r in log.read("alerts", ALERTS).collect()] == ["RESOLVED"]
    assert sorted((r.action, r.tenant_id) for r in log.read("audit").collect()) == [("ALERT_AUTO_RESOLVED", 5), ("ALERT_CREATED", 5)]
    latest = {r.component: r.feature_ts_ms for r in log.read("latest").collect()}
    assert log.read("notifications").count() == 6 and latest == {"BRAKE": 2, "BATTERY": 2}


def test_view_and_risk_written_follow_the_batch(spark, tmp_path):
    """Only the buckets of the scored components are made anew, in the risk table and in the view."""
    from tarmac.streaming.scoring import Scorer

    class Model:
        kind, threshold = "fixed", 0.5

        def score(self, df):
            return df.withColumn("p7d", F.lit(0.2))

    parts = spark.range(200).select(F.concat(F.lit("v"), "id").alias("vehicle_id"), F.lit("BRAKE").alias("component"), F.concat(F.lit("c"), "id").alias("vehicle_component_id"), F.lit("ACTIVE").alias("status"))
    owners = parts.select("vehicle_component_id", F.lit(1).cast("long").alias("tenant_id"))
    scorer, log = Scorer(str(tmp_path), Model(), lambda s: s, lambda: parts, lambda: owners, lambda risk: risk.select("vehicle_component_id", "p7d", "feature_ts_ms"), refresh_seconds=0), Commits(spark, str(tmp_path))
    scorer.on_snapshots(parts.select("vehicle_id", "component", F.lit(1).cast("long").alias("feature_ts_ms")), 0)
    files = lambda t: {e["bucket"]: e["path"] for e in log.state().tables[t]}
    risk, view = files("risk"), files("view")
    assert len(risk) == len(view) > 50 and log.read("view").count() == 200
    scorer.on_snapshots(spark.createDataFrame([("v7", "BRAKE", 5)], "vehicle_id string, component string, feature_ts_ms long"), 1)
    assert sum(files("risk")[b] != p for b, p in risk.items()) == sum(files("view")[b] != p for b, p in view.items()) == 1
    assert log.read("view").where("feature_ts_ms = 5").count() == 1 and log.read("view").count() == 200
    assert scorer.refresh_view(log) == []


def live(spark, path):
    fleet = spark.createDataFrame([(VIN, "v1", "HYBRID")], "vin string, vehicle_id string, vehicle_type string")
    parts = spark.createDataFrame([("v1", "POWERTRAIN", "c1", "ACTIVE")], "vehicle_id string, component string, vehicle_component_id string, status string")
    owners = spark.createDataFrame([("c1", 5)], "vehicle_component_id string, tenant_id long")
    return Live(str(path), lambda: fleet, lambda: parts, lambda: dtc_registry(spark), lambda: owners)


TABLES = ("telemetry", "dead_letters", "alerts", "audit")


def test_live_pipeline_batch_can_be_repeated(spark, tmp_path):
    log = Commits(spark, str(tmp_path))
    for _ in range(2):
        live(spark, tmp_path).batch(envelopes(spark), 0)
    assert [log.read(t).count() for t in TABLES] == [2, 3, 1, 1]
    live(spark, tmp_path).batch(envelopes(spark), 1)  # all delivered again: telemetry and alerts are there
    assert [log.read(t).count() for t in TABLES] == [2, 6, 1, 1]


def test_a_crash_between_any_two_writes_loses_and_repeats_nothing(spark, tmp_path, monkeypatch):
    """Each write, and the commit itself, fails once; readers see nothing of the batch, and its repeat leaves one alert and one audit row."""
    steps, real = [], {n: getattr(Change, n) for n in ("append", "put", "commit")}
    for n, f in real.items():
        monkeypatch.setattr(Change, n, lambda self, *a, n=n, f=f, **k: (steps.append(n), f(self, *a, **k))[1])
    live(spark, tmp_path / "whole").batch(envelopes(spark), 0)
    assert steps == ["append", "put", "put", "append", "commit"]
    for crash in range(len(steps)):
        for after in (False, True):
            left = [crash]

            def call(self, *a, f, **k):
                left[0] -= 1
                if left[0] == -1 and not after:
                    raise OSError("crash")
                out = f(self, *a, **k)
                if left[0] == -1:
                    raise OSError("crash")
                return out

            for n, f in real.items():
                monkeypatch.setattr(Change, n, lambda self, *a, f=f, **k: call(self, *a, f=f, **k))
            root = tmp_path / f"{crash}{after}"
            log = Commits(spark, str(root))
            with pytest.raises(OSError):
                live(spark, root).batch(envelopes(spark), 0)
            done = crash == len(steps) - 1 and after
            assert bool(log.state().tables) == done
            live(spark, root).batch(envelopes(spark), 0)
            assert [log.read(t).count() for t in TABLES] == [2, 3, 1, 1]


def test_vehicles_are_read_anew_for_an_unknown_vin(spark, tmp_path):
    """Not before the dimension is five seconds old, and without waiting for its sixty."""
    fleets = [spark.createDataFrame([], "vin string, vehicle_id string, vehicle_type string"), spark.createDataFrame([(VIN, "v1", "HYBRID")], "vin string, vehicle_id string, vehicle_type string")]
    now, reads = [0.0], []
    engine = live(spark, tmp_path)
    engine.vehicles, engine.clock = lambda: (reads.append(1), fleets[min(len(reads), 2) - 1])[1], lambda: now[0]
    count = lambda: engine.resolved(envelopes(spark))[0].count()
    assert (count(), len(reads)) == (0, 1)
    now[0] = 4.9
    assert (count(), len(reads)) == (0, 1)
    now[0] = 5.0
    assert count() > 0 and len(reads) == 2
    now[0] = 9.0
    assert count() > 0 and len(reads) == 2


def test_first_delivery_keeps_one(spark):
    df = spark.createDataFrame([("v", 1, 5, "late"), ("v", 1, 3, "first"), ("v", 2, 1, "x")], "vehicle_id string, seq long, ts_ms long, what string")
    assert {(r.seq, r.what) for r in ingest.first_delivery(df).collect()} == {(1, "first"), (2, "x")}


def test_streams_keep_their_state_in_the_shared_folder(spark):
    from tarmac.plans.scoring import _folder

    assert _folder(spark).startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))


def test_state_holds_only_blocks_that_later_snapshots_need(spark, tmp_path):
    """A batch of days leaves the blocks of each vehicle's last day, one an hour; it wrote all of its own before."""
    stats = {n: all_stats()[n] for n in ("n_events", "speed_sum", "soc_last")}
    engine = Snapshots(f"{tmp_path}/s", stats, {"24h": list(stats)}, buckets=2)
    rows = history(200)
    for i in range(2):
        engine.batch(frame(spark, rows[i * 100 : (i + 1) * 100]).repartition(3), i)
    last = {v: max(r[1] for r in rows if r[0] == v) // HOUR_MS for v in ("v0", "v1", "v2")}
    want = sorted({(r[0], r[1] // HOUR_MS) for r in rows if r[1] // HOUR_MS > last[r[0]] - 24})
    assert sorted((r.vehicle_id, r.hour) for r in Commits(spark, f"{tmp_path}/s").read("blocks").collect()) == want


def test_slices_of_a_stream_are_written_by_many_tasks(spark, tmp_path):
    """Each slice has as many files as tasks read it, its rows once, and a third of the slice before's last hours again; one task wrote each before."""
    from tarmac.plans.scoring import END_MS, START_MS, _slice

    rows = [(i, START_MS + (END_MS - START_MS) * i // 3000) for i in range(-30, 3030)]
    events = spark.createDataFrame(rows, "event_id long, ms long").select("event_id", F.timestamp_millis("ms").cast("timestamp_ntz").alias("ts"))
    events.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    width, seen = (END_MS - START_MS) // 5 + 1, 0
    for i in range(5):
        _slice(spark, str(tmp_path), f"{tmp_path}/in", i, 5)
        files = spark.read.parquet(f"{tmp_path}/in").select("event_id", F.input_file_name().alias("f")).collect()
        assert len({r.f for r in files}) == 3 * (i + 1)
        own = {e for e, ms in rows if min(4, max(0, (ms - START_MS) // width)) == i}
        again = {e for e, ms in rows if e % 3 == 0 and START_MS + i * width > ms >= START_MS + i * width - 20 * HOUR_MS} if i else set()
        seen += len(own) + len(again)
        assert len(files) == seen and own | again <= {r.event_id for r in files} and (not i or again)


def test_stored_spells_share_the_day_window(spark, tmp_path):
    """A row an event hour and a change, fewer than spells; spread out they are the snapshots, and totals of both forms agree."""
    engine, rows = Snapshots(f"{tmp_path}/s"), history(120)
    for i in range(3):
        engine.batch(frame(spark, rows[i * 40 : (i + 1) * 40]), i)
    engine.batch(frame(spark, []), 3)  # nothing but a watermark that moves
    stored, spells = engine.read_stored(spark), engine.read_spells(spark)
    assert stored.count() < spells.count() < engine.read(spark).count()
    assert spells.columns == windows.spells(frame(spark, rows)).columns
    from tarmac.plans.telemetry import window_totals

    totals = [sorted(window_totals(x).collect()) for x in (stored, spells, windows.spells(frame(spark, rows)))]
    for other in totals[1:]:
        for a, b in zip(totals[0], other, strict=True):
            assert all(x == y or x == pytest.approx(y, abs=0.011) for x, y in zip(a, b, strict=True))
    assert Commits(spark, f"{tmp_path}/s").state().writers == {"snapshots": 3}
