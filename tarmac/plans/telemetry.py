"""Queries over telemetry: the events table plays telemetry, faults and maintenance events.

A user is a vehicle, an event a record with its id as sequence number; the value and the number k in its properties stand
for signals. Errors and purchases are triggers, sign-ups services.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.config import DAY_MS, HOUR_MS, DatasetConfig
from tarmac.functions.features import features
from tarmac.functions.scalars import epoch_ms, f32, hash_percent, std_from_sums
from tarmac.functions.stats import all_stats
from tarmac.operators import asof, checks, ingest, labels, windows
from tarmac.operators.blocks import Layout, in_arrow, weighted
from tarmac.plans.registry import query
from tarmac.sources.readers import table

START_MS, END_MS = 1_704_067_200_000, 1_706_572_800_000  # 2024-01-01 and 2024-01-30
TRIGGERS, SERVICE = ["error", "purchase"], "signup"
SPLITS = DatasetConfig(splits={"train": (1, 12), "calibration": (14, 16), "threshold": (17, 19), "test": (20, 22)}, horizon_days=2)

RAW = """raw AS (SELECT user_id AS vehicle_id, event_id AS seq, epoch_us(ts) // 1000 AS ts_ms, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events)"""
TEL = f"""{RAW}, tel AS (SELECT vehicle_id, seq, ts_ms, event_type, CAST(CAST(value AS FLOAT) AS DOUBLE) AS speed, CAST(CAST(value + k AS FLOAT) AS DOUBLE) AS odo,
  CAST(CAST((k - 50) / 10.0 AS FLOAT) AS DOUBLE) AS accel, event_type = 'error' AS harsh, CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS soc,
  CASE WHEN k % 3 <> 0 THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END AS temp, CAST(k - 60 AS DOUBLE) AS amp, CASE WHEN k < 20 THEN k % 7 END AS code FROM raw)"""
GRID = f"""{TEL}, b AS (SELECT vehicle_id, min(ts_ms) AS f, max(ts_ms) AS l FROM tel GROUP BY 1),
 g AS (SELECT vehicle_id, f, unnest(generate_series(f // 3600000 + 1, l // 3600000)) * 3600000 AS t FROM b)"""


def raw(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """The events table (or a stream of its rows) with the names used here."""
    e = table(spark, sf_dir, "events") if events is None else events
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return e.select(F.col("user_id").alias("vehicle_id"), F.col("event_id").alias("seq"), epoch_ms(F.col("ts")).alias("ts_ms"), "event_type", "value", k.alias("k"))


def telemetry(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Records with all columns that the statistics read; some signals have nulls."""
    k, v = F.col("k"), F.col("value")
    soc, temp = F.when(k % 5 != 0, k.cast("double")), F.when(k % 3 != 0, v)
    codes = F.when(k < 20, F.array(F.element_at(F.array(*[F.lit(c) for c in CODES]), k % 7 + 1)))
    return raw(spark, sf_dir, events).select(
        "vehicle_id", "seq", "ts_ms", "event_type", v.alias("speed_kmh"), (v + k).alias("odometer_km"), ((k - 50) / F.lit(10.0)).alias("acceleration_ms2"),
        (F.col("event_type") == "error").alias("harsh_brake"), codes.alias("dtc_codes"), soc.alias("soc_pct"), temp.alias("temperature_c"), temp.alias("engine_temp_c"),
        temp.alias("motor_temp_c"), v.alias("voltage_v"), (k - 60).cast("double").alias("current_a"), v.alias("power_kw"), v.alias("engine_load_pct"), v.alias("rpm"),
    )


# The six known fault codes and one that is not registered.
CODES = ["P0301", "P0562", "BATT_TEMP_HIGH", "BATT_VOLT_UNSTABLE", "BRAKE_WEAR_HIGH", "BRAKE_SYSTEM_CRITICAL", "U9999"]
SIX = ["n_events", "speed_sum", "speed_sumsq", "odo_min", "odo_max", "soc_first", "soc_last"]


# Every statistic as SQL over the columns of ``tel``. Codes 0 and 1 of the seven are of the powertrain, 2 and 3 of the battery,
# 4 and 5 of the brakes; the seventh is unknown.
_SIGNAL_SQL = {"battery_temp": "temp", "engine_temp": "temp", "motor_temp": "temp", "voltage": "speed", "current": "amp", "power": "speed", "engine_load": "speed", "rpm": "speed"}
_COUNT_SQL = {
    "n_events": "e.seq IS NOT NULL", "n_moving": "speed > 1", "harsh_count": "harsh", "harsh_high_speed_count": "harsh AND speed >= 80", "harsh_accel_n": "harsh AND accel IS NOT NULL", "brake_n": "accel < -1",
    "dtc_event_count": "code IS NOT NULL", "dtc_brake_count": "code IN (4, 5)", "dtc_powertrain_count": "code IN (0, 1)", "dtc_battery_count": "code IN (2, 3)",
    **{f"{n}_n": f"{c} IS NOT NULL" for n, c in _SIGNAL_SQL.items()}, "engine_temp_high_count": "temp > 105", "engine_load_high_count": "speed > 80", "motor_temp_high_count": "temp > 90",
    "power_high_count": "speed > 60", "battery_temp_high_count": "temp > 40", "deep_discharge_count": "soc < 10", "charging_count": "amp < -1", "fast_charge_count": "amp < -100",
}
_SUM_SQL = {"speed_sum": ("speed", "speed > 1"), "speed_sumsq": ("speed * speed", "speed > 1"), "harsh_accel_sum": ("accel", "harsh"), "brake_accel_sum": ("accel", "accel < -1")}
_SUM_SQL |= {f"{n}_sum": (c, "true") for n, c in _SIGNAL_SQL.items()} | {f"{n}_sumsq": (f"{c} * {c}", "true") for n, c in _SIGNAL_SQL.items()}
_ENDS_SQL = {"odo_min": "min(odo)", "odo_max": "max(odo)", "accel_min": "min(accel)", "current_absmax": "max(abs(amp))", "soc_min": "min(soc)", "soc_max": "max(soc)"}
_ENDS_SQL |= {f"{n}_{m}": f"{m}({c})" for n, c in _SIGNAL_SQL.items() for m in ("max", "min")}
_ENDS_SQL |= {"soc_first": "arg_min(soc, (e.ts_ms, e.seq)) FILTER (WHERE soc IS NOT NULL)", "soc_last": "arg_max(soc, (e.ts_ms, e.seq)) FILTER (WHERE soc IS NOT NULL)"}
_ALL_SQL = {n: f"count(*) FILTER (WHERE {c})" for n, c in _COUNT_SQL.items()} | {n: f"round(coalesce(sum({x}) FILTER (WHERE {c}), 0), 2)" for n, (x, c) in _SUM_SQL.items()} | _ENDS_SQL
#: A named subquery with all statistics, as a format of its name, source (``tel`` rows named e), grouping and the names' prefix.
ALL_STATS_SQL = "{name} AS (SELECT {by}, " + ", ".join(f'{x} AS "{{prefix}}{n}"' for n, x in _ALL_SQL.items()) + " FROM {source} GROUP BY ALL)"


_WINDOWS = {"5m": 300, "1h": 3600, "24h": 86400}
#: The snapshots of all windows with all statistics, summed up by vehicle.
WINDOW_TOTALS_SQL = ", ".join(
    ALL_STATS_SQL.format(name=f"x{w}", source=f"g LEFT JOIN tel e ON e.vehicle_id = g.vehicle_id AND e.ts_ms < g.t AND e.ts_ms >= g.t - {s * 1000}", by="g.vehicle_id, g.t", prefix=f"{w}_") for w, s in _WINDOWS.items()
) + " SELECT vehicle_id, count(*) AS snapshots, " + ", ".join(f'round(sum(CAST("{w}_{n}" AS DOUBLE)), 2) AS "{w}_{n}"' for w in _WINDOWS for n in _ALL_SQL) + " FROM x24h JOIN x1h USING (vehicle_id, t) JOIN x5m USING (vehicle_id, t) GROUP BY 1"


def window_totals(spells: DataFrame) -> DataFrame:
    """Every statistic of every window summed over each vehicle's snapshots: a small result that holds all of them. Sums are rounded first, as the SQL does.

    In spells as a stream stores them (with ``fresh``), the short windows count for the first hour alone.
    """
    names = [f"{w}_{n}" for w in _WINDOWS for n in all_stats()]
    value = lambda c: f"`{c}`.value" if c.endswith(("soc_first", "soc_last")) else f"`{c}`"
    light = "fresh" if "fresh" in spells.columns else "size(hours)"
    plain = spells.selectExpr("vehicle_id", "CAST(size(hours) AS BIGINT) AS snapshots", f"CAST({light} AS BIGINT) AS light", *[f"CAST({value(c)} AS DOUBLE) AS `{c}`" for c in names])
    layout, rounded = Layout({c: plain.schema[c].dataType for c in names}), {c for c in names if c.endswith(("_sum", "_sumsq"))}
    parts = in_arrow(layout.packed(plain, "vehicle_id", "snapshots", "light"), plain.schema, weighted(rounded, {c for c in names if not c.startswith("24h_")}), layout)
    return parts.groupBy("vehicle_id").agg(F.sum("snapshots").alias("snapshots"), *[F.expr(f"round(sum(`{c}`), 2) AS `{c}`") for c in names])


def plain_stats(df: DataFrame) -> DataFrame:
    """Sums rounded as the SQL rounds them (most are zero: rounding is the dear part), first and last values without their keys."""
    out = []
    for c in df.columns:
        value = f"if(`{c}` = 0, `{c}`, round(`{c}`, 2))" if c.endswith(("_sum", "_sumsq")) else f"`{c}`.value" if c.endswith(("soc_first", "soc_last")) else f"`{c}`"
        out.append(f"{value} AS `{c}`")
    return df.selectExpr(*out)


def six() -> dict:
    return {n: s for n, s in all_stats().items() if n in SIX}


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with one in seven delivered again a second later."""
    first = raw(spark, sf_dir).withColumn("received_ms", F.col("ts_ms"))
    return first.unionByName(first.where("seq % 7 = 0").withColumn("received_ms", F.col("ts_ms") + 1000))


DELIVERIES = f"WITH {RAW}, d AS (SELECT *, ts_ms AS received_ms FROM raw UNION ALL SELECT *, ts_ms + 1000 FROM raw WHERE seq % 7 = 0)"


@query(DELIVERIES + " SELECT vehicle_id, seq, ts_ms, event_type, value, k, received_ms FROM d QUALIFY row_number() OVER (PARTITION BY vehicle_id, seq ORDER BY received_ms) = 1")
def dedup_first_delivery(spark, sf_dir):
    return ingest.first_delivery(deliveries(spark, sf_dir), order=["received_ms"])


@query(DELIVERIES + " SELECT count(*) AS published, count(DISTINCT (vehicle_id, seq)) AS distinct_keys, count(*) - count(DISTINCT (vehicle_id, seq)) AS dropped FROM d")
def dedup_invariant(spark, sf_dir):
    return checks.delivery_invariant(deliveries(spark, sf_dir), ["vehicle_id", "seq"])


@query("SELECT count(DISTINCT (user_id, event_type, CAST(ts AS DATE))) AS n FROM events")
def multi_key_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.count_distinct("user_id", "event_type", F.to_date("ts")).alias("n"))


def _bucket_sql(seconds: int) -> str:
    return f"""WITH {TEL} SELECT vehicle_id, ts_ms // {seconds * 1000} AS bucket, count(*) AS n_events, round(coalesce(sum(speed) FILTER (WHERE speed > 1), 0), 3) AS speed_sum,
      round(coalesce(sum(speed * speed) FILTER (WHERE speed > 1), 0), 2) AS speed_sumsq, min(odo) AS odo_min, max(odo) AS odo_max,
      arg_min(soc, (ts_ms, seq)) FILTER (WHERE soc IS NOT NULL) AS soc_first, arg_max(soc, (ts_ms, seq)) FILTER (WHERE soc IS NOT NULL) AS soc_last FROM tel GROUP BY 1, 2"""


def _flat(df: DataFrame) -> DataFrame:
    return df.withColumns({"speed_sum": F.round("speed_sum", 3), "speed_sumsq": F.round("speed_sumsq", 2), "soc_first": F.col("soc_first.value"), "soc_last": F.col("soc_last.value")})


@query(_bucket_sql(60))
def bucket_60s_stats(spark, sf_dir):
    return _flat(windows.buckets(telemetry(spark, sf_dir), 60, six()))


@query(_bucket_sql(900))
def bucket_900s_stats(spark, sf_dir):
    return _flat(windows.buckets(telemetry(spark, sf_dir), 900, six()))


@query(f"""WITH {TEL}, {ALL_STATS_SQL.format(name="x", source="tel e", by="vehicle_id, ts_ms // 60000 AS bucket", prefix="")} SELECT * FROM x""")
def bucket_60s_all_stats(spark, sf_dir):
    return plain_stats(windows.buckets(telemetry(spark, sf_dir), 60))


@query(f"""WITH {TEL}, {ALL_STATS_SQL.format(name="x", source="tel e", by="vehicle_id, ts_ms // 900000 AS bucket", prefix="")} SELECT * FROM x""")
def bucket_900s_all_stats(spark, sf_dir):
    return plain_stats(windows.buckets(telemetry(spark, sf_dir), 900))


@query(f"WITH {GRID}, {WINDOW_TOTALS_SQL}")
def windows_all_stats(spark, sf_dir):
    """All 70 statistics over all three windows, summed up by vehicle."""
    return window_totals(windows.spells(telemetry(spark, sf_dir)))


# A number for each window of a snapshot that changes with any value of any statistic: hundredths, weighted by the statistic.
_WEIGHTS = {n: 2 * i + 3 for i, n in enumerate(_ALL_SQL)}
WINDOW_MARKS_SQL = WINDOW_TOTALS_SQL[: WINDOW_TOTALS_SQL.index(" SELECT vehicle_id, count(*) AS snapshots")].replace("round(coalesce(", "(coalesce(").replace("), 2)", "))") + " SELECT vehicle_id, t AS feature_ts_ms, " + ", ".join(
    " + ".join(f'coalesce(CAST(floor(CAST("{w}_{n}" AS DOUBLE) * 100 + 0.5) AS BIGINT), 7777) * {k}' for n, k in _WEIGHTS.items()) + f' AS "mark_{w}"' for w in _WINDOWS
) + " FROM x24h JOIN x1h USING (vehicle_id, t) JOIN x5m USING (vehicle_id, t)"


def window_marks(spells: DataFrame) -> DataFrame:
    """Every spell with one number for each of its windows, into which all statistics go."""
    value = lambda w, n: f"`{w}_{n}`.value" if n in ("soc_first", "soc_last") else f"`{w}_{n}`"
    mark = lambda w: " + ".join(f"coalesce(CAST(floor(CAST({value(w, n)} AS DOUBLE) * 100 + 0.5) AS BIGINT), 7777L) * {k}" for n, k in _WEIGHTS.items())
    return spells.selectExpr("vehicle_id", "hours", *[f"{mark(w)} AS `mark_{w}`" for w in _WINDOWS])


@query(f"WITH {GRID}, {WINDOW_MARKS_SQL}")
def windows_all_stats_rows(spark, sf_dir):
    """Each snapshot of all statistics and windows, a number a window: a value on the wrong hour shows."""
    return windows.each_hour(window_marks(windows.spells(telemetry(spark, sf_dir))))


_POINTS_SQL = f"{TEL}, p AS (SELECT DISTINCT vehicle_id, (ts_ms // 300000 + 1) * 300000 AS t FROM tel)"


def _band_sql(name: str) -> str:
    width, n = windows.BANDS[name]
    w = width * 1000
    return f"""b{name} AS (SELECT p.vehicle_id, p.t, count(e.seq) AS n_events, round(coalesce(sum(e.speed) FILTER (WHERE e.speed > 1), 0), 3) AS speed_sum, min(e.odo) AS odo_min, max(e.odo) AS odo_max,
      arg_min(e.soc, (e.ts_ms, e.seq)) FILTER (WHERE e.soc IS NOT NULL) AS soc_first, arg_max(e.soc, (e.ts_ms, e.seq)) FILTER (WHERE e.soc IS NOT NULL) AS soc_last
      FROM p LEFT JOIN tel e ON e.vehicle_id = p.vehicle_id AND e.ts_ms < (p.t // {w}) * {w} AND e.ts_ms >= (p.t // {w} - {n}) * {w} GROUP BY 1, 2)"""


_BAND_STATS = ["n_events", "speed_sum", "odo_min", "odo_max", "soc_first", "soc_last"]


@query(f"WITH {_POINTS_SQL}, " + ", ".join(map(_band_sql, windows.BANDS)) + " SELECT vehicle_id, t AS feature_ts_ms, " + ", ".join(f'b{w}.{n} AS "{w}_{n}"' for w in windows.BANDS for n in _BAND_STATS) + " FROM b5m JOIN b1h USING (vehicle_id, t) JOIN b24h USING (vehicle_id, t)")
def bucket_snapshots_5m_grid(spark, sf_dir):
    """Snapshots at the five-minute boundary after each event, merged from buckets of 60 and 900 seconds."""
    t = telemetry(spark, sf_dir)
    points = t.select("vehicle_id", ((F.floor(F.col("ts_ms") / 300_000) + 1) * 300_000).alias("feature_ts_ms"))
    found = windows.bucket_snapshots(t, points, {w: _BAND_STATS for w in windows.BANDS})
    flat = {f"{w}_{n}": F.round(f"{w}_{n}", 3) if n == "speed_sum" else F.col(f"`{w}_{n}`.value") if n.startswith("soc") else F.col(f"`{w}_{n}`") for w in windows.BANDS for n in _BAND_STATS}
    return found.select("vehicle_id", "feature_ts_ms", *[c.alias(n) for n, c in flat.items()])


@query(f"WITH {RAW} SELECT vehicle_id, seq, ts_ms, value FROM raw ORDER BY ts_ms, vehicle_id, seq")
def replay_sort(spark, sf_dir):
    return windows.replay_order(raw(spark, sf_dir).select("vehicle_id", "seq", "ts_ms", "value"))


@query("SELECT DISTINCT user_id AS vehicle_id FROM events ORDER BY 1")
def distinct_vehicles(spark, sf_dir):
    from tarmac.sources import readers

    return readers.distinct_vehicles(raw(spark, sf_dir))


@query(f"""WITH {RAW}, d AS (SELECT vehicle_id, ts_ms // 86400000 AS day, list(DISTINCT 'C' || CAST(k % 9 AS VARCHAR)) FILTER (WHERE k < 40) AS a, list(DISTINCT 'C' || CAST(k % 13 AS VARCHAR)) FILTER (WHERE k >= 60) AS b FROM raw GROUP BY 1, 2)
  SELECT vehicle_id, day, array_to_string(list_sort(coalesce(a, [])), ',') AS codes, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') AS injected FROM d""")
def code_set_union(spark, sf_dir):
    """Sorted distinct codes of a day, and their union with injected ones."""
    from tarmac.functions.scalars import sorted_codes

    r = raw(spark, sf_dir).withColumn("day", F.floor(F.col("ts_ms") / DAY_MS))
    code = lambda n, c: F.collect_list(F.when(c, F.concat(F.lit("C"), (F.col("k") % n).cast("string"))))
    sets = r.groupBy("vehicle_id", "day").agg(code(9, F.col("k") < 40).alias("a"), code(13, F.col("k") >= 60).alias("b"))
    return sets.select("vehicle_id", "day", F.array_join(sorted_codes(F.col("a")), ",").alias("codes"), F.array_join(sorted_codes(F.col("a"), F.col("b")), ",").alias("injected"))


@query(f"""WITH {RAW} SELECT seq, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(ts_ms % 1000 // 10 AS VARCHAR), 2, '0') || 'Z' AS centis, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS millis,
  greatest(0, {END_MS} - ts_ms) AS latency_ms, CASE WHEN value >= 499 THEN '>99.9%' ELSE printf('%.1f%%', round(value / 5, 1)) END AS label FROM raw""")
def time_and_display_formats(spark, sf_dir):
    """ISO texts to hundredths and thousandths, latency against a fixed now, and a percentage for display."""
    from tarmac.functions import scalars as S

    p = F.round(F.col("value") / 5, 1) / 100
    label = F.when(F.col("value") >= 499, S.percent_label(F.lit(0.9995))).otherwise(S.percent_label(F.least(p, F.lit(0.998))))
    return raw(spark, sf_dir).select("seq", S.iso_centis(F.col("ts_ms")).alias("centis"), S.iso_millis(F.col("ts_ms")).alias("millis"), S.latency_ms(F.col("ts_ms"), F.lit(END_MS)).alias("latency_ms"), label.alias("label"))


@query(f"""WITH {TEL} SELECT vehicle_id, ts_ms // 3600000 AS hour, count(*) AS n, round(coalesce(sum(speed) FILTER (WHERE speed > 1), 0), 3) AS total,
  count(*) FILTER (WHERE ts_ms // 60000 % 60 >= 55) AS late_n, round(coalesce(sum(speed) FILTER (WHERE speed > 1 AND ts_ms // 60000 % 60 >= 55), 0), 3) AS late_total,
  max(odo) FILTER (WHERE ts_ms // 60000 % 60 >= 55) AS late_max FROM tel GROUP BY 1, 2""")
def hour_blocks(spark, sf_dir):
    b = windows.hour_blocks(telemetry(spark, sf_dir), {n: s for n, s in all_stats().items() if n in ("n_events", "speed_sum", "odo_max")})
    return b.select("vehicle_id", "hour", F.col("h_n_events").alias("n"), F.round("h_speed_sum", 3).alias("total"), F.col("l_n_events").alias("late_n"), F.round("l_speed_sum", 3).alias("late_total"), F.col("l_odo_max").alias("late_max"))


def _window_sql(seconds: int) -> str:
    return f"""WITH {GRID} SELECT g.vehicle_id, g.t AS feature_ts_ms, count(e.seq) AS n_events, round(coalesce(sum(e.speed) FILTER (WHERE e.speed > 1), 0), 3) AS speed_sum,
      min(e.odo) AS odo_min, max(e.odo) AS odo_max, arg_min(e.soc, (e.ts_ms, e.seq)) FILTER (WHERE e.soc IS NOT NULL) AS soc_first, arg_max(e.soc, (e.ts_ms, e.seq)) FILTER (WHERE e.soc IS NOT NULL) AS soc_last
      FROM g LEFT JOIN tel e ON e.vehicle_id = g.vehicle_id AND e.ts_ms < g.t AND e.ts_ms >= g.t - {seconds * 1000} GROUP BY 1, 2"""


def _window(spark, sf_dir, name: str) -> DataFrame:
    used = ["n_events", "speed_sum", "odo_min", "odo_max", "soc_first", "soc_last"]
    s = windows.snapshots(telemetry(spark, sf_dir), {name: used})
    s = s.select("vehicle_id", "feature_ts_ms", *[F.col(f"{name}_{u}").alias(u) for u in used])
    return s.withColumns({"speed_sum": F.round("speed_sum", 3), "soc_first": F.col("soc_first.value"), "soc_last": F.col("soc_last.value")})


@query(_window_sql(3600))
def window_1h_snapshot(spark, sf_dir):
    return _window(spark, sf_dir, "1h")


@query(_window_sql(300))
def window_5m_snapshot(spark, sf_dir):
    return _window(spark, sf_dir, "5m")


@query(_window_sql(86400))
def window_24h_snapshot(spark, sf_dir):
    return _window(spark, sf_dir, "24h")


@query(f"""WITH {GRID}, w AS (SELECT g.vehicle_id, g.t, g.f, count(e.seq) AS n, count(*) FILTER (WHERE e.speed > 1) AS m, coalesce(sum(e.speed) FILTER (WHERE e.speed > 1), 0) AS s,
  coalesce(sum(e.speed * e.speed) FILTER (WHERE e.speed > 1), 0) AS q, max(e.odo) - min(e.odo) AS d, count(*) FILTER (WHERE e.harsh) AS hb, min(e.accel) AS ma,
  sum(e.accel) FILTER (WHERE e.accel < -1) AS bs, count(*) FILTER (WHERE e.accel < -1) AS bn
  FROM g LEFT JOIN tel e ON e.vehicle_id = g.vehicle_id AND e.ts_ms < g.t AND e.ts_ms >= g.t - 86400000 GROUP BY 1, 2, 3)
  SELECT vehicle_id, t AS feature_ts_ms, f <= t - 86400000 AS window_complete, CAST(n AS DOUBLE) AS w24h_events, CAST(m AS DOUBLE) AS w24h_moving_events, round(s / nullif(m, 0), 5) AS w24h_avg_speed_moving,
  CASE WHEN m > 0 THEN round(sqrt(greatest(0.0, q / m - (s / m) * (s / m))), 4) END AS w24h_speed_std_moving, round(d, 4) AS w24h_distance_km, CAST(hb AS DOUBLE) AS w24h_harsh_brakes, ma AS w24h_min_accel,
  round(-bs / nullif(bn, 0), 5) AS w24h_mean_braking_decel FROM w""")
def feature_snapshots_24h(spark, sf_dir):
    """The flagship: day-long features of every vehicle at every hour, empty hours included."""
    used = ["n_events", "n_moving", "speed_sum", "speed_sumsq", "odo_min", "odo_max", "harsh_count", "accel_min", "brake_n", "brake_accel_sum"]
    snaps = windows.snapshots(telemetry(spark, sf_dir), {"24h": used})
    formulas = features_24h()
    digits = {"w24h_avg_speed_moving": 5, "w24h_speed_std_moving": 4, "w24h_distance_km": 4, "w24h_mean_braking_decel": 5}
    wanted = ["events", "moving_events", "avg_speed_moving", "speed_std_moving", "distance_km", "harsh_brakes", "min_accel", "mean_braking_decel"]
    out = [F.round(formulas[n], digits[f"w24h_{n}"]).alias(f"w24h_{n}") if f"w24h_{n}" in digits else formulas[n].alias(f"w24h_{n}") for n in wanted]
    return snaps.select("vehicle_id", "feature_ts_ms", (F.col("first_event_ts_ms") <= F.col("feature_ts_ms") - DAY_MS).alias("window_complete"), *out)


def features_24h() -> dict:
    return {n.removeprefix("w24h_"): c for n, c in features("BRAKE").items() if n.startswith("w24h_")}


@query(f"""WITH {TEL} SELECT vehicle_id, seq, count(*) OVER w AS n_before, round(sum(speed) OVER w, 3) AS speed_before, max(odo) OVER w AS odo_before FROM tel
  WINDOW w AS (PARTITION BY vehicle_id ORDER BY ts_ms RANGE BETWEEN 86400000 PRECEDING AND 1 PRECEDING)""")
def rolling_range_24h(spark, sf_dir):
    t = telemetry(spark, sf_dir).select("vehicle_id", "seq", "ts_ms", f32(F.col("speed_kmh")).alias("speed"), f32(F.col("odometer_km")).alias("odo"))
    r = windows.rolling(t, "vehicle_id", "ts_ms", 86400, {"n_before": F.count(F.lit(1)), "speed_before": F.sum("speed"), "odo_before": F.max("odo")})
    return r.select("vehicle_id", "seq", "n_before", F.round("speed_before", 3).alias("speed_before"), "odo_before")


@query(f"""WITH {RAW}, x AS (SELECT vehicle_id, value, unnest(generate_series(ts_ms // 3600000 + 1, ts_ms // 3600000 + 24)) AS h FROM raw)
  SELECT vehicle_id, h * 3600000 AS end_ms, count(*) AS n_events, round(sum(value), 3) AS total FROM x GROUP BY 1, 2""")
def sliding_window_24h_by_1h(spark, sf_dir):
    """Spark's own sliding windows: only those that hold events."""
    df = raw(spark, sf_dir).withColumn("at", F.timestamp_millis("ts_ms"))
    g = df.groupBy("vehicle_id", F.window("at", "24 hours", "1 hour")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 3).alias("total"))
    return g.select("vehicle_id", F.unix_millis("window.end").alias("end_ms"), "n_events", "total")


@query("SELECT user_id AS vehicle_id, round(sqrt(greatest(0.0, sum(value * value) / count(*) - (sum(value) / count(*)) * (sum(value) / count(*)))), 4) AS std FROM events GROUP BY 1")
def std_from_running_sums(spark, sf_dir):
    v = F.col("value")
    return raw(spark, sf_dir).groupBy("vehicle_id").agg(F.round(std_from_sums(F.sum(v), F.sum(v * v), F.count(v)), 4).alias("std"))


@query(f"""WITH {TEL} SELECT vehicle_id, arg_max(soc, (ts_ms, seq)) FILTER (WHERE soc IS NOT NULL) - arg_min(soc, (ts_ms, seq)) FILTER (WHERE soc IS NOT NULL) AS soc_delta FROM tel GROUP BY 1""")
def first_last_delta(spark, sf_dir):
    stats = {n: s for n, s in all_stats().items() if n in ("soc_first", "soc_last")}
    agg = telemetry(spark, sf_dir).groupBy("vehicle_id").agg(*[s.aggregate() for s in stats.values()])
    return agg.select("vehicle_id", (F.col("soc_last.value") - F.col("soc_first.value")).alias("soc_delta"))


@query(f"""WITH {TEL} SELECT vehicle_id, count(*) FILTER (WHERE temp > 105) AS engine_temp_high_count, count(*) FILTER (WHERE speed > 80) AS engine_load_high_count, count(*) FILTER (WHERE soc < 10) AS deep_discharge_count,
  count(*) FILTER (WHERE harsh AND speed >= 80) AS harsh_high_speed_count, count(*) FILTER (WHERE accel < -1) AS brake_n FROM tel GROUP BY 1""")
def threshold_counts(spark, sf_dir):
    wanted = ["engine_temp_high_count", "engine_load_high_count", "deep_discharge_count", "harsh_high_speed_count", "brake_n"]
    stats = all_stats()
    return telemetry(spark, sf_dir).groupBy("vehicle_id").agg(*[stats[n].aggregate() for n in wanted])


@query("SELECT user_id AS vehicle_id, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 4) AS total, max(CAST(CAST(value AS FLOAT) AS DOUBLE)) AS largest FROM events GROUP BY 1")
def f32_quantised_sums(spark, sf_dir):
    v = f32(F.col("value"))
    return raw(spark, sf_dir).groupBy("vehicle_id").agg(F.round(F.sum(v), 4).alias("total"), F.max(v).alias("largest"))


def _snapshot_rows(spark, sf_dir) -> DataFrame:
    """A snapshot every hour of every vehicle, as in the windows."""
    s = windows.snapshots(telemetry(spark, sf_dir), {"1h": ["n_events"]})
    return s.select("vehicle_id", "feature_ts_ms", "first_event_ts_ms")


def _maintenance(spark, sf_dir) -> DataFrame:
    return raw(spark, sf_dir).where(F.col("event_type").isin(*TRIGGERS, SERVICE)).select("vehicle_id", F.col("seq").alias("event_id"), "event_type", "ts_ms", "value")


EVENTS = f"{GRID}, ev AS (SELECT vehicle_id, seq AS event_id, event_type, ts_ms, value FROM raw WHERE event_type IN ('error', 'purchase', 'signup'))"


@query(f"""WITH {EVENTS} SELECT g.vehicle_id, g.t AS feature_ts_ms, max(ts_ms) AS service_ts_ms, arg_max(value, (ts_ms, event_id)) AS service_value, (g.t - max(ts_ms)) / 86400000.0 :: DOUBLE AS days_since_service
  FROM g LEFT JOIN ev ON ev.vehicle_id = g.vehicle_id AND ev.event_type = 'signup' AND ev.ts_ms <= g.t GROUP BY 1, 2""")
def asof_backward_service(spark, sf_dir):
    services = _maintenance(spark, sf_dir).where(F.col("event_type") == SERVICE)
    found = asof.backward(_snapshot_rows(spark, sf_dir), services, ["vehicle_id"], "feature_ts_ms", "ts_ms", "service_", True, [F.col("event_id")])
    days = (F.col("feature_ts_ms") - F.col("service_ts_ms")) / F.lit(float(DAY_MS))
    return found.select("vehicle_id", "feature_ts_ms", "service_ts_ms", "service_value", days.alias("days_since_service"))


def _labelled(spark, sf_dir) -> DataFrame:
    return labels.label_snapshots(_snapshot_rows(spark, sf_dir), _maintenance(spark, sf_dir), END_MS, 2, "vehicle_id", TRIGGERS)


NEXT = f"""{EVENTS}, nx AS (SELECT g.vehicle_id, g.t, g.f, min((ts_ms, event_type, event_id)) AS n FROM g LEFT JOIN ev ON ev.vehicle_id = g.vehicle_id AND ev.event_type <> 'signup' AND ev.ts_ms > g.t AND ev.ts_ms <= g.t + 172800000 GROUP BY 1, 2, 3),
 ls AS (SELECT g.vehicle_id, g.t, arg_max(event_type, (ts_ms, event_type, event_id)) AS last_type FROM g LEFT JOIN ev ON ev.vehicle_id = g.vehicle_id AND ev.ts_ms <= g.t GROUP BY 1, 2),
 lab AS (SELECT nx.vehicle_id, nx.t, nx.f, CASE WHEN n[1] IS NULL THEN 0 ELSE 1 END AS label_7d, n[3] AS label_next_event_id, (n[1] - nx.t) / 3600000.0 :: DOUBLE AS hours, coalesce(last_type <> 'signup', false) AS in_gap,
 nx.t + 172800000 > {END_MS} AS tail FROM nx JOIN ls USING (vehicle_id, t))""".replace("n[1]", "struct_extract_at(n, 1)").replace("n[3]", "struct_extract_at(n, 3)")


@query(f"WITH {NEXT} SELECT vehicle_id, t AS feature_ts_ms, label_7d, label_next_event_id, hours AS label_hours_to_event FROM lab")
def asof_forward_label(spark, sf_dir):
    return _labelled(spark, sf_dir).select("vehicle_id", "feature_ts_ms", F.col("label_7d").cast("int").alias("label_7d"), "label_next_event_id", "label_hours_to_event")


@query(f"WITH {NEXT} SELECT vehicle_id, t AS feature_ts_ms, in_gap FROM lab")
def in_gap_flag(spark, sf_dir):
    return _labelled(spark, sf_dir).select("vehicle_id", "feature_ts_ms", "in_gap")


@query(f"WITH {NEXT} SELECT tail, count(*) AS n, min(t) AS first_ms FROM lab GROUP BY 1")
def tail_flag(spark, sf_dir):
    return _labelled(spark, sf_dir).groupBy("tail").agg(F.count(F.lit(1)).alias("n"), F.min("feature_ts_ms").alias("first_ms"))


SPLIT_SQL = "CASE " + " ".join(f"WHEN t >= {a} AND t < {b} THEN '{n}'" for n, (a, b) in SPLITS.ranges_ms(START_MS).items()) + " END"


@query(f"""WITH {NEXT}, x AS (SELECT *, f <= t - 86400000 AS c, {SPLIT_SQL} AS split FROM lab) SELECT count(*) AS snapshots_total, count(*) FILTER (WHERE NOT c) AS excluded_warmup, count(*) FILTER (WHERE c AND in_gap) AS excluded_in_gap,
  count(*) FILTER (WHERE c AND NOT in_gap AND tail) AS excluded_tail, count(*) FILTER (WHERE c AND NOT in_gap AND NOT tail AND split IS NULL) AS excluded_outside_splits,
  count(*) FILTER (WHERE c AND NOT in_gap AND NOT tail AND split IS NOT NULL) AS rows_kept FROM x""")
def exclusion_funnel(spark, sf_dir):
    df = _labelled(spark, sf_dir).withColumn("window_complete", F.col("first_event_ts_ms") <= F.col("feature_ts_ms") - DAY_MS)
    return labels.exclusion_funnel(df, labels.split_of(F.col("feature_ts_ms"), SPLITS, START_MS))


@query(f"WITH {GRID}, x AS (SELECT {SPLIT_SQL} AS split, vehicle_id FROM g) SELECT split, count(*) AS n, count(DISTINCT vehicle_id) AS vehicles FROM x GROUP BY 1")
def chrono_splits(spark, sf_dir):
    s = _snapshot_rows(spark, sf_dir).select(labels.split_of(F.col("feature_ts_ms"), SPLITS, START_MS).alias("split"), "vehicle_id")
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("vehicle_id").alias("vehicles"))


HEX = "list_reduce(list_prepend(0, list_transform(string_split(sha256('42:' || CAST({0} AS VARCHAR)), ''), lambda c: strpos('0123456789abcdef', c) - 1)), lambda a, d: (a * 16 + d) % 100)"


@query(f"SELECT DISTINCT user_id AS vehicle_id, CAST({HEX.format('user_id')} AS INTEGER) AS h, CASE WHEN {HEX.format('user_id')} < 20 THEN 'holdout' ELSE 'dev' END AS vehicle_group FROM events")
def holdout_hash(spark, sf_dir):
    ids = raw(spark, sf_dir).select("vehicle_id").distinct()
    return ids.select("vehicle_id", hash_percent(F.concat(F.lit("42:"), F.col("vehicle_id").cast("string"))).alias("h"), labels.vehicle_group(F.col("vehicle_id"), SPLITS).alias("vehicle_group"))


@query(f"""WITH {NEXT}, x AS (SELECT *, {SPLIT_SQL} AS split, {HEX.format('vehicle_id')} < 20 AS held FROM lab WHERE f <= t - 86400000 AND NOT in_gap AND NOT tail)
  SELECT split AS meta_split, count(*) AS rows, count(*) FILTER (WHERE label_7d = 1) AS positives, round(avg(label_7d), 6) AS prevalence, count(DISTINCT label_next_event_id) AS positive_events, count(DISTINCT vehicle_id) AS vehicles,
  count(*) FILTER (WHERE held) AS holdout_rows FROM x WHERE split IS NOT NULL GROUP BY 1""")
def dataset_counts(spark, sf_dir):
    parts = table(spark, sf_dir, "events").select(F.col("user_id").alias("vehicle_id"), F.lit("BRAKE").alias("component"), F.col("user_id").alias("vehicle_component_id"), F.lit("EV").alias("vehicle_type")).distinct()
    snaps = _snapshot_rows(spark, sf_dir).withColumns({"component": F.lit("BRAKE"), "window_complete": F.col("first_event_ts_ms") <= F.col("feature_ts_ms") - DAY_MS})
    renamed = F.when(F.col("event_type") == SERVICE, "SERVICE_COMPLETED").when(F.col("event_type") == "error", "FAILURE").otherwise("MAINTENANCE_REQUIRED")
    ev = _maintenance(spark, sf_dir).select(F.col("vehicle_id").alias("vehicle_component_id"), "event_id", renamed.alias("event_type"), "ts_ms")
    rows, _ = labels.build_dataset(snaps, parts, ev, START_MS, 2 * END_MS, SPLITS)
    counts = labels.dataset_counts(rows.where(F.col("meta_feature_ts_ms") + 2 * DAY_MS <= END_MS))
    return counts.select("meta_split", "rows", "positives", F.round("prevalence", 6).alias("prevalence"), "positive_events", "vehicles", "holdout_rows")


@query(f"""WITH {RAW}, x AS (SELECT event_type, lag(event_type) OVER (PARTITION BY vehicle_id ORDER BY ts_ms, event_type, seq) AS p FROM raw WHERE event_type IN ('error', 'purchase', 'signup'))
  SELECT count(*) FILTER (WHERE event_type = 'signup' AND (p IS NULL OR p = 'signup')) AS orphan_services, count(*) FILTER (WHERE event_type <> 'signup' AND p <> 'signup') AS repeated_triggers FROM x""")
def lifecycle_lag_check(spark, sf_dir):
    return checks.lifecycle(_maintenance(spark, sf_dir), "vehicle_id", ["ts_ms", "event_type", "event_id"], TRIGGERS, SERVICE)


@query(f"WITH {RAW} SELECT vehicle_id, event_type, seq, ts_ms, value FROM raw QUALIFY row_number() OVER (PARTITION BY vehicle_id, event_type ORDER BY ts_ms DESC, seq DESC) = 1")
def latest_per_key(spark, sf_dir):
    df = raw(spark, sf_dir).select("vehicle_id", "event_type", "seq", "ts_ms", "value")
    return windows.latest_per_key(df, ["vehicle_id", "event_type"], ["ts_ms", "seq"])


@query(f"""WITH {TEL}, x AS (SELECT vehicle_id, ts_ms // 3600000 + 1 AS h, arg_max(soc, ts_ms) AS soc FROM tel WHERE soc IS NOT NULL GROUP BY 1, 2), r AS (SELECT vehicle_id, unnest(generate_series(min(h), max(h))) AS h FROM x GROUP BY 1)
  SELECT r.vehicle_id, r.h * 3600000 AS t_ms, last_value(x.soc IGNORE NULLS) OVER (PARTITION BY r.vehicle_id ORDER BY r.h) AS soc_pct FROM r LEFT JOIN x ON x.vehicle_id = r.vehicle_id AND x.h = r.h""")
def latest_before_t(spark, sf_dir):
    return windows.latest_before(telemetry(spark, sf_dir), "vehicle_id", "ts_ms", "soc_pct")


@query(f"""WITH {RAW} SELECT 'both' AS side, count(*) AS n FROM (SELECT vehicle_id FROM raw WHERE k < 30 INTERSECT SELECT vehicle_id FROM raw WHERE k >= 70)
  UNION ALL SELECT 'left_only', count(*) FROM (SELECT vehicle_id FROM raw WHERE k < 3 EXCEPT SELECT vehicle_id FROM raw WHERE k >= 98)""")
def key_intersection(spark, sf_dir):
    r = raw(spark, sf_dir)
    ids = lambda c: r.where(c).select("vehicle_id").distinct()
    n = lambda df, s: df.agg(F.lit(s).alias("side"), F.count(F.lit(1)).alias("n"))
    return n(ids("k < 30").intersect(ids("k >= 70")), "both").unionByName(n(ids("k < 3").subtract(ids("k >= 98")), "left_only"))


@query(f"""WITH {RAW}, a AS (SELECT DISTINCT vehicle_id, ts_ms // 3600000 AS h FROM raw WHERE k < 60), b AS (SELECT DISTINCT vehicle_id, ts_ms // 3600000 AS h FROM raw WHERE k >= 40)
  SELECT (SELECT count(*) FROM a JOIN b USING (vehicle_id, h)) AS common, (SELECT count(*) FROM b ANTI JOIN a USING (vehicle_id, h)) AS missing, (SELECT count(*) FROM a ANTI JOIN b USING (vehicle_id, h)) AS extra""")
def missing_extra_keys(spark, sf_dir):
    hours = raw(spark, sf_dir).withColumn("h", F.floor(F.col("ts_ms") / HOUR_MS))
    return checks.compare_keys(hours.where("k < 60"), hours.where("k >= 40"), ["vehicle_id", "h"])


@query(f"WITH {RAW} SELECT part, count(*) AS n, round(sum(value), 3) AS total FROM (SELECT 'even' AS part, value FROM raw WHERE seq % 2 = 0 UNION ALL SELECT 'odd', value FROM raw WHERE seq % 2 = 1) GROUP BY 1")
def union_parts(spark, sf_dir):
    r = raw(spark, sf_dir)
    both = r.where("seq % 2 = 0").withColumn("part", F.lit("even")).unionByName(r.where("seq % 2 = 1").withColumn("part", F.lit("odd")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query(f"""WITH {RAW}, e AS (SELECT user_id, list_sort(list(DISTINCT event_type) FILTER (WHERE value > 100)) AS types FROM events GROUP BY 1) SELECT user_id AS vehicle_id, coalesce(array_to_string(types, ','), '') AS types FROM e""")
def array_agg_filter_ordered(spark, sf_dir):
    r = raw(spark, sf_dir)
    kinds = F.array_sort(F.collect_set(F.when(F.col("value") > 100, F.col("event_type"))))
    return r.groupBy("vehicle_id").agg(F.array_join(kinds, ",").alias("types"))


@query(f"""WITH {RAW} SELECT third, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE value > 100) AS large FROM (SELECT *, least(2, CAST(floor((ts_ms - {START_MS}) / ({END_MS - START_MS} / 3.0)) AS INTEGER)) AS third
  FROM raw WHERE ts_ms >= {START_MS} AND ts_ms < {END_MS}) GROUP BY 1""")
def thirds_stationarity(spark, sf_dir):
    from tarmac.operators.metrics import thirds

    return thirds(raw(spark, sf_dir), "ts_ms", START_MS, END_MS, {"errors": F.col("event_type") == "error", "large": F.col("value") > 100})


@query("""SELECT user_id AS principal, date_trunc('minute', ts) AS minute, count(*) AS requests FROM events GROUP BY 1, 2 HAVING count(*) > 1""")
def rate_limit_windows(spark, sf_dir):
    from tarmac.operators.serving import rate_limited

    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("principal"), "ts")
    return rate_limited(e, 1).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("SELECT min(value) AS least, max(value) AS largest, count(value) AS filled, count(*) AS rows FROM events")
def range_profile(spark, sf_dir):
    return checks.range_profile(table(spark, sf_dir, "events"), "value")


@query(f"WITH {TEL} SELECT event_type, count(*) AS rows, count(soc) AS filled FROM tel GROUP BY 1")
def ground_truth_counts(spark, sf_dir):
    return checks.counts_by_type(telemetry(spark, sf_dir), "event_type", "soc_pct")


@query(f"WITH {GRID} SELECT t AS feature_ts_ms, count(*) AS snapshots, count(DISTINCT vehicle_id) AS vehicles, count(*) FILTER (WHERE f <= t - 86400000) AS complete FROM g GROUP BY 1")
def snapshot_completeness(spark, sf_dir):
    s = _snapshot_rows(spark, sf_dir).withColumn("window_complete", F.col("first_event_ts_ms") <= F.col("feature_ts_ms") - DAY_MS)
    return checks.completeness(s)


@query(f"WITH {RAW} SELECT vehicle_id, seq, ts_ms, value FROM raw WHERE vehicle_id = 1 ORDER BY ts_ms DESC, seq DESC LIMIT 20")
def recent_n(spark, sf_dir):
    from tarmac.operators.serving import recent_telemetry

    return recent_telemetry(raw(spark, sf_dir), 1, 20).select("vehicle_id", "seq", "ts_ms", "value")


@query(f"WITH {RAW} SELECT count(*) FILTER (WHERE vehicle_id IN (SELECT vehicle_id FROM raw WHERE value > 300)) AS inside, count(*) FILTER (WHERE vehicle_id NOT IN (SELECT vehicle_id FROM raw WHERE value > 300)) AS outside FROM raw")
def semi_anti_members(spark, sf_dir):
    r = raw(spark, sf_dir)
    big = r.where("value > 300").select("vehicle_id").distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(r.join(big, "vehicle_id", "left_semi"), "inside").join(F.broadcast(n(r.join(big, "vehicle_id", "left_anti"), "outside")))


@query(f"WITH {RAW} SELECT vehicle_id, seq, ts_ms, value FROM raw WHERE ts_ms >= {START_MS + 5 * DAY_MS} AND ts_ms < {START_MS + 7 * DAY_MS} AND vehicle_id IN (SELECT user_id FROM events WHERE value > 200)")
def telemetry_time_range_scan(spark, sf_dir):
    from tarmac.sources.readers import telemetry_scan

    r = raw(spark, sf_dir).select("vehicle_id", "seq", "ts_ms", "value")
    return telemetry_scan(r, START_MS + 5 * DAY_MS, START_MS + 7 * DAY_MS, r.where("value > 200").select("vehicle_id").distinct())
