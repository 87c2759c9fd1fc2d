"""Queries of ingestion and of what follows scores: events become manufacturers' envelopes, customers play vehicles with VINs.

Of three events, one comes in the flat layout, one in the nested one, and one of a manufacturer without an adapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.functions import features
from tarmac.functions.scalars import iso_millis, nan_to_null, percent_text, sorted_codes, vin_check_digit
from tarmac.operators import alerts as A
from tarmac.operators import ingest, labels, ml, serving, windows
from tarmac.plans.registry import query
from tarmac.plans.serving import BASE, SUM_SQL, components, vehicles
from tarmac.plans.telemetry import CODES, RAW, raw
from tarmac.sources.readers import service_history, table, vehicle_context

# The fleet knows nine of ten customers; even ones have VINs with a right check digit.
VINS_SQL = f"""a0 AS (SELECT c_custkey, 'WTX' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || 'Z' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS vin FROM customer), s0 AS (SELECT *, ({SUM_SQL}) % 11 AS r FROM a0),
 vins AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN substr(vin, 1, 8) || CASE WHEN r = 10 THEN 'X' ELSE CAST(r AS VARCHAR) END || substr(vin, 10) ELSE vin END AS vin, c_custkey % 2 = 0 AS valid FROM s0)"""
FLEET_SQL = f"""{RAW}, {VINS_SQL},
 e AS (SELECT raw.*, vin, valid, CASE WHEN seq % 11 = 0 THEN 'MISSING_VIN' WHEN NOT valid OR seq % 13 = 0 THEN 'INVALID_VIN' WHEN vehicle_id % 10 = 0 THEN 'UNKNOWN_VIN' END AS reason FROM raw JOIN vins ON c_custkey = vehicle_id)"""


def vins(spark, sf_dir) -> DataFrame:
    """(vehicle_id, vin): one of its own for each customer."""
    key = F.col("c_custkey").cast("string")
    made = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("WTX"), F.lpad(key, 5, "0"), F.lit("Z"), F.lpad(key, 8, "0")).alias("vin"))
    right = F.concat(F.substring("vin", 1, 8), vin_check_digit(F.col("vin")), F.substring("vin", 10, 8))
    return made.select(F.col("c_custkey").alias("vehicle_id"), F.when(F.col("c_custkey") % 2 == 0, right).otherwise(F.col("vin")).alias("vin"))


def envelopes(spark, sf_dir) -> DataFrame:
    """(received_at, oem_id, schema_version, payload) of every event of a customer; received_at is the event's number."""
    k, v, seq = F.col("k"), F.col("value"), F.col("seq")
    e = raw(spark, sf_dir).join(vins(spark, sf_dir), "vehicle_id")
    vin = F.when(seq % 11 == 0, F.lit(None)).when(seq % 13 == 0, F.concat(F.substring("vin", 1, 16), F.lit("I"))).otherwise(F.col("vin"))
    codes = F.when(k < 20, F.array(F.element_at(F.array(*[F.lit(c) for c in CODES]), k % 7 + 1))).otherwise(F.array().cast("array<string>"))
    speed, fault = F.when(k == 7, -1.0).otherwise(v), F.col("event_type") == "error"
    flat = F.to_json(F.struct(
        vin.alias("vin"), iso_millis(F.col("ts_ms")).alias("ts"), (k * 2.0 - 90).alias("lat"), (k - 50.0).alias("lng"), speed.alias("vehicleSpeed"), (v + k).alias("mileageKm"), k.cast("double").alias("batteryLevel"),
        F.lit(400.0).alias("batteryVoltage"), (k - 60.0).alias("batteryCurrent"), (v / 10).alias("batteryTemp"), codes.alias("faultCodes"), ((k - 50) / F.lit(10.0)).alias("longitudinalAccel"),
        F.when(fault, "DTC").when(k > 90, "HARSH_BRAKE").otherwise("TELEMETRY").alias("event"), seq.alias("sequence"),
    ))
    nested = F.to_json(F.struct(
        F.struct(vin.alias("vin")).alias("vehicle"), F.col("ts_ms").alias("timestamp_epoch_ms"), seq.alias("sequence_no"), F.struct(F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude")).alias("position"),
        F.struct(v.alias("speed_mph"), (v + k).alias("odometer_miles"), ((k - 50) / F.lit(10.0)).alias("accel_g")).alias("motion"),
        F.struct((k * 1.5).alias("soc_percent"), F.lit(400.0).alias("pack_voltage"), (k - 60.0).alias("pack_current"), v.alias("pack_temp_f")).alias("energy"), F.struct(k.cast("double").alias("power_kw")).alias("motor"),
        F.struct(codes.alias("dtcs")).alias("diagnostics"), F.when(fault, F.array(F.lit("DTC_RAISED"))).when(k > 90, F.array(F.lit("HARSH_BRAKING"))).otherwise(F.array().cast("array<string>")).alias("events"),
    ))
    third = seq % 3
    return e.select(
        seq.cast("string").alias("received_at"), F.when(third == 0, "OEM_A").when(third == 1, "OEM_B").otherwise("OEM_C").alias("oem_id"), F.when(third == 0, "1.0").when(third == 1, "2.0").otherwise("9").alias("schema_version"),
        ingest.once(F.when(third == 1, nested).otherwise(flat)).alias("payload"),
    )


def fleet(spark, sf_dir) -> DataFrame:
    known = vehicles(spark, sf_dir).select("vehicle_id", "vehicle_type").where("vehicle_id % 10 <> 0")
    return known.join(vins(spark, sf_dir), "vehicle_id").withColumn("vehicle_id", F.col("vehicle_id").cast("string"))


def canonical(spark, sf_dir) -> DataFrame:
    return ingest.violations(ingest.normalise(ingest.resolve(envelopes(spark, sf_dir), fleet(spark, sf_dir))[0]))


@query(f"WITH {FLEET_SQL} SELECT seq, reason FROM e WHERE reason IS NOT NULL")
def ingest_dead_letters(spark, sf_dir):
    """Why each envelope without a known vehicle is dead."""
    _, dead = ingest.resolve(envelopes(spark, sf_dir), fleet(spark, sf_dir))
    return dead.select(F.get_json_object("envelope", "$.received_at").cast("long").alias("seq"), "reason")


@query(f"""WITH {FLEET_SQL}, r AS (SELECT seq, seq % 3 AS third, k, 'speed_kmh:minimum' AS rule FROM e WHERE reason IS NULL AND k = 7 AND seq % 3 = 0
  UNION ALL SELECT seq, seq % 3, k, 'lat:range' FROM e WHERE reason IS NULL AND seq % 3 = 0 AND k * 2 - 90 > 90 UNION ALL SELECT seq, seq % 3, k, 'soc_pct:range' FROM e WHERE reason IS NULL AND seq % 3 = 1 AND k * 1.5 > 100)
  SELECT rule, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM r GROUP BY 1""")
def ingest_violations(spark, sf_dir):
    """The rules of the canonical event that normalised events break."""
    broken = canonical(spark, sf_dir).select("seq", F.explode("violations").alias("rule"))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))


def _two(x: str, digits: int = 2) -> str:
    return f"CAST(printf('%.{digits}f', {x}) AS DOUBLE)"


@query(f"""WITH {FLEET_SQL} SELECT CAST(vehicle_id AS VARCHAR) AS vehicle_id, seq, ts_ms, CASE WHEN event_type = 'error' THEN 'DTC' ELSE 'TELEMETRY' END AS event_type, CASE seq % 3 WHEN 0 THEN 'OEM_A' ELSE 'OEM_B' END AS oem_id,
  CASE seq % 3 WHEN 0 THEN value ELSE {_two("value * 1.609344 :: DOUBLE")} END AS speed_kmh, CASE seq % 3 WHEN 0 THEN value + k ELSE {_two("(value + k) * 1.609344 :: DOUBLE", 3)} END AS odometer_km,
  CASE seq % 3 WHEN 0 THEN (k - 50) / 10.0 :: DOUBLE ELSE {_two("((k - 50) / 10.0 :: DOUBLE) * 9.80665 :: DOUBLE")} END AS acceleration_ms2, CASE seq % 3 WHEN 0 THEN CAST(k AS DOUBLE) ELSE k * 1.5 :: DOUBLE END AS soc_pct,
  CASE seq % 3 WHEN 0 THEN value / 10 ELSE {_two("(value - 32) * 5 / 9")} END AS temperature_c, CASE seq % 3 WHEN 0 THEN {_two("400.0 :: DOUBLE * (k - 60) / 1000")} ELSE CAST(k AS DOUBLE) END AS power_kw,
  event_type <> 'error' AND k > 90 AS harsh_brake, CASE WHEN k < 20 THEN CASE k % 7 {" ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES))} END ELSE '' END AS codes
  FROM e WHERE reason IS NULL AND seq % 3 < 2 AND NOT (seq % 3 = 0 AND (k = 7 OR k * 2 - 90 > 90)) AND NOT (seq % 3 = 1 AND k * 1.5 > 100)""")
def ingest_telemetry(spark, sf_dir):
    """Telemetry records of all valid events of known manufacturers, in metric units."""
    kept = ingest.flatten(canonical(spark, sf_dir).where(F.size("violations") == 0))
    return kept.select("vehicle_id", "seq", "ts_ms", "event_type", "oem_id", "speed_kmh", "odometer_km", "acceleration_ms2", "soc_pct", "temperature_c", "power_kw", "harsh_brake", F.array_join(sorted_codes(F.col("dtc_codes")), ",").alias("codes"))


@query("SELECT event_id AS seq, CASE WHEN event_id % 4 < 3 THEN epoch_us(ts) // 1000 END AS ts_ms FROM events")
def timestamp_layouts(spark, sf_dir):
    """Epoch milliseconds of four layouts: UTC, an offset, digits, and no time at all."""
    from tarmac.functions.scalars import epoch_ms, parse_ts_ms

    e = table(spark, sf_dir, "events")
    ms = epoch_ms(F.col("ts"))
    text = F.when(F.col("event_id") % 4 == 0, iso_millis(ms)).when(F.col("event_id") % 4 == 1, F.regexp_replace(iso_millis(ms + 2 * 3_600_000), "Z$", "+02:00")).when(F.col("event_id") % 4 == 2, ms.cast("string")).otherwise("no time")
    return e.select(F.col("event_id").alias("seq"), parse_ts_ms(text).alias("ts_ms"))


@query(f"""WITH {RAW} SELECT seq, CASE WHEN k % 4 <> 0 THEN value END AS value, 'BRAKE: ' || CAST(k AS VARCHAR) || '% probability of maintenance or failure within 7 days' AS message FROM raw""")
def json_and_messages(spark, sf_dir):
    """Values through JSON and back, not-a-number as null; alert texts."""
    value = nan_to_null(F.when(F.col("k") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    text = raw(spark, sf_dir).select("seq", "k", F.to_json(F.struct(value.alias("v"))).alias("t"))
    return text.select("seq", F.from_json("t", "v double")["v"].alias("value"), percent_text(F.lit("BRAKE"), F.col("k") / 100).alias("message"))


# Components in use: one a customer and kind, by the latest order; a third of the vehicles have no battery.
PARTS_SQL = f"""{BASE}, sn AS (SELECT vehicle_id, component, created_at, vehicle_component_id AS oid, p7d FROM vc), kinds AS (SELECT vehicle_id, component, tenant_id, vehicle_id * 10 + CASE component WHEN 'BRAKE' THEN 0 WHEN 'POWERTRAIN' THEN 1 ELSE 2 END AS cid,
  CASE WHEN component = 'BATTERY' AND vehicle_id % 3 = 0 THEN 'NOT_APPLICABLE' ELSE 'ACTIVE' END AS state FROM v, (SELECT unnest(['BRAKE', 'POWERTRAIN', 'BATTERY']) AS component)),
 now AS (SELECT cid, component, tenant_id, epoch_ms(created_at) * 1000000 + oid AS version, p7d FROM sn JOIN kinds USING (vehicle_id, component) WHERE state = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY cid ORDER BY created_at DESC, oid DESC) = 1)"""


def parts_in_use(spark, sf_dir) -> DataFrame:
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(i).alias("i")) for i, c in enumerate(("BRAKE", "POWERTRAIN", "BATTERY"))])).alias("x")
    each = vehicles(spark, sf_dir).select("vehicle_id", "tenant_id", kinds).select("vehicle_id", "tenant_id", "x.component", (F.col("vehicle_id") * 10 + F.col("x.i")).alias("vehicle_component_id"))
    return each.withColumn("status", F.when((F.col("component") == "BATTERY") & (F.col("vehicle_id") % 3 == 0), "NOT_APPLICABLE").otherwise("ACTIVE"))


class PriceModel:
    """Scores orders by their price, to hold the way of scores through the tables against SQL."""

    kind, threshold = "price", 0.4

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("p7d", F.col("share"))


def latest_scores(spark, sf_dir) -> DataFrame:
    version = F.unix_millis(F.col("created_at").cast("timestamp")) * 1_000_000 + F.col("vehicle_component_id")
    snaps = components(spark, sf_dir).select("vehicle_id", "component", version.alias("feature_ts_ms"), F.col("p7d").alias("share"))
    return ml.score_latest(PriceModel(), snaps, parts_in_use(spark, sf_dir))


@query(f"WITH {PARTS_SQL} SELECT cid AS vehicle_component_id, component, 'price' AS model_kind, version AS feature_ts_ms, p7d, 0.4 :: DOUBLE AS threshold FROM now")
def score_latest_active(spark, sf_dir):
    """Risk rows of the latest snapshot of every component in use: orders stand for snapshots."""
    return latest_scores(spark, sf_dir)


# Every other component has an active alert of its score from before.
CHANGES_SQL = f"""WITH {PARTS_SQL}, x AS (SELECT *, cid % 2 = 0 AS standing FROM now), moved AS (SELECT cid, tenant_id, p7d, CASE WHEN p7d >= 0.4 THEN CASE WHEN p7d >= 0.8 THEN 'CRITICAL' ELSE 'HIGH' END ELSE 'OLD' END AS severity,
  CASE WHEN p7d >= 0.4 AND NOT standing THEN 'ALERT_CREATED' WHEN p7d < 0.4 AND standing THEN 'ALERT_AUTO_RESOLVED' END AS action FROM x)"""


@query(f"{CHANGES_SQL} SELECT cid AS vehicle_component_id, tenant_id, action, 'ml-scorer' AS actor_id, severity FROM moved WHERE action IS NOT NULL")
def score_alert_audit(spark, sf_dir):
    """Audit rows of the alerts that new scores raise and resolve, with their tenants."""
    scored, parts = latest_scores(spark, sf_dir), parts_in_use(spark, sf_dir)
    kinds = dict(x.split() for x in A.ALERTS.split(", "))
    known = {"vehicle_component_id": F.col("vehicle_component_id"), "alert_type": F.lit(A.ML_ALERT), "severity": F.lit("OLD"), "status": F.lit("ACTIVE")}
    standing = parts.where("vehicle_component_id % 2 = 0").select(*[known.get(c, F.lit(None)).cast(kinds[c] if c != "vehicle_component_id" else "long").alias(c) for c in kinds])
    raised, resolved = A.score_alerts(scored, standing)
    log = A.audit(raised, "ALERT_CREATED", "ml-scorer", parts).unionByName(A.audit(resolved, "ALERT_AUTO_RESOLVED", "ml-scorer", parts))
    return log.select("vehicle_component_id", "tenant_id", "action", "actor_id", F.get_json_object("metadata", "$.severity").alias("severity"))


@query(f"WITH {BASE} SELECT vehicle_component_id AS alert_id, CASE WHEN status = 'ACTIVE' AND tenant_id = 2 AND vehicle_component_id % 7 = 0 THEN 'ACKNOWLEDGED' ELSE status END AS status FROM vc JOIN v USING (vehicle_id)")
def acknowledge_in_tenant(spark, sf_dir):
    """Alerts after one tenant has acknowledged every seventh of all: only its own active ones change."""
    raised = components(spark, sf_dir).join(vehicles(spark, sf_dir).select("vehicle_id", "tenant_id"), "vehicle_id").withColumn("alert_id", F.col("vehicle_component_id"))
    visible = raised.where("tenant_id = 2").select("vehicle_component_id")
    return A.acknowledge(raised, F.when(F.col("alert_id") % 7 == 0, F.col("alert_id")), visible).select("alert_id", "status")


@query("""SELECT o_orderkey AS trip_id, CASE WHEN o_custkey <> 7 THEN o_custkey END AS driver_id, CASE WHEN c_custkey <> 7 THEN c_name END AS name, CASE WHEN c_custkey <> 7 THEN c_acctbal END AS phone FROM orders JOIN customer ON o_custkey = c_custkey""")
def erase_one_driver(spark, sf_dir):
    """Trips and personal columns after the erasure of one driver; nothing else changes."""
    drivers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("driver_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("phone"))
    trips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("driver_id"), F.col("o_custkey").alias("was"))
    drivers, trips = serving.erase_driver(drivers, trips, 7, ["name", "phone"])
    return trips.join(drivers.select(F.col("driver_id").alias("was"), "name", "phone"), "was").select("trip_id", "driver_id", "name", "phone")


@query(f"""WITH {RAW}, b AS (SELECT vehicle_id, min(ts_ms) AS f, max(ts_ms) AS l FROM raw GROUP BY 1), g AS (SELECT vehicle_id, unnest(generate_series(f // 3600000 + 1, l // 3600000)) * 3600000 AS t FROM b),
  s AS (SELECT g.vehicle_id, g.t, max(ts_ms) AS service_ts FROM g LEFT JOIN raw r ON r.vehicle_id = g.vehicle_id AND r.ts_ms <= g.t AND r.event_type = 'signup' GROUP BY 1, 2), {BASE}
  SELECT s.vehicle_id, t AS feature_ts_ms, (t - service_ts) / 86400000.0 :: DOUBLE AS days_since_service, CASE WHEN service_ts IS NULL THEN 0.0 ELSE 1.0 END :: DOUBLE AS has_service_history,
  CAST(vehicle_type = 'ICE' AS DOUBLE) AS vt_ice, CAST(vehicle_type = 'EV' AS DOUBLE) AS vt_ev, CAST(vehicle_type = 'HYBRID' AS DOUBLE) AS vt_hybrid FROM s JOIN v USING (vehicle_id)""")
def static_features(spark, sf_dir):
    """Features of a vehicle's context at every hour: days since its last service, and its type."""
    from tarmac.functions.stats import all_stats
    from tarmac.operators.asof import around
    from tarmac.plans.telemetry import telemetry

    snaps = windows.snapshots(telemetry(spark, sf_dir), {"24h": ["odo_max"]}, {"odo_max": all_stats()["odo_max"]})
    events = raw(spark, sf_dir).where("event_type = 'signup'").select("vehicle_id", F.col("seq").alias("event_id"), "event_type", "ts_ms")
    found = around(snaps, events, ["vehicle_id"], "feature_ts_ms", "ts_ms", F.lit(False), [F.col("event_id")])
    found = found.join(vehicles(spark, sf_dir).select("vehicle_id", "vehicle_type"), "vehicle_id")
    found = found.withColumns({"last_service_ts_ms": F.col("last_ts_ms"), "last_service_odometer_km": F.lit(0.0), "manufacture_date_ms": F.lit(0).cast("long")})
    names = ["days_since_service", "has_service_history", "vt_ice", "vt_ev", "vt_hybrid"]
    return found.select("vehicle_id", "feature_ts_ms", *[c.alias(n) for n, c in features.static().items() if n in names])


@query(f"""WITH {PARTS_SQL} SELECT o_orderkey * 10 + l_linenumber AS event_id, o_custkey AS vehicle_id, component, epoch_ms(l_shipdate) AS ts_ms, l_extendedprice AS odometer_km
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN kinds ON vehicle_id = o_custkey AND cid = o_custkey * 10 + l_linenumber % 3 WHERE l_returnflag = 'R'""")
def service_dimension(spark, sf_dir):
    """Completed services by vehicle and component: returned order lines stand for services."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    events = li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("o_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), (F.col("o_custkey") * 10 + F.col("l_linenumber") % 3).alias("vehicle_component_id"),
        F.when(F.col("l_returnflag") == "R", "SERVICE_COMPLETED").otherwise("OTHER").alias("event_type"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"), F.col("l_extendedprice").alias("odometer_km"),
    )
    found = service_history(events, parts_in_use(spark, sf_dir))
    named = events.where("event_type = 'SERVICE_COMPLETED'").select("event_id", "ts_ms", "odometer_km", F.floor(F.col("vehicle_component_id") / 10).alias("vehicle_id"), F.get(F.array(*[F.lit(c) for c in ("BRAKE", "POWERTRAIN", "BATTERY")]), (F.col("vehicle_component_id") % 10).cast("int")).alias("component"))
    return named.join(found, ["vehicle_id", "component", "ts_ms", "odometer_km"], "left_semi").select("event_id", "vehicle_id", "component", "ts_ms", "odometer_km")


@query(f"WITH {PARTS_SQL} SELECT vehicle_id, array_to_string(list_sort(list(component) FILTER (WHERE state = 'ACTIVE')), ',') AS components FROM kinds GROUP BY 1")
def vehicle_context_active(spark, sf_dir):
    """Vehicles with their components in use."""
    found = vehicle_context(vehicles(spark, sf_dir).select("vehicle_id"), parts_in_use(spark, sf_dir))
    return found.select("vehicle_id", F.array_join("components", ",").alias("components"))


@query(f"WITH {RAW}, t AS (SELECT quantile_disc(value, 0.5) FILTER (WHERE k % 4 > 0) AS middle FROM raw) SELECT seq, CASE WHEN k % 4 > 0 THEN value ELSE middle END AS filled, CAST(k % 4 = 0 AS DOUBLE) AS missing FROM raw, t")
def median_imputation(spark, sf_dir):
    """Missing values take the median of the others, and say so."""
    from pyspark.ml.feature import Imputer

    rows = ml.with_indicators(raw(spark, sf_dir).select("seq", F.when(F.col("k") % 4 > 0, F.col("value")).alias("f_value")), ["f_value"])
    fitted = Imputer(strategy="median", inputCols=["f_value"], outputCols=["filled"], relativeError=0.0).fit(rows)
    return fitted.transform(rows).select("seq", "filled", F.col("f_value_missing").alias("missing"))


@query("""WITH c AS (SELECT 'P' || CAST(l_partkey AS VARCHAR) AS component, count(*) FILTER (WHERE l_returnflag = 'R') AS positives, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS positive_events FROM lineitem GROUP BY 1) SELECT component, positives, positive_events FROM c WHERE positives < 50 OR positive_events < 5""")
def calibration_guardrails(spark, sf_dir):
    """The components whose calibration rests on too few positives or events: parts stand for components, suppliers for events."""
    li = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("meta_component"), F.lit("calibration").alias("meta_split"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label_7d"),
        F.col("l_suppkey").alias("label_next_event_id"), F.col("l_suppkey").alias("meta_vehicle_id"), F.lit("dev").alias("meta_vehicle_group"),
    )
    return labels.calibration_guardrails(labels.dataset_counts(li)).select(F.col("meta_component").alias("component"), "positives", "positive_events")
