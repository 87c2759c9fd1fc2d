"""Queries of the serving layer, alerts and ingestion: customers play vehicles, nations fleets, regions tenants, orders
components with their risk and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.scalars import coarse, encode_cursor, is_valid_vin, money_label, py_round, uuid5, vin_of_payload
from tarmac.functions.scalars import vin_check_digit as check_digit
from tarmac.operators import alerts as A
from tarmac.operators import serving as S
from tarmac.operators import upserts
from tarmac.operators.ingest import G_MS2, MILE_KM, fahrenheit
from tarmac.plans.registry import query
from tarmac.plans.telemetry import CODES, RAW, raw, telemetry
from tarmac.sources.readers import dtc_registry, table

BASE = """v AS (SELECT c_custkey AS vehicle_id, c_name AS vin, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'ICE' WHEN 'MACHINERY' THEN 'EV' WHEN 'BUILDING' THEN 'ICE' ELSE 'HYBRID' END AS vehicle_type, c_mktsegment AS oem_id, c_nationkey AS fleet_id, n_regionkey AS tenant_id, c_acctbal
  FROM customer JOIN nation ON n_nationkey = c_nationkey),
 vc AS (SELECT o_orderkey AS vehicle_component_id, o_custkey AS vehicle_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'BRAKE' WHEN '2' THEN 'POWERTRAIN' WHEN '3' THEN 'POWERTRAIN' ELSE 'BATTERY' END AS component,
  least(1.0, o_totalprice / 600000.0) :: DOUBLE AS p7d, 0.4 :: DOUBLE AS threshold, o_orderdate AS created_at, CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'RESOLVED' ELSE 'ACKNOWLEDGED' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN 'ML' ELSE 'RULE' END AS source FROM orders),
 cost AS (SELECT * FROM (VALUES """ + ", ".join(f"('{a}', '{b}', {c} :: DOUBLE, {d} :: DOUBLE, {e} :: DOUBLE)" for a, b, c, d, e in S.COSTS) + """) t(component, vehicle_type, direct, hours, rate)),
 pv AS (SELECT vc.vehicle_component_id, vc.vehicle_id, vc.component, v.vin, v.vehicle_type, v.fleet_id, v.tenant_id, vc.p7d, vc.threshold, vc.p7d * (direct + hours * rate) AS expected_loss,
  CASE WHEN direct IS NULL THEN 'COST_DATA_REQUIRED' ELSE 'OK' END AS cost_status FROM vc JOIN v USING (vehicle_id) LEFT JOIN cost c ON c.component = vc.component AND c.vehicle_type = v.vehicle_type)"""


def vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    kind = F.when(seg.isin("AUTOMOBILE", "BUILDING"), "ICE").when(seg == "MACHINERY", "EV").otherwise("HYBRID")
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = c.join(n, c.c_nationkey == n.n_nationkey)
    return joined.select(F.col("c_custkey").alias("vehicle_id"), F.col("c_name").alias("vin"), kind.alias("vehicle_type"), seg.alias("oem_id"), F.col("c_nationkey").alias("fleet_id"), F.col("n_regionkey").alias("tenant_id"), "c_acctbal")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    status = F.when(F.col("o_orderstatus") == "O", "ACTIVE").when(F.col("o_orderstatus") == "F", "RESOLVED").otherwise("ACKNOWLEDGED")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("vehicle_component_id"), F.col("o_custkey").alias("vehicle_id"),
        F.when(first == "1", "BRAKE").when(first.isin("2", "3"), "POWERTRAIN").otherwise("BATTERY").alias("component"),
        F.least(F.lit(1.0), F.col("o_totalprice") / 600000.0).alias("p7d"), F.lit(0.4).alias("threshold"), F.col("o_orderdate").alias("created_at"), status.alias("status"),
        F.when(F.col("o_orderkey") % 2 == 0, "ML").otherwise("RULE").alias("source"),
    )


def priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, v = components(spark, sf_dir), vehicles(spark, sf_dir)
    fleets = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("fleet_id"), F.col("n_regionkey").alias("tenant_id"))
    view = S.priority_view(parts.select("vehicle_component_id", "p7d", "threshold"), parts, v, fleets, S.costs(spark))
    return view.select("vehicle_component_id", "vehicle_id", "component", "vin", "vehicle_type", "fleet_id", "tenant_id", "p7d", "threshold", "expected_loss", "cost_status")


@query(f"WITH {BASE} SELECT * FROM pv")
def priority_view(spark, sf_dir):
    return priority(spark, sf_dir)


TOP = "SELECT vehicle_component_id, vehicle_id, component, round(coalesce(expected_loss, -1), 2) AS sort_loss FROM pv"


@query(f"WITH {BASE} {TOP} WHERE tenant_id = 1 ORDER BY 4 DESC, 1 DESC LIMIT 51")
def priority_topn(spark, sf_dir):
    return S.priority_page(priority(spark, sf_dir), tenant=1, limit=50).select("vehicle_component_id", "vehicle_id", "component", "sort_loss")


@query(f"WITH {BASE} {TOP} WHERE component = 'BATTERY' AND (round(coalesce(expected_loss, -1), 2) < 5000.0 OR (round(coalesce(expected_loss, -1), 2) = 5000.0 AND vehicle_component_id < 100)) ORDER BY 4 DESC, 1 DESC LIMIT 26")
def priority_keyset_page2(spark, sf_dir):
    cursor = encode_cursor({"sort_loss": 5000.0, "vehicle_component_id": 100})
    return S.priority_page(priority(spark, sf_dir), component="BATTERY", limit=25, cursor=cursor).select("vehicle_component_id", "vehicle_id", "component", "sort_loss")


@query(f"WITH {BASE} SELECT vehicle_component_id AS alert_id, created_at, component, source, vehicle_id, vin FROM vc JOIN v USING (vehicle_id) WHERE status = 'ACTIVE' AND source = 'ML' AND tenant_id = 2 ORDER BY created_at DESC, 1 DESC LIMIT 31")
def alerts_page(spark, sf_dir):
    parts = components(spark, sf_dir)
    raised = parts.select(F.col("vehicle_component_id").alias("alert_id"), "vehicle_component_id", "created_at", "status", "source")
    owners = parts.select("vehicle_component_id", "component", "vehicle_id").join(vehicles(spark, sf_dir).select("vehicle_id", "vin", "tenant_id"), "vehicle_id")
    return S.alerts_page(raised, owners, 2, "ACTIVE", "ML", 30).select("alert_id", "created_at", "component", "source", "vehicle_id", "vin")


@query(f"WITH {BASE}, p AS (SELECT vehicle_id, vin, vehicle_type FROM v WHERE tenant_id = 0 AND vehicle_id > 10 ORDER BY vehicle_id LIMIT 41) SELECT p.*, (SELECT round(max(p7d), 4) FROM vc WHERE vc.vehicle_id = p.vehicle_id) AS max_p7d FROM p")
def vehicles_with_max_risk(spark, sf_dir):
    page = S.vehicles_page(vehicles(spark, sf_dir), components(spark, sf_dir).select("vehicle_id", "p7d"), 0, limit=40, cursor=encode_cursor({"vehicle_id": 10}))
    return page.select("vehicle_id", "vin", "vehicle_type", "max_p7d")


@query("SELECT c_custkey AS vehicle_id, c_name AS vin FROM customer WHERE starts_with(c_name, 'Customer#00000001')")
def prefix_search(spark, sf_dir):
    return table(spark, sf_dir, "customer").where(F.col("c_name").startswith("Customer#00000001")).select(F.col("c_custkey").alias("vehicle_id"), F.col("c_name").alias("vin"))


@query(f"""WITH {BASE} SELECT (SELECT count(*) FROM v WHERE tenant_id = 3) AS vehicles, (SELECT count(*) FROM pv WHERE tenant_id = 3) AS components_scored, (SELECT count(*) FROM pv WHERE tenant_id = 3 AND p7d >= threshold) AS components_above_threshold,
  (SELECT round(coalesce(sum(expected_loss), 0), 0) FROM pv WHERE tenant_id = 3) AS total_expected_loss_7d, (SELECT count(*) FROM vc JOIN v USING (vehicle_id) WHERE tenant_id = 3 AND status = 'ACTIVE' AND source = 'ML') AS active_ml_alerts,
  (SELECT count(*) FROM vc JOIN v USING (vehicle_id) WHERE tenant_id = 3 AND status = 'ACTIVE' AND source = 'RULE') AS active_rule_alerts, (SELECT max(created_at) FROM vc) AS last_scored_at""")
def summary_kpis(spark, sf_dir):
    v = vehicles(spark, sf_dir)
    raised = components(spark, sf_dir).select("vehicle_id", "status", "source").join(v.select("vehicle_id", "tenant_id"), "vehicle_id")
    return S.summary(priority(spark, sf_dir), v, raised, 3, components(spark, sf_dir).select(F.col("created_at").alias("scored_at")))


@query(f"""WITH {BASE} SELECT vc.vehicle_component_id, vc.component, vc.status, r.p7d, r.threshold, round(pv.expected_loss, 2) AS expected_loss, pv.cost_status
  FROM vc LEFT JOIN (SELECT vehicle_component_id, round(p7d, 4) AS p7d, threshold FROM vc WHERE vehicle_component_id % 3 > 0) r USING (vehicle_component_id)
  LEFT JOIN (SELECT * FROM pv WHERE vehicle_component_id % 3 > 0) pv USING (vehicle_component_id) WHERE vc.vehicle_id = 7 ORDER BY 2, 1""")
def vehicle_components(spark, sf_dir):
    """The components of one vehicle; a third of them have not been scored."""
    parts, view = components(spark, sf_dir), priority(spark, sf_dir)
    scored = F.col("vehicle_component_id") % 3 > 0
    return S.vehicle_components(parts, parts.where(scored).select("vehicle_component_id", "p7d", "threshold"), view.where(scored), 7)


@query("""SELECT l_orderkey * 10 + l_linenumber AS event_id, l_returnflag AS event_type, l_shipdate AS occurred_at, round(l_extendedprice, 1) AS odometer_km, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'BRAKE' WHEN '2' THEN 'POWERTRAIN' WHEN '3' THEN 'POWERTRAIN' ELSE 'BATTERY' END AS component
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey = 7 ORDER BY 3 DESC, 1 DESC LIMIT 50""")
def vehicle_events(spark, sf_dir):
    """The latest 50 maintenance events of one vehicle: order lines stand for events."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_orderkey").alias("vehicle_component_id"), F.col("l_returnflag").alias("event_type"), F.col("l_shipdate").alias("occurred_at"), F.col("l_extendedprice").alias("odometer_km"))
    return S.vehicle_events(li, components(spark, sf_dir), 7)


@query("""SELECT o_orderkey, o_custkey AS vehicle_id, o_orderdate AS ts FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)""")
def reset_deletes(spark, sf_dir):
    """What a reset of one fleet's vehicles leaves in a table."""
    gone = vehicles(spark, sf_dir).where("fleet_id = 3").select("vehicle_id")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("vehicle_id"), F.col("o_orderdate").alias("ts"))
    return o.join(gone, "vehicle_id", "left_anti").select("o_orderkey", "vehicle_id", "ts")


@query(f"""WITH {BASE} SELECT vehicle_component_id, CASE WHEN expected_loss IS NULL THEN 'cost data required' ELSE printf('$%s', regexp_replace(regexp_replace(CAST(CAST(round_even(expected_loss, 0) AS BIGINT) AS VARCHAR), '(\\d)(\\d{{3}})$', '\\1,\\2'), '(\\d)(\\d{{3}}),', '\\1,\\2,')) END AS loss FROM pv""")
def money_labels(spark, sf_dir):
    """Expected losses for display."""
    return priority(spark, sf_dir).select("vehicle_component_id", money_label(F.col("expected_loss")).alias("loss"))


@query(f"""WITH {BASE} SELECT component, count(*) AS scored, count(*) FILTER (WHERE p7d >= threshold) AS above_threshold, round(coalesce(sum(expected_loss), 0), 0) AS expected_loss, round(avg(p7d), 4) AS mean_p7d, count(*) FILTER (WHERE p7d < 0.05) AS b_0_5,
  count(*) FILTER (WHERE p7d >= 0.05 AND p7d < 0.1) AS b_5_10, count(*) FILTER (WHERE p7d >= 0.1 AND p7d < 0.25) AS b_10_25, count(*) FILTER (WHERE p7d >= 0.25 AND p7d < 0.5) AS b_25_50, count(*) FILTER (WHERE p7d >= 0.5) AS b_50_100 FROM pv GROUP BY 1""")
def risk_breakdown_hist(spark, sf_dir):
    return S.risk_breakdown(priority(spark, sf_dir))


@query(f"WITH {BASE} SELECT vehicle_type, oem_id, count(*) AS vehicles FROM v GROUP BY 1, 2")
def fleet_composition(spark, sf_dir):
    return S.fleet_composition(vehicles(spark, sf_dir))


@query(f"WITH {BASE} SELECT tenant_id, count(DISTINCT vehicle_id) AS vehicles, count(*) AS components FROM v JOIN vc USING (vehicle_id) GROUP BY 1")
def tenant_scoped_counts(spark, sf_dir):
    v = vehicles(spark, sf_dir).select("vehicle_id", "tenant_id")
    return v.join(components(spark, sf_dir).select("vehicle_id"), "vehicle_id").groupBy("tenant_id").agg(F.count_distinct("vehicle_id").alias("vehicles"), F.count(F.lit(1)).alias("components"))


CODE_SQL = "CASE k % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODES)) + " END"
REGISTRY_SQL = "reg AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{p}', '{s}')" for c, p, s, _ in A.DTC_REGISTRY) + ") t(code, component, severity))"
HITS_SQL = f"WITH {RAW}, {REGISTRY_SQL}, c AS (SELECT vehicle_id, seq, ts_ms, {CODE_SQL} AS code FROM raw WHERE k < 20)"


@query(f"{HITS_SQL} SELECT code, component, severity, count(*) AS hits, count(DISTINCT vehicle_id) AS vehicles FROM c JOIN reg USING (code) GROUP BY 1, 2, 3")
def dtc_explode_rules(spark, sf_dir):
    hits, _ = A.rule_hits(telemetry(spark, sf_dir), dtc_registry(spark))
    return hits.groupBy("code", "component", "severity").agg(F.count(F.lit(1)).alias("hits"), F.count_distinct("vehicle_id").alias("vehicles"))


@query(f"{HITS_SQL} SELECT code, count(*) AS unknown FROM c ANTI JOIN reg USING (code) GROUP BY 1")
def dtc_unknown_codes(spark, sf_dir):
    return A.rule_hits(telemetry(spark, sf_dir), dtc_registry(spark))[1]


ALERTS_SQL = f"""{HITS_SQL}, x AS (SELECT vehicle_id * 10 + CASE component WHEN 'BRAKE' THEN 0 WHEN 'POWERTRAIN' THEN 1 ELSE 2 END AS vehicle_component_id, 'DTC_' || code AS alert_type, severity, ts_ms, seq FROM c JOIN reg USING (code) WHERE component <> 'BATTERY' OR vehicle_id % 3 <> 0)
  SELECT vehicle_component_id, alert_type, severity, ts_ms, seq FROM x WHERE NOT (vehicle_component_id % 5 = 0 AND alert_type = 'DTC_BRAKE_WEAR_HIGH') QUALIFY row_number() OVER (PARTITION BY vehicle_component_id, alert_type ORDER BY ts_ms, seq) = 1"""


@query(ALERTS_SQL)
def active_alert_dedup(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    kinds = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.lit(i).alias("i")) for i, c in enumerate(("BRAKE", "POWERTRAIN", "BATTERY"))])).alias("x")
    parts = t.select("vehicle_id").distinct().select("vehicle_id", kinds).select("vehicle_id", "x.component", (F.col("vehicle_id") * 10 + F.col("x.i")).alias("vehicle_component_id"))
    parts = parts.withColumn("status", F.when((F.col("component") == "BATTERY") & (F.col("vehicle_id") % 3 == 0), "NOT_APPLICABLE").otherwise("ACTIVE"))
    standing = parts.where("vehicle_component_id % 5 = 0").select("vehicle_component_id", F.lit("DTC_BRAKE_WEAR_HIGH").alias("alert_type"), F.lit("ACTIVE").alias("status"))
    hits, _ = A.rule_hits(t, dtc_registry(spark))
    return A.raise_alerts(A.candidate_alerts(hits, parts), standing).select("vehicle_component_id", "alert_type", "severity", "ts_ms", "seq")


@query(f"WITH {BASE} SELECT vehicle_component_id, CASE WHEN p7d >= greatest(0.6, 2 * threshold) THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM vc WHERE p7d >= threshold")
def alert_severity(spark, sf_dir):
    s = components(spark, sf_dir).where("p7d >= threshold")
    return s.select("vehicle_component_id", A.severity_of(F.col("p7d"), F.col("threshold")).alias("severity"))


UPSERT = f"WITH {RAW}, old AS (SELECT vehicle_id, max(ts_ms) AS version, arg_max(value, (ts_ms, seq)) AS p FROM raw WHERE seq % 2 = 0 GROUP BY 1), new AS (SELECT vehicle_id, max(ts_ms) AS version, arg_max(value, (ts_ms, seq)) AS p FROM raw WHERE seq % 3 = 0 GROUP BY 1)"


@query(f"{UPSERT} SELECT vehicle_id, version, p FROM (SELECT *, 0 AS n FROM old UNION ALL SELECT *, 1 FROM new) QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY version DESC, n DESC) = 1")
def upsert_latest_risk(spark, sf_dir):
    r = raw(spark, sf_dir)
    of = lambda step: r.where(F.col("seq") % step == 0).groupBy("vehicle_id").agg(F.max("ts_ms").alias("version"), F.max_by("value", F.struct("ts_ms", "seq")).alias("p"))
    return upserts.newest_wins(of(2), of(3), ["vehicle_id"], "version")


@query(f"WITH {RAW}, a AS (SELECT vehicle_id, ts_ms // 3600000 AS h FROM raw WHERE seq % 2 = 0) SELECT vehicle_id, ts_ms // 3600000 AS h, arg_min(value, (ts_ms, seq)) AS value FROM raw WHERE (vehicle_id, ts_ms // 3600000) NOT IN (SELECT (vehicle_id, h) FROM a) GROUP BY 1, 2")
def insert_first_write_wins(spark, sf_dir):
    r = raw(spark, sf_dir).withColumn("h", F.floor(F.col("ts_ms") / 3_600_000))
    new = upserts.first_write_wins(r.where("seq % 2 = 0").select("vehicle_id", "h"), r.select("vehicle_id", "h", "ts_ms", "seq", "value"), ["vehicle_id", "h"], ["ts_ms", "seq"])
    return new.select("vehicle_id", "h", "value")


@query("SELECT o_orderkey AS audit_id, o_orderdate AS occurred_at, o_custkey FROM orders WHERE (o_orderdate < TIMESTAMP '1996-06-01' OR (o_orderdate = TIMESTAMP '1996-06-01' AND o_orderkey < 5000)) ORDER BY 2 DESC, 1 DESC LIMIT 101")
def audit_keyset(spark, sf_dir):
    import datetime

    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("audit_id"), F.col("o_orderdate").alias("occurred_at"), "o_custkey")
    keys = [S.Key("occurred_at"), S.Key("audit_id")]
    return S.page(log.where(S.after(keys, [datetime.datetime(1996, 6, 1), 5000])), keys, 100)


@query("SELECT s_suppkey, round(s_acctbal / 100.0, 2) AS latitude, round(s_nationkey * 3.14159 :: DOUBLE, 2) AS longitude FROM supplier")
def coarsen_coordinates(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", coarse(F.col("s_acctbal") / 100.0).alias("latitude"), coarse(F.col("s_nationkey") * 3.14159).alias("longitude"))


# Synthetic VINs from keys: 17 characters of the allowed alphabet, every other one with its check digit put right.
ALPHABET = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
VALUES = "".join(str(x) for x in (1, 2, 3, 4, 5, 6, 7, 8, 1, 2, 3, 4, 5, 7, 9, 2, 3, 4, 5, 6, 7, 8, 9, 0, 1, 2, 3, 4, 5, 6, 7, 8, 9))
WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_SQL = " || ".join(f"substr('{ALPHABET}', CAST((c_custkey * {7 * i + 3} + {i * i}) % 33 AS INTEGER) + 1, 1)" for i in range(17))
SUM_SQL = " + ".join(f"CAST(substr('{VALUES}', strpos('{ALPHABET}', substr(vin, {i + 1}, 1)), 1) AS INTEGER) * {w}" for i, w in enumerate(WEIGHTS))


@query(f"""WITH a AS (SELECT c_custkey, {VIN_SQL} AS vin FROM customer), s AS (SELECT *, ({SUM_SQL}) % 11 AS r FROM a), f AS (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN substr(vin, 1, 8) || CASE WHEN r = 10 THEN 'X' ELSE CAST(r AS VARCHAR) END || substr(vin, 10) ELSE vin END AS vin FROM s),
  g AS (SELECT *, ({SUM_SQL}) % 11 AS r FROM f) SELECT c_custkey, vin, substr(vin, 9, 1) = CASE WHEN r = 10 THEN 'X' ELSE CAST(r AS VARCHAR) END AS valid FROM g""")
def vin_check_digit(spark, sf_dir):
    key = F.col("c_custkey")
    letters = [F.substr(F.lit(ALPHABET), ((key * (7 * i + 3) + i * i) % 33 + 1).cast("int"), F.lit(1)) for i in range(17)]
    made = table(spark, sf_dir, "customer").select("c_custkey", F.concat(*letters).alias("vin"))
    right = F.concat(F.substring("vin", 1, 8), check_digit(F.col("vin")), F.substring("vin", 10, 8))
    return made.withColumn("vin", F.when(key % 2 == 0, right).otherwise(F.col("vin"))).select("c_custkey", "vin", is_valid_vin(F.col("vin")).alias("valid"))


@query("SELECT o_orderkey, " + ", ".join(f"CAST(printf('%.2f', {x}) AS DOUBLE) AS {n}" for n, x in (
    ("km", "o_totalprice / 1000 * 1.609344 :: DOUBLE"), ("celsius", "(o_totalprice / 1000 - 32) * 5 / 9"), ("ms2", "o_totalprice / 1000000 * 9.80665 :: DOUBLE"),
)) + " FROM orders")
def unit_conversions(spark, sf_dir):
    x = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").select("o_orderkey", py_round(x * MILE_KM, 2).alias("km"), fahrenheit(x).alias("celsius"), py_round(F.col("o_totalprice") / 1000000 * G_MS2, 2).alias("ms2"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE 'VIN' || CAST(user_id AS VARCHAR) END AS vin, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events")
def json_adapter_projection(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    vin = F.concat(F.lit("VIN"), F.col("user_id").cast("string"))
    flat, nested = F.to_json(F.struct(vin.alias("vin"))), F.to_json(F.struct(F.struct(vin.alias("vin")).alias("vehicle")))
    payload = F.when(F.col("event_id") % 3 == 0, flat).when(F.col("event_id") % 3 == 1, nested).otherwise(F.lit("{}"))
    return e.select("event_id", vin_of_payload(payload).alias("vin"), F.get_json_object("props", "$.k").cast("int").alias("k"))


UUID_SQL = "sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('vehicle:' || vin))"


@query(f"""WITH {BASE}, h AS (SELECT vehicle_id, {UUID_SQL} AS h FROM v) SELECT vehicle_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM h""")
def deterministic_ids(spark, sf_dir):
    """Name-based ids of vehicles (tests hold them against Python's)."""
    return vehicles(spark, sf_dir).select("vehicle_id", uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("vehicle:"), "vin")).alias("uuid"))


@query("SELECT count(*) FILTER (WHERE NOT (l_discount BETWEEN 0 AND 0.05)) AS violations, 'discount' AS rule FROM lineitem UNION ALL SELECT count(*) FILTER (WHERE NOT (l_quantity > 1)), 'quantity' FROM lineitem")
def check_constraints(spark, sf_dir):
    from tarmac.operators.checks import broken_rules

    li = table(spark, sf_dir, "lineitem")
    return broken_rules(li, {"discount": F.col("l_discount").between(0, 0.05), "quantity": F.col("l_quantity") > 1})


@query("SELECT 'orphan_orders' AS rule, (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)) AS n UNION ALL SELECT 'repeated_lines', (SELECT count(*) FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1))")
def key_constraints(spark, sf_dir):
    from tarmac.operators.checks import orphans, repeated

    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "o_custkey")
    n = lambda df, rule: df.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"))
    return n(orphans(o, c, "o_custkey"), "orphan_orders").unionByName(n(repeated(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]), "repeated_lines"))
