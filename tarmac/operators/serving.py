"""The priority view and the tenant-scoped, keyset-paginated reads over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.scalars import coarse, decode_cursor, encode_cursor

MAX_LIMIT, ASSISTANT_LIMIT, TELEMETRY_LIMIT = 200, 20, 500
# Cost profiles (component, vehicle type, direct failure cost, downtime hours, cost per hour).
COSTS = [
    ("BRAKE", "ICE", 1800.0, 16.0, 95.0), ("BRAKE", "EV", 2000.0, 16.0, 95.0), ("BRAKE", "HYBRID", 1900.0, 16.0, 95.0),
    ("POWERTRAIN", "ICE", 6500.0, 48.0, 95.0), ("POWERTRAIN", "EV", 8000.0, 40.0, 95.0), ("POWERTRAIN", "HYBRID", 7200.0, 44.0, 95.0),
    ("BATTERY", "EV", 12000.0, 72.0, 95.0), ("BATTERY", "HYBRID", 7000.0, 48.0, 95.0),
]
# The bounds of the risk histogram.
RISK_BOUNDS = [0.05, 0.10, 0.25, 0.50]


def costs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COSTS, "component string, vehicle_type string, direct_failure_cost double, expected_downtime_hours double, downtime_cost_per_hour double")


def priority_view(risk: DataFrame, components: DataFrame, vehicles: DataFrame, fleets: DataFrame, cost: DataFrame) -> DataFrame:
    """Expected loss of every scored component; null, and COST_DATA_REQUIRED, where its cost profile is missing."""
    joined = risk.join(components.select("vehicle_component_id", "vehicle_id", "component"), "vehicle_component_id")
    joined = joined.join(vehicles.select("vehicle_id", "vin", "vehicle_type", "fleet_id"), "vehicle_id").join(fleets.select("fleet_id", "tenant_id"), "fleet_id")
    joined = joined.join(cost, ["component", "vehicle_type"], "left")
    loss = F.col("p7d") * (F.col("direct_failure_cost") + F.col("expected_downtime_hours") * F.col("downtime_cost_per_hour"))
    status = F.when(F.col("direct_failure_cost").isNull(), "COST_DATA_REQUIRED").otherwise("OK")
    return joined.withColumn("expected_loss", loss).withColumn("cost_status", status).drop("direct_failure_cost", "expected_downtime_hours", "downtime_cost_per_hour")


def clamp(limit: int, most: int = MAX_LIMIT) -> int:
    """A limit within 1 and ``most``: MAX_LIMIT of pages, ASSISTANT_LIMIT of the assistant, TELEMETRY_LIMIT of telemetry."""
    return max(1, min(int(limit), most))


def sort_loss(loss: Column) -> Column:
    """What the priority list is sorted by: the rounded loss, with unknown ones last."""
    return F.round(F.coalesce(loss, F.lit(-1.0)), 2)


def scoped(df: DataFrame, tenant: str | int | None) -> DataFrame:
    """The rows of a tenant; all rows for an administrator (no tenant)."""
    return df if tenant is None else df.where(F.col("tenant_id") == tenant)


@dataclass(frozen=True)
class Key:
    name: str
    descending: bool = True


def after(keys: list[Key], last: list) -> Column:
    """The keyset condition: rows that follow ``last``. The first key's bound stands alone as well, for the scan to use."""
    first, value = F.col(keys[0].name), F.lit(last[0])
    beyond = (lambda k, v: F.col(k.name) < F.lit(v)) if keys[0].descending else (lambda k, v: F.col(k.name) > F.lit(v))
    if len(keys) == 1:
        return beyond(keys[0], last[0])
    bound = first <= value if keys[0].descending else first >= value
    return bound & (beyond(keys[0], last[0]) | after(keys[1:], last[1:]))


def page(df: DataFrame, keys: list[Key], limit: int, cursor: str | None = None) -> DataFrame:
    """The next ``limit`` + 1 rows by keyset; the extra one tells whether there are more (see ``cut``)."""
    limit = clamp(limit)
    if cursor:
        found = decode_cursor(cursor, [k.name for k in keys])
        df = df.where(after(keys, [found[k.name] for k in keys]))
    order = [F.col(k.name).desc_nulls_last() if k.descending else F.col(k.name).asc_nulls_last() for k in keys]
    return df.orderBy(*order).limit(limit + 1)


def cut(df: DataFrame, keys: list[Key], limit: int) -> dict:
    """A served page: at most ``limit`` items (at most 200 rows come to the driver), and a cursor if more follow."""
    limit = clamp(limit)
    rows = [r.asDict() for r in df.collect()]
    items = rows[:limit]
    more = len(rows) > limit
    return {"items": items, "next_cursor": encode_cursor({k.name: items[-1][k.name] for k in keys}) if more else None}


PRIORITY_KEYS = [Key("sort_loss"), Key("vehicle_component_id")]


def priority_page(view: DataFrame, tenant=None, component: str | None = None, limit: int = 50, cursor: str | None = None) -> DataFrame:
    df = scoped(view, tenant).withColumn("sort_loss", sort_loss(F.col("expected_loss")))
    if component:
        df = df.where(F.col("component") == component)
    return page(df, PRIORITY_KEYS, limit, cursor)


def alerts_page(alerts: DataFrame, owners: DataFrame, tenant=None, status: str = "ACTIVE", source: str | None = None, limit: int = 50, cursor: str | None = None) -> DataFrame:
    """``owners``: vehicle_component_id with component, vehicle and tenant."""
    df = alerts.where(F.col("status") == status)
    df = df.where(F.col("source") == source) if source else df
    return page(scoped(df.join(owners, "vehicle_component_id"), tenant), [Key("created_at"), Key("alert_id")], limit, cursor)


def vehicles_page(vehicles: DataFrame, risk_by_vehicle: DataFrame, tenant=None, prefix: str | None = None, limit: int = 50, cursor: str | None = None) -> DataFrame:
    """Vehicles with their largest risk. ``risk_by_vehicle``: vehicle_id, p7d."""
    df = scoped(vehicles, tenant)
    df = df.where(F.col("vin").startswith(prefix)) if prefix else df
    top = risk_by_vehicle.groupBy("vehicle_id").agg(F.round(F.max("p7d"), 4).alias("max_p7d"))
    return page(df, [Key("vehicle_id", False)], limit, cursor).join(top, "vehicle_id", "left")


def audit_page(audit: DataFrame, limit: int = 50, cursor: str | None = None) -> DataFrame:
    return page(audit, [Key("occurred_at"), Key("audit_id")], limit, cursor)


def recent_telemetry(telemetry: DataFrame, vehicle_id, limit: int = 100, full_access: bool = True) -> DataFrame:
    df = telemetry.where(F.col("vehicle_id") == vehicle_id).orderBy(F.desc("ts_ms"), F.desc("seq")).limit(clamp(limit, TELEMETRY_LIMIT))
    return df if full_access else df.withColumns({c: coarse(F.col(c)) for c in ("latitude", "longitude") if c in df.columns})


def vehicle_components(components: DataFrame, risk: DataFrame, view: DataFrame, vehicle_id) -> DataFrame:
    """A vehicle's components in order, with their risk and expected loss where they have been scored.

    ``components``: vehicle_id, vehicle_component_id, component, status. ``risk``: p7d, threshold and what else the scorer left.
    """
    mine = components.where(F.col("vehicle_id") == vehicle_id).select("vehicle_component_id", "component", "status")
    scored = risk.select("vehicle_component_id", F.round("p7d", 4).alias("p7d"), F.round("threshold", 4).alias("threshold"), *[c for c in ("feature_ts_ms", "model_version") if c in risk.columns])
    losses = view.select("vehicle_component_id", F.round("expected_loss", 2).alias("expected_loss"), "cost_status")
    key = "vehicle_component_id"
    return mine.join(scored, key, "left").join(losses, key, "left").orderBy("component", key)


def vehicle_events(events: DataFrame, components: DataFrame, vehicle_id, limit: int = 50) -> DataFrame:
    """A vehicle's latest maintenance events with their component, newest first; ties by event id."""
    mine = components.where(F.col("vehicle_id") == vehicle_id).select("vehicle_component_id", "component")
    found = events.join(mine, "vehicle_component_id").orderBy(F.desc("occurred_at"), F.desc("event_id")).limit(limit)
    return found.select("event_id", "event_type", "occurred_at", F.round("odometer_km", 1).alias("odometer_km"), "component")


def summary(view: DataFrame, vehicles: DataFrame, alerts: DataFrame, tenant=None, risk: DataFrame | None = None) -> DataFrame:
    """One row of key figures. The views carry tenant_id; ``risk`` (scored_at) adds last_scored_at, which is of all tenants."""
    v = scoped(vehicles, tenant).agg(F.count(F.lit(1)).alias("vehicles"))
    p = scoped(view, tenant).agg(
        F.count(F.lit(1)).alias("components_scored"), F.count_if(F.col("p7d") >= F.col("threshold")).alias("components_above_threshold"),
        F.round(F.coalesce(F.sum("expected_loss"), F.lit(0.0)), 0).alias("total_expected_loss_7d"),
    )
    active = scoped(alerts, tenant).where("status = 'ACTIVE'")
    a = active.agg(F.count_if(F.col("source") == "ML").alias("active_ml_alerts"), F.count_if(F.col("source") == "RULE").alias("active_rule_alerts"))
    out = v.join(F.broadcast(p)).join(F.broadcast(a))  # one row each
    return out if risk is None else out.join(F.broadcast(risk.agg(F.max("scored_at").alias("last_scored_at"))))


def risk_breakdown(view: DataFrame, tenant=None) -> DataFrame:
    p, bounds = F.col("p7d"), [None, *RISK_BOUNDS, None]
    inside = lambda a, b: (F.lit(True) if a is None else p >= a) & (F.lit(True) if b is None else p < b)
    bins = [F.count_if(inside(a, b)).alias(f"b_{int(100 * (a or 0))}_{int(100 * (b or 1))}") for a, b in zip(bounds, bounds[1:], strict=False)]
    return scoped(view, tenant).groupBy("component").agg(
        F.count(F.lit(1)).alias("scored"), F.count_if(p >= F.col("threshold")).alias("above_threshold"),
        F.round(F.coalesce(F.sum("expected_loss"), F.lit(0.0)), 0).alias("expected_loss"), F.round(F.avg("p7d"), 4).alias("mean_p7d"), *bins,
    )


def fleet_composition(vehicles: DataFrame, tenant=None) -> DataFrame:
    return scoped(vehicles, tenant).groupBy("vehicle_type", "oem_id").agg(F.count(F.lit(1)).alias("vehicles"))


def erase_driver(drivers: DataFrame, trips: DataFrame, driver_id, personal: list[str]) -> tuple[DataFrame, DataFrame]:
    """Drivers with one driver's personal columns emptied, and trips without the link to that driver."""
    mine = F.col("driver_id") == driver_id
    blank = {c: F.when(~mine, F.col(c)) for c in personal}
    return drivers.withColumns(blank), trips.withColumn("driver_id", F.when(~F.coalesce(mine, F.lit(False)), F.col("driver_id")))


def rate_limited(requests: DataFrame, limit: int = 120, by: str = "principal", ts: str = "ts") -> DataFrame:
    """Requests of each principal and clock minute over the limit."""
    return requests.groupBy(by, F.window(ts, "1 minute")["start"].alias("minute")).agg(F.count(F.lit(1)).alias("requests")).where(F.col("requests") > limit)
