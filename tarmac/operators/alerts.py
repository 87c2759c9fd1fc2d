"""Alerts from rules and scores, their severity, deduplication against active ones, and the audit rows they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions.scalars import percent_text
from tarmac.functions.stats import DTC_REGISTRY as DTC_REGISTRY

ML_ALERT = "ML_RISK_7D"
#: The alerts table, of rules and scores.
ALERTS = "vehicle_component_id string, alert_type string, severity string, source string, message string, ts_ms long, seq long, risk_probability double, model_version string, status string"


def rule_hits(events: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, counts of unknown codes). ``registry``: code, component, severity, description."""
    codes = events.select("vehicle_id", "ts_ms", "seq", F.explode("dtc_codes").alias("code"))
    found = codes.join(registry, "code", "left")
    return found.where("component is not null"), found.where("component is null").groupBy("code").agg(F.count(F.lit(1)).alias("unknown"))


def candidate_alerts(hits: DataFrame, components: DataFrame) -> DataFrame:
    """Hits with the vehicle's component where it is ACTIVE."""
    active = components.where("status = 'ACTIVE'").select("vehicle_id", "component", "vehicle_component_id")
    alert_type = F.concat(F.lit("DTC_"), F.col("code")).alias("alert_type")
    return hits.join(active, ["vehicle_id", "component"]).select("vehicle_component_id", alert_type, "severity", F.lit("RULE").alias("source"), F.col("description").alias("message"), "ts_ms", "seq")


def raise_alerts(candidates: DataFrame, alerts: DataFrame) -> DataFrame:
    """The new ACTIVE alerts: the earliest candidate of each (component, type) that has no ACTIVE alert yet."""
    keys = ["vehicle_component_id", "alert_type"]
    rest = [c for c in candidates.columns if c not in keys]
    first = candidates.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ts_ms", "seq")).alias("first"))
    new = first.select(*keys, *[F.col(f"first.{c}").alias(c) for c in rest], F.lit("ACTIVE").alias("status"))
    return new.join(alerts.where("status = 'ACTIVE'").select(*keys), keys, "left_anti")


def severity_of(p: Column, threshold: Column) -> Column:
    return F.when(p >= F.greatest(F.lit(0.6), 2 * threshold), "CRITICAL").otherwise("HIGH")


def score_alerts(scores: DataFrame, alerts: DataFrame, model_version: str = "v1") -> tuple[DataFrame, DataFrame]:
    """(new alerts of scores at or over their threshold, active score alerts to resolve because the score fell below).

    ``scores``: vehicle_component_id, component, p7d, threshold, feature_ts_ms; only accepted (not stale) scores belong here.
    """
    over = scores.where("p7d >= threshold").select(
        "vehicle_component_id", F.lit(ML_ALERT).alias("alert_type"), severity_of(F.col("p7d"), F.col("threshold")).alias("severity"), F.lit("ML").alias("source"),
        percent_text(F.col("component"), F.col("p7d")).alias("message"), F.col("feature_ts_ms").alias("ts_ms"), F.lit(0).cast("long").alias("seq"),
        F.col("p7d").alias("risk_probability"), F.lit(model_version).alias("model_version"),
    )
    below = scores.where("p7d < threshold").select("vehicle_component_id")
    resolved = alerts.where(f"status = 'ACTIVE' and alert_type = '{ML_ALERT}'").join(below, "vehicle_component_id", "left_semi").withColumn("status", F.lit("RESOLVED"))
    return raise_alerts(over, alerts), resolved


def acknowledge(alerts: DataFrame, alert_id: Column, visible: DataFrame) -> DataFrame:
    """The alerts table with one ACTIVE alert acknowledged, if its component is among the ``visible`` ones of the tenant."""
    seen = visible.select("vehicle_component_id").distinct().withColumn("__seen", F.lit(True))
    hit = (F.col("alert_id") == alert_id) & (F.col("status") == "ACTIVE") & F.coalesce("__seen", F.lit(False))
    return alerts.join(seen, "vehicle_component_id", "left").withColumn("status", F.when(hit, "ACKNOWLEDGED").otherwise(F.col("status"))).select(*alerts.columns)


def audit(alerts: DataFrame, action: str, actor: str, owners: DataFrame) -> DataFrame:
    """Audit rows of alerts. ``owners``: vehicle_component_id, tenant_id."""
    meta = F.to_json(F.struct(*[c for c in ("alert_type", "severity", "risk_probability", "model_version") if c in alerts.columns]))
    return alerts.join(owners.select("vehicle_component_id", "tenant_id"), "vehicle_component_id", "left").select(
        "tenant_id", F.lit("SERVICE").alias("actor_type"), F.lit(actor).alias("actor_id"), F.lit(action).alias("action"), F.lit("alert").alias("entity_type"), "vehicle_component_id", meta.alias("metadata")
    )
