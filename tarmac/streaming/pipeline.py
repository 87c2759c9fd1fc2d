"""The live pipeline as one query: envelopes in, telemetry, dead letters, alerts and audit rows out, committed together."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.alerts import ALERTS, audit, candidate_alerts, raise_alerts, rule_hits
from tarmac.operators.ingest import first_delivery, flatten, normalise, resolve, violations
from tarmac.operators.upserts import first_write_wins
from tarmac.sources.commits import Commits, bucket_of, query_name

#: Buckets of the alerts and risk tables, by component.
BUCKETS = 64
COMPONENT = ["vehicle_component_id"]


@dataclass
class Live:
    """Tables of a live run under one root, kept in a log of commits (``Commits(spark, root).read("alerts")``).

    A batch's telemetry, dead letters, alerts and audit rows count all together or not at all, and a batch that is repeated
    finds itself committed. ``vehicles``, ``components``, ``registry`` and ``owners`` (tenants of components, for audit rows)
    give dimensions; what they give is kept for ``refresh_seconds`` and then read anew, vehicles after ``unknown_seconds``
    when a batch has an unknown VIN. Rules see the normalised stream before telemetry is deduplicated: repeated deliveries
    raise nothing twice, because one ACTIVE alert a component and type is kept. Telemetry is in buckets by day, alerts by
    component: a batch reads those that it touches.
    """

    root: str
    vehicles: callable
    components: callable
    registry: callable
    owners: callable = None
    refresh_seconds: float = 60.0
    unknown_seconds: float = 5.0
    clock: callable = time.monotonic
    held: dict = field(default_factory=dict)

    def dimension(self, name: str, most: float | None = None) -> DataFrame:
        now = self.clock()
        if name not in self.held or now - self.held[name][0] >= (self.refresh_seconds if most is None else most):
            if name in self.held:
                self.held[name][1].unpersist()
            self.held[name] = now, getattr(self, name)().persist()
        return self.held[name][1]

    def resolved(self, envelopes: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``resolve``; once more with vehicles read anew if a VIN is unknown and they are older than ``unknown_seconds``."""
        vehicles = self.dimension("vehicles")
        known, dead = resolve(envelopes, vehicles)
        if self.clock() - self.held["vehicles"][0] >= self.unknown_seconds and not dead.where("reason = 'UNKNOWN_VIN'").isEmpty():
            known, dead = resolve(envelopes, self.dimension("vehicles", self.unknown_seconds))
        return known, dead

    def batch(self, envelopes: DataFrame, batch_id: int) -> None:
        """One micro-batch; a repeated one changes nothing, wherever its first run stopped."""
        spark = envelopes.sparkSession
        change = Commits(spark, self.root).begin(query_name(spark, "live"), batch_id)
        if change is None:
            return
        held = [envelopes := envelopes.persist()]
        try:
            known, dead = self.resolved(envelopes)
            change.append("dead_letters", dead)
            checked = violations(normalise(known)).where(F.size("violations") == 0).drop("violations")
            records = flatten(checked).withColumn("event_date", F.timestamp_millis("ts_ms").cast("date")).persist()
            held.append(records)
            day, once = F.col("event_date"), first_delivery(records)
            stored = change.read("telemetry", once.schema, change.touched(records, day))
            change.put("telemetry", first_write_wins(stored, once, ["vehicle_id", "seq", "ts_ms"]), day)
            hits, _ = rule_hits(records, self.dimension("registry"))
            candidates = candidate_alerts(hits, self.dimension("components")).persist()
            held.append(candidates)
            bucket = bucket_of(COMPONENT, BUCKETS)
            touched = change.touched(candidates, bucket)
            if touched:
                alerts = change.read("alerts", ALERTS, touched)
                new = raise_alerts(candidates, alerts).withColumns({"risk_probability": F.lit(None).cast("double"), "model_version": F.lit(None).cast("string")})
                new = change.put("alerts", new.select(*alerts.columns), bucket)
                if self.owners:
                    change.append("audit", audit(new, "ALERT_CREATED", "rule-engine", self.dimension("owners")), most=5000)
            change.commit()
        finally:
            for df in held:
                df.unpersist()

    def start(self, envelopes: DataFrame, checkpoint: str, **trigger):
        return envelopes.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
