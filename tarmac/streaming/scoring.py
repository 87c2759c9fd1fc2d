"""Event-driven scoring: every batch of snapshots is scored, and risk, alerts, audit rows and the priority view follow."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.alerts import ALERTS, audit, score_alerts
from tarmac.operators.ml import RiskModel, score_latest
from tarmac.operators.upserts import accepted, newest_wins, replace_by_key
from tarmac.operators.windows import latest_per_key
from tarmac.sources.commits import Change, Commits, bucket_of, query_name
from tarmac.streaming.pipeline import BUCKETS, COMPONENT

RISK = "vehicle_component_id string, component string, model_kind string, feature_ts_ms long, p7d double, threshold double, scored_at timestamp"
NOTE = ["vehicle_id", "component", "feature_ts_ms"]
#: Notifications are kept until so many newer ones are there.
NOTIFICATIONS = 200_000


class Scorer:
    """Tables of risk, alerts, audit rows, notifications and the view under one root, in a log of commits; give ``on_snapshots``
    to ``Snapshots``.

    ``features`` turns snapshots into feature rows (see ``per_component``), ``components`` has the components with their ids
    and status, ``owners`` their tenants. ``view`` makes the view's rows from risk rows, each from its own (dimensions may be
    joined); it is brought up to date at most every ``refresh_seconds``. Risk, alerts and the view are in buckets by
    component, and a batch reads and writes only those that it touches. A stale score (older than the stored one) changes
    nothing; nor does a batch that is repeated. The table ``latest`` has the newest feature row of each component.
    """

    def __init__(self, root: str, model: RiskModel, features: Callable[[DataFrame], DataFrame], components: Callable[[], DataFrame], owners: Callable[[], DataFrame],
                 view: Callable[[DataFrame], DataFrame] | None = None, refresh_seconds: float = 10.0, clock: Callable[[], float] = time.monotonic):
        self.root, self.model, self.features, self.components, self.owners, self.view = root.rstrip("/"), model, features, components, owners, view
        self.refresh, self.clock, self.refreshed = refresh_seconds, clock, None

    def on_snapshots(self, snapshots: DataFrame, batch_id: int) -> None:
        spark = snapshots.sparkSession
        log = Commits(spark, self.root)
        change = log.begin(query_name(spark, "scorer"), batch_id)
        if change is not None:
            rows = self.features(snapshots).persist()
            try:
                self._score(change, rows)
                change.commit()
            finally:
                rows.unpersist()
        now = self.clock()
        if self.view and (self.refreshed is None or now - self.refreshed >= self.refresh):
            self.refreshed = now
            self.refresh_view(log)

    def _score(self, change: Change, rows: DataFrame) -> None:
        self._notify(change, rows)
        newest = latest_per_key(rows, ["vehicle_id", "component"], ["feature_ts_ms"])
        change.upsert("latest", newest, bucket_of(["vehicle_id", "component"], BUCKETS), lambda old, new: newest_wins(old, new, ["vehicle_id", "component"], "feature_ts_ms"))
        scores = score_latest(self.model, rows, self.components()).withColumn("scored_at", F.current_timestamp()).persist()
        bucket = bucket_of(COMPONENT, BUCKETS)
        touched = change.touched(scores, bucket)
        if touched:
            risk, alerts = change.read("risk", RISK, touched), change.read("alerts", ALERTS, touched)
            fresh = accepted(risk, scores, COMPONENT, "feature_ts_ms").persist()
            raised, resolved = score_alerts(fresh, alerts)
            raised, resolved = raised.select(*alerts.columns).persist(), resolved.persist()
            log = audit(raised, "ALERT_CREATED", "ml-scorer", self.owners()).unionByName(audit(resolved, "ALERT_AUTO_RESOLVED", "ml-scorer", self.owners()))
            change.append("audit", log, most=5000)
            changed = change.touched(raised.unionByName(resolved), bucket)
            if changed:
                before = change.read("alerts", ALERTS, changed)
                change.put("alerts", replace_by_key(before, resolved, [*COMPONENT, "alert_type", "ts_ms"]).unionByName(raised), bucket, changed)
            change.put("risk", newest_wins(risk, fresh.select(*risk.columns), COMPONENT, "feature_ts_ms"), bucket, touched)
            for df in (fresh, raised, resolved):
                df.unpersist()
        scores.unpersist()

    def _notify(self, change: Change, rows: DataFrame) -> None:
        """Add the batch's notifications; whole batches go from the old end while the rest still has NOTIFICATIONS entries."""
        n = rows.count()
        change.append("notifications", rows.select(*NOTE), rows=n)
        for e in reversed(change.base.tables.get("notifications", [])):
            if n >= NOTIFICATIONS:
                change.drop.setdefault("notifications", []).append(e["path"])
            n += e["rows"]

    def refresh_view(self, log: Commits) -> list[str]:
        """Make the view's buckets anew whose risk has changed since they were made; returns them."""
        state = log.state()
        made = {e["bucket"]: e["of"] for e in state.tables.get("view", [])}
        there = {e["bucket"]: e["path"] for e in state.tables.get("risk", [])}
        stale = sorted(b for b, path in there.items() if made.get(b) != path)
        if not stale:
            return []
        change = Change(log, "view", state.number + 1, state)
        rows = self.view(change.read("risk", RISK, stale))
        change.put("view", rows, bucket_of(COMPONENT, BUCKETS), stale)
        for e in change.add.get("view", []):
            e["of"] = there[e["bucket"]]
        change.commit()
        return stale
