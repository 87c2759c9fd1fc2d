"""Stream deduplication by identity, by event time or by wall-clock time, and the window sums that need no state of our own."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators.ingest import first_delivery
from tarmac.sources.commits import Commits, query_name


def dedup(events: DataFrame, ts: str = "event_ts", horizon: str = "15 minutes", keys: list[str] | None = None) -> DataFrame:
    """One row of each identity within the horizon of event time."""
    return events.withWatermark(ts, horizon).dropDuplicatesWithinWatermark(keys or ["vehicle_id", "seq"])


def sliding(events: DataFrame, ts: str = "event_ts", length: str = "24 hours", step: str = "1 hour", by: str = "vehicle_id", aggregates: dict | None = None) -> DataFrame:
    """Aggregates of each sliding window that has events; the stream needs a watermark."""
    aggregates = aggregates or {"n_events": F.count(F.lit(1))}
    grouped = events.groupBy(by, F.window(ts, length, step)).agg(*[c.alias(n) for n, c in aggregates.items()])
    return grouped.select(by, F.col("window.end").alias("feature_ts"), *aggregates)


class Deliveries:
    """One row of each identity within ``seconds`` of wall-clock time, whatever the events' own times say.

    What a batch accepts and the identities that it adds are one commit. Identities are kept in a folder a batch with the
    time at which they were accepted: a batch reads those that still count and drops older ones whole, so that it writes as
    much as it accepts. A later delivery doesn't prolong its identity's time. Within a batch the first by ``order`` counts.
    Rows with a null in an identity equal no row of another batch.
    """

    def __init__(self, root: str, seconds: float = 900.0, keys: list[str] | None = None, order: list[str] | None = None, clock: Callable[[], float] = time.time):
        self.root, self.seconds, self.keys, self.order, self.clock = root, seconds, keys or ["vehicle_id", "seq"], order or ["ts_ms"], clock

    def batch(self, events: DataFrame, batch_id: int) -> None:
        """Accept a micro-batch's new identities; a repeated batch changes nothing."""
        spark = events.sparkSession
        change = Commits(spark, self.root).begin(query_name(spark, "deliveries"), batch_id)
        if change is None:
            return
        now = self.clock()
        first = first_delivery(events, self.keys, self.order)
        seen = change.read("seen", first.select(*self.keys).schema, since=now - self.seconds)
        new = change.append("accepted", first.join(seen, self.keys, "left_anti").withColumn("accepted_batch", F.lit(batch_id)))
        change.append("seen", new.select(*self.keys), at=now)
        change.drop_before("seen", now - self.seconds)
        change.commit()

    def accepted(self, spark) -> DataFrame:
        return Commits(spark, self.root).read("accepted")

    def start(self, events: DataFrame, checkpoint: str | None = None, **trigger):
        writer = events.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint or f"{self.root}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()
