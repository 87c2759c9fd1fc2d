"""Exact snapshots on a stream, of all statistics: each micro-batch is merged into hour blocks that are kept between batches.

A batch's events become parts of hour blocks in their tasks, before the shuffle, so a vehicle of any traffic adds one row an
hour and task. Snapshots are made from these and the state's blocks; only blocks that later snapshots can need are written.
The state is two tables in buckets of vehicles: these hour blocks, and each vehicle's progress. A batch reads and writes the
buckets of its vehicles (and one more, to forget vehicles that are gone), and its state and snapshots are one commit
(``Commits``): a batch that is repeated after a failure, wherever that was, finds the state of the one before, or itself
committed; nothing is applied or emitted twice.

Every hour boundary that a vehicle passes emits a snapshot, hours without events included; snapshots are never revised.
Events too far behind the latest one that came before them (in this batch or an earlier one) are counted and left out, so
how a stream is cut into batches doesn't matter. Repeated deliveries are dropped ahead of the state by identity (``dedup``).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.config import HOUR_MS, FeatureConfig
from tarmac.functions.features import COMPONENTS, features, window_complete
from tarmac.functions.stats import Stat, all_stats
from tarmac.operators.blocks import Layout
from tarmac.operators.windows import HOURS, each_hour, filled, hour_parts, join_parts, unpaired, window_spells
from tarmac.sources.commits import Change, Commits, bucket_of, query_name
from tarmac.sources.sinks import retry

WINDOWS = ("5m", "1h", "24h")
ARRIVAL = "arrival"
#: Arrivals of a vehicle are compared in runs of so many, each a partition of its own.
RUN = 1 << 13


def with_lateness(events: DataFrame, latest: DataFrame, lateness_ms: int, by: str = "vehicle_id", flag: str = "__late") -> DataFrame:
    """Adds ``flag``: whether an event is over ``lateness_ms`` behind the latest one of its vehicle that arrived before it.

    ``events`` has ts_ms and ``arrival`` (a number that rises in order of arrival), ``latest`` (by, max_event_ts_ms) what
    earlier batches had. The running maximum is taken in two steps, of runs of arrivals and within each, so a vehicle of any
    traffic spreads over many tasks.
    """
    run = F.floor(F.col(ARRIVAL) / RUN)
    tagged = events.withColumn("__run", run)
    runs = tagged.groupBy(by, "__run").agg(F.max("ts_ms").alias("__top"))
    ahead = F.max("__top").over(Window.partitionBy(by).orderBy("__run").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.join(latest.select(by, F.col("max_event_ts_ms").alias("__known")), by, "left").select(by, "__run", F.greatest("__known", ahead).alias("__before"))
    within = F.max("ts_ms").over(Window.partitionBy(by, "__run").orderBy(ARRIVAL).rowsBetween(Window.unboundedPreceding, -1))
    late = F.coalesce(F.col("ts_ms") < F.greatest("__before", within) - lateness_ms, F.lit(False))
    return tagged.join(runs, [by, "__run"]).withColumn(flag, late).drop("__run", "__before")


class Snapshots:
    """The state of a stream of telemetry under one root folder, which all executors share.

    Events that have a column ``arrival`` are taken in its order (as a topic's offset gives it), others as they are read: give it
    where rows have been shuffled since, as ``dedup`` does.
    ``on_snapshots`` gets each batch's snapshots (once they are committed) and the batch's number; it is called again when a
    batch is repeated. A vehicle that no batch has touched for ``ttl_seconds`` of wall-clock time is forgotten, at the latest
    ``buckets`` batches later. A batch writes at least a file for each bucket it touches, so few buckets suit small fleets.
    """

    def __init__(self, root: str, stats: dict[str, Stat] | None = None, windows: dict[str, list[str]] | None = None, config: FeatureConfig | None = None,
                 ttl_seconds: int = 7 * 86_400, on_snapshots: Callable[[DataFrame, int], None] | None = None, buckets: int = 64):
        self.root, self.stats, self.buckets = root.rstrip("/"), stats or all_stats(), buckets
        self.windows = windows or {w: list(self.stats) for w in WINDOWS}
        self.lateness = (config or FeatureConfig()).lateness_seconds * 1000
        self.ttl, self.on_snapshots = ttl_seconds, on_snapshots

    def batch(self, events: DataFrame, batch_id: int, emit: bool = True) -> None:
        """Apply one micro-batch. ``emit=False`` only builds state (see ``warm_up``)."""
        spark = events.sparkSession
        log, writer = Commits(spark, self.root), query_name(spark, "snapshots")
        change = log.begin(writer, batch_id)
        if change is not None:
            events = (events if ARRIVAL in events.columns else events.withColumn(ARRIVAL, F.monotonically_increasing_id())).persist()
            try:
                self._apply(change, events, emit)
            finally:
                events.unpersist()
        if emit and self.on_snapshots:
            out = each_hour(unpaired(log.read("snapshots", batch=(writer, batch_id)), self.windows, self.stats)) if self._has(log, writer, batch_id) else None
            if out is not None:
                self.on_snapshots(out, batch_id)

    @staticmethod
    def _has(log: Commits, writer: str, batch_id: int) -> bool:
        return any((e["writer"], e["batch"]) == (writer, batch_id) for e in log.state().tables.get("snapshots", []))

    def _apply(self, change: Change, events: DataFrame, emit: bool) -> None:
        vehicle, bucket = events.schema["vehicle_id"].dataType.simpleString(), bucket_of(["vehicle_id"], self.buckets)
        shape = f"vehicle_id {vehicle}, first_event_ts_ms long, max_event_ts_ms long, emitted_hour long, applied long, late long, touched timestamp, done long"
        filled_buckets, spark = change.touched(events, bucket), events.sparkSession
        touched = sorted({*filled_buckets, str(change.batch % self.buckets)})
        before = change.read("progress", shape, touched).drop("done")
        expired = F.col("touched") <= F.current_timestamp() - F.make_dt_interval(secs=F.lit(self.ttl))
        if not filled_buckets and before.where(expired).isEmpty():
            # Without events, and with none to forget, state stays as it is (a stream's last batch moves its watermark only).
            if emit:
                new, layout = hour_parts(events, self.stats)
                change.append("snapshots", spark.createDataFrame([], self.due(new, layout, before.withColumn("done", F.col("emitted_hour"))).schema))
            change.commit()
            return
        tagged, new = with_lateness(events, before, self.lateness).persist(), None
        try:
            new, layout = hour_parts(tagged.where("not __late"), self.stats)
            new = new.persist()
            counted = tagged.groupBy("vehicle_id").agg(
                F.min(F.when(~F.col("__late"), F.col("ts_ms"))).alias("first_event_ts_ms"), F.max(F.when(~F.col("__late"), F.col("ts_ms"))).alias("max_event_ts_ms"),
                F.count_if(~F.col("__late")).alias("applied"), F.count_if("__late").alias("late"),
            )
            seen = counted.withColumn("touched", F.current_timestamp()).unionByName(before, allowMissingColumns=True)
            progress = seen.groupBy("vehicle_id").agg(
                F.min("first_event_ts_ms").alias("first_event_ts_ms"), F.max("max_event_ts_ms").alias("max_event_ts_ms"), F.max("emitted_hour").alias("done"),
                F.sum("applied").alias("applied"), F.sum("late").alias("late"), F.max("touched").alias("touched"),
            ).where("max_event_ts_ms is not null")
            progress = progress.where(~expired)
            reached = F.floor(F.col("max_event_ts_ms") / HOUR_MS)
            # The first snapshot follows the hour of the vehicle's first event; later ones follow the last one emitted.
            progress = progress.withColumn("done", F.coalesce("done", F.floor(F.col("first_event_ts_ms") / HOUR_MS))).withColumn("emitted_hour", F.greatest("done", reached))
            progress = change.put("progress", progress.select(*[c.split()[0] for c in shape.split(", ")]), bucket, touched)
            stored = T.StructType([new.schema["vehicle_id"], new.schema["hour"], *[T.StructField(c, k) for c, k in layout.kinds.items()]])
            blocks = layout.packed(change.read("blocks", stored, touched), "vehicle_id", "hour").unionByName(new)
            if emit:
                change.append("snapshots", self.due(blocks, layout, progress))
            # What no later snapshot can need is left behind.
            known = progress.select("vehicle_id", (F.col("emitted_hour") + 1 - HOURS).alias("__oldest"))
            kept = blocks.join(known, "vehicle_id").where("hour >= __oldest").drop("__oldest")
            change.put("blocks", layout.wide(join_parts(kept, layout, self.stats), "vehicle_id", "hour"), bucket, touched)
            change.commit()
        finally:
            tagged.unpersist()
            if new is not None:
                new.unpersist()

    def due(self, blocks: DataFrame, layout: Layout, progress: DataFrame) -> DataFrame:
        """The spells of snapshots of the hours after ``done`` up to ``emitted_hour``, from the blocks of the day before each, in the form to store."""
        due = progress.where("emitted_hour > done").select("vehicle_id", "first_event_ts_ms", (F.col("done") + 1).alias("from_hour"), F.col("emitted_hour").alias("to_hour"))
        return window_spells(blocks, layout, due, self.windows, self.stats, paired=True)

    def warm_up(self, history: DataFrame, batch_id: int = 0) -> None:
        """Rebuild the state from stored telemetry, as if the stream had run over it: the next batch has the number after."""
        self.batch(history, batch_id, emit=False)

    def read(self, spark: SparkSession) -> DataFrame:
        """All snapshots so far."""
        return each_hour(self.read_spells(spark))

    def read_spells(self, spark: SparkSession) -> DataFrame:
        """All snapshots so far as spells, which agree in all windows."""
        return unpaired(Commits(spark, self.root).read("snapshots"), self.windows, self.stats)

    def read_stored(self, spark: SparkSession) -> DataFrame:
        """All snapshots so far as they are stored: spells that agree in the day's window; the others are of the first hour, where ``fresh``."""
        return filled(Commits(spark, self.root).read("snapshots"), self.windows, self.stats)

    def counters(self, spark: SparkSession) -> DataFrame:
        """One row: vehicles, applied and late events as of the last commit."""
        found = Commits(spark, self.root).read("progress", "applied long, late long")
        return found.agg(F.count(F.lit(1)).alias("vehicles"), F.sum("applied").alias("applied"), F.sum("late").alias("late"))

    def start(self, events: DataFrame, checkpoint: str | None = None, **trigger):
        """A streaming query that applies each batch, trying again with growing pauses when it fails."""
        writer = events.writeStream.foreachBatch(lambda df, n: retry(lambda: self.batch(df, n), attempts=3))
        return writer.option("checkpointLocation", checkpoint or f"{self.root}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()


def per_component(snapshots: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Feature rows of every ACTIVE component: a snapshot with all statistics, by the formulas of its component.

    ``vehicles``: vehicle_id, vehicle_type, manufacture_date_ms, and components (an array of the ACTIVE ones, as
    ``vehicle_context`` makes it); service columns are null where snapshots lack them. Features that a component's formulas
    don't have are null.
    """
    service = {"last_service_ts_ms": "long", "last_service_odometer_km": "double"}
    joined = snapshots.join(vehicles, "vehicle_id").withColumns({c: F.lit(None).cast(t) for c, t in service.items() if c not in snapshots.columns})
    out = None
    for component in COMPONENTS:
        mine = joined.where(F.array_contains("components", component))
        part = mine.select("vehicle_id", F.lit(component).alias("component"), "feature_ts_ms", window_complete().alias("window_complete"), *[c.alias(n) for n, c in features(component).items()])
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def drain(stream: DataFrame, name: str, checkpoint: str) -> DataFrame:
    """Run a stream over all that is there and return what it put out, by way of Parquet files beside the checkpoint."""
    rows = f"{checkpoint}-rows-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").queryName(name).outputMode("append").option("path", rows).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(rows)
