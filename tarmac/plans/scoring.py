"""Queries of model metrics: orders stand for scored rows, y is whether an order is open, p its price's share.

The streaming queries run to the end of what is there and are held against the batch SQL of the same thing.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarmac.operators import labels, metrics, ml
from tarmac.plans.registry import query
from tarmac.config import HOUR_MS
from tarmac.functions.scalars import epoch_ms
from tarmac.plans.telemetry import END_MS, GRID, RAW, START_MS, WINDOW_TOTALS_SQL, raw, telemetry, window_totals
from tarmac.sources.readers import table
from tarmac.streaming.dedup import Deliveries, dedup
from tarmac.streaming.snapshots import Snapshots, drain, with_lateness

SC = "sc AS (SELECT o_orderkey AS id, CASE WHEN (o_orderstatus = 'O' AND o_orderkey % 3 > 0) OR o_totalprice > 450000 THEN 1 ELSE 0 END AS y, round(o_totalprice / 600000.0, 3) AS p FROM orders)"


def scores(spark, sf_dir) -> DataFrame:
    y = ((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 > 0)) | (F.col("o_totalprice") > 450000)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(y, 1).otherwise(0).alias("y"), F.round(F.col("o_totalprice") / 600000.0, 3).alias("p"))


CURVE = f"WITH {SC}, c AS (SELECT p, count(*) AS n, sum(y) AS pos FROM sc GROUP BY 1), k AS (SELECT p, n, pos, sum(n) OVER (ORDER BY p DESC) AS an, sum(pos) OVER (ORDER BY p DESC) AS ap, sum(pos) OVER () AS t, sum(n) OVER () AS total FROM c)"


@query(f"{CURVE} SELECT round(1 - sum(pos * ((an - ap) - (n - pos) / 2.0)) / (max(t) * (max(total) - max(t))), 8) AS roc_auc FROM k")
def roc_auc_rank(spark, sf_dir):
    return metrics.roc_auc(scores(spark, sf_dir)).select(F.round("roc_auc", 8).alias("roc_auc"))


@query(f"{CURVE} SELECT round(sum(pos * (ap / an)) / max(t), 8) AS average_precision FROM k")
def average_precision(spark, sf_dir):
    return metrics.average_precision(scores(spark, sf_dir)).select(F.round("average_precision", 8).alias("average_precision"))


@query(f"{CURVE}, f AS (SELECT p, ap / an AS pr, ap / t AS re FROM k) SELECT p AS threshold, round(pr, 8) AS precision, round(re, 8) AS recall, round(2 * pr * re / (pr + re), 8) AS f1 FROM f WHERE pr + re > 0 ORDER BY 2 * pr * re / (pr + re) DESC, p LIMIT 1")
def max_f1_threshold(spark, sf_dir):
    return metrics.best_f1(scores(spark, sf_dir)).select("threshold", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")])


@query(f"WITH {SC} SELECT count(*) AS k, round(avg(y), 8) AS precision_at_top FROM (SELECT y FROM sc ORDER BY p DESC, id LIMIT (SELECT greatest(1, CAST(floor(count(*) * 0.01) AS BIGINT)) FROM sc))")
def precision_at_top1pct(spark, sf_dir):
    return metrics.precision_at_top(scores(spark, sf_dir), 0.01, "id").withColumn("precision_at_top", F.round("precision_at_top", 8))


@query(f"WITH {SC} SELECT count(*) AS n, count(*) FILTER (WHERE y = 1) AS positives, round(avg(y), 8) AS prevalence, round(avg((p - y) * (p - y)), 8) AS brier, round(count(*) FILTER (WHERE p >= 0.5 AND y = 1) / count(*) FILTER (WHERE p >= 0.5), 8) AS precision, round(count(*) FILTER (WHERE p >= 0.5 AND y = 1) / count(*) FILTER (WHERE y = 1), 8) AS recall, count(*) FILTER (WHERE p >= 0.5) AS alerts FROM sc")
def brier_prevalence(spark, sf_dir):
    r = metrics.at_threshold(scores(spark, sf_dir), 0.5)
    return r.select("n", "positives", *[F.round(c, 8).alias(c) for c in ("prevalence", "brier", "precision", "recall")], "alerts")


@query("WITH s AS (SELECT list_sort(list(value)) AS v, count(*) AS n FROM events) SELECT q, v[CAST(least(floor(q * n), n - 1) AS BIGINT) + 1] AS value FROM s, (SELECT unnest([0.5, 0.95, 0.99]) :: DOUBLE AS q)")
def latency_percentiles(spark, sf_dir):
    return metrics.index_percentiles(table(spark, sf_dir, "events"), "value", [0.5, 0.95, 0.99])


@query("SELECT CAST(le AS DOUBLE) AS le, (SELECT count(*) FROM events WHERE value <= le) AS n FROM (SELECT unnest([5, 25, 100, 250, 'Infinity' :: DOUBLE]) AS le)")
def cumulative_histogram(spark, sf_dir):
    return metrics.cumulative_histogram(table(spark, sf_dir, "events"), "value", [5, 25, 100, 250])


@query("SELECT 'f_price' AS feature UNION ALL SELECT 'f_status'")
def usable_features(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("f_price"), F.lit(1.0).alias("f_constant"), F.lit(None).cast("double").alias("f_empty"), F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0).alias("f_status"))
    return spark.createDataFrame([(n,) for n in labels.usable_features(o)], "feature string")


# Calibrating on two scores only has a closed form: slope and offset meet both scores' shares of positives.
TWO = "b AS (SELECT id, y, CASE WHEN p < 0.3 THEN 0.2 ELSE 0.7 END :: DOUBLE AS p FROM sc), r AS (SELECT p, ln(p / (1 - p)) AS x, avg(y) AS q FROM b GROUP BY 1), e AS (SELECT p, x, ln(q / (1 - q)) AS l FROM r)"


@query(f"WITH {SC}, {TWO}, f AS (SELECT (h.l - w.l) / (h.x - w.x) AS slope, w.l - w.x * (h.l - w.l) / (h.x - w.x) AS o FROM e h, e w WHERE h.p > w.p) SELECT id, y, round(1 / (1 + exp(-(slope * ln(p / (1 - p)) + o))), 4) AS p7d FROM b, f")
def platt_two_scores(spark, sf_dir):
    """Calibration of scores of two values, where the fit has a closed form."""
    from tarmac.functions.scalars import logit, sigmoid

    s = scores(spark, sf_dir).withColumn("p", F.when(F.col("p") < 0.3, 0.2).otherwise(0.7))
    slope, offset = ml.platt(s.select(F.col("y").alias(ml.LABEL), "p"))
    return s.select("id", "y", F.round(sigmoid(F.lit(slope) * logit(F.col("p")) + F.lit(offset)), 4).alias("p7d"))


@query(None)
def platt_scores(spark, sf_dir):
    """Calibrated scores of orders (an iterative fit; tests check the calibration)."""
    from tarmac.functions.scalars import logit, sigmoid

    s = scores(spark, sf_dir)
    slope, offset = ml.platt(s.select(F.col("y").alias(ml.LABEL), "p"))
    return s.select("id", "y", sigmoid(F.lit(slope) * logit(F.col("p")) + F.lit(offset)).alias("p7d"))


def _folder(spark) -> str:
    """A new folder that executors share (``spark.checkpoint.dir``); in local mode one of its own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/') or tempfile.mkdtemp(prefix='tarmac-stream-')}/stream-{uuid.uuid4().hex}"


@query(f"WITH {RAW} SELECT vehicle_id, count(*) AS n, round(sum(value), 3) AS total FROM raw GROUP BY 1")
def stream_dedup_windows(spark, sf_dir):
    """Events delivered twice through a stream, deduplicated by identity, then summed."""
    schema = table(spark, sf_dir, "events").schema
    once = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    twice = once.unionByName(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*"))
    named = twice.select(F.col("user_id").alias("vehicle_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("event_ts"), "value")
    out = drain(dedup(named, horizon="40 days"), f"dedup_{uuid.uuid4().hex}", _folder(spark))
    return out.groupBy("vehicle_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def _slice(spark, sf_dir, folder: str, i: int, n: int, hours: int = 20) -> None:
    """Add slice ``i`` of ``n`` of the events by time to a folder; a third of what the last ``hours`` of a slice hold comes again in the next."""
    events = table(spark, sf_dir, "events")
    width = (END_MS - START_MS) // n + 1
    ts = epoch_ms(F.col("ts"))
    at = F.floor((ts - START_MS) / width)
    at = F.when(at < 0, 0).when(at >= n, n - 1).otherwise(at)
    again = (at == i - 1) & (F.col("event_id") % 3 == 0) & (ts >= START_MS + i * width - hours * HOUR_MS)
    events.where((at == i) | again).write.mode("append").parquet(folder)


@query(f"WITH {GRID}, {WINDOW_TOTALS_SQL}")
def stream_snapshots(spark, sf_dir):
    """All 70 statistics of all windows through the stream's state, in five micro-batches with repeated deliveries, summed up by vehicle.

    The stream is started for each slice once that is there, and goes on from its checkpoint: what is there is a micro-batch.
    """
    folder, events = _folder(spark), table(spark, sf_dir, "events")
    engine = Snapshots(folder, buckets=8)
    for i in range(5):
        _slice(spark, sf_dir, f"{folder}-events", i, 5)
        once = dedup(spark.readStream.schema(events.schema).parquet(f"{folder}-events").withColumn("event_ts", F.timestamp_millis(epoch_ms(F.col("ts")))), horizon="25 hours", keys=["user_id", "event_id"])
        engine.start(telemetry(spark, sf_dir, once.drop("event_ts")).withColumn("arrival", F.col("ts_ms"))).awaitTermination()
    return window_totals(engine.read_stored(spark))


_LATE_SQL = f"""{RAW}, o AS (SELECT vehicle_id, seq, ts_ms, (seq * 7919) % 10007 AS arrival FROM raw),
  m AS (SELECT *, max(ts_ms) OVER (PARTITION BY vehicle_id ORDER BY arrival, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o)"""


@query(f"WITH {_LATE_SQL} SELECT vehicle_id, count(*) FILTER (WHERE coalesce(ts_ms >= before - 90000000, true)) AS applied, count(*) FILTER (WHERE ts_ms < before - 90000000) AS late FROM m GROUP BY 1")
def late_by_running_maximum(spark, sf_dir):
    """Events in a shuffled order of arrival: those over 25 hours behind the latest one that came before them are late."""
    order = ((F.col("seq") * 7919) % 10007) * F.lit(1 << 30) + F.col("seq")
    events = raw(spark, sf_dir).select("vehicle_id", "seq", "ts_ms", order.alias("arrival"))
    found = with_lateness(events, spark.createDataFrame([], "vehicle_id long, max_event_ts_ms long"), 25 * HOUR_MS)
    return found.groupBy("vehicle_id").agg(F.count_if(~F.col("__late")).alias("applied"), F.count_if("__late").alias("late"))


@query(f"WITH {RAW} SELECT vehicle_id, seq, value, seq % 3 AS accepted_batch FROM raw UNION ALL SELECT vehicle_id, seq, value, seq % 3 + 3 FROM raw WHERE seq % 14 = 0")
def wall_clock_dedup(spark, sf_dir):
    """Deliveries in six batches, ten minutes apart by the clock: a second one a batch later is dropped, a third three batches later isn't."""
    events = raw(spark, sf_dir).select("vehicle_id", "seq", "ts_ms", "value")
    stages = [(0, F.lit(True)), (1, F.col("seq") % 7 == 0), (3, F.col("seq") % 14 == 0)]
    sent = reduce(DataFrame.unionByName, [events.where(which).withColumn("n", F.col("seq") % 3 + later) for later, which in stages])
    now = iter(range(0, 6 * 600, 600))
    gate = Deliveries(_folder(spark), 900, clock=lambda: next(now))
    for b in range(6):
        gate.batch(sent.where(F.col("n") == b).drop("n"), b)
    return gate.accepted(spark).select("vehicle_id", "seq", "value", F.col("accepted_batch").cast("long").alias("accepted_batch"))
