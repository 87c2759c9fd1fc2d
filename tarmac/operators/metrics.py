"""Metrics of scores as DataFrame operations: y (0/1) against p.

Scores are first counted by distinct value, with a partial count before the shuffle; the running sums that curves need go
over these. Where the distinct values are many, running sums are taken within ranges of values (percentiles), and each range's offset is
added from a table with one row a range, so no single task holds the whole curve.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions.scalars import ratio


def score_curve(scores: DataFrame, ranges: int | None = None) -> DataFrame:
    """(p, n, pos, above_n, above_pos): counts at each distinct score, and at or above it.

    The ranges hold about as many distinct scores each (cut at approximate percentiles), however the scores crowd.
    """
    ranges = ranges or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = scores.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y").cast("long")).alias("pos"))
    cuts = counted.agg(F.percentile_approx("p", F.array(*[F.lit(i / ranges) for i in range(1, ranges + 1)]), 10 * ranges).alias("cuts"))
    below = F.size(F.filter(F.array_distinct("cuts"), lambda c: c < F.col("p")))
    placed = counted.join(F.broadcast(cuts)).select("p", "n", "pos", F.when(F.col("cuts").isNull(), 0).otherwise(below).alias("range"))
    within = Window.partitionBy("range").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy("range").agg(F.sum("n").alias("rn"), F.sum("pos").alias("rpos"))
    higher = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("range", F.coalesce(F.sum("rn").over(higher), F.lit(0)).alias("on"), F.coalesce(F.sum("rpos").over(higher), F.lit(0)).alias("opos"))
    return placed.join(F.broadcast(offsets), "range").select("p", "n", "pos", (F.col("on") + F.sum("n").over(within)).alias("above_n"), (F.col("opos") + F.sum("pos").over(within)).alias("above_pos"))


def average_precision(scores: DataFrame) -> DataFrame:
    """One row: the sum over thresholds of the recall gained times the precision there."""
    curve = score_curve(scores)
    return curve.agg((F.sum(F.col("pos") * ratio(F.col("above_pos"), F.col("above_n"))) / F.sum("pos")).alias("average_precision"))


def roc_auc(scores: DataFrame) -> DataFrame:
    """One row: the Mann-Whitney statistic with average ranks for ties."""
    curve = score_curve(scores)
    total, pos = F.max("above_n"), F.max("above_pos")
    # A positive at p beats the negatives below it, and half of those that tie with it.
    above_neg, here_neg = F.col("above_n") - F.col("above_pos"), F.col("n") - F.col("pos")
    lost = F.sum(F.col("pos") * (above_neg - here_neg / 2.0))
    return curve.agg((1 - lost / (pos * (total - pos)).cast("double")).alias("roc_auc"))


def best_f1(scores: DataFrame) -> DataFrame:
    """One row: the threshold of the largest F1 (ties: the smallest), precision, recall and F1 there."""
    curve, totals = score_curve(scores), scores.agg(F.sum(F.col("y").cast("long")).alias("positives"))
    rated = curve.join(F.broadcast(totals)).withColumn("precision", ratio(F.col("above_pos"), F.col("above_n"))).withColumn("recall", ratio(F.col("above_pos"), F.col("positives")))
    rated = rated.withColumn("f1", F.coalesce(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    top = rated.agg(F.max_by(F.struct("p", "precision", "recall", "f1"), F.struct("f1", (-F.col("p")).alias("low"))).alias("t"))
    return top.select(F.col("t.p").alias("threshold"), "t.precision", "t.recall", "t.f1")


def precision_at_top(scores: DataFrame, fraction: float = 0.01, tie: str | None = None) -> DataFrame:
    """One row: the precision among the top fraction of scores (at least one). Of equal scores those with the smallest
    ``tie`` count (a numeric column with a value a row); without it, their average does.

    The cut is read off the score curve, so the top rows are never gathered in one task.
    """
    curve = score_curve(scores)
    total = curve.agg(F.max("above_n")).first()[0] or 0
    k = max(1, int(total * fraction))
    row = F.struct("p", "n", "pos", "above_n", "above_pos")
    cut = curve.where(F.col("above_n") >= k).agg(F.min_by(row, "above_n").alias("c")).select("c.*").first()
    if cut is None or cut["p"] is None:
        return scores.sparkSession.createDataFrame([(0, None)], "k long, precision_at_top double")
    left, hits = k - (cut["above_n"] - cut["n"]), float(cut["above_pos"] - cut["pos"])
    if left == cut["n"] or not tie:
        hits += cut["pos"] * left / cut["n"]
    else:
        ties = score_curve(scores.where(F.col("p") == cut["p"]).select((-F.col(tie)).alias("p"), "y"))
        hits += ties.where(F.col("above_n") <= left).agg(F.coalesce(F.max("above_pos"), F.lit(0))).first()[0]
    return scores.sparkSession.createDataFrame([(k, hits / k)], "k long, precision_at_top double")


def at_threshold(scores: DataFrame, threshold: float, days: float = 1.0, components: int = 1) -> DataFrame:
    """One row: n, positives, prevalence, Brier score, precision, recall, alerts, alerts per 1000 components a day."""
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    alerts, tp, positives = F.count_if(hit), F.count_if(hit & y), F.count_if(y)
    return scores.agg(
        F.count(F.lit(1)).alias("n"), positives.alias("positives"), F.avg(F.col("y").cast("double")).alias("prevalence"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"),
        (tp / F.greatest(F.lit(1), alerts)).alias("precision"), (tp / F.greatest(F.lit(1), positives)).alias("recall"), alerts.alias("alerts"),
        (1000.0 * alerts / max(1, components) / max(days, 1e-9)).alias("alerts_per_1000_components_per_day"),
    )


def index_percentiles(df: DataFrame, column: str, fractions: list[float]) -> DataFrame:
    """(q, value): the value at index int(q * n) of the sorted column.

    Values are counted first; the running count over distinct values finds the indexes.
    """
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    flipped = score_curve(df.where(F.col(column).isNotNull()).select((-F.col(column)).alias("p"), F.lit(0).alias("y"))).select((-F.col("p")).alias("value"), "n", "above_n")
    total = counted.agg(F.sum("n").alias("total"))
    wanted = total.select("total", F.explode(F.array(*[F.lit(q) for q in fractions])).alias("q")).withColumn("at", F.least(F.floor(F.col("q") * F.col("total")), F.col("total") - 1))
    hit = flipped.join(F.broadcast(wanted), (F.col("at") < F.col("above_n")) & (F.col("at") >= F.col("above_n") - F.col("n")))
    return hit.select("q", "value")


def cumulative_histogram(df: DataFrame, column: str, bounds: list[float]) -> DataFrame:
    """(le, n): how many values are at most each bound, and at most infinity."""
    x = F.col(column)
    counts = df.agg(*[F.count_if(x <= b).alias(f"b{i}") for i, b in enumerate(bounds)], F.count(column).alias("all"))
    pairs = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)]
    return counts.select(F.explode(F.array(*pairs, F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))).alias("x")).select("x.le", "x.n")


def thirds(df: DataFrame, ts_ms: str, start_ms: int, end_ms: int, counted: dict) -> DataFrame:
    """(third, counts): conditions counted over three equal parts of a run, [start, end)."""
    width = (end_ms - start_ms) / 3.0
    inside = df.where((F.col(ts_ms) >= start_ms) & (F.col(ts_ms) < end_ms))
    part = F.least(F.lit(2), F.floor((F.col(ts_ms) - start_ms) / F.lit(width)).cast("int"))
    return inside.groupBy(part.alias("third")).agg(*[F.count_if(c).alias(n) for n, c in counted.items()])
