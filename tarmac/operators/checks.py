"""Data quality: key comparison, lifecycle order, constraints, delivery invariants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compare_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: keys in both, missing from ``a`` and extra in it."""
    left, right = a.select(*keys).distinct().withColumn("a", F.lit(1)), b.select(*keys).distinct().withColumn("b", F.lit(1))
    both = left.join(right, keys, "full_outer")
    return both.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("a").isNull()).alias("missing"), F.count_if(F.col("b").isNull()).alias("extra"))


def compare_values(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-6) -> DataFrame:
    """One row: compared values, mismatches beyond the relative tolerance (null equals null), largest relative difference."""
    joined = a.alias("a").join(b.alias("b"), keys)
    parts = []
    for v in values:
        x, y = F.col(f"a.`{v}`").cast("double"), F.col(f"b.`{v}`").cast("double")
        gap = F.when(x.isNull() & y.isNull(), 0.0).when(x.isNull() | y.isNull(), float("inf")).otherwise(F.abs(x - y) / F.greatest(F.lit(1.0), F.abs(x), F.abs(y)))
        parts.append(gap)
    gaps = joined.select(F.explode(F.array(*parts)).alias("gap"))
    return gaps.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("gap") > tolerance).alias("mismatches"), F.max("gap").alias("largest"))


def lifecycle(events: DataFrame, key: str, order: list[str], triggers: list[str], service: str) -> DataFrame:
    """One row: services that no trigger precedes, and triggers that follow a trigger."""
    before = F.lag("event_type").over(Window.partitionBy(key).orderBy(*order))
    seen = events.select("event_type", before.alias("before"))
    trigger, was = F.col("event_type").isin(triggers), F.coalesce(F.col("before").isin(triggers), F.lit(False))
    return seen.agg(F.count_if((F.col("event_type") == service) & ~was).alias("orphan_services"), F.count_if(trigger & was).alias("repeated_triggers"))


def delivery_invariant(published: DataFrame, keys: list[str]) -> DataFrame:
    """One row: published, distinct and dropped deliveries."""
    total, distinct = F.sum("n"), F.count(F.lit(1))
    counted = published.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))  # a key with nulls is a key here
    return counted.agg(total.alias("published"), distinct.alias("distinct_keys"), (total - distinct).alias("dropped"))


def broken_rules(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): how many rows break each CHECK rule; as in SQL, an unknown outcome isn't a violation."""
    counts = df.agg(*[F.count_if(~rule).alias(name) for name, rule in rules.items()])
    return counts.select(F.explode(F.create_map(*[x for n in rules for x in (F.lit(n), F.col(n))])).alias("rule", "violations"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose non-null key the parent lacks."""
    return child.where(F.col(key).isNotNull()).join(parent.select(key), key, "left_anti")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def range_profile(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.min(column).alias("least"), F.max(column).alias("largest"), F.count(column).alias("filled"), F.count(F.lit(1)).alias("rows"))


def counts_by_type(events: DataFrame, kind: str, value: str) -> DataFrame:
    """By type of event: how many there are, and how many have a value."""
    return events.groupBy(kind).agg(F.count(F.lit(1)).alias("rows"), F.count(value).alias("filled"))


def completeness(snapshots: DataFrame) -> DataFrame:
    """By hour: snapshots, vehicles, and how many have a complete window."""
    return snapshots.groupBy("feature_ts_ms").agg(F.count(F.lit(1)).alias("snapshots"), F.count_distinct("vehicle_id").alias("vehicles"), F.count_if("window_complete").alias("complete"))


def forbidden_columns(df: DataFrame, pattern: str = r"(?i)(health|wear|hidden|hazard|stress)") -> list[str]:
    """Columns whose name tells of hidden state, which telemetry and features must never carry."""
    import re

    return [c for c in df.columns if re.search(pattern, c)]
