"""Forward-looking labels, gaps and tails of snapshots, and the training set built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.config import DAY_MS, DatasetConfig
from tarmac.functions.features import feature_names
from tarmac.functions.scalars import hash_percent, ratio
from tarmac.operators.asof import around

# The events that a label looks for.
TRIGGERS = ["MAINTENANCE_REQUIRED", "FAILURE"]
#: Snapshots that a task sorts, about: their partitions grow with them.
ROWS_A_TASK = 1_000_000


def label_snapshots(snapshots: DataFrame, events: DataFrame, data_end_ms: int, horizon_days: int = 7, key: str = "vehicle_component_id", triggers: list[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Adds label_7d, label_next_event_id, label_hours_to_event, in_gap and tail.

    Positive: a trigger at t < ts <= t + horizon. In a gap: the last event at or before t (ties by type) is a trigger.
    Tail: the horizon ends after the data. ``snapshots`` has the key and feature_ts_ms; ``events`` the key, event_id,
    event_type and ts_ms.
    """
    triggers = triggers or TRIGGERS
    horizon = horizon_days * DAY_MS
    every = events.select(key, "event_id", "event_type", "ts_ms")
    found = around(snapshots, every, [key], "feature_ts_ms", "ts_ms", F.col("event_type").isin(triggers), [F.col("event_type"), F.col("event_id")], partitions)
    near = F.coalesce(F.col("next_ts_ms") <= F.col("feature_ts_ms") + horizon, F.lit(False))
    return found.select(
        *snapshots.columns,
        F.when(near, 1).otherwise(0).cast("byte").alias("label_7d"),
        F.when(near, F.col("next_event_id")).alias("label_next_event_id"),
        F.when(near, (F.col("next_ts_ms") - F.col("feature_ts_ms")) / F.lit(3_600_000.0)).alias("label_hours_to_event"),
        F.coalesce(F.col("last_event_type").isin(triggers), F.lit(False)).alias("in_gap"),
        (F.col("feature_ts_ms") + horizon > data_end_ms).alias("tail"),
    )


def split_of(ts_ms: Column, config: DatasetConfig, start_ms: int) -> Column:
    """The split whose half-open range holds a prediction time; null outside all of them."""
    out = F.lit(None).cast("string")
    for name, (a, b) in config.ranges_ms(start_ms).items():
        out = F.when((ts_ms >= a) & (ts_ms < b), name).otherwise(out)
    return out


def vehicle_group(vehicle_id: Column, config: DatasetConfig) -> Column:
    h = hash_percent(F.concat(F.lit(f"{config.seed}:"), vehicle_id.cast("string")))
    return F.when(h < round(config.holdout_fraction * 100), "holdout").otherwise("dev")


def exclusion_funnel(labelled: DataFrame, split: Column) -> DataFrame:
    """One row: how many snapshots each rule leaves out, in order, and how many are kept."""
    complete, gap, tail = F.col("window_complete"), F.col("in_gap"), F.col("tail")
    keep = complete & ~gap & ~tail
    return labelled.agg(
        F.count(F.lit(1)).alias("snapshots_total"), F.count_if(~complete).alias("excluded_warmup"), F.count_if(complete & gap).alias("excluded_in_gap"),
        F.count_if(complete & ~gap & tail).alias("excluded_tail"), F.count_if(keep & split.isNull()).alias("excluded_outside_splits"),
        F.count_if(keep & split.isNotNull()).alias("rows_kept"),
    )


def build_dataset(features: DataFrame, components: DataFrame, events: DataFrame, start_ms: int, end_ms: int, config: DatasetConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with meta_, label_ and f_ columns, exclusion counts).

    Every snapshot needs exactly one row of ``components`` (vehicle_id, component, vehicle_component_id, vehicle_type);
    ValueError otherwise.
    """
    config = config or DatasetConfig()
    keys = ["vehicle_id", "component"]
    if not components.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError("components repeat a (vehicle_id, component)")
    held = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).join(components.select(*keys, F.lit(True).alias("known")), keys, "left")
    found = held.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count_if(F.col("known").isNull()).alias("unknown")).first()
    if found.unknown:
        raise ValueError("snapshots without a component")
    partitions = max(int(features.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-found.rows // ROWS_A_TASK))
    joined = features.drop("vehicle_type").where((F.col("feature_ts_ms") >= start_ms) & (F.col("feature_ts_ms") < end_ms)).repartition(partitions, *keys).join(components, keys)
    labelled = label_snapshots(joined, events, end_ms, config.horizon_days, partitions=partitions)
    split = split_of(F.col("feature_ts_ms"), config, start_ms)
    funnel = exclusion_funnel(labelled, split)
    kept = labelled.where(F.col("window_complete") & ~F.col("in_gap") & ~F.col("tail")).withColumn("meta_split", split).where("meta_split is not null")
    names = sorted({n for c in ("BRAKE", "POWERTRAIN", "BATTERY") for n in feature_names(c)} & set(features.columns))
    rows = kept.select(
        F.col("vehicle_id").alias("meta_vehicle_id"), F.col("component").alias("meta_component"), F.col("vehicle_type").alias("meta_vehicle_type"),
        F.col("vehicle_component_id").alias("meta_vehicle_component_id"), F.col("feature_ts_ms").alias("meta_feature_ts_ms"),
        vehicle_group(F.col("vehicle_id"), config).alias("meta_vehicle_group"), "meta_split", "label_7d", "label_next_event_id", "label_hours_to_event",
        *[F.col(n).cast("double").alias(f"f_{n}") for n in names],
    )
    return rows, funnel


def dataset_counts(rows: DataFrame) -> DataFrame:
    """Rows, positives, prevalence, positive events, vehicles and holdout rows of each component and split."""
    positive = F.col("label_7d") == 1
    return rows.groupBy("meta_component", "meta_split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(positive).alias("positives"), ratio(F.count_if(positive), F.count(F.lit(1))).alias("prevalence"),
        F.count_distinct(F.when(positive, F.col("label_next_event_id"))).alias("positive_events"), F.count_distinct("meta_vehicle_id").alias("vehicles"),
        F.count_if(F.col("meta_vehicle_group") == "holdout").alias("holdout_rows"),
    )


def manifest(rows: DataFrame, funnel: DataFrame, start_ms: int, end_ms: int, config: DatasetConfig | None = None, versions: dict[str, str] | None = None) -> dict:
    """What a training set was made of: its splits, exclusions, counts and guardrail warnings, as a small dictionary."""
    config, counts = config or DatasetConfig(), {}
    for r in dataset_counts(rows).collect():  # a row for each component and split
        figures = {k: r[k] for k in ("rows", "positives", "positive_events", "vehicles", "holdout_rows")}
        counts.setdefault(r.meta_component, {})[r.meta_split] = {**figures, "prevalence": round(r.prevalence, 5) if r.prevalence is not None else None}
    warnings = [f"{r.meta_component}: calibration split has {r.positives} positives of {r.positive_events} events" for r in calibration_guardrails(dataset_counts(rows), config).collect()]
    return {
        **(versions or {}), "seed": config.seed, "data_start_ms": start_ms, "data_end_ms": end_ms, "horizon_days": config.horizon_days, "split_days": {k: list(v) for k, v in config.splits.items()},
        "split_ranges_ms": {k: list(v) for k, v in config.ranges_ms(start_ms).items()}, "holdout_fraction": config.holdout_fraction, "model_input_columns": [c for c in rows.columns if c.startswith("f_")],
        "exclusion_counts": funnel.first().asDict(), "counts": counts, "guardrail_warnings": sorted(warnings),
    }


def calibration_guardrails(counts: DataFrame, config: DatasetConfig | None = None) -> DataFrame:
    """The components whose calibration split has too few positives or positive events."""
    config = config or DatasetConfig()
    few = (F.col("positives") < config.min_calibration_positives) | (F.col("positive_events") < config.min_calibration_events)
    return counts.where((F.col("meta_split") == "calibration") & few)


def usable_features(rows: DataFrame, prefix: str = "f_") -> list[str]:
    """The feature columns with a value and more than one distinct value, in one pass."""
    names = [c for c in rows.columns if c.startswith(prefix)]
    found = rows.agg(*[F.struct(F.min(c).alias("a"), F.max(c).alias("b")).alias(c) for c in names]).first()
    return [c for c in names if found[c]["a"] is not None and found[c]["a"] != found[c]["b"]]
