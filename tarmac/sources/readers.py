"""Sources: tables, telemetry by time and vehicle, dimension snapshots, streams of files or of Kafka topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators.alerts import DTC_REGISTRY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(spark: SparkSession, path: str) -> DataFrame:
    """A directory of Parquet parts, with the columns of its partition folders."""
    return spark.read.parquet(path)


def telemetry_scan(telemetry: DataFrame, start_ms: int, end_ms: int, vehicles: DataFrame | None = None) -> DataFrame:
    """Telemetry with start <= ts_ms < end of the given vehicles. The range reaches the Parquet scan; partitions by
    event_date, where there are any, are pruned by it as well."""
    df = telemetry.where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
    if "event_date" in telemetry.columns:
        days = [F.timestamp_millis(F.lit(x)).cast("date") for x in (start_ms, end_ms - 1)]
        df = df.where(F.col("event_date").between(*days))
    return df if vehicles is None else df.join(vehicles.select("vehicle_id"), "vehicle_id", "left_semi")


def distinct_vehicles(telemetry: DataFrame) -> DataFrame:
    return telemetry.select("vehicle_id").distinct().orderBy("vehicle_id")


def dtc_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(code, component, severity, description), of a YAML file or as built in."""
    rows = DTC_REGISTRY
    if path:
        import yaml

        with open(path) as f:
            rows = [(k, v["component"], v["severity"], v["description"]) for k, v in yaml.safe_load(f)["codes"].items()]
    return spark.createDataFrame(rows, "code string, component string, severity string, description string")


def vehicle_context(vehicles: DataFrame, components: DataFrame) -> DataFrame:
    """Vehicles with their ACTIVE components in order; an empty array without any."""
    active = components.groupBy("vehicle_id").agg(F.array_sort(F.collect_list(F.when(F.col("status") == "ACTIVE", F.col("component")))).alias("components"))
    return vehicles.join(active, "vehicle_id", "left").withColumn("components", F.coalesce("components", F.array().cast("array<string>")))


def service_history(events: DataFrame, components: DataFrame) -> DataFrame:
    """(vehicle_id, component, ts_ms, odometer_km) of completed services, for as-of joins."""
    done = events.where("event_type = 'SERVICE_COMPLETED'").join(components.select("vehicle_component_id", "vehicle_id", "component"), "vehicle_component_id")
    return done.select("vehicle_id", "component", "ts_ms", "odometer_km")


def stream(spark: SparkSession, kind: str, schema: T.StructType | None = None, **options: str) -> DataFrame:
    """A stream of JSON or Parquet files (kind "json", "parquet") or of a Kafka topic (kind "kafka").

    Kafka rows are turned into key and value texts; it needs Spark's connector on the class path.
    """
    reader = spark.readStream.format(kind).options(**options)
    if kind == "kafka":
        return reader.option("startingOffsets", options.get("startingOffsets", "earliest")).load().select(F.col("key").cast("string"), F.col("value").cast("string"))
    return reader.schema(schema).load()
