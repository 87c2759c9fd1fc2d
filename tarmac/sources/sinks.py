"""Sinks that may be called twice with the same batch: what is written stays written once."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators.upserts import first_write_wins, newest_wins


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = file_system(spark, path)
    return fs.exists(p)


def append_new(df: DataFrame, path: str, keys: list[str], order: list[str] | None = None, partition_by: list[str] | None = None) -> None:
    """Insert the rows whose key the table lacks (ON CONFLICT DO NOTHING); the first of equal keys wins.

    Only what the batch can meet is read: of the table's partitions those of the batch's values, and of the key columns the
    range that the batch spans, which prunes folders and row groups. Rows with a null key column equal no row.
    """
    spark = df.sparkSession
    existing = spark.createDataFrame([], df.schema)
    if exists(spark, path):
        names = list(dict.fromkeys([*(partition_by or []), *keys]))
        bounds = df.agg(*[F.min(c).alias(f"a{i}") for i, c in enumerate(names)], *[F.max(c).alias(f"b{i}") for i, c in enumerate(names)]).first()
        existing = spark.read.schema(df.schema).parquet(path)
        for i, c in enumerate(names):
            if bounds[f"a{i}"] is not None:
                existing = existing.where(F.col(c).between(bounds[f"a{i}"], bounds[f"b{i}"]))
        if partition_by and len(partition_by) == 1:
            some = [r[0] for r in df.select(partition_by[0]).distinct().limit(400).collect()]
            existing = existing.where(F.col(partition_by[0]).isin(some)) if len(some) < 400 else existing
    df = first_write_wins(existing, df, keys, order)
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """A micro-batch in a folder of its own: a repeated batch overwrites what its first run left."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id:012d}")


def current_version(spark: SparkSession, path: str) -> str | None:
    """The folder of a versioned table's present version: the newest one that was written to its end."""
    fs, root = file_system(spark, path)
    if not fs.exists(root):
        return None
    found = sorted(str(s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().startswith("version="))
    whole = [v for v in found if fs.exists(file_system(spark, f"{v}/_SUCCESS")[1])]
    return whole[-1] if whole else None


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A versioned table as it is now; empty, with ``schema``, before its first version."""
    found = current_version(spark, path)
    if found is None:
        return spark.createDataFrame([], schema)
    return (spark.read.schema(schema) if schema is not None else spark.read).parquet(found)


def publish(df: DataFrame, path: str, keep: int = 2) -> None:
    """Replace a versioned table: the new version is written beside the old ones and counts once it is whole.

    Readers find the old version or the new one at any time, also after a crash half-way. Versions before the last ``keep``
    are removed.
    """
    spark = df.sparkSession
    last = current_version(spark, path)
    number = int(last.rsplit("=", 1)[1]) + 1 if last else 0
    df.write.mode("overwrite").parquet(f"{path}/version={number:012d}")
    fs, root = file_system(spark, path)
    for s in sorted(str(s.getPath()) for s in fs.listStatus(root) if s.getPath().getName().startswith("version="))[: -keep]:
        fs.delete(file_system(spark, s)[1], True)


def upsert_newest(new: DataFrame, path: str, keys: list[str], version: str, buckets: int | None = None) -> None:
    """Conditional upsert into a versioned table: a row replaces one of the same key unless it is older.

    With ``buckets`` the table is one versioned table for each hash bucket of the keys, and only the buckets that the new
    rows fall into are read and written.
    """
    spark = new.sparkSession
    if not buckets:
        publish(newest_wins(read_table(spark, path, new.schema), new, keys, version), path)
        return
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets))
    for b in sorted(r[0] for r in new.select(bucket).distinct().collect()):
        upsert_newest(new.where(bucket == b), f"{path}/bucket={b}", keys, version)


def read_buckets(spark: SparkSession, path: str, schema) -> DataFrame:
    """All buckets of a table that ``upsert_newest`` keeps in buckets."""
    fs, root = file_system(spark, path)
    names = sorted(str(s.getPath()) for s in fs.listStatus(root)) if fs.exists(root) else []
    folders = [v for n in names if (v := current_version(spark, n))]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def delete_keys(path: str, keys: DataFrame) -> None:
    """Reset: remove the rows of a versioned table whose key columns are in ``keys``."""
    found = read_table(keys.sparkSession, path)
    publish(found.join(keys.distinct(), keys.columns, "left_anti"), path)


def write_parts(features: DataFrame, path: str) -> None:
    """Feature rows as Parquet parts in place of all older parts; the old ones go only when the new ones are whole."""
    publish(features, path, keep=1)


def write_dataset(rows: DataFrame, path: str, manifest: dict | None = None) -> None:
    """The training set in folders by component and split, with a manifest beside them if there is one."""
    rows.withColumns({"component": F.col("meta_component"), "split": F.col("meta_split")}).write.mode("overwrite").partitionBy("component", "split").parquet(path)
    if manifest is not None:
        text = json.dumps(manifest, indent=2, default=str)
        fs, target = file_system(rows.sparkSession, f"{path}/_manifest.json")  # readers of the folder pass over names that begin so
        out = fs.create(target, True)
        out.write(bytearray(text.encode()))
        out.close()


def read_manifest(spark: SparkSession, path: str) -> dict:
    fs, target = file_system(spark, f"{path}/_manifest.json")
    stream = fs.open(target)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def notify(snapshots: DataFrame, path: str, batch_id: int, most: int = 200_000) -> None:
    """Notifications of new snapshots: (batch, vehicle_id, component, feature_ts_ms) in a folder a batch.

    The stream is capped: whole batches are dropped from its old end while the rest still has ``most`` entries.
    """
    write_batch(snapshots.select("vehicle_id", "component", "feature_ts_ms"), path, batch_id)
    spark = snapshots.sparkSession
    sizes = spark.read.parquet(path).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("batch")).collect()  # a row a batch kept
    fs, _ = file_system(spark, path)
    kept = 0
    for r in sizes:
        if kept >= most:
            fs.delete(file_system(spark, f"{path}/batch={r.batch:012d}")[1], True)
        kept += r.n


def read_notifications(spark: SparkSession, path: str, after: int = -1, most: int = 1000) -> DataFrame:
    """The notifications that follow batch ``after``, oldest batches first, in whole batches up to at least ``most`` entries."""
    sizes = spark.read.parquet(path).where(F.col("batch") > after).groupBy("batch").agg(F.count(F.lit(1)).alias("n")).orderBy("batch").collect()
    chosen, n = [], 0
    for r in sizes:
        if n >= most:
            break
        chosen, n = [*chosen, r.batch], n + r.n
    return spark.read.parquet(path).where(F.col("batch").isin(chosen))


def flush_audit(rows: DataFrame, path: str, batch_id: int, most: int = 5000) -> None:
    """Audit rows of a micro-batch, in files of at most ``most`` rows; a repeated batch writes them once.

    The rows must follow from the batch alone: what depends on other tables is written with them in one commit
    (``sources.commits``), as the live pipeline and the scorer do.
    """
    rows.write.mode("overwrite").option("maxRecordsPerFile", most).parquet(f"{path}/batch={batch_id:012d}")


def retry(action, first: float = 1.0, most: float = 30.0, attempts: int | None = None, sleep=time.sleep):
    """Call ``action`` until it succeeds, waiting twice as long after each failure; the last error after ``attempts``."""
    wait, done = first, 0
    while True:
        try:
            return action()
        except Exception:
            done += 1
            if attempts is not None and done >= attempts:
                raise
            sleep(wait)
            wait = min(most, 2 * wait)


def to_kafka(df: DataFrame, topic: str, servers: str, checkpoint: str, key: str = "vehicle_id"):
    """A stream's rows as JSON values keyed by a column (needs Spark's Kafka connector)."""
    out = df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct("*")).alias("value"))
    return out.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("kafka.acks", "all").option("checkpointLocation", checkpoint).start()
