"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarmac.session import ship

_own_dir: dict[str, str] = {}
HOT_KEYS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode (tests) one of its own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", "") or spark.conf.get("spark.checkpoint.dir", "")
    if not base:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir.setdefault(app, tempfile.mkdtemp(prefix="tarmac-"))
    return base.rstrip("/")


def stash(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder as Parquet and read it back.

    The files outlive lost executors, and are removed when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def forget_at_exit(spark: SparkSession, path: str) -> None:
    """Have Hadoop's file system delete ``path`` when the driver's JVM ends."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm_path)


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` lacks (Spark's names don't depend on case), for what an operator adds while it works."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_keys(df: DataFrame) -> list[Column]:
    """Two 64-bit hashes of all columns: together they tell rows apart, and rows that agree in every column have the same."""
    plain = [F.to_json(F.struct(c)) if isinstance(df.schema[c].dataType, T.MapType) else F.col(f"`{c}`") for c in df.columns]
    nulls = [F.col(f"`{c}`").isNull() for c in df.columns]  # hashes pass over nulls, so where they stand is hashed as well
    return [F.xxhash64(F.lit(n), *plain, *nulls) for n in (1, 2)]


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: str, how: str = "left") -> DataFrame:
    """``left`` joined to ``right``, which has a row a key and in ``rows`` how many rows of ``left`` have it; ``rows`` is dropped.

    However the rows are spread over the keys, no task gets a hot key: the keys that hold more than one in ``HOT_KEYS`` of
    all rows (so fewer than ``HOT_KEYS``) are broadcast, the others meet by a shuffle (at every size: ``right`` grows with
    ``left``, so a broadcast would only do on small tables). ``left`` is read twice.
    """
    total = right.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot, rest = right.where(F.col(rows) * HOT_KEYS > total).drop(rows), right.where(F.col(rows) * HOT_KEYS <= total).drop(rows)
    few = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(rest.hint("shuffle_merge"), keys, how)
    return left.join(F.broadcast(hot), keys).unionByName(few)


def map_rows(df: DataFrame, schema: str | T.StructType, rows: Callable[[list[list]], Iterable[tuple]]) -> DataFrame:
    """``mapInArrow`` over lists of column values: ``rows`` gets the columns of a batch and yields output tuples.

    Batches are small (Arrow's limits on rows and bytes hold), and output leaves in pieces of a few thousand rows.
    """
    out_schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(out_schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for row in rows([c.to_pylist() for c in batch.columns]):
                held.append(row)
                if len(held) >= 5000:
                    yield _batch(held, arrow)
                    held = []
            if held:
                yield _batch(held, arrow)

    ship(df.sparkSession)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])  # mapInArrow resolves columns by name
    return plain.mapInArrow(run, out_schema)


def filter_rows(df: DataFrame, columns: list[str], keep: Callable[[list[list]], list[bool]]) -> DataFrame:
    """The rows of ``df`` for which ``keep``, given the named columns of a batch, says so; nulls reach ``keep`` as None.

    Repeated rows are judged one by one; columns, their names and types stay; an empty table stays empty.
    """
    ship(df.sparkSession)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep([batch.column(i).to_pylist() for i in at]), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (u, v long) can reach.

    Alternates large-star and small-star steps, each a grouped minimum with a join, until the edge set stops changing.
    Nodes without an edge to another node are not returned. Nulls are ignored; an empty input gives an empty result.
    """
    ordered = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen = stash(ordered, "edges"), None
    for _ in range(max_rounds):
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == seen:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        now = stash(small.distinct(), "edges")
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
