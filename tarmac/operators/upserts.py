"""Merges on a key for plain Parquet: what an upsert leaves in the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_write_wins(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """The rows of ``new`` to append: one of each key (the first by ``order``) that the table lacks."""
    rest = [c for c in new.columns if c not in keys]
    one = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*(order or rest))).alias("one")).select(*keys, *[F.col(f"one.{c}").alias(c) for c in rest])
    return one.join(existing.select(*keys), keys, "left_anti")


def newest_wins(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The table after an upsert that a row of an older version can't make; equal versions are replaced."""
    rest = [c for c in existing.columns if c not in keys]
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.select(*existing.columns).withColumn("__new", F.lit(1)))
    top = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("top"))
    return top.select(*keys, *[F.col(f"top.{c}").alias(c) for c in rest]).select(*existing.columns)


def accepted(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The rows of ``new`` that ``newest_wins`` takes: only those may raise or resolve alerts."""
    old = existing.select(*keys, F.col(version).alias("__old"))
    return new.join(old, keys, "left").where(F.col("__old").isNull() | (F.col("__old") <= F.col(version))).drop("__old")


def replace_by_key(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows whose key isn't in ``new``, and all of ``new``."""
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new.select(*existing.columns))
