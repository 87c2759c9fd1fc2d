"""As-of joins by union and window: one shuffle on the key, one sort, no range join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _both(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, right_first: bool, tie: list[Column]) -> tuple[DataFrame, list[Column]]:
    """Left and right rows in one frame with the order in which equal times stand."""
    l = left.select(*by, F.col(left_ts).alias("__ts"), F.lit(1 if right_first else 0).alias("__side"), F.struct(*left.columns).alias("__left"))
    keep = F.struct(*right.columns)
    r = right.select(*by, F.col(right_ts).alias("__ts"), F.lit(0 if right_first else 1).alias("__side"), keep.alias("__right"), F.struct(F.lit(0), *tie).alias("__tie"))
    return l.unionByName(r, allowMissingColumns=True), [F.col("__ts"), F.col("__side"), F.col("__tie")]


def backward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, prefix: str, inclusive: bool = True, tie: list[Column] | None = None) -> DataFrame:
    """``left`` with the last right row at or before (``inclusive``) its time; right columns get ``prefix``.

    ``tie`` orders right rows of the same time; the last one counts. Rows without a match get nulls.
    """
    both, order = _both(left, right, by, left_ts, right_ts, inclusive, tie or [])
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__found", F.last("__right", ignorenulls=True).over(frame)).where(F.col("__left").isNotNull())
    return found.select(*[F.col(f"__left.{c}").alias(c) for c in left.columns], *[F.col(f"__found.{c}").alias(f"{prefix}{c}") for c in right.columns if c not in by])


def _ahead(both: DataFrame, by: list[str], wanted: Column) -> Column:
    """The nearest right row after each row: in falling order of time it is the last one seen, so the frame only grows."""
    frame = Window.partitionBy(*by).orderBy(F.desc("__ts"), F.desc("__side"), F.desc("__tie")).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(wanted, ignorenulls=True).over(frame)


def forward(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, prefix: str, tie: list[Column] | None = None) -> DataFrame:
    """``left`` with the first right row strictly after its time; right columns get ``prefix``."""
    both, _ = _both(left, right, by, left_ts, right_ts, True, tie or [])
    found = both.withColumn("__found", _ahead(both, by, F.col("__right"))).where(F.col("__left").isNotNull())
    return found.select(*[F.col(f"__left.{c}").alias(c) for c in left.columns], *[F.col(f"__found.{c}").alias(f"{prefix}{c}") for c in right.columns if c not in by])


def around(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, ahead: Column, tie: list[Column] | None = None, partitions: int | None = None) -> DataFrame:
    """``left`` with the last right row at or before its time (prefix last_), and the first one strictly after it for which
    ``ahead`` holds (prefix next_). ``ahead`` is a condition on the columns of ``right``. ``partitions``: in which the rows are
    sorted, Spark's number if None.

    The right rows are told what follows them before they meet the left ones, which are then sorted once: what follows a
    left row follows the last right row at or before it. A row without time, ahead of a key's others, stands for what
    precedes them all.
    """
    own = [c for c in right.columns if c not in by]
    facts = right.select(*by, F.col(right_ts).alias("__ts"), F.struct(F.lit(0), *(tie or [])).alias("__tie"), F.struct(*own).alias("__right"), ahead.alias("__ahead"))
    following = Window.partitionBy(*by).orderBy(F.desc("__ts"), F.desc("__tie"))
    falling = following.rowsBetween(Window.unboundedPreceding, -1)
    so_far = following.rowsBetween(Window.unboundedPreceding, 0)
    wanted = F.when(F.col("__ahead"), F.col("__right"))
    told = facts.where(F.col("__ts").isNotNull()).select(
        *by, "__ts", "__tie", F.col("__right").alias("__last"), F.last(wanted, ignorenulls=True).over(falling).alias("__next"),
        F.last(wanted, ignorenulls=True).over(so_far).alias("__with"), F.lead(F.lit(True), 1, False).over(following).alias("__more"),
    )
    seen = F.struct("__last", "__next").alias("__seen")
    before = told.where(~F.col("__more")).select(*by, F.lit(None).cast(facts.schema["__ts"].dataType).alias("__ts"), F.lit(None).cast(told.schema["__tie"].dataType).alias("__tie"), F.lit(None).cast(told.schema["__last"].dataType).alias("__last"), F.col("__with").alias("__next"))
    marks = told.select(*by, "__ts", "__tie", "__last", "__next").unionByName(before).select(*by, "__ts", F.lit(0).alias("__side"), "__tie", seen)
    rest = [c for c in left.columns if c not in [*by, left_ts]]
    rows = left.select(*by, F.col(left_ts).alias("__ts"), F.lit(1).alias("__side"), F.struct(F.lit(0).alias("__0"), *rest).alias("__left"))
    frame = Window.partitionBy(*by).orderBy(F.asc_nulls_first("__ts"), "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks, allowMissingColumns=True)
    both = both.repartition(partitions, *by) if partitions else both
    found = both.select(*by, "__ts", "__left", F.last("__seen", ignorenulls=True).over(frame).alias("__seen")).where(F.col("__left").isNotNull())
    mine = [F.col(c) if c in by else F.col("__ts").alias(c) if c == left_ts else F.col(f"__left.{c}").alias(c) for c in left.columns]
    return found.select(*mine, *[F.col(f"__seen.__{side}.{c}").alias(f"{side}_{c}") for side in ("last", "next") for c in own])
