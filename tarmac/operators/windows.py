"""Exact half-open windows [t - W, t) at every hour boundary t, from hour blocks.

Events are summed into hour blocks within each task, before the shuffle (a vehicle of any size leaves one row an hour). A
vehicle's hours are cut into groups of eight windows' length; a block is posted to its group, and to the next one if windows
there reach back to it, so that a group is complete in its task however long the history. There the windows are ranges of
sorted blocks, merged a statistic at a time (``blocks``); between changes all snapshots have the same ones. No block is
copied to each of the 24 windows that hold it. Hours without events get a snapshot as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.config import HOUR_MS
from tarmac.functions.stats import INPUT_COLUMNS, Stat, all_stats
from tarmac.operators.blocks import Layout, in_arrow, joined, slid, summed

HOURS = 24
#: Windows of a key are made in groups of so many times their length.
GROUP = 8
LAST_MINUTE = 55


def allowed(telemetry: DataFrame, by: str) -> DataFrame:
    """Telemetry with the columns that may influence features, and the key: a statistic of any other column doesn't resolve."""
    return telemetry.select(*[c for c in telemetry.columns if c == by or c in INPUT_COLUMNS])


def buckets(telemetry: DataFrame, seconds: int, stats: dict[str, Stat] | None = None, by: str = "vehicle_id") -> DataFrame:
    """(vehicle_id, bucket, statistics): aggregates over buckets of a fixed width, bucket = ts_ms div width."""
    stats = stats or all_stats()
    return allowed(telemetry, by).groupBy(by, F.floor(F.col("ts_ms") / (seconds * 1000)).alias("bucket")).agg(*[s.aggregate() for s in stats.values()])


def hour_blocks(telemetry: DataFrame, stats: dict[str, Stat] | None = None, by: str = "vehicle_id") -> DataFrame:
    """(vehicle_id, hour, h_<stat>, l_<stat>, first_ts, last_ts): whole hours, and their last five minutes (l_)."""
    stats = stats or all_stats()
    late = F.floor(F.col("ts_ms") / 60_000) % 60 >= LAST_MINUTE
    parts = allowed(telemetry, by).select(by, "ts_ms", F.floor(F.col("ts_ms") / HOUR_MS).alias("hour"), late.alias("__late"), *[s.part().alias(f"__{n}") for n, s in stats.items()])
    whole = [s.op.filled(f"{s.op.function}(`__{n}`)") + f" AS `h_{n}`" for n, s in stats.items()]
    last = [s.op.filled(f"{s.op.function}(if(__late, `__{n}`, null))") + f" AS `l_{n}`" for n, s in stats.items()]
    return parts.groupBy(by, "hour").agg(*map(F.expr, whole + last), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts"))


def hour_parts(telemetry: DataFrame, stats: dict[str, Stat], by: str = "vehicle_id", held: list[str] | None = None) -> tuple[DataFrame, Layout]:
    """(vehicle_id, hour, packed h_<stat> and l_<stat>): hour blocks before the shuffle, so one or a few rows an hour and task; ``held`` names the columns wanted."""
    held = held or [f"{side}_{n}" for side in "hl" for n in stats]
    late = F.floor(F.col("ts_ms") / 60_000) % 60 >= LAST_MINUTE
    rows = allowed(telemetry, by).where("ts_ms IS NOT NULL").withColumn("__hour", F.floor(F.col("ts_ms") / HOUR_MS)).sortWithinPartitions(by, "__hour")
    parts = rows.select(by, F.col("__hour").alias("hour"), late.alias("__last"), *[s.part().alias(f"__{n}") for n, s in stats.items() if f"h_{n}" in held or f"l_{n}" in held])
    kinds = {f.name: f.dataType for f in parts.schema}
    values, blocks = Layout({c: k for c, k in kinds.items() if c[2:] in stats}), Layout({c: kinds[f"__{c[2:]}"] for c in held})
    schema = T.StructType([parts.schema[by], parts.schema["hour"], *[T.StructField(c, k) for c, k in blocks.kinds.items()]])
    return in_arrow(values.packed(parts, by, "hour", "__last"), schema, summed({n: s.op for n, s in stats.items()}, held), values, blocks), blocks


def join_parts(parts: DataFrame, layout: Layout, stats: dict[str, Stat], by: str = "vehicle_id") -> DataFrame:
    """One row an hour from the packed parts of hour blocks."""
    dealt = parts.repartition(_partitions(parts), by).sortWithinPartitions(by, "hour")
    schema = T.StructType([parts.schema[by], parts.schema["hour"], *[T.StructField(c, k) for c, k in layout.kinds.items()]])
    return in_arrow(dealt, schema, joined({n: s.op for n, s in stats.items()}), layout, layout)


def _partitions(df: DataFrame) -> int:
    # A number of its own: by bytes, adaptive execution would join what is still to expand into few.
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _held(windows: dict[str, list[str]], stats: dict[str, Stat], wide: str = "24h") -> list[str]:
    """The columns of blocks that windows are made of."""
    held = [f"h_{n}" for n in stats if any(n in names for w, names in windows.items() if w == wide or w != "5m")]
    return held + [f"l_{n}" for n in stats if wide != "5m" and n in windows.get("5m", [])]


def snapshots(telemetry: DataFrame, windows: dict[str, list[str]] | None = None, stats: dict[str, Stat] | None = None, by: str = "vehicle_id") -> DataFrame:
    """(vehicle_id, feature_ts_ms, first_event_ts_ms, <window>_<stat>): a row for each hour t with first event < t <= last.

    ``windows`` names the statistics wanted of each of 5m, 1h and 24h (all of them by default).
    """
    return each_hour(spells(telemetry, windows, stats, by))


def spells(telemetry: DataFrame, windows: dict[str, list[str]] | None = None, stats: dict[str, Stat] | None = None, by: str = "vehicle_id") -> DataFrame:
    """``snapshots``, with a row for those of a vehicle's group of hours that follow each other and agree in all windows: ``hours`` has their hours.

    What only depends on the windows is computed here, a third as often as for each snapshot where events are hours apart.
    """
    stats = stats or all_stats()
    windows = windows or {w: list(stats) for w in ("5m", "1h", "24h")}
    used = {n: stats[n] for n in dict.fromkeys(x for names in windows.values() for x in names)}
    hour = lambda c: F.floor(F.col(c) / HOUR_MS)
    bounds = allowed(telemetry, by).groupBy(by).agg(F.min("ts_ms").alias("first_event_ts_ms"), F.max("ts_ms").alias("last_ts"))
    due = bounds.select(by, "first_event_ts_ms", (hour("first_event_ts_ms") + 1).alias("from_hour"), hour("last_ts").alias("to_hour"))
    return window_spells(*hour_parts(telemetry, used, by, _held(windows, used)), due, windows, used, by)


def each_hour(spells: DataFrame) -> DataFrame:
    """The rows of spells for each of their hours, as feature_ts_ms."""
    found = _each(spells)
    return found.select(*[c for c in found.columns if c != "t"], (F.col("t") * HOUR_MS).alias("feature_ts_ms"))


def _each(spells: DataFrame) -> DataFrame:
    # Packed, a spell is copied to its snapshots as one value; the columns are laid out once.
    names = [c for c in spells.columns if c != "hours"]
    packed = spells.selectExpr(f"named_struct({', '.join(f"'{c}', `{c}`" for c in names)}) AS has", "explode(hours) AS t")
    return packed.selectExpr(*[f"has.`{c}` AS `{c}`" for c in names], "t")


def window_spells(blocks: DataFrame, layout: Layout, due: DataFrame, windows: dict[str, list[str]], stats: dict[str, Stat], by: str = "vehicle_id", paired: bool = False) -> DataFrame:
    """The spells of the hours ``from_hour`` to ``to_hour`` of each row of ``due`` (by, first_event_ts_ms and these), from packed hour blocks or their parts."""
    width = GROUP * HOURS
    groups = due.where("from_hour <= to_hour").selectExpr(f"`{by}`", "first_event_ts_ms", "from_hour", "to_hour", f"explode(sequence({_group('from_hour', HOURS)}, {_group('to_hour', HOURS)})) AS `group`")
    groups = groups.selectExpr(f"`{by}`", "`group`", "first_event_ts_ms", f"sequence(greatest(from_hour, `group` * {width} + 1), least(to_hour, (`group` + 1) * {width})) AS hours")
    return sliding_spells(blocks, layout, groups, windows, stats, by, paired=paired)


def unpaired(stored: DataFrame, windows: dict[str, list[str]], stats: dict[str, Stat]) -> DataFrame:
    """Spells from the form in which they are stored: a row for the hours that agree in the day's window.

    Its short windows are those of its first hour where it is ``fresh``, and empty at all other hours.
    """
    short = [f"{w}_{n}" for w, names in windows.items() if w != "24h" for n in names]
    names = [c for c in stored.columns if c not in ("hours", "fresh")]
    first = stored.where("fresh").selectExpr(*[f"`{c}`" for c in names], "slice(hours, 1, 1) AS hours")
    later = [f"CAST(NULL AS {stored.schema[c].dataType.simpleString()}) AS `{c}`" if c in short else f"`{c}`" for c in names]
    rest = stored.where("NOT fresh OR size(hours) > 1").selectExpr(*later, "if(fresh, slice(hours, 2, size(hours)), hours) AS hours")
    return filled(first.unionByName(rest), windows, stats)


def filled(stored: DataFrame, windows: dict[str, list[str]], stats: dict[str, Stat]) -> DataFrame:
    """Stored rows with the zeros of empty windows."""
    adds = {f"{w}_{n}": stats[n].op for w, names in windows.items() for n in names if stats[n].op.adds}
    return stored.selectExpr(*[f"{adds[c].filled(f'`{c}`')} AS `{c}`" if c in adds else f"`{c}`" for c in stored.columns])


def _group(t: str, span: int) -> str:
    """Group g holds the snapshots of hours g * width + 1 to (g + 1) * width, where ``GROUP`` windows make the width."""
    return f"CAST(floor(({t} - 1) / {GROUP * span}) AS BIGINT)"


#: Windows from buckets: the buckets' width in seconds, and how many make a window.
BANDS = {"5m": (60, 5), "1h": (60, 60), "24h": (900, 96)}


def bucket_snapshots(telemetry: DataFrame, points: DataFrame, windows: dict[str, list[str]] | None = None, stats: dict[str, Stat] | None = None, by: str = "vehicle_id") -> DataFrame:
    """``points`` (by, feature_ts_ms: any times) with the windows before them, merged from buckets of two widths.

    Of n buckets of width w, a window at t takes those of index [t div w - n, t div w): exact where t is a multiple of w, and
    ending at the last whole bucket elsewhere. Points that share a bucket share one merge; buckets are posted twice each.
    """
    stats = stats or all_stats()
    windows = windows or {w: list(stats) for w in BANDS}
    out = points.select(by, "feature_ts_ms").distinct()
    for w, names in windows.items():
        width, n = BANDS[w]
        used = {x: stats[x] for x in names}
        blocks = buckets(telemetry, width, used, by)
        blocks = blocks.select(by, F.col("bucket").alias("hour"), *[F.col(x).alias(f"h_{x}") for x in names])
        index = F.floor(F.col("feature_ts_ms") / (width * 1000))
        groups = out.select(by, index.alias("t")).groupBy(by, F.expr(_group("t", n)).alias("group")).agg(F.lit(0).cast("long").alias("first_event_ts_ms"), F.collect_set("t").alias("hours"))
        layout = Layout({c: blocks.schema[c].dataType for c in blocks.columns if c.startswith("h_")})
        merged = _each(sliding_spells(layout.packed(blocks, by, "hour"), layout, groups, {w: names}, used, by, n, w)).drop("first_event_ts_ms")
        out = out.withColumn("t", index).join(merged, [by, "t"]).drop("t")
    return out


def sliding_spells(blocks: DataFrame, layout: Layout, groups: DataFrame, windows: dict[str, list[str]], stats: dict[str, Stat], by: str = "vehicle_id", span: int = HOURS, wide: str = "24h", paired: bool = False) -> DataFrame:
    """(by, first_event_ts_ms, <window>_<stat>, hours) over all ``hours`` of ``groups`` (by, group, first_event_ts_ms, hours: a row a group), from blocks of any width.

    ``blocks`` has packed h_ and l_ columns and their number ``hour``, in one or several parts; the window ``wide`` spans
    ``span`` blocks before t, the others one. ``paired``, they come in the form to store (see ``unpaired``).
    """
    reach = span if wide in windows else 1
    # Windows of the hours up to ``reach`` after a block hold it.
    posted = blocks.selectExpr(f"`{by}`", f"explode(sequence({_group('hour + 1', span)}, {_group(f'hour + {reach}', span)})) AS `group`", "hour", *[f"`{f.name}`" for f in layout.fields])
    met = groups.select(by, "group", F.lit(None).cast("long").alias("hour"), "first_event_ts_ms", "hours").unionByName(posted, allowMissingColumns=True)
    dealt = met.repartition(_partitions(met), by, "group").sortWithinPartitions(by, "group", "hour")
    kinds = {**{f.name: f.dataType for f in met.schema}, **layout.kinds}
    columns = [(f"{w}_{n}", kinds[f"{'l' if w == '5m' and w != wide else 'h'}_{n}"]) for w in sorted(windows, key=lambda w: w == wide) for n in windows[w]]
    schema = T.StructType([T.StructField(c, t) for c, t in [(by, kinds[by]), ("first_event_ts_ms", kinds["first_event_ts_ms"]), *columns, ("hours", kinds["hours"]), *([("fresh", T.BooleanType())] if paired else [])]])
    return in_arrow(dealt, schema, slid({n: s.op for n, s in stats.items()}, windows, wide, span, paired), layout)


def rolling(df: DataFrame, by: str, ts: str, seconds: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over each row's preceding [ts - W, ts), by a range frame on epoch milliseconds.

    A key's rows are dealt into spans of the window's length: each row is posted to its own span, and to the next one as
    history. Spans are partitions of their own, so no task holds more than two windows of a key, however long its history.
    """
    width = seconds * 1000
    own = F.floor(F.col(ts) / width)
    posted = df.withColumn("__posts", F.array(F.struct(own.alias("span"), F.lit(True).alias("own")), F.struct((own + 1).alias("span"), F.lit(False).alias("own"))))
    posted = posted.select("*", F.inline("__posts")).drop("__posts").withColumnsRenamed({"span": "__span", "own": "__own"})
    frame = Window.partitionBy(by, "__span").orderBy(ts).rangeBetween(-width, -1)
    out = posted.select("*", *[c.over(frame).alias(n) for n, c in aggregates.items()])
    return out.where("__own").drop("__span", "__own")


def replay_order(telemetry: DataFrame) -> DataFrame:
    """Telemetry in the order in which it is replayed: time, vehicle, sequence. A range-partitioned sort."""
    return telemetry.orderBy("ts_ms", "vehicle_id", "seq")


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` of each key, as a grouped maximum (no sort of the groups)."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("top"))
    return top.select(*keys, *[F.col(f"top.{c}").alias(c) for c in rest])


def latest_before(df: DataFrame, by: str, ts_ms: str, value: str) -> DataFrame:
    """(by, t, value): the last non-null value before each hour boundary that follows an event, carried forward."""
    last = df.where(F.col(value).isNotNull()).groupBy(by, (F.floor(F.col(ts_ms) / HOUR_MS) + 1).alias("hour")).agg(F.max_by(value, F.col(ts_ms)).alias(value))
    ends = last.groupBy(by).agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = ends.select(by, F.explode(F.sequence("a", "b")).alias("hour"))
    carried = F.last(value, ignorenulls=True).over(Window.partitionBy(by).orderBy("hour"))
    return grid.join(last, [by, "hour"], "left").select(by, (F.col("hour") * HOUR_MS).alias("t_ms"), carried.alias(value))
