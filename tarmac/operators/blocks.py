"""Blocks of statistics in Arrow tasks: Spark deals them out and sorts them, and columns are merged over ranges of sorted rows.

As rows of hundreds of columns, Spark's own frames and aggregates take a time for each of a row's values that exceeds that of
merging them many times over. Memory is bounded by a batch and by the blocks of one key, which are merged before they wait.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarmac.functions.stats import Merge
from tarmac.session import ship

Batches = Iterator[pa.RecordBatch]


PACKED = "packed"


@dataclass(frozen=True)
class Layout:
    """Statistics by column, with their types: in Spark's rows the numbers are one array, so that it carries few columns; in tasks all are columns again.

    Counts are held as doubles, which are exact up to 2 ^ 53.
    """

    kinds: dict[str, T.DataType]

    @property
    def numbers(self) -> list[str]:
        return [c for c, kind in self.kinds.items() if isinstance(kind, (T.LongType, T.DoubleType))]

    @property
    def fields(self) -> list[T.StructField]:
        """Of a packed row, but for its keys."""
        return [*[T.StructField(c, kind) for c, kind in self.kinds.items() if c not in self.numbers], T.StructField(PACKED, T.ArrayType(T.DoubleType()))]

    def packed(self, df: DataFrame, *keys: str) -> DataFrame:
        """Rows with a column each, packed."""
        return df.selectExpr(*[f"`{k}`" for k in keys], *[f"`{f.name}`" for f in self.fields[:-1]], f"array({', '.join(f'CAST(`{c}` AS DOUBLE)' for c in self.numbers)}) AS `{PACKED}`")

    def wide(self, df: DataFrame, *keys: str) -> DataFrame:
        """Packed rows with a column each."""
        of = {c: f"CAST(`{PACKED}`[{i}] AS {self.kinds[c].simpleString()})" for i, c in enumerate(self.numbers)}
        return df.selectExpr(*[f"`{k}`" for k in keys], *[f"{of.get(c, f'`{c}`')} AS `{c}`" for c in self.kinds])

    def columns_of(self, b: pa.RecordBatch) -> pa.RecordBatch:
        lists, names = b.column(PACKED), self.numbers
        at, flat = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False)), lists.flatten()
        values, missing = np.zeros((len(names), b.num_rows)), np.ones((len(names), b.num_rows), dtype=bool)
        missing[:, at] = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(names)).T
        values[:, at] = pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).reshape(-1, len(names)).T
        found = {c: pa.array(v.astype(np.int64) if isinstance(self.kinds[c], T.LongType) else v, mask=m) for c, v, m in zip(names, values, missing)}
        found = {**{c: b.column(c) for c in b.schema.names if c != PACKED and c not in self.kinds}, **{c: found[c] if c in found else b.column(c) for c in self.kinds}}
        return pa.RecordBatch.from_arrays(list(found.values()), list(found))

    def rows_of(self, b: pa.RecordBatch, out: pa.Schema) -> pa.RecordBatch:
        names = self.numbers
        values, missing = np.empty((len(names), b.num_rows)), np.empty((len(names), b.num_rows), dtype=bool)
        for i, c in enumerate(names):
            missing[i] = b.column(c).is_null().to_numpy(zero_copy_only=False)
            values[i] = pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * np.int32(len(names)))
        lists = pa.ListArray.from_arrays(offsets, pa.array(values.T.ravel(), mask=missing.T.ravel()), type=out.field(PACKED).type)
        return pa.RecordBatch.from_arrays([lists if c == PACKED else b.column(c) for c in out.names], schema=out)


def in_arrow(df: DataFrame, schema: T.StructType, run: Callable[[Batches, pa.Schema], Batches], of: Layout | None = None, to: Layout | None = None) -> DataFrame:
    """``mapInArrow`` over columns, where rows are packed ``of`` and ``to`` a layout; ``run`` gets the schema that is put out as well."""
    out = to_arrow_schema(schema)
    rows = to_arrow_schema(T.StructType([*schema.fields[: -len(to.kinds)], *to.fields])) if to else out
    ship(df.sparkSession)

    def task(batches: Batches) -> Batches:
        found = run((of.columns_of(b) if of else b for b in batches if b.num_rows), out)
        return (to.rows_of(b, rows) for b in found) if to else found

    return df.mapInArrow(task, T.StructType([*schema.fields[: -len(to.kinds)], *to.fields]) if to else schema)


def merged(op: Merge, column: pa.Array, low: np.ndarray, high: np.ndarray, fill: bool = True) -> pa.Array:
    """The merge of the rows of each range [low, high); of none, or of nulls alone, null, or zero where values add and ``fill`` says so."""
    empty = low >= high
    if (high - low).max(initial=0) <= 1:
        found = column.take(pa.array(np.where(empty, 0, low), mask=empty))
        return pc.fill_null(found, 0) if op.adds and fill else found
    ends = np.stack([low, high], axis=1).ravel()  # every other reduction is of a range, the rest of what lies between
    if op.adds:
        values = pc.fill_null(column, 0).to_numpy(zero_copy_only=False)
        found = np.add.reduceat(np.append(values, values[:1]), ends)[::2]
        found[empty] = 0
        return pa.array(found, type=column.type, mask=None if fill else empty)
    n, order = len(column), _order(column)
    ranks = np.empty(n + 1, dtype=np.int64)
    ranks[order] = np.arange(n)
    least = op.function == "min"
    ranks[np.append(column.is_null().to_numpy(zero_copy_only=False), True)] = none = n if least else -1
    found = (np.minimum if least else np.maximum).reduceat(ranks, ends)[::2]
    missing = empty | (found == none)
    return column.take(pa.array(order[np.where(missing, 0, found)], mask=missing))


def _order(column: pa.Array) -> np.ndarray:
    """Row numbers by rising value: NaN last, structs by their fields, in which nulls are first."""
    if pa.types.is_floating(column.type):
        return np.argsort(column.to_numpy(zero_copy_only=False), kind="stable")  # where nulls stand doesn't matter
    keys = []
    for field in column.flatten() if pa.types.is_struct(column.type) else [column]:
        if not (pa.types.is_floating(field.type) or pa.types.is_integer(field.type)):
            field = pc.rank(field, null_placement="at_start", tiebreaker="dense")
        keys = [pc.fill_null(field, 0).to_numpy(zero_copy_only=False), field.is_valid().to_numpy(zero_copy_only=False), *keys]
    return np.lexsort(keys)


def _starts(*keys: pa.Array) -> np.ndarray:
    """The rows where a run of equal keys begins."""
    changes = np.zeros(len(keys[0]) - 1, dtype=bool)
    for key in keys:
        codes = key.dictionary_encode(null_encoding="encode").indices.to_numpy()
        changes |= codes[1:] != codes[:-1]
    return np.append(0, np.flatnonzero(changes) + 1)


def _ranges(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return starts, np.append(starts[1:], n)


def summed(ops: dict[str, Merge], held: list[str]) -> Callable[[Batches, pa.Schema], Batches]:
    """Rows (key, number, flag, ``__<stat>``) sorted by key and number become blocks (key, number, ``held``: h_ of all rows, l_ of flagged ones)."""

    def run(batches: Batches, out: pa.Schema) -> Batches:
        for b in batches:
            low, high = _ranges(_starts(b.column(0), b.column(1)), b.num_rows)
            flagged = np.flatnonzero(pc.fill_null(b.column(2), False).to_numpy(zero_copy_only=False))
            some = np.searchsorted(flagged, low), np.searchsorted(flagged, high)
            columns = [b.column(i).take(pa.array(low)) for i in (0, 1)]
            for c in held:
                values = b.column(f"__{c[2:]}")
                columns.append(merged(ops[c[2:]], values, low, high, False) if c[0] == "h" else merged(ops[c[2:]], values.take(pa.array(flagged)), *some, False))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return run


def _merge_rows(b: pa.RecordBatch, keys: int, ops: dict[str, Merge]) -> pa.RecordBatch:
    """One row for rows that follow each other with equal first columns; h_ and l_ columns are merged, of others the first row's stay."""
    starts = _starts(*b.columns[:keys])
    if len(starts) == b.num_rows:
        return b
    low, high = _ranges(starts, b.num_rows)
    return pa.RecordBatch.from_arrays([merged(ops[c[2:]], x, low, high, False) if c[2:] in ops and i >= keys else x.take(pa.array(low)) for i, (c, x) in enumerate(zip(b.schema.names, b.columns))], schema=b.schema)


def joined(ops: dict[str, Merge]) -> Callable[[Batches, pa.Schema], Batches]:
    """Blocks (key, number, statistics) sorted by key and number: one for each of these."""

    def run(batches: Batches, out: pa.Schema) -> Batches:
        held = None
        for b in batches:
            b = _merge_rows(b if held is None else pa.concat_batches([held, b]), 2, ops)
            held = b.slice(b.num_rows - 1)
            yield pa.RecordBatch.from_arrays(b.slice(0, b.num_rows - 1).columns, schema=out)
        if held is not None:
            yield pa.RecordBatch.from_arrays(held.columns, schema=out)

    return run


def slid(ops: dict[str, Merge], windows: dict[str, list[str]], wide: str, span: int, paired: bool = False) -> Callable[[Batches, pa.Schema], Batches]:
    """Spells from rows (key, group, number, first_event_ts_ms, hours, statistics) sorted by the first three.

    A row with ``hours`` (its number is null) names those wanted of a key's group; the others are blocks, in one or several
    parts. ``paired``, a row is for the hours that agree in the window ``wide`` and tells whether its short windows are those of
    its first hour (``fresh``) or, as at all its later hours, empty; what adds is null in place of zero in empty windows.
    """

    def run(batches: Batches, out: pa.Schema) -> Batches:
        held = None
        for b in batches:
            b = _merge_rows(b if held is None else pa.concat_batches([held, b]), 3, ops)
            cut = int(_starts(b.column(0), b.column(1))[-1])
            held = b.slice(cut)
            if cut:
                yield from spells(b.slice(0, cut), out)
        if held is not None:
            yield from spells(held, out)

    def spells(b: pa.RecordBatch, out: pa.Schema) -> Batches:
        key = np.zeros(b.num_rows, dtype=np.int64)
        key[_starts(b.column(0), b.column(1))[1:]] = 1
        key = np.cumsum(key)
        wanted = b.column("hours").is_valid().to_numpy(zero_copy_only=False)
        asked, at = pa.array(np.flatnonzero(wanted)), np.flatnonzero(~wanted)
        hours = b.column("hours").take(asked)
        t, row = hours.flatten().to_numpy(), asked.to_numpy()[pc.list_parent_indices(hours).to_numpy()]
        if not len(t):
            return
        order = np.lexsort((t, row))
        t, row = t[order], row[order]
        number, blocks = b.column(2).take(pa.array(at)).to_numpy(), b.take(pa.array(at))
        least = min(t.min(), number.min(initial=t.min())) - span - 1
        wide_enough = max(t.max(), number.max(initial=t.max())) - least + 2
        found = lambda hour: np.searchsorted(key[at] * wide_enough + (number - least), key[row] * wide_enough + (hour - least))
        high = found(t)
        low = found(t - span) if wide in windows else high
        last = found(t - 1)  # the block of the hour before is there if one lies between
        own = last < high
        new = np.append(True, (row[1:] != row[:-1]) | own[1:] | (own[:-1] & (not paired)) | ((low[1:] != low[:-1]) | (high[1:] != high[:-1]) if wide in windows else False))
        first = np.flatnonzero(new)
        low, high, last = low[first], high[first], last[first]
        columns = [b.column(c).take(pa.array(row[first])) for c in (b.schema.names[0], "first_event_ts_ms")]
        for w, names in windows.items():
            if w != wide:
                side = "l" if w == "5m" else "h"
                columns += [merged(ops[n], blocks.column(f"{side}_{n}"), last, high, not paired) for n in names]
        columns += [merged(ops[n], blocks.column(f"h_{n}"), low, high, not paired) for n in windows.get(wide, [])]
        offsets = pa.array(np.append(first, len(t)).astype(np.int32))
        columns.append(pa.ListArray.from_arrays(offsets, pa.array(t), type=out.field("hours").type))
        yield pa.RecordBatch.from_arrays([*columns, *([pa.array(own[first])] if paired else [])], schema=out)

    return run


def weighted(rounded: set[str], light: set[str]) -> Callable[[Batches, pa.Schema], Batches]:
    """Rows (key, two weights, numbers) become sums of the weights and of each number times its row's weight, over rows of one key that follow each other.

    ``light`` numbers go by the second weight, others by the first; ``rounded`` ones are taken to hundredths, halves away from
    zero. Nulls count for nothing; nulls alone sum up to null.
    """

    def run(batches: Batches, out: pa.Schema) -> Batches:
        for b in batches:
            starts, weights = _starts(b.column(0)), [b.column(i).to_numpy() for i in (1, 2)]
            columns = [b.column(0).take(pa.array(starts)), *[pa.array(np.add.reduceat(w, starts), type=out.field(1).type) for w in weights]]
            for name, column in zip(b.schema.names[3:], b.columns[3:]):
                values, valid = column.to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)
                weight = weights[name in light]
                total = np.add.reduceat(np.where(valid, (_hundredths(values) if name in rounded else values) * weight, 0.0), starts)
                columns.append(pa.array(total, mask=~np.logical_or.reduceat(valid, starts)))
            yield pa.RecordBatch.from_arrays(columns, schema=out)

    return run


def _hundredths(values: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", over="ignore"):
        large = np.abs(values) * 100
        whole = np.floor(large)
        found = np.copysign(whole + (large - whole >= 0.5), values) / 100
    return np.where(np.isfinite(found), found, values)
