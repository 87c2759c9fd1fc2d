"""Removal of passages that an earlier document holds, found by difference-cover anchors.

A window is WINDOW consecutive words of one document; words covered by a window that also starts in a document of a smaller
id go. Anchors are shorter windows at the places whose number, modulo a period, lies in a difference cover: residues such
that any two places are both in the cover after one shift below the period. As an anchor is ``window - period + 1`` words
long, any two equal windows hold an equal anchor at the same distance from their starts. So:

1. anchors meet by hash, and those of two or more documents are shared;
2. a document's anchors are extended: each window that holds a shared one is hashed whole (88 bits) and meets its equals,
   of which all but those of the smallest id are covered;
3. the covered words go. Of texts that are equal as a whole (by 128 bits), only the smallest id's has anchors.

No pairs are made. A task first settles what meets within its own chunks of documents, and sends one row of each hash and
chunk on, so that a passage of a third of all documents reaches the task of its hash once a chunk; what is settled travels
as ranges of places. What is sorted by hash is read as a stream. Texts are shuffled once: all joins use the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count
from math import isqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarmac.llm.common import join_hot, stash, table
from tarmac.session import ship

WINDOW = 13
#: Documents are worked on together until their texts have so many bytes; words are hashed in pieces of about so many.
CHUNK, PIECE = 4 << 20, 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 64
#: Takes the place of a null id: the largest.
NO_ID = (1 << 63) - 1
_SPACES = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_STEP = 0x9E3779B97F4A7C15
_EMPTY = np.empty(0, np.uint64)
_LOW_BITS = np.int64(0xFFFFFFFF)
#: All places, as a range.
ALL = 0x7FFFFFFF


def difference_cover(period: int) -> tuple[int, ...]:
    """Residues of ``period`` whose differences make up all residues: the fewest for small periods, about 2 sqrt(period) else."""
    if period > 24:
        step = isqrt(period - 1) + 1
        return tuple(sorted({*range(step), *range(0, period, step)}))
    for size in count(1):
        for rest in combinations(range(1, period), size - 1):
            cover = (0, *rest)
            if len({(a - b) % period for a in cover for b in cover}) == period:
                return cover


class Hash:
    """64-bit hashes of all words of a piece of text at once: differences of prefix sums of a polynomial over its bytes, mixed."""

    def __init__(self, seed: int):
        self.seed, self.base = seed, xxhash.xxh3_64_intdigest(b"base", seed) | 5
        self.bytes = np.array([xxhash.xxh3_64_intdigest(bytes([i]), seed) for i in range(256)], np.uint64)
        self.powers = self.inverse = _EMPTY

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.powers):
            size = max(len(data) + 1, 2 * PIECE)
            self.powers, self.inverse = (np.cumprod(np.append(np.uint64(1), np.full(size, x, np.uint64)), dtype=np.uint64) for x in (self.base, pow(self.base, -1, 1 << 64)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.bytes[data] * self.powers[: len(data)], out=sums[1:])
        out = (sums[ends] - sums[starts]) * self.inverse[starts]
        out ^= out >> np.uint64(33)
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(29)
        for i in np.flatnonzero(ends - starts > LONG):
            out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), self.seed)
        return out


def bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end: between white space of ASCII."""
    edges = np.flatnonzero(np.diff(_SPACES[data], prepend=True, append=True))
    return edges[::2], edges[1::2]


class Words:
    """The words of documents, one after the other: their hashes, and where each document's begin."""

    hashes: tuple[Hash, Hash] | None = None

    def __init__(self, texts: list[bytes], both: bool = True):
        Words.hashes = Words.hashes or (Hash(1), Hash(2))
        used = Words.hashes if both else Words.hashes[:1]
        found: list[list[np.ndarray]] = [[_EMPTY] for _ in used]
        counts = np.zeros(len(texts), np.int64)
        for first, piece in self._pieces(texts):
            data = np.frombuffer(b" ".join(piece), np.uint8)
            starts, ends = bounds(data)
            for to, of in zip(found, used, strict=True):
                to.append(of(data, starts, ends))
            stops = np.cumsum([len(t) + 1 for t in piece])
            counts[first : first + len(piece)] += np.bincount(np.searchsorted(stops, starts, side="right"), minlength=len(piece))[: len(piece)]
        self.low, self.high = np.concatenate(found[0]), np.concatenate(found[-1])
        self.counts, self.first = counts, np.concatenate([[0], np.cumsum(counts)])
        self.row = np.repeat(np.arange(len(texts)), counts)
        self.place = np.arange(len(self.row)) - self.first[self.row]

    @staticmethod
    def _pieces(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
        """(number of the first, texts) of about PIECE bytes; a longer text comes in several, cut at spaces."""
        held, size, first = [], 0, 0
        for n, text in enumerate(texts):
            begin = 0
            while len(text) - begin > 2 * PIECE and (cut := text.find(b" ", begin + PIECE)) >= 0:
                if held:
                    yield first, held
                    held, size = [], 0
                yield n, [text[begin:cut]]
                begin, first = cut + 1, n
            if not held:
                first = n
            held.append(text[begin:] if begin else text)
            size += len(held[-1])
            if size >= PIECE:
                yield first, held
                held, size = [], 0
        if held:
            yield first, held


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words, from those of runs of powers of two."""
    runs, out, length = words, None, 0
    for bit in range(size.bit_length()):
        if size >> bit & 1:  # runs already put together stand behind this one
            out = runs if out is None else _joined(runs, 1 << bit, out, length)
            length += 1 << bit
        if size >> bit > 1:
            runs = _joined(runs, 1 << bit, runs, 1 << bit)
    return out


def _joined(a: np.ndarray, a_size: int, b: np.ndarray, b_size: int) -> np.ndarray:
    n = max(0, min(len(a), len(b) - a_size))
    return a[:n] * np.uint64(pow(_STEP, b_size, 1 << 64)) + b[a_size : a_size + n]


def _spans(places: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) index of each run of ``places`` that goes on by one between ``breaks`` (True where another row begins)."""
    new = breaks.copy()
    new[1:] |= places[1:] != places[:-1] + 1
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(places)) - 1


class Rule:
    """The window, and what follows from it."""

    def __init__(self, window: int):
        if window < 1:
            raise ValueError("a window has at least one word")
        self.window, self.period = window, (window + 1) // 2
        self.anchor, self.covered = window - self.period + 1, np.isin(np.arange(self.period), difference_cover(self.period))

    def anchors(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(indexes of words, hashes) of the anchors of all texts that are long enough for a window."""
        found = grams(words.low, self.anchor)
        n = len(found)
        fits = words.place[:n] + self.anchor <= words.counts[words.row[:n]]
        at = np.flatnonzero(self.covered[words.place[:n] % self.period] & fits & (words.counts[words.row[:n]] >= self.window))
        return at, found[at] >> np.uint64(16)  # 48 bits do: an anchor taken for shared costs work, not correctness

    def around(self, at: np.ndarray, words: Words) -> np.ndarray:
        """The indexes of all windows that hold an anchor at one of ``at``."""
        edges = np.zeros(len(words.low) + 1, np.int64)
        np.add.at(edges, np.maximum(at - (self.window - self.anchor), words.first[words.row[at]]), 1)
        np.add.at(edges, at + 1, -1)
        whole = words.place + self.window <= words.counts[words.row]
        return np.flatnonzero((np.cumsum(edges[:-1]) > 0) & whole)

    def windows(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """64 and 24 bits of each run of words as long as a window (also of those that lie in two texts)."""
        return grams(words.low, self.window), grams(words.high, self.window) >> np.uint64(40)


def _arrow(df: DataFrame, schema: str, run) -> DataFrame:
    """``mapInArrow`` with numpy columns: ``run`` gets the batches and yields lists of columns."""
    out = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(found):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    ship(df.sparkSession)
    return df.mapInArrow(batches, out)


def _chunks(batches: Iterator[pa.RecordBatch], text_at: int) -> Iterator[list[tuple]]:
    """Rows, gathered until their texts have CHUNK bytes."""
    held, size = [], 0
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            held.append(row)
            size += len(row[text_at])
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


def _starts(*sorted_columns: np.ndarray) -> np.ndarray:
    """Where rows differ from the row before."""
    new = np.ones(len(sorted_columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_columns])
    return new


def _longs(*columns: np.ndarray) -> list[np.ndarray]:
    return [c.view(np.int64) if c.dtype == np.uint64 else c for c in columns]


def _nulls(n: int) -> pa.Array:
    return pa.nulls(n, pa.int64())


def _anchors_of(docs: DataFrame, rule: Rule) -> DataFrame:
    """(anchor, r, span) of (k, r, text, no_id): each anchor once a row and chunk, span null; or, without anchor, a range of those that
    another row of the chunk has too. Of the rows that share an anchor within a chunk, one sends it on, to meet other chunks'.
    """

    def run(batches):
        for rows in _chunks(batches, 2):
            words, r = Words([x[2] for x in rows], both=False), np.array([x[1] for x in rows], np.int64)
            at, found = rule.anchors(words)
            if not len(at):
                continue
            row = words.row[at]
            order = np.lexsort((row, found))
            anchor, by = found[order], row[order]
            first = _starts(anchor)
            group = np.cumsum(first) - 1
            shared = np.maximum.reduceat(by, np.flatnonzero(first)) != by[first]
            one = np.sort(order[first])  # in order of documents, which packs better
            yield [*_longs(found[one]), r[row[one]], _nulls(len(one))]
            known = np.sort(order[shared[group]])
            if len(known):
                a, z = _spans(known, _starts(row[known]))
                places = words.place[at]
                yield [_nulls(len(a)), r[row[known[a]]], places[known[a]] << 32 | places[known[z]]]

    return _arrow(docs, "anchor long, r long, span long", run)


def _shared(anchors: DataFrame) -> DataFrame:
    """(r, anchor, span): the anchors that two or more chunks have (a row and its neighbour in the order of hashes agree), and the ranges."""

    def run(batches):
        held = None
        for batch in batches:
            known = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                some = batch.filter(pa.array(known))
                yield [some.column(1), some.column(0), some.column(2)]
                batch = batch.filter(pa.array(~known))
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:2]] + [np.zeros(len(batch), bool)]
            held = [np.concatenate(c) for c in zip(held, now, strict=True)] if held else now
            if not len(held[0]):
                continue
            new = _starts(held[0])
            same = held[2] | ~new | ~np.append(new[1:], True)
            keep = same[:-1]  # the last row waits for its neighbour
            yield [held[1][:-1][keep], held[0][:-1][keep], _nulls(int(keep.sum()))]
            held = [held[0][-1:], held[1][-1:], same[-1:]]
        if held and len(held[2]) and held[2][0]:
            yield [held[1], held[0], _nulls(1)]

    met = anchors.repartition(F.expr("coalesce(anchor, r)")).sortWithinPartitions("anchor")
    return _arrow(met, "r long, anchor long, span long", run)


def _windows_of(joined: DataFrame, rule: Rule) -> DataFrame:
    """(low, tail, k, r): windows of (k, r, text, no_id, anchors, spans) that hold a shared anchor, each once a row and chunk (tail: more
    bits, and the place); or, without low, a range of those that the chunk has under a smaller k. Those of the smallest go on.
    """

    def run(batches):
        for rows in _chunks(batches, 2):
            words = Words([x[2] for x in rows])
            at, found = rule.anchors(words)
            ends = np.searchsorted(words.row[at], np.arange(len(rows) + 1))
            hit = np.zeros(len(at), bool)
            for n, x in enumerate(rows):
                own = slice(ends[n], ends[n + 1])
                if x[4]:
                    hit[own] = np.isin(found[own], np.array(x[4], np.int64).view(np.uint64))
                for span in x[5]:
                    places = words.place[at[own]]
                    hit[own] |= (places >= span >> 32) & (places <= span & 0xFFFFFFFF)
            at = rule.around(at[hit], words)
            if not len(at):
                continue
            low, high = (x[at] for x in rule.windows(words))
            row, place = words.row[at], words.place[at]
            k, r = np.array([x[0] for x in rows], np.int64), np.array([x[1] for x in rows], np.int64)
            order = np.lexsort((place, row, k[row], high, low))
            first = _starts(low[order], high[order])
            least = k[row[order[np.flatnonzero(first)]]][np.cumsum(first) - 1]
            known = k[row[order]] > least
            once = np.sort(order[~known & _starts(low[order], high[order], row[order])])
            yield [*_longs(low[once]), high[once].astype(np.int64) << 32 | place[once], k[row[once]], r[row[once]]]
            known = np.sort(order[known])
            if len(known):
                a, z = _spans(place[known], _starts(row[known]))
                some = row[known[a]]
                yield [_nulls(len(a)), place[known[a]] << 32 | place[known[z]], k[some], r[some]]

    return _arrow(joined, "low long, tail long, k long, r long", run)


def _covered(windows: DataFrame) -> DataFrame:
    """(k, r, span): ranges of places at which windows start that start under a smaller k as well."""

    def run(batches):
        last = None  # (low, high, smallest k) of the last window of the batch before
        for batch in batches:
            known = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if known.any():
                some = batch.filter(pa.array(known))
                yield [some.column(2), some.column(3), some.column(1)]
                batch = batch.filter(pa.array(~known))
            if not len(batch):
                continue
            low, tail, k, r = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            high, place = tail >> 32, tail & _LOW_BITS
            new = _starts(low, high)
            least = k[np.flatnonzero(new)]
            if last and (low[0], high[0]) == last[:2]:
                least[0] = last[2]
            last = (low[-1], high[-1], least[-1])
            hit = k > least[np.cumsum(new) - 1]
            yield [k[hit], r[hit], place[hit] << 32 | place[hit]]

    met = windows.repartition(F.expr("coalesce(low, r)")).sortWithinPartitions("low", F.expr("shiftright(tail, 32)"), "k")
    return _arrow(met, "k long, r long, span long", run)


def _kept(joined: DataFrame, rule: Rule) -> DataFrame:
    """(no_id, k, n_words, n_removed, kept) of (k, r, text, no_id, spans)."""

    def cut(text: bytes, spans: list[int]) -> tuple[int, int, bytes]:
        words = Words([text])
        low, high = rule.windows(words)
        edges = np.zeros(len(low) + 1, np.int64)
        for span in spans:
            edges[min(span >> 32, len(low))] += 1
            edges[min((span & 0xFFFFFFFF) + 1, len(low))] -= 1
        at = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        found = np.isin(low, low[at])
        if found.sum() > len(at):  # equal windows of one text were sent once
            _, same = np.unique(np.stack([low, high], axis=1), axis=0, return_inverse=True)
            found = np.isin(same.ravel(), same.ravel()[at])
        at = np.flatnonzero(found)
        edges = np.zeros(len(words.low) + 1, np.int64)
        edges[at] += 1
        np.add.at(edges, at + rule.window, -1)
        keep = np.cumsum(edges[:-1]) == 0
        starts, ends = bounds(np.frombuffer(text, np.uint8))
        rest = [text[a:z] for a, z in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]
        return len(keep), len(keep) - len(rest), b" ".join(rest)

    def run(batches):
        for rows in _chunks(batches, 2):
            out = []
            for k, _, text, no_id, found in rows:
                spans = [x["span"] for x in found or () if x["k"] == k]
                if spans:
                    out.append((no_id, k, *cut(text, spans)))
                else:
                    found = text.split()  # as bytes, it cuts at white space of ASCII only
                    out.append((no_id, k, len(found), 0, b" ".join(found)))
            yield list(zip(*out, strict=True))

    return _arrow(joined, "no_id boolean, k long, n_words long, n_removed long, kept binary", run)


def _copies(source: DataFrame) -> DataFrame:
    """(k, r) of the rows whose whole text a smaller k has."""
    keys = stash(source.select("k", "r", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2")), "text-keys")
    first = stash(keys.groupBy("h1", "h2").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("rows")).where("rows > 1"), "first-copies")
    return join_hot(keys, first, ["h1", "h2"], "rows", "inner").where("k > least").select("k", "r")


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept) for each row: its words (kept: joined by one space) without those that an earlier document repeats.

    Earlier is a smaller id; a null id counts as the largest of all, and rows of one id don't act on each other, nor does a
    document on itself. Null and empty texts have no words; texts shorter than the window keep theirs; an empty table gives
    no row; other columns don't matter. Rows that agree in id and text meet in one task, as a stream.
    """
    rule = Rule(window)
    given = F.col(f"`{id_col}`").cast("long")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    source = docs.select(F.coalesce(given, F.lit(NO_ID)).alias("k"), F.xxhash64(given, given.isNull(), text).alias("r"), text.alias("text"), given.isNull().alias("no_id"))
    parted, copies = source.select("k", "r", "text", "no_id"), _copies(source)
    single = parted.join(copies.select("r").hint("shuffle_merge"), "r", "left_anti")
    shared = _shared(_anchors_of(single.select("k", "r", "text", "no_id"), rule)).groupBy("r").agg(F.collect_set("anchor").alias("anchors"), F.collect_set("span").alias("spans"))
    windows = _windows_of(parted.join(shared, "r").select("k", "r", "text", "no_id", "anchors", "spans"), rule)
    places = _covered(windows).unionByName(copies.withColumn("span", F.lit(ALL).cast("long")))
    places = places.groupBy("r").agg(F.collect_set(F.struct("k", "span")).alias("spans"))
    kept = _kept(parted.join(places, "r", "left").select("k", "r", "text", "no_id", "spans"), rule)
    return kept.select(F.when(~F.col("no_id"), F.col("k")).alias("id"), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))
