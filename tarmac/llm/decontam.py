"""Benchmark decontamination by SimHash of item-sized windows and multi-index Hamming blocks.

Texts are lower-cased and cut into words (runs of letters, digits and underscores). For an item of n words, every window
of n words of a document is compared by its five-word shingles (an item of fewer words is one shingle), each weighted by
how often it occurs: similarity is the sum of the smaller weights over the sum of the larger ones.

Each window's 64-bit SimHash (rolling sums of the bits of its shingles' hashes) is looked up in eight tables of 8-bit
blocks. Fingerprints within ``RADIUS`` = 23 bits differ by two bits or fewer in one block at least, and each table holds,
for every value, the items within two bits of it, so all fingerprints within the radius are found. The exact similarity of
the candidates then decides. At a similarity of 0.8 the expected distance is 9.6 bits with a deviation of 2.8, so the radius
lies over four deviations beyond it (a test measures the loss).

A sieve spares most of the work: a window of similarity above zero shares a shingle with its item, so only windows that hold
a shingle of some item of their size need a fingerprint. Without it (``sieve=False``) every window gets one; the results are
the same, as a test shows.

The benchmark is read in blocks of ``ITEMS_PER_BLOCK`` items and ``BYTES_PER_BLOCK`` bytes, each sent to the executors in
turn, so what is broadcast stays bounded whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import filter_rows, map_rows, table

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
ITEMS_PER_BLOCK = 20_000
BYTES_PER_BLOCK = 16 << 20
PAIRS = 1 << 22
FILTER_BITS = 22
WORD = re.compile(r"\w+")
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    LIMIT = 500_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A well-mixed 64-bit hash of each run of k words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for i in range(1, k):
        h = h * MULTIPLIER + words[i : i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def simhashes(shingles: np.ndarray, span: int) -> np.ndarray:
    """The SimHash of each run of ``span`` shingles: a bit is 1 if it is set in over half of them."""
    bits = np.unpackbits(shingles.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)
    sums = np.vstack([np.zeros((1, 64), dtype=np.int32), np.cumsum(bits, axis=0, dtype=np.int32)])
    ones = sums[span:] - sums[:-span]
    return np.packbits(2 * ones > span, axis=1).view("<u8").reshape(-1)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two multisets of shingles."""
    both = sum(min(n, b[s]) for s, n in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


def shingles_of(words: list[str], k: int) -> Counter:
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


class Blocks:
    """Items of one size by the blocks of their fingerprints."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        values = np.arange(1 << BLOCK_BITS, dtype=np.uint64)
        self.near = [np.bitwise_count(values[:, None] ^ self.block(prints, b)[None, :]) <= BLOCK_RADIUS for b in range(BLOCKS)]

    @staticmethod
    def block(prints: np.ndarray, b: int) -> np.ndarray:
        return prints >> np.uint64(BLOCK_BITS * b) & np.uint64((1 << BLOCK_BITS) - 1)

    def within(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, differing bits) of all pairs within the radius: look-ups in each block's table, then a count."""
        out, step = [], max(1, PAIRS // len(self.prints))
        for at in range(0, len(windows), step):
            some = windows[at : at + step]
            met = self.near[0][self.block(some, 0).astype(np.int64)]
            for b in range(1, BLOCKS):
                met |= self.near[b][self.block(some, b).astype(np.int64)]
            w, i = np.nonzero(met)
            bits = np.bitwise_count(some[w] ^ self.prints[i])
            close = bits <= RADIUS
            out.append((w[close] + at, i[close], bits[close].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Index:
    """What is looked up for one block of the benchmark: items by size and fingerprint, and the sieve's shingles."""

    def __init__(self, items: list[tuple[int, str]]):
        hashes = WordHashes()
        self.hashes = hashes
        self.items: list[tuple[int, int, int, str]] = []  # id, words, shingle size, text
        self.shingled: dict[int, Counter] = {}
        sized, parts = defaultdict(list), defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k = min(SHINGLE, len(words))
            shingles = shingle_hashes(hashes.of(words), k)
            sized[len(words), k].append((len(self.items), simhashes(shingles, len(shingles))[0]))
            parts[k].append((shingles, np.full(len(shingles), len(self.items))))
            self.items.append((item_id, len(words), k, text))
        self.sized = {key: (np.array([i for i, _ in x]), Blocks(np.array([p for _, p in x], dtype=np.uint64))) for key, x in sized.items()}
        self.sizes = np.array([x[1] for x in self.items], dtype=np.int64)
        self.shingles = {}
        for k, found in parts.items():
            h, item = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(h, kind="stable")
            sieve = np.zeros(1 << FILTER_BITS, dtype=bool)
            sieve[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)] = True
            self.shingles[k] = h[order], item[order], sieve

    def shingles_of_item(self, i: int) -> Counter:
        if i not in self.shingled:
            if len(self.shingled) >= 5000:
                self.shingled.clear()
            self.shingled[i] = shingles_of(words_of(self.items[i][3]), self.items[i][2])
        return self.shingled[i]

    def sieved(self, hashes: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """By item size and shingle size: the starts of the windows that hold a shingle of an item of that size."""
        out: dict[tuple[int, int], set[int]] = defaultdict(set)
        total = len(hashes)
        for k, (known, item, sieve) in self.shingles.items():
            h = shingle_hashes(hashes, k)
            maybe = np.flatnonzero(sieve[(h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
            if not len(maybe):
                continue
            left, right = np.searchsorted(known, h[maybe], "left"), np.searchsorted(known, h[maybe], "right")
            places = defaultdict(set)
            for p, a, b in zip(maybe.tolist(), left.tolist(), right.tolist(), strict=True):
                for n in set(self.sizes[item[a:b]].tolist()):
                    places[n].add(p)
            for n, at in places.items():
                last = max(0, total - n)
                for p in at:
                    out[n, k].update(range(min(max(0, p + k - n), last), min(p, last) + 1))
        return {key: np.array(sorted(starts)) for key, starts in out.items()}

    def hits(self, text: str | None, sieve: bool = True):
        """(item id, similarity, first word, differing bits) of the best window for each item that the text holds."""
        words = words_of(text)
        hashes = self.hashes.of(words)
        best: dict[int, tuple[float, int, int]] = {}
        starts_of = self.sieved(hashes) if sieve else {key: np.arange(max(0, len(words) - key[0]) + 1) for key in self.sized}
        for (n, k), starts in starts_of.items():
            size = min(n, len(words))
            span = size - k + 1
            if span < 1:
                continue
            items, blocks = self.sized[n, k]
            for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
                prints = simhashes(shingle_hashes(hashes[run[0] : run[-1] + size], k), span)
                last, window = -1, Counter()
                for w, i, bits in zip(*(x.tolist() for x in blocks.within(prints)), strict=True):
                    start, item = int(run[w]), int(items[i])
                    if start != last:
                        last, window = start, shingles_of(words[start : start + size], k)
                    s = similarity(window, self.shingles_of_item(item))
                    if s >= SIMILARITY and (item not in best or (-s, start) < (-best[item][0], best[item][1])):
                        best[item] = s, start, bits
        return [(self.items[i][0], *x) for i, x in sorted(best.items())]


_indexes: dict[int, Index] = {}


def _index(sent) -> Index:
    """The index that a worker builds once for each broadcast."""
    key = sent.value[0]
    if key not in _indexes:
        _indexes.clear()
        _indexes[key] = Index(sent.value[1])
    return _indexes[key]


def benchmark_blocks(benchmark: DataFrame):
    """Lists of (item_id, text) with at most ``ITEMS_PER_BLOCK`` items, cut by a hash of the id. Null texts are ignored."""
    items = benchmark.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    n, size = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // ITEMS_PER_BLOCK), -(-size // BYTES_PER_BLOCK))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield sorted({(r.item_id, r.text) for r in part.toLocalIterator()})


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, hamming): the best window of each document for each item it holds.

    Null and empty texts hold nothing; repeated rows are repeated; a null doc_id is returned as null. Ties go to the
    first window. An empty benchmark or an empty table gives an empty result.
    """
    schema = "doc_id long, item_id long, similarity double, first_word long, hamming int"
    spark, out = docs.sparkSession, None
    source = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    for number, items in enumerate(benchmark_blocks(benchmark)):
        sent = spark.sparkContext.broadcast((hash((number, tuple(items))), items))

        def rows(columns, sent=sent):
            index = _index(sent)
            for doc_id, text in zip(*columns, strict=True):
                for hit in index.hits(text):
                    yield doc_id, *hit

        found = map_rows(source, schema, rows)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, all columns as they are.

    Null and empty texts hold nothing and stay; repeated rows stay or go together; ids are not looked at. An empty
    benchmark removes nothing; an empty table stays empty.
    """
    for number, items in enumerate(benchmark_blocks(benchmark)):
        sent = docs.sparkSession.sparkContext.broadcast((hash((number, tuple(items))), items))

        def keep(columns, sent=sent):
            index = _index(sent)
            return [not index.hits(text) for text in columns[0]]

        docs = filter_rows(docs, ["text"], keep)
    return docs


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
