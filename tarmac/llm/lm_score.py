"""Language-model scores by masked pseudo-likelihood.

Texts are lower-cased and cut at white space. The ``VOCABULARY`` most frequent words of the whole corpus (exact counts of
64-bit word hashes) are types of their own; the others are unknown words, in ``UNKNOWN`` types by their hash. A network sees
``SIDE`` tokens on the left and as many on the right of a masked token and predicts it: each position has an embedding
table, their sum goes through a hidden layer, and a two-level softmax over all types follows, in which both levels depend
on the hidden layer: first the class (types by falling count, ``CLASSES`` classes of like size), then the type within it.
A document's score is the sum of the conditional log-probabilities of all its tokens.

The network is trained in numpy on the executors, on every document: rows are dealt into ``ROUNDS`` rounds
and, within a round, into shards of some ``SHARD_TOKENS`` tokens by a hash of the row (copies of a text spread over them), and
stand in a shard in the order of that hash. Each shard starts from the round's weights and runs gradient steps over all its
texts, in which every token is predicted from its context; the shards' weights are then averaged by tokens in whole numbers,
so that the order of adding doesn't matter.
Neither the cluster nor a rerun changes the result. The driver only holds one set of weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import row_keys, stash, table
from tarmac.session import ship

VOCABULARY = 3072
UNKNOWN = 1024
TYPES = VOCABULARY + UNKNOWN
CLASSES = 64
SIDE = 2
HIDDEN = 32
ROUNDS = 3
SHARD_TOKENS = 4_000_000
BATCH = 8192
RATE, TABLE_RATE, TYPE_RATE = 0.2, 0.3, 0.1
PART = 256
SCALE = 1 << 16
PIECE = 8192
CHUNK = 8192
SLICE = 512
SPAN = 32
TEXT_BYTES = 1 << 20
WORDS_HELD = 1_000_000
SEED = 11
#: Texts of these characters only have the same lower case in Arrow and in Python.
LATIN = r"^[\x00-\x7f\xa0-\x{12f}\x{131}-\x{24f}]*$"
#: Words of up to so many bytes are hashed all at once, the few longer ones by xxhash.
SHORT = 32
_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_ODD = [np.uint64(n) for n in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


class Types:
    """Types of words by their hash. ``known`` has the type of each hash of the vocabulary."""

    def __init__(self, known: dict[int, int]):
        self.hashes = np.array([*sorted(known), -1], dtype=np.int64)
        self.types = np.array([*(known[h] for h in sorted(known)), -1], dtype=np.int16)

    def by_hash(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes[:-1], hashes)
        return np.where(self.hashes[at] == hashes, self.types[at], VOCABULARY + hashes % UNKNOWN).astype(np.int16)

    def of(self, text: str | None) -> np.ndarray:
        return self.by_hash(word_hashes(pa.array([text or ""]))[0])


def word_hash(word: str) -> int:
    data = np.frombuffer(word.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    return int(hash_bytes(data, np.array([0]), np.array([len(data)]))[0])


def hash_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """63-bit hashes of strings within ``data``, eight bytes of all strings at a time; those of one size up to 8 bytes
    only meet by the bit that is left out."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    h = sizes.astype(np.uint64) * _ODD[0]
    for at in range(0, SHORT, 8):
        which = np.flatnonzero(sizes > at)
        if not len(which):
            break
        x = eight[starts[which] + at]
        x &= _FIRST_BYTES[np.minimum(sizes[which] - at, 8)]
        x ^= h[which]
        for n, shift in zip(_ODD[1:], (32, 29), strict=True):
            x *= n
            x ^= x >> np.uint64(shift)
        h[which] = x
    for i in np.flatnonzero(sizes > SHORT):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : starts[i] + sizes[i]])
    return (h >> np.uint64(1)).astype(np.int64)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts in turn, the texts' numbers of words); a null has none.

    Words are those of Python's ``lower().split()``: Arrow splits at the same characters.
    """
    texts = pc.fill_null(texts, "")
    other = pc.invert(pc.match_substring_regex(texts, LATIN))
    low = pc.utf8_lower(texts)
    if pc.any(other).as_py():
        low = pc.replace_with_mask(low, other, pa.array([t.lower() for t in texts.filter(other).to_pylist()], texts.type))
    found = pc.utf8_split_whitespace(low)
    words, bounds = found.values, found.offsets.to_numpy()
    if not len(words):
        return np.zeros(0, dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
    places = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, sizes = words.buffers()[2], np.diff(places)
    kept = sizes > 0  # white space at an end of a text leaves an empty word
    hashes = hash_bytes(np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, dtype=np.uint8), places[:-1], sizes)
    return hashes[kept], np.diff(np.r_[0, np.cumsum(kept)][bounds])


def portions(batch: pa.RecordBatch, column: int):
    """The batch in runs of rows of about ``TEXT_BYTES`` in a column of texts; a longer text is a run of its own."""
    ends, begin = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)), 0
    while begin < len(ends):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + TEXT_BYTES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def shapes() -> list[tuple[int, ...]]:
    """A table for each position (one more row stands beyond a text's ends), offsets, classes, and the types by class."""
    return [(2 * SIDE, TYPES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,), (TYPES, HIDDEN), (TYPES,)]


def fresh(counts: np.ndarray) -> np.ndarray:
    """Weights to start with: small ones, and offsets that give each type about its share of the corpus."""
    rng, classes = np.random.default_rng(SEED), Classes(counts)
    tables, hidden, out, class_offsets, types, type_offsets = (np.zeros(s) for s in shapes())
    for x in (tables, out, types):
        x[:] = rng.normal(0, 0.05, x.shape)
    mass = np.add.reduceat(counts + 0.5, classes.starts[:-1])
    class_offsets[:] = np.log(mass / mass.sum())
    type_offsets[:] = np.log((counts + 0.5) / mass[classes.kind])
    return np.concatenate([x.ravel() for x in (tables, hidden, out, class_offsets, types, type_offsets)]).astype(np.float32)


def unpack(flat: np.ndarray) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes():
        n = int(np.prod(s))
        out.append(flat[at : at + n].reshape(s))
        at += n
    return out


class Classes:
    """Where the classes start among the types (which stand by falling count, unknown ones last), and each type's class.

    Frequent types have small classes, so that the classes' shares don't differ much: cut where the mass is even, and into
    classes of no more than four times the average size.
    """

    def __init__(self, counts: np.ndarray):
        mass, most = np.cumsum(counts + 0.5), 4 * TYPES // CLASSES
        starts, last = [0], 0
        for k in range(1, CLASSES):
            even = int(np.searchsorted(mass, mass[-1] * k / CLASSES))
            least = TYPES - (CLASSES - k) * most  # what is left must fit into the other classes
            last = min(max(even, last + 1, least), last + most, TYPES - (CLASSES - k))
            starts.append(last)
        self.starts = np.array([*starts, TYPES])
        self.kind = np.repeat(np.arange(CLASSES), np.diff(self.starts)).astype(np.int16)

    def groups(self, kinds: np.ndarray):
        """(first token, last, first type, last) of each class among tokens sorted by class."""
        at = np.searchsorted(kinds, np.arange(CLASSES + 1)).tolist()
        starts = self.starts.tolist()
        for k in range(CLASSES):
            if at[k] < at[k + 1]:
                yield at[k], at[k + 1], starts[k], starts[k + 1]


def windows(flat: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each token of the texts (one after the other) the types around it in its own text, left to right."""
    place = np.arange(len(flat)) + SIDE * (np.repeat(np.arange(len(lengths)), lengths) + 1)
    padded = np.full(len(flat) + SIDE * (len(lengths) + 1), TYPES, dtype=np.int16)
    padded[place] = flat
    return np.stack([padded[place + i] for i in range(-SIDE, SIDE + 1) if i], axis=0)


def add_rows(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``target[at] -= rows``; of a place that repeats, the sum over the root of its number counts, which keeps steps stable.

    Rows are sorted by place; running sums within spans of rows are a product, and a place's sum is a difference of these.
    """
    n, width = len(at), rows.shape[1]
    order = np.argsort(at, kind="stable")
    places = at[order]
    last = np.flatnonzero(np.r_[places[1:] != places[:-1], True])
    spans = np.zeros((-(-n // SPAN), SPAN, width), dtype=np.float32)
    np.take(rows, order, axis=0, out=spans.reshape(-1, width)[:n], mode="clip")
    running = np.tril(np.ones((SPAN, SPAN), dtype=np.float32)) @ spans
    before = np.zeros((len(spans), width))
    np.cumsum(running[:-1, -1], axis=0, dtype=np.float64, out=before[1:])
    ends = np.take(before, last // SPAN, axis=0)
    ends += np.take(running.reshape(-1, width), last, axis=0)
    ends[1:] -= ends[:-1].copy()
    ends /= np.sqrt(np.diff(last, prepend=-1))[:, None]
    places = places[last].astype(np.intp)
    target[places] = np.take(target, places, axis=0) - ends


def row_sums(z: np.ndarray) -> np.ndarray:
    """By a product with ones, which is several times faster than a sum over short rows."""
    return z @ np.ones(z.shape[1], z.dtype)


def hidden_layer(tables: np.ndarray, hidden: np.ndarray, around: np.ndarray) -> np.ndarray:
    """With a last column of ones, by which offsets are a column of weights."""
    h = np.ones((around.shape[1], HIDDEN + 1), dtype=np.float32)
    for at in range(0, len(h), SLICE):  # temporary arrays stay in the processor's cache
        x = around[:, at : at + SLICE]
        some = np.take(tables[0], x[0], axis=0)
        for t, places in zip(tables[1:], x[1:], strict=True):
            some += np.take(t, places, axis=0)
        some += hidden
        np.tanh(some, out=h[at : at + SLICE, :HIDDEN])
    return h


def with_offsets(rows: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, offsets[:, None]], axis=1)


def gradients(h: np.ndarray, weights: np.ndarray, wanted: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of a softmax over the rows of ``weights``, by the hidden layer and by the weights. ``wanted``: where the right row of
    each token stands among the products, counted through. ``safe``: no value is too large for exp.

    Exponentials aren't divided by their sum; the smaller factors of both products are.
    """
    q = h @ weights.T
    if not safe:
        q -= q.max(axis=1, keepdims=True)
    np.exp(q, out=q)
    total = row_sums(q)
    q.reshape(-1)[wanted] -= total
    share = (1 / total)[:, None]
    back = q @ weights[:, :HIDDEN]
    back *= share
    return back, q.T @ (h * share)


def train(flat: np.ndarray, around: np.ndarray, types: np.ndarray, classes: Classes) -> None:
    """Gradient steps over all windows in batches: every token is predicted from those around it; changes ``flat``."""
    tables, hidden, out, class_offsets, v, type_offsets = unpack(flat)
    outer, inner = with_offsets(out.T, class_offsets), with_offsets(v, type_offsets)
    for at in range(0, len(types), BATCH):
        y = types[at : at + BATCH]
        order = np.argsort(y, kind="stable")
        y, c = y[order], np.take(around[:, at : at + BATCH], order, axis=1)
        kinds, n = classes.kind[y], len(y)
        safe = all(bounded(w[:, :HIDDEN], w[:, HIDDEN]) for w in (outer, inner))
        h = hidden_layer(tables, hidden, c)
        back, step = np.empty((n, HIDDEN), dtype=np.float32), np.zeros_like(outer)
        wanted = kinds + np.arange(n) % SLICE * CLASSES
        for a in range(0, n, SLICE):
            back[a : a + SLICE], part = gradients(h[a : a + SLICE], outer, wanted[a : a + SLICE], safe)
            step += part
        outer -= np.float32(RATE / n) * step
        for a, b, low, high in classes.groups(kinds):
            if high - low == 1:
                continue
            some, step = gradients(h[a:b], inner[low:high], np.arange(-low, (b - a) * (high - low) - low, high - low) + y[a:b], safe)
            back[a:b] += some
            inner[low:high] -= np.float32(TYPE_RATE / np.sqrt(b - a)) * step
        back *= 1 - h[:, :HIDDEN] * h[:, :HIDDEN]
        hidden -= np.float32(RATE / n) * row_sums(back.T)
        back *= np.float32(TABLE_RATE)
        for t, x in zip(tables, c, strict=True):
            add_rows(t, x, back)
    out[:], class_offsets[:] = outer[:, :HIDDEN].T, outer[:, HIDDEN]
    v[:], type_offsets[:] = inner[:, :HIDDEN], inner[:, HIDDEN]


def log_probabilities(flat: np.ndarray, types: np.ndarray, lengths: np.ndarray, classes: Classes) -> np.ndarray:
    """Of every token of the texts in turn, in pieces that bound the memory of a long text."""
    tables, hidden, out, class_offsets, v, type_offsets = unpack(flat)
    outer, inner = with_offsets(out.T, class_offsets), with_offsets(v, type_offsets)
    around, found = windows(types, lengths), np.empty(len(types))
    safe = bounded(out.T, class_offsets) and bounded(v, type_offsets)

    def chosen(h: np.ndarray, weights: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        z = h @ weights.T
        some = z.reshape(-1)[wanted]
        some -= log_sum(z, safe)
        return some

    for at in range(0, len(types), CHUNK):
        y = types[at : at + CHUNK]
        order = np.argsort(y, kind="stable")
        y, c = y[order], np.take(around[:, at : at + CHUNK], order, axis=1)
        kinds, h = classes.kind[y], hidden_layer(tables, hidden, c)
        wanted = kinds + np.arange(len(y)) % SLICE * CLASSES
        some = np.concatenate([chosen(h[a : a + SLICE], outer, wanted[a : a + SLICE]) for a in range(0, len(y), SLICE)])
        for a, b, low, high in classes.groups(kinds):
            if high - low > 1:
                some[a:b] += chosen(h[a:b], inner[low:high], np.arange(-low, (b - a) * (high - low) - low, high - low) + y[a:b])
        found[at + order] = some
    return found


def bounded(rows: np.ndarray, offsets: np.ndarray) -> bool:
    """Whether no product of a hidden layer (within -1 and 1) with ``rows``, plus the offsets, can leave float32's range for exp."""
    return bool(row_sums(np.abs(rows)).max() + np.abs(offsets).max() < 80)


def log_sum(z: np.ndarray, safe: bool = False) -> np.ndarray:
    """The logarithm of the sum of each row's exponentials; uses up ``z``. ``safe``: no value is too large for exp."""
    if safe:
        np.exp(z, out=z)
        return np.log(row_sums(z))
    top = z.max(axis=1)
    z -= top[:, None]
    np.exp(z, out=z)
    top += np.log(row_sums(z))
    return top


def vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[list[int], int, np.ndarray]:
    """(hashes of the most frequent words by falling count, ties by hash; tokens in all; counts of the types).

    The words of the whole corpus are counted: a task adds up its own, and a grouped sum the tasks'.
    """

    def run(batches):
        held, size = [], 0

        def part() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(n)], names=["word", "n"])

        for batch in batches:
            for some in portions(batch, 0):  # what a task holds is bounded
                held.append(word_hashes(some.column(0))[0])
                size += len(held[-1])
                if size >= WORDS_HELD:
                    yield part()
                    held, size = [], 0
        if size:
            yield part()

    ship(docs.sparkSession)
    counts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stash(counts, "words")
    top = counts.orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    known = docs.sparkSession.createDataFrame([(r.word,) for r in top], "word long")
    rest = counts.join(F.broadcast(known), "word", "left_anti").groupBy((F.col("word") % UNKNOWN).alias("bucket")).agg(F.sum("n").alias("n")).collect()
    found = np.zeros(TYPES)
    found[: len(top)] = [r.n for r in top]
    for r in rest:
        found[VOCABULARY + r.bucket] = r.n
    return [r.word for r in top], int(found.sum()), found


def encode(docs: DataFrame, words: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, k1, types array<smallint>): every text as its types, stored."""
    sent = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def run(batches):
        types = Types(sent.value)
        for batch in batches:
            for some in portions(batch, 2):
                hashes, lengths = word_hashes(some.column(2))
                found = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(types.by_hash(hashes)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), found], names=["id", "k1", "types"])

    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), row_keys(docs)[0].alias("k1"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return stash(source.mapInArrow(run, "id long, k1 long, types array<smallint>"), "encoded")


def lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, and the lists' lengths."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def fit(encoded: DataFrame, tokens: int, counts: np.ndarray) -> np.ndarray:
    """Weights after all rounds over the encoded texts. Without any token they stay at their start."""
    flat, classes = fresh(counts), Classes(counts)
    shards = max(1, -(-tokens // (ROUNDS * SHARD_TOKENS)))
    ship(encoded.sparkSession)
    for r in range(ROUNDS):
        sent = encoded.sparkSession.sparkContext.broadcast((flat, classes))
        turn = encoded.where((F.pmod("k1", F.lit(ROUNDS)) == r) & (F.size("types") > 0)).withColumn("shard", F.pmod(F.expr(f"k1 div {ROUNDS}"), F.lit(shards)))
        turn = turn.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "k1", "types").select("shard", "types")

        def run(batches, sent=sent):
            shard, weights, seen, held, size = None, None, 0, [], 0

            def learn():
                nonlocal held, size, seen
                if held:
                    types, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
                    train(weights, windows(types, lengths), types, sent.value[1])
                    seen, held, size = seen + len(types), [], 0

            def parts():
                scaled = np.rint(weights.astype(np.float64) * SCALE) * seen
                cut = [scaled[i : i + PART] for i in range(0, len(scaled), PART)]
                for at in range(0, len(cut), 512):
                    some = cut[at : at + 512]
                    arrays = [pa.array(range(at, at + len(some)), pa.int32()), pa.array([float(seen)] * len(some)), pa.array(some, pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["part", "seen", "value"])

            for batch in batches:
                of = batch.column(0).to_numpy()
                for low, high in zip(*_runs(of), strict=True):
                    if of[low] != shard:  # partitions may hold several shards, each is trained on its own
                        if weights is not None:
                            learn()
                            yield from parts()
                        shard, weights, seen = of[low], sent.value[0].copy(), 0
                    types, lengths = lists(batch.column(1).slice(low, high - low))
                    ends = np.cumsum(lengths)
                    begin = 0
                    while begin < len(lengths):  # texts in groups of about PIECE tokens; a long one is a group of its own
                        done = ends[begin - 1] if begin else 0
                        end = max(begin + 1, int(np.searchsorted(ends, done + PIECE - size)))
                        held.append((types[done : ends[end - 1]], lengths[begin:end]))
                        size += int(ends[end - 1] - done)
                        begin = end
                        if size >= PIECE:
                            learn()
            if weights is not None:
                learn()
                yield from parts()

        trained = turn.mapInArrow(run, "part int, seen double, value array<double>")
        total = trained.groupBy("part").agg(Summarizer.sum(array_to_vector(F.col("value"))).alias("value"), F.sum("seen").alias("seen"))
        found = total.orderBy("part").collect()  # the size of one set of weights
        if found:
            flat = np.concatenate([p["value"].toArray() / (p["seen"] * SCALE) for p in found]).astype(np.float32)
    return flat


def _runs(of: np.ndarray) -> tuple[list[int], list[int]]:
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]).tolist() if len(of) else []
    return first, [*first[1:], len(of)] if first else []


def score(encoded: DataFrame, weights: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob): one row per encoded row, every token of the whole text.

    Texts without tokens have log_prob 0 and a null mean.
    """
    sent = encoded.sparkSession.sparkContext.broadcast((weights, Classes(counts)))

    def run(batches):
        weights, classes = sent.value
        for batch in batches:
            types, lengths = lists(batch.column(1))
            totals, ends, begin = np.zeros(len(lengths)), np.cumsum(lengths), 0
            while begin < len(lengths):
                done = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, done + PIECE)))
                n = lengths[begin:end]
                if ends[end - 1] > done:
                    values = log_probabilities(weights, types[done : ends[end - 1]], n, classes)
                    totals[begin:end] = np.bincount(np.repeat(np.arange(len(n)), n), weights=values, minlength=len(n))
                begin = end
            mean = pa.array(totals / np.maximum(lengths, 1), mask=lengths == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int64)), pa.array(totals), mean], names=["id", "n_tokens", "log_prob", "mean_log_prob"])

    return encoded.select("id", "types").mapInArrow(run, "id long, n_tokens long, log_prob double, mean_log_prob double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, log_prob, mean_log_prob): one row per input row, by a network trained on the documents themselves.

    Null and blank texts have no tokens, log_prob 0 and a null mean; ids may be null; repeated rows are repeated, train
    like any others and score alike; an empty table gives no row. Words of equal count enter the vocabulary by their hash.
    """
    words, tokens, counts = vocabulary(docs, text_col)
    encoded = encode(docs, words, id_col, text_col)
    return score(encoded, fit(encoded, tokens, counts), counts)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")
