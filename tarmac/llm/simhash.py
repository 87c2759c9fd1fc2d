"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint is eight positional bytes. Two fingerprints within two bits differ in two bytes at most, so they share at
least six of the eight: that is the guaranteed minimum of matches. Lists of single positional bytes would be as long as a
256th of the corpus, so the index keeps the lists that six of them have in common: each distinct fingerprint is posted
under the 28 choices of six of its positional bytes. Fingerprints that meet in a posting have tallied six shared bytes
by that, one more is tallied where a further byte is equal, and the rest are verified by the exact number of differing bits.

Members of a posting differ in two bytes only, so no posting has more than 65,536 of them, whatever the corpus: a hot group
of near copies is spread over many postings, and none can grow beyond what a task holds. Inside a posting the members within
two bits of each one are looked up (136 ways to differ), so no pairs are formed that fail the verification.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import connected_components, join_hot, map_rows, row_keys, spare, stash, table
from tarmac.session import ship

MAX_BITS = 2
SHINGLE = 3
SEED = 42
#: The pairs of positional bytes that a posting leaves open, by the posting's kind.
OPEN = list(combinations(range(8), 2))


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of the text's 3-word shingles as an unsigned integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower() and split() touch ASCII only
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(id, fp), and (k1, k2) of ``row_keys`` if ``keyed``: a row for each input row; fp is the fingerprint as a signed long.

    Null text counts as empty.
    """

    def rows(columns):
        for i, text, *keys in zip(*columns, strict=True):
            fp = fingerprint(text)
            yield i, fp - (1 << 64) if fp >> 63 else fp, *keys

    keys = [k.alias(f"k{n}") for n, k in enumerate(row_keys(docs), 1)] if keyed else []
    schema = "id long, fp long" + (", k1 long, k2 long" if keyed else "")
    return map_rows(docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"), *keys), schema, rows)


def _masks() -> list[tuple[int, int]]:
    """(difference of the two open bytes, further shared bytes) of members within ``MAX_BITS`` bits."""
    bits = [1 << i for i in range(16)]
    found = [sum(c) for n in (1, MAX_BITS) for c in combinations(bits, n)]
    return [(m, int(m & 0xFF == 0) + int(m >> 8 == 0)) for m in found]


def posting_links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): the links among members of the same posting (``keys`` and unsigned ``prints``, sorted by key).

    A pair with seven shared bytes meets in seven postings; it is given by the first of them only.
    """
    if not len(keys):
        return prints, prints
    starts = np.r_[True, keys[1:] != keys[:-1]]
    run = np.cumsum(starts) - 1
    many = np.bincount(run)[run] > 1
    keys, prints, run = keys[many], prints[many], run[many].astype(np.uint64)
    if not len(keys):
        return prints, prints
    kind = keys >> 48
    low, high = (np.array([o[i] for o in OPEN])[kind] for i in (0, 1))
    byte = lambda at: prints >> (8 * at).astype(np.uint64) & np.uint64(0xFF)
    codes = run << np.uint64(16) | byte(high) << np.uint64(8) | byte(low)
    order = np.argsort(codes)
    codes, prints, low, high = codes[order], prints[order], low[order], high[order]
    us, vs = [], []
    for mask, further in _masks():
        wanted = codes ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(codes, wanted), len(codes) - 1)
        hit = (codes[at] == wanted) & (codes < wanted)
        if further:  # six shared bytes and this one
            shared, differing = (low, high) if mask & 0xFF == 0 else (high, low)
            hit &= shared == np.where(differing == 0, 1, 0)
        us.append(prints[hit])
        vs.append(prints[at[hit]])
    return np.concatenate(us), np.concatenate(vs)


def links(reps: DataFrame) -> DataFrame:
    """(u, v): every pair of distinct fingerprints (column fp, long) within ``MAX_BITS`` bits, once."""
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255).cast("long")) for i in range(8)]

    def key(kind: int, left_out: tuple[int, int]):
        out = F.lit(kind).cast("long")
        for i in range(8):
            if i not in left_out:
                out = F.shiftleft(out, 8).bitwiseOR(byte[i])
        return out

    posted = reps.select("fp", F.explode(F.array(*[key(k, o) for k, o in enumerate(OPEN)])).alias("key"))
    sorted_postings = posted.repartition("key").sortWithinPartitions("key").select("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, prints = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            prints = np.concatenate([prints, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(keys, keys[-1]))  # the last posting may go on in the next batch
            yield found(keys[:whole], prints[:whole])
            keys, prints = keys[whole:], prints[whole:]
        yield found(keys, prints)

    def found(keys: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        u, v = posting_links(keys, prints.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    ship(reps.sparkSession)
    return sorted_postings.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """(id, fp, root, component), and (k1, k2) of ``row_keys`` if ``keyed``: one row per input row.

    ``root`` is the group's smallest fingerprint, ``component`` the smallest id reachable over links of two or fewer
    differing bits. Null and empty texts have fingerprint zero and link like any other. Repeated rows are repeated; rows
    that share an id but not a text are grouped by their texts. A row whose id is null gets the smallest id of its group,
    and null where no row of the group has one. An empty table gives an empty result; other columns are ignored.
    """
    prints = stash(fingerprints(docs, id_col, text_col, keyed), "fingerprints")
    reps = stash(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("rows")), "reps")
    found = connected_components(links(reps))
    rooted = stash(reps.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", "rows", F.coalesce("root", "fp").alias("root")), "rooted")
    groups = rooted.groupBy("root").agg(F.min("least").alias("component"), F.count(F.lit(1)).alias("members"))
    named = join_hot(rooted, groups, ["root"], "members").select("fp", "root", "component", "rows")
    return join_hot(prints, stash(named, "named"), ["fp"], "rows").select("id", "fp", "root", "component", *(["k1", "k2"] if keyed else []))


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without all but one row of each group of near-duplicates.

    The row with the group's smallest id stays; of several with that id the one whose hash is smallest, and rows without an
    id only where the group has none with one. Rows are told apart by all their columns, so rows that share an id, or have
    none, but hold texts of other groups all stay. Null and empty texts form one group. Columns are those of ``docs``
    whatever their names; an empty table stays empty.
    """
    found = stash(near_duplicates(docs, id_col, text_col, keyed=True), "groups")
    best = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2")).alias("best"))
    kept = best.select("best.k1", "best.k2")
    rows = found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows"))
    lost, repeated = rows.join(kept, ["k1", "k2"], "left_anti"), rows.where("rows > 1").join(kept, ["k1", "k2"])
    names = [spare(docs, "k1"), spare(docs, "k2")]
    keyed = docs.withColumns(dict(zip(names, row_keys(docs), strict=True)))
    other = stash(lost.select("k1", "k2").unionByName(repeated.select("k1", "k2")), "not-as-they-are").toDF(*names)
    once = stash(repeated.select("k1", "k2"), "repeated").toDF(*names)
    # Always by a shuffle: the rows left out grow with the documents, so that a broadcast would only do on small tables.
    out = keyed.join(other.hint("shuffle_merge"), names, "left_anti").select(*[f"`{c}`" for c in docs.columns])
    if once.isEmpty():
        return out
    same = keyed.join(once, names, "left_semi").groupBy(*names).agg(F.any_value(F.struct(*[f"`{c}`" for c in docs.columns])).alias("row"))
    return out.unionByName(same.select("row.*"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), hex16(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))
