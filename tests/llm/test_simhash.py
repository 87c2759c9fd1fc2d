import random

import xxhash
from pyspark.sql import functions as F

from tarmac.llm import simhash
from tarmac.llm.common import connected_components


def brute_print(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """{id: smallest id reachable} over pairs of two or fewer differing bits."""
    ids, root = sorted(prints), {}
    for i in ids:
        if i in root:
            continue
        todo, root[i] = [i], i
        while todo:
            a = todo.pop()
            for b in ids:
                if b not in root and (prints[a] ^ prints[b]).bit_count() <= 2:
                    root[b] = i
                    todo.append(b)
    return root


TEXTS = [None, "", "  \t\n", "One", "one", "ONE two", "É two", "é two", "a b c d e f g", "A B C d", "x " * 500, "😀 b c", "a\x0bb\x0cc", "a\x1cb c"]


def test_fingerprints():
    for t in TEXTS:
        assert simhash.fingerprint(t) == brute_print(t), t


def test_driver_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: brute_print(r.text) for r in docs}
    want = brute_components(prints)
    got = simhash.op3_simhash_near_dedup(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (int(r.fingerprint, 16), r.component_id) == (prints[r.doc_id], want[r.doc_id]) and len(r.fingerprint) == 16


def random_prints(seed, n=400):
    """Balls of near fingerprints, a chain, and loners."""
    rnd, out = random.Random(seed), []
    flip = lambda x, k: x ^ sum(1 << b for b in rnd.sample(range(64), k))
    for _ in range(4):
        centre = rnd.getrandbits(64)
        out += [flip(centre, rnd.randint(0, 3)) for _ in range(n // 8)]
    x = rnd.getrandbits(64)
    for _ in range(30):
        out.append(x := flip(x, 2))
    return out + [rnd.getrandbits(64) for _ in range(n // 2)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_are_all_near_pairs_once(spark):
    prints = list(dict.fromkeys(random_prints(4)))
    found = [tuple(sorted((r.u % (1 << 64), r.v % (1 << 64)))) for r in simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()]
    want = {tuple(sorted((a, b))) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2}
    assert len(found) == len(set(found)) and set(found) == want


def test_links_of_postings_over_several_batches(spark):
    """A full posting: all values of the two open bytes, more rows than an Arrow batch holds."""
    base = random.Random(2).getrandbits(64) & ~0xFFFF
    prints = [base | x for x in range(0, 1 << 16, 3)]
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"))
    near = sum((x ^ y).bit_count() <= 2 for x in range(0, 1 << 16, 3) for y in [x ^ m for m, _ in simhash._masks()] if y % 3 == 0) // 2
    assert found.count() == found.distinct().count() == near


def test_components_of_paths_and_empty(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one(spark):
    rows = [(5, "the same words here", "x"), (3, "The Same words here", "x"), (9, "quite another text of words", "x"), (9, "quite another text of words", "x"), (None, "the same words here", "x"), (7, None, "x"), (8, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x)) == [3, 7, 9]
    assert simhash.keep_one(docs.where("false")).count() == 0
    assert simhash.near_duplicates(docs).where(F.col("id").isNull()).first().component == 3


def test_keep_one_tells_rows_apart_not_ids(spark):
    rows = [(1, "a b c d", None), (2, "a b c d", None), (2, "totally other words here now", None), (None, "no id and a text of its own", None), (None, "no id and another text entirely", "x"), (None, "no id and another text entirely", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id string")
    got = sorted(((r.doc_id, r.text) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d"), (2, "totally other words here now"), (None, "no id and a text of its own"), (None, "no id and another text entirely")], key=str)
    clash = docs.withColumns({c: F.lit("mine") for c in ("k1", "K2", "root", "rows", "id")})
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns and kept.count() == 4 and {r.k1 for r in kept.collect()} == {"mine"}


def test_shared_ids_join_no_groups(spark):
    """Two texts of one id belong to their own groups, whose other members stay apart."""
    rows = [(1, "a b c d"), (1, "totally other words here now"), (2, "a b c d"), (3, "totally other words here now")]
    found = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    roots = {r.id: r.root for r in found if r.id != 1}
    assert len({r.root for r in found}) == 2 and roots[2] != roots[3] and {r.component for r in found} == {1}
