import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarmac.llm import merkle

DOCS = "doc_id long, source string, lang string, n_chars long, text string"
H = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for nodes in levels[:-1]:
        run = i - i % 3
        out.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 3])))
        i //= 3
    return out


def brute(rows):
    """[(row, leaf, subroot, root, proof)], by whole trees."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf_of(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g], key=lambda x: x[:3])]) for g in order}
    top = tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, (_, _, leaf, r) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            out.append((r[0], g, leaf, trees[g][-1][0], top[-1][0], path(trees[g], i) + path(top, k)))
    return sorted(out, key=str)


def found(df, **more):
    return sorted(((r.id, r.group, r.leaf, r.subroot, r.root, [tuple(x) for x in r.proof]) for r in merkle.manifest(df, **more).collect()), key=str)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 8, 9, 10, 26, 27, 28, 80, 81, 82, 243, 250])
def test_walk_gives_each_path(n):
    leaves = [H(str(i)) for i in range(n)]
    levels = tree(leaves)
    assert merkle.height_of(n) == len(levels) - 1
    assert list(merkle.walk(leaves, len(levels) - 1)) == [path(levels, i) for i in range(n)]
    assert merkle.block_root(leaves, len(levels) - 1) == levels[-1][0]


def test_walk_of_a_short_block_goes_on_to_its_height():
    """The last block of a larger tree: its nodes are hashed up alone."""
    (proof,) = merkle.walk(["ab"], 3)
    assert proof == [("", "")] * 3 and merkle.block_root(["ab"], 3) == H(H(H("ab")))


def test_walk_holds_few_nodes():
    """What the traversal keeps of 6,561 leaves, besides them, is less than a fiftieth."""
    leaves, most = [H(str(i)) for i in range(6561)], 0
    held = []
    init = merkle.Subtree.__init__
    try:
        merkle.Subtree.__init__ = lambda self, *a: (held.append(self), init(self, *a))[1]
        for i, _ in enumerate(merkle.walk(leaves, 8)):
            if i % 500 == 0:
                live = held[-8:]
                most = max(most, sum(len(x) for t in live for x in (*t.levels, *t.open)))
    finally:
        merkle.Subtree.__init__ = init
    assert 0 < most < 6561 / 50


@pytest.mark.parametrize(("levels", "seed"), [(1, 1), (2, 2), (8, 3)])
def test_manifest_against_whole_trees(spark, levels, seed):
    """Blocks of 3, 9 and 6,561 nodes: up to six steps of blocks, over sources of any size, nulls, ties and repeated rows."""
    rnd = random.Random(seed)
    sources = [None, "", "a", "é", "\U0001f600", "z", "=", *[f"s{i}" for i in range(20)]]
    rows = [(rnd.choice([None, rnd.randrange(-5, 40)]), "a" if rnd.random() < 0.5 else rnd.choice(sources), rnd.choice([None, "en"]), rnd.choice([None, 3]), rnd.choice([None, "", "x\ny", "é"])) for _ in range(130)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = found(df, block_levels=levels)
    assert got == brute(rows)
    for i, g, leaf, _, root, proof in got[:20]:
        for left, right in proof:
            leaf = H(left, leaf, right)
        assert leaf == root, (i, g)


def test_edges(spark):
    one = (7, "s", "en", 3, "abc")
    (row,) = found(spark.createDataFrame([one], DOCS))
    assert row == (7, "s", leaf_of(one), leaf_of(one), leaf_of(one), [])
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0
    big = (1, "s", None, None, "é\n" * 1_500_000)
    assert found(spark.createDataFrame([big, one], DOCS)) == brute([big, one])
    clash = spark.createDataFrame([(*one, 1, 2)], DOCS + ", g int, Leaf int")
    assert merkle.manifest(clash).first().leaf == leaf_of(one)
    with pytest.raises(ValueError):
        merkle.manifest(clash, carry={"Root": F.lit(1)})


def test_tampered_rows_do_not_verify(spark, sf):
    import zlib

    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in merkle.op13_merkle_manifest(spark, sf).collect():
        even = zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        assert r.verified == (not even or "\n" not in docs[r.doc_id].text) and (r.folded_root == r.root) == r.verified
