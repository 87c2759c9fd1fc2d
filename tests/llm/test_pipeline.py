import re

import corpus_pipeline as P
from pyspark.sql import functions as F

from tarmac.llm import decontam, pii, quality
from tarmac.llm.common import stash, table
from tests.llm.test_pii import PLAIN, passes
from tests.llm.test_simhash import brute_components, brute_print
from tests.llm.test_text_operators import brute_leaks


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "decontaminate", "pii", "mixing"]
    columns = docs.columns
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    model = quality.fit(docs, table(spark, sf, "labels"))
    scores = {r.id: r.score for r in quality.score(docs, model).collect()}
    good = stash(P.quality(spark, docs, sf), "t")
    assert good.columns == columns and set(texts(good)) == {i for i, s in scores.items() if s >= quality.THRESHOLD}
    one = stash(P.near_dedup(spark, good, sf), "t")
    prints = {i: brute_print(t) for i, t in texts(good).items()}
    assert one.columns == columns and set(texts(one)) == set(brute_components(prints).values())
    clean = stash(P.decontaminate(spark, one, sf), "t")
    held = brute_leaks(list(texts(one).items()), [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    assert clean.columns == columns and set(texts(clean)) == set(texts(one)) - {d for d, _ in held}
    private = stash(P.pii(spark, clean, sf), "t")
    after = texts(private)
    assert private.columns == columns and set(after) == set(texts(clean))
    assert not [m[0] for t in after.values() for k, p in PLAIN.items() for m in re.finditer(p, t) if passes(k, m[0])]
    mixed = P.mixing(spark, private, sf)
    assert mixed.columns == [*columns, "rate"] and texts(mixed) == after and all(r.rate >= 0 for r in mixed.collect())
    assert pii.KINDS and decontam.SIMILARITY == 0.8 and P.ORACLE_SQL is None


def test_run_and_empty_input(spark, sf):
    out = P.run(spark, sf)
    assert out.count() > 0 and out.columns == [*table(spark, sf, "documents").columns, "rate"]
    docs = table(spark, sf, "documents").where(F.lit(False))
    for _, stage in P.STAGES:
        docs = stash(stage(spark, docs, sf), "t")
    assert docs.count() == 0


def test_stages_with_awkward_rows(spark, sf):
    """Nulls, repeated ids and rows, a long text and clashing names pass every stage."""
    docs = table(spark, sf, "documents").limit(40)
    odd = [(None, None), (None, "a text without an id"), (7, "one text of this id"), (7, "and quite another text of it"), (7, "one text of this id"), (8, "long " * 200_000), (9, "")]
    extra = spark.createDataFrame(odd, "doc_id long, text string")
    both = docs.unionByName(extra, allowMissingColumns=True).withColumns({c: F.lit("mine") for c in ("__id", "__cut", "__text", "k1", "rate", "rows", "id", "root", "score", "found")})
    one = P.near_dedup(spark, both, sf)
    assert one.columns == both.columns and {"a text without an id", "and quite another text of it"} <= {r.text for r in one.collect()}
    for name, stage in P.STAGES:
        out = stash(stage(spark, both, sf), name)
        assert set(out.columns) == set(both.columns) and out.where("__text != 'mine' or __cut != 'mine' or k1 != 'mine'").count() == 0
        if name in ("pii", "mixing"):
            assert out.count() == both.count()
