import hashlib
import random
import re

import numpy as np
import pytest

from tarmac.llm import substrings


def brute(rows, window=13):
    """[(id, n_words, n_removed, kept)] of [(id, text)]; a null id is the largest."""
    size = lambda i: (i is None, i)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, ws in split:
        for p in range(len(ws) - window + 1):
            key = tuple(ws[p : p + window])
            first[key] = min(first.get(key, i), i, key=size)
    out = []
    for i, ws in split:
        gone = {q for p in range(len(ws) - window + 1) if size(first[tuple(ws[p : p + window])]) < size(i) for q in range(p, p + window)}
        out.append((i, len(ws), len(gone), " ".join(w for q, w in enumerate(ws) if q not in gone)))
    return out


def found(df, **more):
    return sorted(((r.id, r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeats(df, **more).collect()), key=str)


def test_difference_covers():
    for period in range(1, 60):
        cover = substrings.difference_cover(period)
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))
    assert substrings.difference_cover(7) == (0, 1, 3)


def test_runs_are_hashed_alike_wherever_they_stand():
    words = np.random.default_rng(1).integers(0, 1 << 63, 60).astype(np.uint64)
    for size in (1, 2, 3, 7, 13):
        one, two = substrings.grams(words, size), substrings.grams(np.concatenate([words, words]), size)
        assert len(one) == 60 - size + 1 == len(set(one.tolist())) and (two[60 : 60 + len(one)] == one).all()
    assert len(substrings.grams(words[:5], 7)) == 0


def test_words_do_not_depend_on_pieces(monkeypatch):
    rnd = random.Random(3)
    texts = [b"", b" \n", b"x" * 90 + b" y", "é   a\x1cb".encode()] + [" ".join(rnd.choice(["a", "bb", "c" * 70]) for _ in range(rnd.randrange(80))).encode() for _ in range(30)]
    whole = substrings.Words(texts)
    assert whole.counts.tolist() == [len(re.findall(rb"[^\x20\x09-\x0D]+", t)) for t in texts]
    monkeypatch.setattr(substrings, "PIECE", 16)
    parts = substrings.Words(texts)
    assert (parts.low == whole.low).all() and (parts.high == whole.high).all() and (parts.place == whole.place).all()


@pytest.mark.parametrize(("window", "seed", "partitions", "chunk"), [(13, 1, 1, 1 << 20), (13, 2, 6, 200), (5, 3, 5, 100), (2, 4, 3, 1), (1, 5, 2, 50)])
def test_against_brute_force(spark, monkeypatch, window, seed, partitions, chunk):
    """Texts cut from a common one at any shift, repeated runs within a text, copies, ties and nulls; also one text a chunk."""
    assert substrings.Rule(window).anchor + substrings.Rule(window).period == window + 1
    monkeypatch.setattr(substrings, "_chunks", lambda *a, of=substrings._chunks, **k: ([r] for rows in of(*a, **k) for r in rows) if chunk == 1 else of(*a, **k))
    rnd = random.Random(seed)
    common = [rnd.choice("abcdefgh") for _ in range(300)]
    rows = [(None, None), (None, " ".join(common[:40])), (3, ""), (3, " ".join(common[5:60])), (4, "x " * 60), (5, "x " * 50 + "y"), (-9, "\t\n "), (6, "a b")]
    for i in range(40):
        parts = []
        for _ in range(rnd.randrange(4)):
            a = rnd.randrange(280)
            parts += common[a : a + rnd.randrange(4, 40)] + [rnd.choice("uvwxyz") for _ in range(rnd.randrange(6))]
        rows.append((rnd.randrange(-5, 30), rnd.choice([" ", "\n", "  \r\n"]).join(parts)))
    rows += rows[10:16] + [(i + 100, t) for i, t in rows[12:20] if i is not None]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    assert found(df, window=window) == sorted(brute(rows, window), key=str)


def test_edges(spark):
    long = " ".join(f"w{i % 9973}" for i in range(300_000))  # words come again, windows of 13 do as well
    rows = [(1, long), (2, "start " + long[:2_000_000]), (3, "no space at all" * 3), (4, "q" * 3_000_000)]
    got = {r.id: r for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = {r[0]: r for r in brute(rows)}
    for i, r in got.items():
        assert (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).digest()) == (want[i][1], want[i][2], hashlib.sha256(want[i][3].encode()).digest())
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(empty).count() == 0
    clash = spark.createDataFrame([(1, "a b c", 2, 3, 4, "x")], "doc_id long, text string, k int, R int, id int, kept string")
    assert found(clash) == [(1, 3, 0, "a b c")]
    with pytest.raises(ValueError):
        substrings.Rule(0)
