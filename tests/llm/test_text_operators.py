"""Quality, decontamination, tokens, licences: against brute force, held-out accuracy or the library itself."""

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tarmac.llm import decontam, licenses, quality, tokens

DOCS = "doc_id long, text string"


def auc(pairs):
    good, bad = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))


def test_quality_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = quality.op9_quality_classifier(spark, sf).collect()
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert auc([(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]) > 0.9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "x" * 200_000), (3, "again"), (None, "no id")], DOCS).withColumn("score", F.lit("extra"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = quality.fit(docs, none)
    assert [r.score for r in quality.score(docs, model).collect()] == [0.5] * 5
    assert quality.keep_good(docs, none).columns == docs.columns and quality.keep_good(docs.where("false"), none).count() == 0


def brute_leaks(docs, items):
    """The best window of every item in every document, by exact similarity of all windows."""
    out = {}
    for d, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for i, item in items:
            target = re.findall(r"\w+", (item or "").lower())
            if not target or not words:
                continue
            k, n = min(5, len(target)), min(len(target), len(words))
            want = decontam.shingles_of(target, k)
            best = max((decontam.similarity(decontam.shingles_of(words[s : s + n], k), want) if n >= k else 0.0, -s) for s in range(len(words) - n + 1))
            if best[0] >= 0.8:
                out[d, i] = (best[0], -best[1])
    return out


def test_leaks_against_all_windows(spark):
    rnd = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rnd.randint(12, 60))) for i in range(30)] + [(100, text(3)), (101, ["same"] * 12)]
    docs = []
    for d in range(120):
        body = text(rnd.randint(5, 200))
        if d % 2 == 0:
            item = list(rnd.choice(items)[1])
            for _ in range(rnd.randint(0, 1) if len(item) > 45 else 0):
                item[rnd.randrange(len(item))] = "changed"
            at = rnd.randrange(len(body))
            body[at:at] = item
        docs.append((d, " ".join(body).upper() if d % 3 else ", ".join(body)))
    docs += [(200, None), (201, ""), (202, "same " * 40)]
    items = [(i, " ".join(t)) for i, t in items] + [(102, None), (103, "")]
    got = decontam.leaks(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in got.collect()}
    assert len(rows) > 40 and rows == brute_leaks(docs, items)
    assert got.agg(F.max("hamming")).first()[0] <= decontam.RADIUS


def test_sieve_changes_nothing(spark, sf):
    """Every window fingerprinted and looked up gives what the sieved ones give; without fingerprints nothing is found."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    index = decontam.Index(items)
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000").limit(80).collect()] + [items[0][1], "x " * 50, None, ""]
    assert [index.hits(t) for t in texts] == [index.hits(t, sieve=False) for t in texts] and index.hits(items[0][1])
    for _, blocks in index.sized.values():
        blocks.prints = ~blocks.prints
    assert not any(index.hits(t) for t in texts)


def test_radius_loses_no_passing_window():
    """Windows of similarity 0.8 to 0.95, where distances are largest: all are found; a radius of 15 bits would lose some."""
    rnd, far, bits = random.Random(8), 0, []
    for _ in range(1500):
        n = rnd.randint(20, 60)
        item = [f"v{rnd.randrange(5000)}" for _ in range(n)]
        index = decontam.Index([(1, " ".join(item))])
        body = [f"u{rnd.randrange(5000)}" for _ in range(3)] + item + [f"u{rnd.randrange(5000)}" for _ in range(3)]
        body = body[3 + rnd.choice([-2, -1, 1, 2]) :][:n]
        words = decontam.shingles_of(body, 5)
        if 0.8 <= decontam.similarity(words, index.shingles_of_item(0)) < 0.95:
            hit = index.hits(" ".join(body))
            assert hit
            bits.append(hit[0][3])
            far += hit[0][3] > 15
    assert len(bits) > 500 and 0 < far < 0.1 * len(bits) and max(bits) <= decontam.RADIUS


def test_fingerprints_within_the_radius_are_all_met():
    rnd = random.Random(4)
    prints = np.array([rnd.getrandbits(64) for _ in range(40)], dtype=np.uint64)
    windows = np.array([int(rnd.choice(prints)) ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 26))) for _ in range(3000)], dtype=np.uint64)
    got = set(zip(*(x.tolist() for x in decontam.Blocks(prints).within(windows)), strict=True))
    want = {(w, i, d) for w, a in enumerate(windows.tolist()) for i, b in enumerate(prints.tolist()) if (d := (a ^ b).bit_count()) <= decontam.RADIUS}
    assert got == want


def test_decontamination_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "w " * 300_000 + "a b c d e f g h i j"), (3, "kept"), (3, "kept")], DOCS).withColumns({n: F.lit("mine") for n in ("item_id", "similarity")})
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns and sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, None), (2, ""), (3, "kept"), (3, "kept")]
    assert [(r.doc_id, r.first_word) for r in decontam.leaks(docs, items).collect()] == [(None, 300_000)]


def test_leaks_in_driver_documents_and_blocks(spark, sf, monkeypatch):
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    want = brute_leaks([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    for block in (2000, 7):  # a benchmark of one block, and of several
        monkeypatch.setattr(decontam, "ITEMS_PER_BLOCK", block)
        assert {(r.doc_id, r.item_id): (r.similarity, r.first_word) for r in decontam.leaks(docs, items).collect()} == want
    kept = decontam.keep_clean(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()} - {d for d, _ in want}
    assert decontam.leaks(docs, items.where("false")).count() == 0 and decontam.keep_clean(docs.where("false"), items).count() == 0


SPECIAL = [None, "", " \n\t ", "<|endoftext|> x<|startoftext|>", "It's DON'T 's'", "é é ﬁ İ ß ẞ 你好 👍🏽", "a b\x0bc\x1cd\x85e", "1234 5.6.7", "!!!???", "Ünïcödé,,, x|y <b>", "a\r\nb\rc", "×÷", "word " * 3000, "x" * 5000]


def test_tokens_as_the_library(spark, sf, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(SPECIAL)] + [(None, "x"), (1, "same id")], DOCS))
    texts = docs.collect()
    for _ in range(2):  # the second time everything is in the cache
        got = tokens.token_counts(docs.withColumn("digest", F.lit("extra")), f"{tmp_path}/cache", path).collect()
        want = sorted(((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in texts), key=str)
        assert sorted(((r.id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
        assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    cache = spark.read.parquet(f"{tmp_path}/cache")
    assert cache.count() == cache.select("digest").distinct().count() == len({re.sub("\r\n?", "\n", r.text or "") for r in texts})
    assert tokens.token_counts(docs.where("false"), f"{tmp_path}/none", path).count() == 0


def brute_licenses(words, index):
    """(labels, score): every template at every start, word by word."""
    labels, best = set(), 0.0
    for t, weight in zip(index.templates, index.weight, strict=True):
        for start in range(-len(t.words), len(words)):
            stands = all(start + at >= 0 and words[start + at : start + at + len(p)] == list(p) for at, p in t.phrases)
            if stands:
                labels.add(t.label)
                best = max(best, sum(index.idf[w] for k, w in enumerate(t.words) if 0 <= start + k < len(words) and words[start + k] == w) / weight)
    return ",".join(sorted(labels)), min(1.0, best)


def test_license_labels_and_scores_by_brute_force(spark, sf):
    templates = licenses.all_templates()
    full = [t[1] for t in licenses.TEMPLATES]
    texts = full + [f"Some words. {t} And more." for t in full] + [t.replace("or", "nor") for t in full] + [" ".join(full), "x " * 200_000 + full[1], None, "", "mit", "License, MIT license mit-license"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS).unionByName(spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    index = licenses.Index(templates, *licenses.document_frequencies(docs, templates))
    got = licenses.scan_licenses(docs.withColumn("labels", F.lit("extra"))).collect()
    assert len(got) == len(rows)
    for r in got:
        if len(rows[r.id] or "") < 30_000 or r.id == len(full) * 3 + 1:
            words = licenses.words_of(rows[r.id])
            want = brute_licenses(words, index) if not index.rarest.isdisjoint(words) else ("", 0.0)
            assert (r.labels, r.score) == (want[0], pytest.approx(want[1])), rows[r.id]
    labelled = {r.id: r.labels.split(",") for r in got}
    assert all(t[0] in labelled[i] and t[0] in labelled[len(full) + i] for i, t in enumerate(licenses.TEMPLATES))
    index.postings = {w: [(i, o + nth, nth) for i, o, nth in p] for w, p in index.postings.items()}
    assert not any(index.places(licenses.words_of(t)) for t in full[1:3])  # the intersection of positions decides


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in text or ""))
    places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = [
    (1, None), (2, ""), (3, "MIT License"), (4, "mit-LICENSE mit license x Apache License, the GNU General Public License"), (5, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (6, "Licensed under CC BY-NC 4.0."), (7, "amit license mit licenses"), (8, "général mit license É"), (9, "the mit license " * 500), (9, "the mit license"), (None, "apache license version 2.0"),
]


def test_licenses(spark, sf):
    docs = spark.createDataFrame(LICENSED, DOCS).withColumn("labels", F.lit("extra"))
    got = licenses.scan_licenses(docs).collect()
    assert sorted([str((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in got]) == sorted(str(brute_base(t)) for _, t in LICENSED)
    by = {r.id: r for r in got}
    assert by[6].labels == "cc-by-nc-4.0" and by[6].score == 1.0 and by[5].labels == "mit" and 0.5 < by[5].score < 1 and by[1].score == 0.0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in licenses.op2_license_scans(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(texts[r.doc_id])
    assert licenses.scan_licenses(docs.where("false")).count() == 0


@pytest.mark.parametrize("word", ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License."])
def test_license_words(word):
    assert licenses.words_of(word)[0] in (b"licensed", b"released")


def test_quality_scores_by_brute_force(spark, sf):
    """Every document's score again: zstandard with either dictionary over the pieces of the text, and the logistic weights."""
    import zstandard

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    packers = [zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for r in quality.op9_quality_classifier(spark, sf).collect():
        data = (texts[r.doc_id] or "").encode()
        good, bad = (sum(len(p.compress(data[i : i + quality.PIECE])) for i in range(0, max(1, len(data)), quality.PIECE)) for p in packers)
        n = max(1, len(data))
        x = [1.0, (bad - good) / n, min(good, bad) / n, (bad - good) / n * np.log1p(n)]
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.dot(x, model.weights))), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
