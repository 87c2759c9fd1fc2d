import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarmac.llm import ann, lm_score, mixing

VECTORS = "vec_id long, embedding array<float>"


def brute_search(rows, k=5):
    good = {i: np.array(v, dtype=np.float64) for i, v in rows}
    out = {}
    for q in good:
        if q % 50 == 0:
            score = {i: float(np.dot(good[q], v) / (np.linalg.norm(good[q]) * np.linalg.norm(v))) for i, v in good.items() if i != q}
            out[q] = sorted(score.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_all_lists_probed_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=24).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000 + i, rows[50][1]) for i in range(3)]  # copies, one a query
    got, want = found(ann.search(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 50 == 0, probes=10_000)), brute_search(rows)
    assert got.keys() == want.keys()
    same = sum([i for i, _ in got[q]] == [i for i, _ in want[q]] for q in want)
    assert same >= 0.97 * len(want)  # the tests of the scan may abandon a candidate wrongly now and then
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in want for a, b in zip(got[q], want[q], strict=True) if a[0] == b[0])
    assert [i for i, _ in got[0]] == [1000, 1001, 1002, 1003, 1004]


def test_recall_on_driver_vectors(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(ann.op6_approximate_nearest_neighbours(spark, sf)), brute_search(rows)
    assert all(len(got[q]) == 5 for q in want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_search_edges(spark):
    bad = [(0, None), (50, [0.0, 0.0]), (100, [float("nan"), 1.0]), (150, [1.0, None]), (200, [float("inf"), 1.0]), (None, [1.0, 1.0]), (250, [1.0])]
    good = [(300, [1.0, 0.0]), (301, [2.0, 0.0]), (302, [0.0, 1.0]), (302, [0.0, 1.0])]
    got = found(ann.search(spark.createDataFrame(bad + good, VECTORS).withColumn("rank", F.lit("extra")), F.col("vec_id") % 50 == 0))
    assert got == {300: [(301, 1.0), (302, 0.0)]}
    assert ann.search(spark.createDataFrame(bad, VECTORS), F.col("vec_id") == 0).count() in (0,)
    short = [(400, [1.0, 0.0, 0.0]), (401, [2.0, 0.0, 1.0]), (250, [3.0]), (251, [-1.0])]
    got = found(ann.search(spark.createDataFrame(good + short, VECTORS), F.col("vec_id") % 50 == 0))
    assert {q: [i for i, _ in x] for q, x in got.items()} == {300: [301, 302], 400: [401], 250: [251]}
    assert ann.search(spark.createDataFrame([], VECTORS), F.col("vec_id") == 0).count() == 0


def test_language_model_prefers_what_it_has_seen(spark):
    rng = np.random.default_rng(1)
    pattern = "the quick brown fox jumps over the lazy dog and runs home".split()
    seen = [(i, " ".join(pattern * 30) + f" {i}") for i in range(400)]
    odd = [(1000 + i, " ".join(rng.permutation(pattern * 30))) for i in range(5)]
    docs = spark.createDataFrame(seen + odd + [(2000, None), (2001, "  "), (None, "fox"), (1, "fox"), (1, "fox")], "doc_id long, text string").withColumn("log_prob", F.lit("extra"))
    got = lm_score.score_documents(docs).collect()
    assert len(got) == docs.count()
    mean = {r.id: r.mean_log_prob for r in got if r.id not in (None, 1)}
    assert min(mean[i] for i in range(2, 400) if i in mean) > max(mean[1000 + i] for i in range(5))
    assert mean[2000] is None and mean[2001] is None and len({r.log_prob for r in got if r.id == 1 and r.n_tokens == 1}) == 1
    assert lm_score.score_documents(docs.where("false")).count() == 0


def plain_scores(weights, texts, counts):
    """The formula, token by token, in double precision."""
    tables, hidden, out, class_offsets, v, type_offsets = (x.astype(np.float64) for x in lm_score.unpack(weights))
    classes, found = lm_score.Classes(counts), []
    for text in texts:
        total = 0.0
        for i, y in enumerate(text):
            around = [text[i + j] if 0 <= i + j < len(text) else lm_score.TYPES for j in (-2, -1, 1, 2)]
            h = np.tanh(sum(tables[n, x] for n, x in enumerate(around)) + hidden)
            z, k = h @ out + class_offsets, int(classes.kind[y])
            low, high = classes.starts[k], classes.starts[k + 1]
            q = v[low:high] @ h + type_offsets[low:high]
            total += z[k] - np.log(np.exp(z).sum()) + q[y - low] - np.log(np.exp(q).sum())
        found.append(total)
    return found


def test_scores_of_the_trained_network_by_brute_force(spark):
    """Counting, encoding, training and scoring through Spark, against the formula in Python; on other partitionings the same."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("n_chars < 3000").select("doc_id", "text")
    rows = docs.collect()
    plain = {}
    for r in rows:
        for w in (r.text or "").lower().split():
            plain[lm_score.word_hash(w)] = plain.get(lm_score.word_hash(w), 0) + 1
    words, tokens, counts = lm_score.vocabulary(docs)
    assert tokens == sum(plain.values()) == counts.sum()
    assert words == [h for h, _ in sorted(plain.items(), key=lambda x: (-x[1], x[0]))[: lm_score.VOCABULARY]]
    weights = lm_score.fit(lm_score.encode(docs, words), tokens, counts)
    again = docs.repartition(7)
    assert np.array_equal(weights, lm_score.fit(lm_score.encode(again, lm_score.vocabulary(again)[0]), tokens, counts))
    types = lm_score.Types({w: i for i, w in enumerate(words)})
    want = dict(zip([r.doc_id for r in rows], plain_scores(weights, [types.of(r.text) for r in rows], counts), strict=True))
    for r in lm_score.score_documents(docs).collect():
        assert r.log_prob == pytest.approx(want[r.id], rel=1e-4, abs=1e-3)
    shares = np.log((counts + 0.5) / (counts + 0.5).sum())
    unigram = np.mean([shares[types.of(r.text)].sum() for r in rows])
    assert np.mean(list(want.values())) > unigram  # the context tells something


def test_probabilities_of_all_types_sum_to_one():
    counts = np.sort(np.random.default_rng(2).zipf(1.3, lm_score.TYPES).astype(float))[::-1]
    weights = lm_score.fresh(counts) + np.random.default_rng(3).normal(0, 0.3, len(lm_score.fresh(counts))).astype(np.float32)
    every = np.concatenate([[5, 9, t, 2, 2] for t in range(lm_score.TYPES)]).astype(np.int16)
    found = lm_score.log_probabilities(weights, every, np.full(lm_score.TYPES, 5), lm_score.Classes(counts))
    assert np.exp(found[2::5]).sum() == pytest.approx(1, abs=1e-3)


def test_types_follow_the_context():
    """Two types, each with a context of its own: the network tells them apart."""
    rng = np.random.default_rng(1)
    texts = [np.array([10, 11, 12, 13, 14] if rng.random() < 0.5 else [20, 21, 22, 23, 24], dtype=np.int16) for _ in range(20_000)]
    ids, lengths = np.concatenate(texts), np.full(len(texts), 5)
    counts = np.bincount(ids, minlength=lm_score.TYPES).astype(float)
    classes, weights = lm_score.Classes(counts), lm_score.fresh(counts)
    for _ in range(3):
        lm_score.train(weights, lm_score.windows(ids, lengths), ids, classes)
    right, wrong = (lm_score.log_probabilities(weights, np.array([10, 11, x, 13, 14], dtype=np.int16), np.array([5]), classes)[2] for x in (12, 22))
    assert right > wrong + 2


def test_every_token_is_predicted_in_training():
    """Four types take turns: training moves the vectors of each, wherever it stands."""
    ids = np.tile(np.array([3000, 3100, 3200, 3300], dtype=np.int16), 100)
    counts = np.sort(np.random.default_rng(2).zipf(1.3, lm_score.TYPES).astype(float))[::-1]
    weights = lm_score.fresh(counts)
    before = lm_score.unpack(weights.copy())
    lm_score.train(weights, lm_score.windows(ids, np.array([len(ids)])), ids, lm_score.Classes(counts))
    after = lm_score.unpack(weights)
    for t in (3000, 3100, 3200, 3300):
        assert after[5][t] > before[5][t] and np.abs(after[4][t] - before[4][t]).max() > 1e-4


def totals(rows, targets):
    n = sum(r.n_tokens for r in rows)
    return {d: sum(r.rate * r.n_tokens * r[f"p_{d}"] for r in rows) / n for d in targets}


def test_mixing_meets_targets(spark):
    sf = "/root/testdata/sf0.01"
    rows = mixing.op1_mixing_to_targets(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(r.rate >= 0 for r in rows)
    assert totals(rows, mixing.TARGETS) == pytest.approx(mixing.TARGETS, abs=1e-3)
    import regex

    assert all(r.n_tokens == len(regex.findall(r"\p{L}+", docs[r.doc_id])) for r in rows)
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    p = {y: np.mean([r.p_toxic for r in rows if labels.get(r.doc_id) == y]) for y in (0, 1)}
    assert p[1] > 0.6 > 0.1 > p[0]


def test_rates_against_plain_projected_gradient(spark):
    rng = np.random.default_rng(5)
    p, n = rng.dirichlet([1, 0.5, 0.3], size=200), rng.integers(1, 500, 200)
    df = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(200)], "doc_id long, n_tokens long, p_clean double, p_poor double, p_toxic double")
    for target in ({"clean": 0.7, "poor": 0.2, "toxic": 0.1}, {"clean": 1.0, "poor": 0.0, "toxic": 0.0}):
        got = mixing.fit_rates(df, target, rounds=60).collect()
        aim, r = np.array([target[d] for d in mixing.DOMAINS]), np.ones(200)
        for _ in range(20_000):
            r = np.maximum(0, r - p @ ((r * n) @ p / n.sum() - aim))
        best = np.abs((r * n) @ p / n.sum() - aim) ** 2
        ours = totals(got, target)
        assert sum((ours[d] - target[d]) ** 2 for d in target) <= best.sum() * 1.05 + 1e-6


def test_rates_meet_the_conditions_of_the_problem_row_by_row(spark):
    """At the optimum a row's gradient is zero where its rate is positive, and not negative where the rate is zero."""
    sf = "/root/testdata/sf0.01"
    for rows, target in (
        (mixing.op1_mixing_to_targets(spark, sf).collect(), mixing.TARGETS),
        (mixing.fit_rates(spark.createDataFrame([(i, 1 + i % 50, (i % 7) / 10, (i % 3) / 10, 1 - (i % 7) / 10 - (i % 3) / 10) for i in range(300)], "doc_id long, n_tokens long, p_clean double, p_poor double, p_toxic double"), {"clean": 0.05, "poor": 0.05, "toxic": 0.9}).collect(), {"clean": 0.05, "poor": 0.05, "toxic": 0.9}),
    ):
        n = np.array([r.n_tokens for r in rows], dtype=float)
        p, rate = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows]), np.array([r.rate for r in rows])
        miss = (rate * n) @ p / n.sum() - np.array([target[d] for d in mixing.DOMAINS])
        gradient = p @ miss + mixing.PULL * (rate - 1)
        assert np.abs(gradient[rate > 0]).max() < 1e-6 and (gradient[rate == 0] > -1e-6).all()


def test_posteriors_by_brute_force(spark):
    """Naive Bayes over the features that tell, summed up in Python from the fitted weights."""
    import math

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    labels = mixing.domains_of(spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    model = mixing.classifier(docs, labels)
    weights = {r.feature: [r[f"w_{d}"] for d in mixing.DOMAINS] for r in model.collect()}
    tokens = mixing.with_tokens(docs.withColumn("__text", F.coalesce("text", F.lit("")))).select("doc_id", F.transform("__tokens", lambda t: F.xxhash64(t)).alias("f"))
    want = {}
    for r in tokens.collect():
        odds = [sum(weights[f][d] for f in r.f if f in weights) for d in range(len(mixing.DOMAINS))]
        mass = [math.exp(x - max(odds)) for x in odds]
        want[r.doc_id] = [x / sum(mass) for x in mass]
    for r in mixing.memberships(docs, model).collect():
        assert [r[f"p_{d}"] for d in mixing.DOMAINS] == pytest.approx(want[r.doc_id], abs=1e-9)


def test_with_rates_keeps_every_row_and_column(spark):
    rows = [(1, "clean words of a text", "a"), (1, "clean words of a text", "a"), (1, "other words", None), (None, None, "b"), (None, "x", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string").withColumns({n: F.lit("mine") for n in ("k1", "rows", "Rate", "n_tokens")})
    out = mixing.with_rates(docs, spark.createDataFrame([], "doc_id long, domain string"))
    assert out.columns == ["doc_id", "text", "extra", "k1", "rows", "n_tokens", "rate"]
    assert sorted(map(str, ((r.doc_id, r.text, r.extra, r.k1) for r in out.collect()))) == sorted(str((*r, "mine")) for r in rows)


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "word " * 5000), (3, "again"), (None, "no id")], "doc_id long, text string").withColumn("rate", F.lit("extra"))
    none = spark.createDataFrame([], "doc_id long, domain string")
    rows = mixing.mix(docs, none).collect()
    assert len(rows) == 5 and {r.n_tokens for r in rows} == {0, 5000, 1, 2} and all(r.p_clean == pytest.approx(1 / 3) for r in rows)
    assert mixing.mix(docs.where("false"), none).count() == 0


def test_training_reaches_every_document(spark):
    """Each row's text is trained on (its context tables move), in tables of a few rows too."""
    texts = [f"alpha{i} beta{i} gamma{i} delta{i} epsilon{i}" for i in range(12)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    words, tokens, counts = lm_score.vocabulary(docs)
    weights = lm_score.fit(lm_score.encode(docs, words), tokens, counts)
    moved = np.abs(lm_score.unpack(weights)[0] - lm_score.unpack(lm_score.fresh(counts))[0]).max(axis=(0, 2)) > 1e-4
    types = lm_score.Types({w: i for i, w in enumerate(words)})
    assert all(moved[types.of(t)].any() for t in texts)


def test_log_sum_is_the_same_with_and_without_a_shift():
    z = np.random.default_rng(3).normal(0, 5, (200, 40)).astype(np.float32)
    expected = np.log(np.exp(z.astype(np.float64)).sum(axis=1))
    assert np.allclose(lm_score.log_sum(z.copy()), expected, atol=1e-4)
    assert np.allclose(lm_score.log_sum(z.copy(), safe=True), expected, atol=1e-4)
    large = np.full((3, 4), 200, dtype=np.float32)
    assert not lm_score.bounded(large, large[0])
    assert np.allclose(lm_score.log_sum(large), 200 + np.log(4))


def test_words_are_counted_whole_when_a_task_gives_out_its_table_often(spark, monkeypatch):
    texts = ["a b c d e f a a", None, "", "g h i a b", " ".join(f"w{i % 7}" for i in range(100))]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    whole = lm_score.vocabulary(docs)
    monkeypatch.setattr(lm_score, "WORDS_HELD", 3)
    words, tokens, counts = lm_score.vocabulary(docs)
    assert (words, tokens) == (whole[0], whole[1]) and (counts == whole[2]).all()
    assert tokens == 113 and counts[0] == 15
    assert set(words[:2]) == {lm_score.word_hash("w0"), lm_score.word_hash("w1")}


def test_words_hashed_at_once_are_those_of_python():
    """Words of whole columns, against lower().split() word by word: white space of all kinds, letters whose lower case
    depends on where they stand, long words, nulls, texts without words."""
    texts = [None, "", " \t\r\n", " The QUICK\x1cfox\x85 ", "ΟΔΥΣΣΕΥΣ İstanbul ẞ ǅ Ünïcode　x", "a" * 32 + " " + "a" * 33 + " " + "é" * 400, "\x00 a\x00 a", "x" * 8 + " " + "x" * 9]
    texts += ["".join(map(chr, range(n, n + 64))) + " end" for n in (*range(0, 0x600, 64), *range(0x1E00, 0x2100, 64), 0x1F600)]
    words = [(t or "").lower().split() for t in texts]
    for column in (pa.array(texts), pa.array(["before", *texts]).slice(1)):
        hashes, lengths = lm_score.word_hashes(column)
        assert lengths.tolist() == [len(w) for w in words]
        assert hashes.tolist() == [lm_score.word_hash(w) for some in words for w in some] and hashes.min() >= 0
    different = {w for some in words for w in some} | {str(i) for i in range(20_000)} | {"0" * n for n in range(1, 80)}
    assert len({lm_score.word_hash(w) for w in different}) == len(different)


def test_gradient_step_by_the_plain_formula():
    """One batch against sums token by token, in double precision; with and without a shift before exp."""
    rng = np.random.default_rng(4)
    ids = rng.zipf(1.3, 3000).clip(1, lm_score.TYPES).astype(np.int16) - 1
    counts = np.bincount(ids, minlength=lm_score.TYPES).astype(float)
    classes, around = lm_score.Classes(counts), lm_score.windows(ids, np.array([len(ids)]))
    for scale in (0.3, 9):
        weights = (lm_score.fresh(counts) + rng.normal(0, scale, len(lm_score.fresh(counts)))).astype(np.float32)
        tables, hidden, out, class_offsets, v, type_offsets = (x.astype(float) for x in lm_score.unpack(weights.copy()))
        steps, times = [np.zeros_like(x) for x in (tables, hidden, out, class_offsets, v, type_offsets)], np.zeros(tables.shape[:2])
        in_class = np.bincount(classes.kind[ids], minlength=lm_score.CLASSES)
        for x, y in zip(around.T, ids, strict=True):
            k = classes.kind[y]
            low, high = classes.starts[k], classes.starts[k + 1]
            h = np.tanh(sum(t[i] for t, i in zip(tables, x, strict=True)) + hidden)
            p, q = h @ out + class_offsets, v[low:high] @ h + type_offsets[low:high]
            p, q = (np.exp(z - z.max()) / np.exp(z - z.max()).sum() for z in (p, q))
            p[k] -= 1
            q[y - low] -= 1
            back = (out @ p + q @ v[low:high]) * (1 - h * h)
            for i, place in enumerate(x):
                steps[0][i, place] += back * lm_score.TABLE_RATE
                times[i, place] += 1
            steps[1] += back * lm_score.RATE / len(ids)
            steps[2] += np.outer(h, p) * lm_score.RATE / len(ids)
            steps[3] += p * lm_score.RATE / len(ids)
            steps[4][low:high] += np.outer(q, h) * lm_score.TYPE_RATE / np.sqrt(in_class[k])
            steps[5][low:high] += q * lm_score.TYPE_RATE / np.sqrt(in_class[k])
        steps[0] /= np.sqrt(np.maximum(times, 1))[:, :, None]
        want = [x - step for x, step in zip((tables, hidden, out, class_offsets, v, type_offsets), steps, strict=True)]
        lm_score.train(weights, around, ids, classes)
        for got, x in zip(lm_score.unpack(weights), want, strict=True):
            assert np.allclose(got, x, rtol=1e-3, atol=2e-4 * scale)
