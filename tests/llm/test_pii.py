import hashlib
import re

from pyspark.sql import functions as F

from tarmac.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = re.sub(r"[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text or "") if passes(k, m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


TEXTS = [
    None, "", "plain words only", "mail a.b@c.de now", "a@b.c_d@e.f", "é@x.y ü a+b%c@d-e.f.g.", "1.2.3.4 256.1.1.1 1.2.3.4.5 001.002.003.004 9999.1.1.1",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1111, 4111111111111112", "tel +1 (017) 555-7713 and +49 30 1234567 and +1234", "x" * 3000 + "@", "9" * 5000,
    "ßßß 🙂 a@b.cd 🙂 1.1.1.1 🙂 +12345678901", "1.2.3.4 5555 5555 5555 4444", "+1 234 567 8901 +1 234 567 8902", "@@@ a@b @c.d a@b..c", "é" * 50 + "4111111111111111", "john (at) mail (dot) com", "call (555) 555-1234 now",
    "12 34-56  78", "4111 1111 1111 1111 4111 1111 1111 1111", "a@b.c" * 40,
]


def found(spark, texts):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    return {r["id"]: r for r in pii.find(df).withColumn("b", pii.listing(F.col("base"))).withColumn("s", pii.listing(F.col("spans"))).collect()}


def test_base_spans_against_plain_patterns(spark):
    got = found(spark, TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i]["b"] == brute(t), t
        assert set(filter(None, got[i]["b"].split(","))) <= set(got[i]["s"].split(","))


def test_driver_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in pii.op10_pii(spark, sf).collect():
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [want.count(f"{k}:") for k in pii.BASE_KINDS]


def test_method_adds_spans(spark):
    texts = [f"please call phone (555) 555-1{i:03d} today, or +1 (212) 555-0{i:03d}, mail me{i}@mail.example.com" for i in range(60)]
    got = found(spark, texts)
    assert sum("phone:18:" in r["s"] or r["s"].count("phone") == 2 for r in got.values()) == 60


def test_redaction(spark):
    texts = ["mail a.b@c.de now", None, "nothing", "1.2.3.4 5555 5555 5555 4444", "éé +1 (212) 555-0123 ü"]
    df = spark.createDataFrame([(i, t, len(t) if t else None, "keep") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, base string")
    out = {r.doc_id: r for r in pii.redact(df).collect()}
    assert pii.redact(df).columns == df.columns
    assert [out[i].text for i in range(5)][:3] == ["mail [EMAIL] now", None, "nothing"] and out[4].text == "éé [PHONE] ü"
    assert out[0].n_chars == len(out[0].text) and out[1].n_chars is None and out[0].base == "keep"
    again = {r.doc_id: r.text for r in pii.redact(df.where("doc_id <> 9").select("*")).collect()}
    assert all(not brute(t) for t in again.values())


def test_empty_table_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find(empty).count() == 0 and pii.redact(empty).count() == 0
    twice = spark.createDataFrame([(1, "a@b.cd"), (1, "a@b.cd"), (None, "a@b.cd")], "doc_id long, text string")
    assert pii.find(twice).count() == 3


def test_em_finds_reliable_labelers():
    counts = {}
    for truth, n in ((1, 80), (0, 40)):
        for code in range(81):
            votes, p = pii.votes_of(code), 1.0
            for j, v in enumerate(votes):
                right = 0.9 if j < 3 else 0.5
                p *= 0.1 if v == 0 else 0.9 * (right if (v > 0) == bool(truth) else 1 - right)
            counts[("email", False, code)] = counts.get(("email", False, code), 0) + n * p
    belief, right = pii.estimate(counts)
    all_yes, all_no = sum(2 * 3**k for k in range(4)), 0
    assert belief["email", False, all_yes] > 0.95 and belief["email", False, all_no] < 0.1
    assert right["email", 0, 1, 1] > 0.7 and abs(right["email", 3, 1, 1] - right["email", 3, 0, 1]) < 0.2


def test_classifier_learns_from_spans(spark):
    """The word before, which no labeler knows, tells numbers apart that get the same votes; brute force gives the same odds."""
    import math

    yes, no = [0] * pii.FEATURES, [0] * pii.FEATURES
    rows, counts = [], {("phone", True, 0): 40, ("phone", True, 80): 40}
    for i in range(80):
        f = [0, 3, 6, 9, pii.WIDE_AT, pii.LENGTH_AT, *[pii.HASHED_AT + n * pii.BUCKETS + (7 if i < 40 else 8) for n in range(4)]]
        rows.append((3, True, 80 if i < 40 else 0, f))
        for x in f:
            (yes if i < 40 else no)[x] += 1
    df = spark.createDataFrame(rows, "rank int, wide boolean, code int, features array<int>")
    assert pii.count_votes(df) == counts
    model = pii.train(df, counts, {("phone", True, 0): 0.0, ("phone", True, 80): 1.0})
    start = 3 * (pii.FEATURES + 1)
    for x in range(pii.FEATURES):
        share = (yes[x] + no[x]) / 82
        want = math.log((yes[x] + 5 * share) / 46 / ((no[x] + 5 * share) / 46)) if share else 0.0
        assert abs(model[start + 1 + x] - want) < 1e-9 and model[start] == 0.0
    assert model[start + 1 + pii.HASHED_AT + 7] > 1 > -1 > model[start + 1 + pii.HASHED_AT + 8]


def test_secrets_and_spans_against_their_candidates(spark):
    texts = [f'token = "{i:08x}e39e3e49cf46b2d7c90f3602a3d0b9{i:02x}"### and text' for i in range(30)] + ["the token: value of things", "key = 12", "secret=short", "a:b=c"]
    got = found(spark, texts)
    assert all(got[i]["s"] == "secret:9:49" and got[i]["b"] == "" for i in range(30)) and not any(got[i]["s"] for i in range(30, 34))
    out = pii.redact(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert out[0].text == 'token = "[SECRET]"### and text' and out[30].text == texts[30]


def test_every_span_by_brute_force_over_the_candidates(spark, sf):
    """Spans are the base ones and the accepted candidates: the classifier's odds are added up here in Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = pii.fit(docs)
    text = F.coalesce("text", F.lit(""))
    cands = docs.select("doc_id", pii.cut(text).alias("cut")).select("doc_id", F.explode(pii.candidates(F.col("cut"))).alias("c")).select("doc_id", "c.*", pii.span_features(F.col("c")).alias("f")).collect()
    want = {}
    for d in {r.doc_id for r in cands}:
        mine = [r for r in cands if r.doc_id == d]
        base = [r for r in mine if r.strict]
        clear = lambda r, base=base: not any(b.start < r.end and r.start < b.end for b in base)
        odds = lambda r: model[r["rank"] * (pii.FEATURES + 1)] + sum(model[r["rank"] * (pii.FEATURES + 1) + 1 + x] for x in r.f)
        kept = base + [r for r in mine if not r.strict and odds(r) >= 0 and clear(r)]
        want[d] = ",".join(f"{pii.KINDS[k]}:{a}:{e}" for a, k, e in sorted((r.start, r["rank"], r.end) for r in kept))
    for r in pii.op10_pii(spark, sf).collect():
        assert r.spans == want.get(r.doc_id, "")


def test_clashing_names(spark):
    names = ["__cut", "__text", "__found", "__spans", "__merged", "__new", "__first", "__done", "parts", "found", "every", "merged", "text_now", "text_first", "text_done", "id"]
    df = spark.createDataFrame([(1, "mail a.b@c.de now", 17)], "doc_id long, text string, n_chars long").withColumns({n: F.lit("mine") for n in names})
    out = pii.redact(df).first()
    assert out.text == "mail [EMAIL] now" and out.n_chars == 16 and all(out[n] == "mine" for n in names)


def test_long_text(spark):
    long = "word " * 400_000 + "mail a.b@c.de"
    got = found(spark, [long])
    assert got[0]["b"] == f"email:{len(long) - 8}:{len(long)}"
