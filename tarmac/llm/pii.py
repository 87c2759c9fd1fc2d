"""Personal data by aggregating weak labelers, in DataFrame functions only.

Candidate spans are the matches of the base patterns (valid or not) and of wider patterns: addresses written out, phone
numbers without a country code, and values of keys that name a secret (kind secret). Four labelers vote on each candidate
(1, -1, or 0 for no opinion): the pattern with its checks, a gazetteer (endings of addresses, issuers of cards, area codes,
reserved networks, prefixes of keys), the words around, and the shape. Votes are counted by kind over the whole corpus;
expectation-maximisation over these counts (a few hundred rows, whatever the corpus) estimates how reliable each labeler is
for each kind and how likely each vote pattern is personal data.

These probabilities are soft labels for the final span classifier, which sees the spans themselves: their shape, length and
first characters, the word before and the word after (hashed into ``BUCKETS`` buckets each), and the votes. It is naive
Bayes: one grouped sum over all candidates trains it. Base spans always stay; candidates that the classifier accepts and that
overlap none of them are added.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import spare, stash, table

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE_KINDS = KINDS[:4]
AROUND = 32
LABELERS = 4
CODES = 3**LABELERS
BUCKETS, LENGTHS = 256, 16
#: Where the classifier's features of a kind start: votes, wider pattern or not, length, then the hashed ones.
VOTES_AT, WIDE_AT, LENGTH_AT = 0, 3 * LABELERS, 3 * LABELERS + 2
HASHED_AT = LENGTH_AT + LENGTHS
FEATURES = HASHED_AT + 4 * BUCKETS

# The base patterns, written without backtracking. A match starts where a run of its first characters
# starts, or where the last match ended inside such a run; that is where the plain pattern's leftmost match starts.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Wider patterns, and a cheap condition that every match needs.
WIDE = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?: ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z0-9-]{2,}+)++",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "secret": r"(?i)(?<=(?:token|secret|passw(?:or)?d|api[_ -]?key|access[_ -]?key|private[_ -]?key)[\"']?\s{0,2}[:=]\s{0,2}[\"']?)(?<![A-Za-z0-9/+_-])[A-Za-z0-9/+_-]{12,}+",
}
# The gazetteers and cue words.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|io|co|de|fr|es|it|uk|nl|be|ch|at|eu|us|ca|au|jp|cn|in|br|ru|pl|se|no|dk|fi|pt|mx|ar"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4[4-9])|35|3[068])"
AREAS = r"^(?:\+|00)?1?[2-9][0-9]{2}"
RESERVED = r"^(?:0|22[4-9]|2[34][0-9]|25[0-5])\."
KEY_PREFIXES = r"^(?:AKIA|ASIA|gh[pousr]_|xox[abpr]-|sk-|AIza|ey[JK])"
CUES = {
    "email": r"(?i)mail|contact|write|address|kontakt|correo|courriel",
    "ip": r"(?i)\bip\b|host|server|login|client|from|adresse",
    "card": r"(?i)card|visa|master|amex|credit|karte|carte|tarjeta|pay",
    "phone": r"(?i)tel|phone|call|fax|mobil|cell|llam|appel",
    "secret": r"(?i)token|secret|passw|api|auth|bearer|credential",
}
AGAINST = r"(?i)version|release|isbn|order|invoice|serial|section|id[:=#]"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    turned = F.reverse(digits)

    def add(total, i):
        d = F.substr(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def valid(kind: str, x: Column) -> Column:
    """The check that a base match has to pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+", "")
        small = lambda p: F.when(F.length(bare(p)) > 3, False).when(bare(p) == "", True).otherwise(bare(p).cast("int") <= 255)
        return F.forall(F.split(x, r"\."), small)
    digits = _digits(x)
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    return F.length(digits).between(10, 15)


def _votes(kind: str, x: Column, before: Column, after: Column, strict: Column) -> list[Column]:
    """What the four labelers say."""
    around = F.concat_ws(" ", before, after)
    digits = _digits(x)
    pattern = F.when(strict, 1).otherwise(-1)
    if kind == "email":
        gazetteer = F.when(F.lower(x).rlike(rf"(?:\.|dot[)\]]) ?(?:{ENDINGS})$"), 1).otherwise(-1)
        shape = F.when(F.length(x).between(6, 64) & ~x.rlike(r"^[.%+-]|\.\."), 1).otherwise(-1)
    elif kind == "ip":
        gazetteer = F.when(x.rlike(RESERVED), -1).otherwise(1)
        shape = F.when(x.rlike(r"(?:^|\.)0[0-9]|[0-9]{4}"), -1).when(before.rlike(r"[0-9]\.$|v$") | after.rlike(r"^\.[0-9]"), -1).otherwise(1)
    elif kind == "card":
        gazetteer = F.when(digits.rlike(ISSUERS), 1).otherwise(-1)
        shape = F.when(x.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$"), 1).otherwise(-1)
    elif kind == "secret":
        pattern = F.when(x.rlike(r"^(?:[0-9a-f]{20,}|[0-9A-F]{20,}|(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z]).{16,})$"), 1).otherwise(-1)
        gazetteer = F.when(x.rlike(KEY_PREFIXES), 1).otherwise(0)
        shape = F.when(x.rlike("[0-9]") & x.rlike("[A-Za-z]") & (F.length(x) >= 16), 1).otherwise(-1)
    else:
        gazetteer = F.when(digits.rlike(AREAS), 1).otherwise(0)
        shape = F.when(x.rlike(r"\([0-9]{2,4}\)|^\+?[0-9]+(?:[ .-][0-9]{2,4}){2,}$"), 1).otherwise(-1)
    context = F.when(around.rlike(CUES[kind]), 1).when(around.rlike(AGAINST), -1).otherwise(0)
    return [pattern, gazetteer, context, shape]


PATTERNS = [(k, BASE[k], False) for k in BASE_KINDS] + [(k, WIDE[k], True) for k in WIDE]


def cut(text: Column) -> Column:
    """The matches (m0 ...) of each pattern in a text column, and the pieces (p0 ...) between them; empty where a cheap
    test says that there is no match. Kept as a column of its own, so that each pattern is searched for once."""
    needs = {
        ("email", False): F.contains(text, F.lit("@")), ("phone", False): F.contains(text, F.lit("+")), ("ip", False): text.rlike(r"[0-9]\.[0-9]"),
        ("card", False): text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), ("email", True): text.rlike(r"(?i)[(\[]at[)\]]"), ("phone", True): text.rlike(r"[0-9]{3}[.-][0-9]{4}"),
        ("secret", True): text.rlike(r"[:=]\s{0,2}[\"']?[A-Za-z0-9/+_-]{12}"),
    }
    none, out = F.array().cast("array<string>"), []
    for i, (kind, pattern, wide) in enumerate(PATTERNS):
        need = needs[kind, wide]
        out.append(F.when(need, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"m{i}"))
        out.append(F.when(need, F.split(text, pattern, -1)).otherwise(none).alias(f"p{i}"))
    return F.struct(*out)


def _places(found: Column, pieces: Column, kind: str, wide: bool) -> Column:
    """A pattern's matches as structs: offsets are code points, ends exclusive; hit, before and after are texts.

    The matches and the pieces between them alternate, so their lengths add up to the offsets: one pass over both.
    """
    place = "struct<start:bigint,rank:int,end:bigint,wide:boolean,strict:boolean,code:int,long:boolean,hit:string,before:string,after:string>"

    def step(state, i):
        hit, before, after = F.get(found, i), F.get(pieces, i), F.get(pieces, i + 1)
        start = state["at"] + F.char_length(before)
        end = start + F.char_length(hit)
        strict = F.lit(False) if wide else F.coalesce(valid(kind, hit), F.lit(False))
        near = F.substring(before, -AROUND, AROUND), F.substring(after, 1, AROUND)
        votes = _votes(kind, hit, *near, strict)
        code = sum((v + 1) * 3**k for k, v in enumerate(votes))
        here = F.struct(
            start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.cast("long").alias("end"), F.lit(wide).alias("wide"),
            strict.alias("strict"), code.cast("int").alias("code"), (F.length(_digits(hit)) >= (13 if kind == "card" else 7)).alias("long"),
            hit.alias("hit"), near[0].alias("before"), near[1].alias("after"),
        )
        return F.struct(end.cast("long").alias("at"), F.array_append(state["out"], here).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{place}>").alias("out"))
    steps = F.when(F.size(found) > 0, F.sequence(F.lit(0), F.size(found) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, begin, step, lambda state: state["out"])


def candidates(parts: Column) -> Column:
    """All candidates of a column of ``cut`` as one array of structs; card-like runs of fewer than 13 digits are left out."""
    found = [_places(parts[f"m{i}"], parts[f"p{i}"], kind, wide) for i, (kind, _, wide) in enumerate(PATTERNS)]
    return F.filter(F.concat(*found), lambda c: c["strict"] | (c["rank"] != KINDS.index("card")) | c["long"])


def span_features(c: Column) -> Column:
    """A candidate's features as numbers below ``FEATURES``."""
    shape = F.regexp_replace(F.regexp_replace(c["hit"], "[A-Za-z]+", "a"), "[0-9]+", "9")
    words = [F.substring(shape, 1, 16), F.substring(F.lower(c["hit"]), 1, 2), *[F.lower(F.regexp_extract(c[side], p, 1)) for side, p in (("before", r"(\p{L}+)[^\p{L}]*$"), ("after", r"^[^\p{L}]*(\p{L}+)"))]]
    hashed = [HASHED_AT + n * BUCKETS + F.pmod(F.xxhash64(w), F.lit(BUCKETS)) for n, w in enumerate(words)]
    votes = [VOTES_AT + 3 * k + F.floor(c["code"] / 3**k) % 3 for k in range(LABELERS)]
    length = LENGTH_AT + F.least(F.lit(LENGTHS - 1), F.floor(F.length(c["hit"]) / 3))
    return F.array(*[x.cast("int") for x in (*votes, WIDE_AT + F.when(c["wide"], 1).otherwise(0), length, *hashed)])


def candidate_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(rank, wide, code, features): a row for each candidate of all documents."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    found = docs.select(cut(text).alias("cut")).select(F.explode_outer(candidates(F.col("cut"))).alias("c")).where("c is not null")
    return found.select("c.rank", "c.wide", "c.code", span_features(F.col("c")).alias("features"))


def count_votes(rows: DataFrame) -> dict[tuple[str, bool, int], int]:
    """How often each vote pattern occurs over all documents, by kind and by whether the wider pattern found it."""
    found = rows.groupBy("rank", "wide", "code").agg(F.count(F.lit(1)).alias("n"))
    return {(KINDS[r["rank"]], r["wide"], r["code"]): r["n"] for r in found.collect()}  # 5 kinds x 2 x 81 patterns at most


def votes_of(code: int) -> list[int]:
    return [code // 3**k % 3 - 1 for k in range(LABELERS)]


def estimate(counts: dict[tuple[str, bool, int], int], rounds: int = 100) -> tuple[dict, dict]:
    """Expectation-maximisation: the probability of each pattern, and (kind, labeler, truth, vote) reliabilities.

    Labelers are taken as independent given the truth. A prior worth a few votes says that labelers are right more often
    than not, which keeps kinds with few candidates, and the two classes' names, in place.
    """
    trust = 3.0
    prior = {(y, v): trust * (0.7 if (v > 0) == bool(y) else 0.3) if v else trust * 0.5 for y in (0, 1) for v in (-1, 0, 1)}
    kinds = {k for k, _, _ in counts}
    right = {(k, j, y, v): prior[y, v] / sum(prior[y, u] for u in (-1, 0, 1)) for k in kinds for j in range(LABELERS) for y in (0, 1) for v in (-1, 0, 1)}
    share = dict.fromkeys(kinds, 0.5)
    belief: dict = {}
    for _ in range(rounds):
        before = dict(belief)
        for kind, wide, code in counts:
            odds = math.log(share[kind] / (1 - share[kind]))
            odds += sum(math.log(right[kind, j, 1, v] / right[kind, j, 0, v]) for j, v in enumerate(votes_of(code)))
            belief[kind, wide, code] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        mass: dict = defaultdict(float)
        for key, n in counts.items():
            for y, p in ((1, belief[key]), (0, 1 - belief[key])):
                mass[key[0], y] += n * p
                for j, v in enumerate(votes_of(key[2])):
                    mass[key[0], j, y, v] += n * p
        for k in kinds:
            share[k] = (mass[k, 1] + trust) / (mass[k, 1] + mass[k, 0] + 2 * trust)
            for j in range(LABELERS):
                for y in (0, 1):
                    total = mass[k, y] + sum(prior[y, v] for v in (-1, 0, 1))
                    for v in (-1, 0, 1):
                        right[k, j, y, v] = (mass[k, j, y, v] + prior[y, v]) / total
        if before and max(abs(belief[k] - before[k]) for k in belief) < 1e-9:
            break
    return belief, right


def numbers(values: list[float]) -> Column:
    """A constant array."""
    return F.from_json(F.lit(json.dumps(values)), "array<double>")


def train(rows: DataFrame, counts: dict[tuple[str, bool, int], int], belief: dict, pull: float = 5.0) -> list[float]:
    """The naive Bayes classifier: for each kind the log-odds to start with, then the weights of its features.

    ``rows`` are candidates, ``belief`` their soft labels by vote pattern. Shares of a feature among spans and others are
    drawn to its share among both by ``pull`` pseudo-counts, so rare features weigh little and unseen ones nothing.
    """
    at = lambda kind, wide, code: (KINDS.index(kind) * 2 + wide) * CODES + code
    soft = [0.0] * (len(KINDS) * 2 * CODES)
    mass = {(r, y): 1.0 for r in range(len(KINDS)) for y in (0, 1)}
    for key, n in counts.items():
        soft[at(*key)] = belief[key]
        mass[KINDS.index(key[0]), 1] += n * belief[key]
        mass[KINDS.index(key[0]), 0] += n * (1 - belief[key])
    label = F.get(numbers(soft), (F.col("rank") * 2 + F.col("wide").cast("int")) * CODES + F.col("code"))
    seen = rows.select("rank", label.alias("label"), F.explode("features").alias("feature")).groupBy("rank", "feature")
    sums = seen.agg(F.sum("label").alias("yes"), F.sum(1 - F.col("label")).alias("no")).collect()  # a row for each kind and feature at most
    out = [0.0] * (len(KINDS) * (FEATURES + 1))
    for r in range(len(KINDS)):
        out[r * (FEATURES + 1)] = math.log(mass[r, 1] / mass[r, 0])
    for s in sums:
        n1, n0 = mass[s["rank"], 1], mass[s["rank"], 0]
        share = (s["yes"] + s["no"]) / (n1 + n0)
        out[s["rank"] * (FEATURES + 1) + 1 + s["feature"]] = math.log((s["yes"] + pull * share) / (n1 + pull) / ((s["no"] + pull * share) / (n0 + pull)))
    return out


def fit(docs: DataFrame, text_col: str = "text") -> list[float] | None:
    """The classifier learnt from all candidates of the documents; None where they have none."""
    rows = stash(candidate_rows(docs, text_col), "candidates")
    counts = count_votes(rows)
    return train(rows, counts, estimate(counts)[0]) if counts else None


def log_odds(c: Column, model: list[float]) -> Column:
    """That a candidate is personal data."""
    weights, start = numbers(model), c["rank"] * (FEATURES + 1)
    return F.aggregate(span_features(c), F.get(weights, start), lambda total, f: total + F.get(weights, start + 1 + f))


def spans(found: Column, model: list[float] | None, threshold: float = 0.0) -> tuple[Column, Column]:
    """(base, all): arrays of structs (start, rank, end) of a column of candidates, by start and kind.

    A candidate needs log-odds of ``threshold``; without a model none is added.
    """
    place = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["end"].alias("end"))
    sure = F.filter(found, lambda c: c["strict"])
    base = F.array_sort(F.transform(sure, place))
    if model is None:
        return base, base
    clear = lambda c: ~F.exists(sure, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    extra = F.transform(F.filter(found, lambda c: F.when(c["strict"], False).otherwise((log_odds(c, model) >= threshold) & clear(c))), place)
    return base, F.array_sort(F.concat(base, extra))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): arrays of structs (start, rank, end), rank counting in ``KINDS``; one row per input row.

    Null texts count as empty and have no spans; ids may be null; repeated rows are repeated; an empty table gives no row.
    Spans of different kinds may overlap; of equal starts the kind listed first stands first.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    base, every = spans(F.col("found"), fit(docs, text_col))
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), cut(text).alias("cut")).select("id", candidates(F.col("cut")).alias("found"))
    return source.select("id", base.alias("base"), every.alias("spans"))


def listing(places: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(places, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    A text that changed is searched once more, because what stands between two replacements may match by itself. Null
    texts stay null. ``chars_col`` is set to the new length where a text changed. Other columns are kept as they are,
    whatever their names; repeated rows stay repeated; an empty table stays empty.
    """
    model = fit(docs, text_col)
    text, first, done = (spare(docs, n) for n in ("text_now", "text_first", "text_done"))
    found = _replaced(docs.withColumn(text, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))), text, first, model)
    again = _replaced(found.withColumn(text, F.coalesce(first, F.lit(""))), text, done, model).withColumn(done, F.coalesce(done, first))
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.coalesce(done, F.col(f"`{text_col}`")).alias(c))
        elif c == chars_col:
            out.append(F.coalesce(F.char_length(done).cast(docs.schema[c].dataType), F.col(f"`{c}`")).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return again.select(*out)


def _replaced(df: DataFrame, text: str, to: str, model: list[float] | None) -> DataFrame:
    """Adds the column ``to``: the column ``text`` with its spans replaced, null where it has none."""
    parts, found, every, merged = (spare(df, n) for n in ("parts", "found", "every", "merged"))
    df = df.withColumn(parts, cut(F.col(text))).withColumn(found, candidates(F.col(parts))).withColumn(every, spans(F.col(found), model)[1])

    def merge(done, s):
        last = F.element_at(done, -1)
        grown = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last["start"].alias("start"), last["rank"].alias("rank"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] > s["start"]), grown).otherwise(F.array_append(done, s))

    joined = F.aggregate(every, F.array().cast("array<struct<start:bigint,rank:int,end:bigint>>"), merge)
    df = df.withColumn(merged, F.when(F.size(every) > 0, joined))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def piece(s, i):
        start = F.coalesce(F.get(F.col(merged), i - 1)["end"], F.lit(0))
        return F.concat(F.substr(text, (start + 1).cast("int"), (s["start"] - start).cast("int")), F.get(names, s["rank"]))

    tail = F.substr(text, (F.element_at(merged, -1)["end"] + 1).cast("int"), F.lit(2147483647))
    changed = F.concat(F.array_join(F.transform(merged, piece), ""), tail)
    return df.withColumn(to, F.when(F.col(merged).isNotNull(), changed)).drop(parts, found, every, merged)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    secrets = F.size(F.filter("spans", lambda s: s["rank"] == KINDS.index("secret"))).cast("long")
    return found.select(
        F.col("id").alias("doc_id"), *[count(k) for k in BASE_KINDS], secrets.alias("n_secret"), F.sha2(listing(F.col("base")), 256).alias("base_sha256"),
        listing(F.col("spans")).alias("spans"),
    )
