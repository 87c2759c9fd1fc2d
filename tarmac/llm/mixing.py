"""Mixing to target weights by soft membership, in DataFrame functions only.

A classifier learned from a labelled table gives each document posteriors over domains: naive Bayes over the words and
marks that a document holds, restricted to those whose share differs surely between a domain and the rest. A document
with n tokens, rate r and posterior p adds r * n * p expected tokens to the domains. Rates are fitted so that the
domains' totals meet their targets in the least-squares sense, by projected gradient in its lazy form: every step sums
the gradient over all documents, adds it (scaled by the small matrix of the domains' second moments, and halved while it
gains nothing) to what was gathered before, and projects where the gathered gradients lead onto rates that are not
negative. A document's rate so follows from its posteriors and one number for each domain.

What reaches the driver is a few numbers for each domain. All significant features count; they come from a bounded sample of
labelled documents, and are broadcast if there are at most ``BROADCAST_ROWS`` of them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import join_hot, row_keys, spare, stash, table

DOMAINS = ["clean", "poor", "toxic"]
TARGETS = {"clean": 0.90, "poor": 0.08, "toxic": 0.02}
BROADCAST_ROWS = 200_000
SURE, RATIO = 4.0, 3.0
BIAS = "\u0000bias"
PULL = 1e-5


def words_of(text: Column) -> Column:
    """The words of a text, with an empty one at either end where it doesn't start or end with a word."""
    return F.split(F.lower(text), r"[^\p{L}]+")


def marks_of(text: Column) -> Column:
    return F.split(text, r"[^#$%&*|!<>=_~^]+")


def count_words(words: Column) -> Column:
    ends = F.when(F.get(words, F.lit(0)) == "", 1).otherwise(0) + F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (F.size(words) - ends).cast("long")


def with_tokens(docs: DataFrame) -> DataFrame:
    """Adds n_tokens and __tokens to rows with __text: its distinct words and marks, how varied its words are, and a mark
    that every text has."""
    cut = docs.withColumn("__words", words_of(F.col("__text")))
    cut = cut.withColumn("__distinct", F.array_distinct("__words")).withColumn("n_tokens", count_words(F.col("__words")))
    size, kinds = F.size("__words"), F.size("__distinct")
    varied = F.concat_ws(":", F.lit("\u0000varied"), F.floor(F.log2(size)).cast("string"), F.floor(2 * F.log2(size / kinds)).cast("string"))
    return cut.withColumn("__tokens", F.concat("__distinct", F.array_distinct(marks_of(F.col("__text"))), F.array(varied, F.lit(BIAS)))).drop("__words", "__distinct")


def classifier(docs: DataFrame, labelled: DataFrame, per_domain: int = 2000, max_fit_bytes: int = 65536) -> DataFrame:
    """(feature long, w_<domain> double): weights of the features that tell a domain from the rest, and of the bias.

    ``labelled`` has doc_id and domain. Fitted on at most ``per_domain`` documents of each domain, in the order of a hash
    of their ids, among those of at most ``max_fit_bytes`` bytes. A feature's presence weighs by the log-ratio of its
    share in the domain to its share in the rest, its absence likewise; only features that are at least ``RATIO`` times as
    frequent in the domain, by a test of ``SURE`` deviations, count (others say little of a text in a rare language, or of a short one).
    The bias holds the domains' shares over all labels, and all features' absence.
    """
    usable = labelled.where(F.col("doc_id").isNotNull() & F.col("domain").isin(DOMAINS)).select("doc_id", "domain").dropDuplicates(["doc_id"])
    shares = {r["domain"]: r["count"] for r in usable.groupBy("domain").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("long"))
    ids = None
    for d in DOMAINS:
        some = usable.where(F.col("domain") == d).orderBy(order, "doc_id").limit(per_domain)
        ids = some if ids is None else ids.unionByName(some)
    text = F.col("text").cast("string")
    fits = F.octet_length(text) <= max_fit_bytes
    seen = docs.where(fits).select("doc_id", text.alias("__text")).join(F.broadcast(ids), "doc_id")
    held = with_tokens(seen).select("domain", F.explode_outer("__tokens").alias("token"))
    counts = held.groupBy("token").agg(*[F.count_if(F.col("domain") == d).alias(d) for d in DOMAINS])
    counts = stash(counts, "features")
    base = counts.where(F.col("token") == BIAS).first()
    totals = {d: base[d] if base else 0 for d in DOMAINS}
    whole = sum(totals.values())
    weights, absences, surely = [], [], F.lit(False)
    for d in DOMAINS:
        n, rest = totals[d], whole - totals[d]
        inside, outside = F.col(d), sum(F.col(x) for x in DOMAINS if x != d)
        p, q = (inside + 0.5) / (n + 1.0), (outside + 0.5) / (rest + 1.0)
        pooled = (inside + outside + 1.0) / (whole + 2.0)
        z = F.abs(p - q) / F.sqrt(pooled * (1 - pooled) * (1 / (n + 1.0) + 1 / (rest + 1.0)))
        tells = (z >= SURE) & (p >= RATIO * q)
        on = F.when(tells, 1.0).otherwise(0.0)
        absences.append((F.ln((1 - p) / (1 - q)) * on).alias(f"a_{d}"))
        weights.append((F.ln(p / q) * on).alias(f"w_{d}"))
        surely = surely | tells
    told = counts.where(F.col("token") != BIAS).select(F.xxhash64("token").alias("feature"), *weights, *absences, surely.alias("sure"))
    kept = stash(told.where("sure").drop("sure"), "weights")
    absent = kept.agg(*[F.coalesce(F.sum(f"a_{d}"), F.lit(0.0)).alias(d) for d in DOMAINS]).first()
    prior = {d: math.log((shares.get(d, 0) + 0.5) / (sum(shares.values()) + 0.5 * len(DOMAINS))) for d in DOMAINS}
    bias = docs.sparkSession.range(1).select(F.xxhash64(F.lit(BIAS)).alias("feature"), *[F.lit(prior[d] + absent[d]).alias(f"w_{d}") for d in DOMAINS])
    return kept.select("feature", *[(F.col(f"w_{d}") - F.col(f"a_{d}")).alias(f"w_{d}") for d in DOMAINS]).unionByName(bias)


def memberships(docs: DataFrame, model: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, n_tokens, p_<domain>): posteriors of each row's domains; rows stay apart even where ids repeat or are null.

    k1 and k2 are the row's keys (``row_keys``). Distinct tokens meet the features in a broadcast join (a shuffled one if
    the features are many), and each task adds up a row's weights before anything is shuffled. (explode_outer, because
    explode makes the optimiser compute the array once more to filter empty ones; none is empty here.)
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    k1, k2 = row_keys(docs)
    source = docs.select(F.monotonically_increasing_id().alias("__row"), k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("__text"))
    row = ["__row", "k1", "k2", "doc_id", "n_tokens"]
    single = with_tokens(source).select(*row, F.explode_outer("__tokens").alias("__t"))
    small = model.count() <= BROADCAST_ROWS
    met = single.join(F.broadcast(model) if small else model, F.xxhash64("__t") == F.col("feature"))
    scored = met.groupBy(*row).agg(*[F.sum(f"w_{d}").alias(d) for d in DOMAINS])
    top = F.greatest(*DOMAINS)
    mass = sum(F.exp(F.col(d) - top) for d in DOMAINS)
    return scored.select("doc_id", "k1", "k2", "n_tokens", *[(F.exp(F.col(d) - top) / mass).alias(f"p_{d}") for d in DOMAINS])


def fit_rates(members: DataFrame, targets: dict[str, float], rounds: int = 40, tolerance: float = 1e-7) -> DataFrame:
    """``members`` with a column rate: not negative, and such that the domains' expected tokens meet their targets.

    Targets are shares of all tokens. The rates minimise half the squared misses plus a slight pull (``PULL``) towards 1.
    A domain without any mass can't be met; its target is left out. Without tokens every rate is 1.
    """
    p = [F.col(f"p_{d}") for d in DOMAINS]
    total, *mass = members.agg(F.sum("n_tokens"), *[F.sum(F.col("n_tokens") * x) for x in p]).first()
    live = [i for i in range(len(p)) if total and mass[i] and mass[i] / total > 1e-9]
    if not live:
        return members.withColumn("rate", F.lit(1.0))
    want = sum(targets[DOMAINS[i]] for i in live) or 1.0
    aim, k = [targets[DOMAINS[i]] / want for i in live], len(live)

    def rate(gathered: list[float]) -> Column:
        """Where the gathered gradients lead from 1, projected onto rates that are not negative."""
        return F.greatest(F.lit(0.0), F.lit(1.0) - sum(F.lit(g) * p[i] for g, i in zip(gathered, live, strict=True)))

    def measure(gathered: list[float]) -> tuple[list[float], list[list[float]]]:
        """The gradient in the domains, and its slope: sums over all documents."""
        weight = F.col("n_tokens") / total
        sums = [F.sum(F.col("__r") * weight * p[i]) for i in live]
        moments = [F.sum(F.when(F.col("__r") > 0, weight).otherwise(0.0) * p[i] * p[j]) for i in live for j in live]
        row = members.withColumn("__r", rate(gathered)).agg(*sums, *moments).first()
        miss = [row[a] - aim[a] - PULL * gathered[a] for a in range(k)]
        return miss, [[row[k + a * k + b] + (PULL if a == b else 0.0) for b in range(k)] for a in range(k)]

    size = lambda miss: sum(x * x for x in miss)
    at = [0.0] * k
    miss, slope = measure(at)
    left = rounds
    while left > 0 and max(map(abs, miss)) > tolerance:
        step, length = solve(slope, miss), 1.0
        while left > 0:
            left -= 1
            to = [x + length * s for x, s in zip(at, step, strict=True)]
            there, slope_there = measure(to)
            if size(there) < size(miss) * (1 - 1e-4 * length):
                break
            length /= 2
        else:
            break
        at, miss, slope = to, there, slope_there
    return members.withColumn("rate", rate(at))


def solve(a: list[list[float]], b: list[float]) -> list[float]:
    """A small linear system by elimination with pivots."""
    n = len(b)
    m = [[*row, x] for row, x in zip(a, b, strict=True)]
    for i in range(n):
        at = max(range(i, n), key=lambda r: abs(m[r][i]))
        m[i], m[at] = m[at], m[i]
        for r in range(n):
            if r != i:
                f = m[r][i] / m[i][i]
                m[r] = [x - f * y for x, y in zip(m[r], m[i], strict=True)]
    return [m[i][n] / m[i][i] for i in range(n)]


def domains_of(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of a labels table: toxic, else poor where quality is 0, else clean; rows without quality are left out."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("domain is not null")


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>, rate): how many times each document is to be drawn for the domains to meet their targets.

    One row per input row. Null and blank texts have no tokens and the domains' shares as posteriors. An empty table
    gives no row; without labels the posteriors are even.
    """
    members = stash(memberships(docs, classifier(docs, labelled)).drop("k1", "k2"), "members")
    return fit_rates(members, targets or TARGETS)


def with_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The documents, all columns as they are, with their ``rate`` (see ``mix``) as the last column.

    Rates belong to rows: rows that share an id, or have none, get their own, and repeated rows the same. A column of the
    documents named rate gives way to ours. Null texts stay null; an empty table stays empty.
    """
    members = stash(memberships(docs, classifier(docs, labelled)), "members")
    names = [spare(docs, "k1"), spare(docs, "k2")]
    one = fit_rates(members, targets or TARGETS).groupBy("k1", "k2").agg(F.max("rate").alias("rate"), F.count(F.lit(1)).alias("rows"))
    one = stash(one, "rates").toDF(*names, "rate", spare(docs, "rows"))
    own = [c for c in docs.columns if c.lower() != "rate"]
    keyed = docs.withColumns(dict(zip(names, row_keys(docs), strict=True))).select(*[f"`{c}`" for c in own], *names)
    return join_hot(keyed, one, names, one.columns[-1]).select(*[f"`{c}`" for c in own], "rate")


def op1_mixing_to_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), domains_of(table(spark, sf_dir, "labels")))
