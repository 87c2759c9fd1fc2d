"""Nearest neighbours by inverted lists with an adaptive scan over dimensions.

Vectors are scaled to unit length (there the nearest by distance is the nearest by cosine) and rotated by a fixed random
orthogonal matrix, so that any block of columns is a fair sample of a distance. Lists come from k-means over a bounded
sample; every vector is indexed. A query scans its ``probes`` nearest lists: blocks of columns add to the partial squared
distance, and after each block a test drops the candidates whose scaled partial distance exceeds the current k-th best
by more than chance allows. The survivors' cosines are computed in double precision on the original vectors.

Equal vectors are one candidate (with their smallest ids), and equal queries one query, so copies cost nothing. Lists are
cut into blocks of at most ``BLOCK`` vectors, met by blocks of at most ``BLOCK`` queries: no list or query set has to fit
into one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarmac.llm.common import stash, table
from tarmac.session import ship

K = 5
QUERY_STEP = 50
BLOCK = 2048
SAMPLE = 20_000
MAX_LISTS = 4096
COLUMNS = 16
#: Of the lists, as many are probed: vectors without any clusters need that many for a recall over 0.9.
PROBE_SHARE = 0.65
CONFIDENCE = 2.5
#: Queries scanned together, candidates that give the first limit, the share of living pairs from which each is scanned
#: on its own, and what rounding to single precision may cost: survivors are scored exactly.
TOGETHER, HEAD, FEW, SLACK = 256, 256, 0.1, 1e-4
SEED = 7


def rotation(dims: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Centres of unit vectors; a centre that loses its vectors moves to the worst served one."""
    rng = np.random.default_rng(SEED)
    centres = x[rng.choice(len(x), size=k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(part @ centres.T).argmax(axis=1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        counts = np.bincount(near, minlength=k)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            worst = np.argsort((x * centres[near]).sum(axis=1))[: len(empty)]
            sums[empty] = x[worst]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>): vectors that take part."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    usable = vectors.where(F.col(f"`{id_col}`").isNotNull() & F.col(f"`{vec_col}`").isNotNull()).where(finite & F.exists(v, lambda x: x != 0))
    return usable.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), v.alias("v"))


def search(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row by cosine, ties to the smaller id.

    ``is_query`` is a condition on ``vec_id``; candidates are all rows but the query's own id. Vectors that are null or
    zero, or hold null or non-finite components, and rows with a null id, take no part. Vectors of different lengths have
    no cosine: each length is searched on its own (with an index of its own). Repeated ids count as one. An empty table gives
    no row; with fewer than k candidates in the probed lists all of them are given.
    """
    usable, out = valid_vectors(vectors, id_col, vec_col), None
    for r in usable.groupBy(F.size("v").alias("n")).count().orderBy("n").collect():  # a row for each length that occurs
        found = _search_length(usable.where(F.size("v") == r["n"]), is_query, k, probes)
        out = found if out is None else out.unionByName(found)
    return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if out is None else out


def _search_length(usable: DataFrame, is_query, k: int, probes: int | None) -> DataFrame:
    """The search among vectors of one length."""
    spark, keep = usable.sparkSession, k + 1
    ship(spark)
    rows = usable.dropDuplicates(["vec_id", "v"])
    order = Window.partitionBy("v").orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= keep)
    classes = stash(first.groupBy("v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "classes")
    queries = rows.where(is_query).join(classes.select("v", "rep"), "v").select("vec_id", "rep")
    queries = stash(queries.withColumnRenamed("vec_id", "query_id"), "queries")

    n = classes.count()
    empty = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], empty)
    dims = len(classes.first()["v"])
    lists = int(min(MAX_LISTS, max(1, round(n**0.5 / 2))))
    sample = np.array([r["v"] for r in classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).collect()])  # bounded: SAMPLE vectors
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    lists = min(lists, len(sample))
    probes = min(lists, probes or max(8, math.ceil(PROBE_SHARE * lists)))
    sent = spark.sparkContext.broadcast((kmeans(sample, lists), rotation(dims)))

    def assign(how_many: int):
        def run(batches):
            centres, _ = sent.value
            for pdf in batches:
                x = np.stack(pdf["v"].to_numpy())
                near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centres.T
                top = np.argpartition(-near, min(how_many, near.shape[1]) - 1, axis=1)[:, :how_many]
                pdf = pdf.assign(list=list(top.astype(np.int32))).explode("list")
                yield pdf.astype({"list": "int32"})

        return run

    listed = stash(classes.mapInPandas(assign(1), "v array<double>, rep long, ids array<long>, list int"), "listed")
    asked = classes.select("v", "rep").join(queries.select("rep").distinct(), "rep", "left_semi").select("v", "rep")
    asked = stash(asked.mapInPandas(assign(probes), "v array<double>, rep long, list int"), "asked")

    def cut(frame, name):
        sizes = frame.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
        return F.broadcast(sizes)  # one row for each of at most MAX_LISTS lists

    cuts, asks = cut(listed, "blocks"), cut(asked, "query_blocks")
    left = listed.join(cuts, "list").join(asks, "list").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    left = left.withColumn("query_block", F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))).select("list", "block", "query_block", "v", "rep", "ids")
    right = asked.join(cuts, "list").join(asks, "list").withColumn("query_block", F.pmod(F.xxhash64("rep"), F.col("query_blocks")).cast("int"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("list", "block", "query_block", "v", "rep")

    def scan(candidates: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        out = {"rep": [], "score": [], "ids": []}
        if len(candidates) and len(questions):
            block, ids, reps = Scan(np.stack(candidates["v"].to_numpy()), sent.value[1]), candidates["ids"].to_numpy(), questions["rep"].to_numpy()
            for j, at, score in block.nearest(np.stack(questions["v"].to_numpy()), keep, ids):
                out["rep"].append(reps[j])
                out["score"].append(score)
                out["ids"].append(ids[at])
        return pd.DataFrame(out)

    by = ["list", "block", "query_block"]
    met = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(scan, "rep long, score double, ids array<long>")
    single = met.select("rep", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
    top = single.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= keep)
    top = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("top"))
    own = queries.join(top, "rep").select("query_id", F.expr("filter(top, x -> x.vec_id != query_id)").alias("top"))
    ranked = own.select("query_id", F.posexplode(F.slice("top", 1, k)).alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))


class Scan:
    """A block of vectors, rotated and laid out by blocks of columns."""

    def __init__(self, original: np.ndarray, turn: np.ndarray):
        self.original, self.turn = original, turn
        self.norms = np.linalg.norm(original, axis=1)
        unit = original / self.norms[:, None] @ turn
        self.dims = unit.shape[1]
        self.blocks = [np.ascontiguousarray(unit[:, i : i + COLUMNS], dtype=np.float32) for i in range(0, self.dims, COLUMNS)]
        self.squares = [(x * x).sum(axis=1) for x in self.blocks]

    def nearest(self, queries: np.ndarray, keep: int, ids):
        """(query row, candidate row, exact cosine): each query's ``keep`` best candidates, ties to the smaller first id."""
        for at in range(0, len(queries), TOGETHER):
            some = queries[at : at + TOGETHER]
            sizes = np.linalg.norm(some, axis=1)
            turned = (some / sizes[:, None] @ self.turn).astype(np.float32)
            for j, alive in enumerate(self._survivors(turned, keep)):
                scores = np.array([np.dot(self.original[i], some[j]) for i in alive]) / (self.norms[alive] * sizes[j])
                for x in sorted(range(len(alive)), key=lambda x, s=scores, a=alive: (-s[x], ids[a[x]][0]))[:keep]:
                    yield at + j, int(alive[x]), float(scores[x])

    def _survivors(self, turned: np.ndarray, keep: int) -> list[np.ndarray]:
        """For each query the candidates that no test has dropped and that may be among its ``keep`` best.

        While most pairs live, a block of columns adds to all partial distances by one matrix product; once few do, only
        to theirs.
        """
        n, m = len(self.original), len(turned)
        limit = np.full(m, np.inf, dtype=np.float32)
        if n >= keep:
            head = sum(self._part(b, turned, slice(0, max(keep, HEAD))) for b in range(len(self.blocks)))
            limit = np.partition(head, keep - 1, axis=0)[keep - 1]
        partial, pairs = np.zeros((n, m), dtype=np.float32), None
        for b, block in enumerate(self.blocks):
            d = min(self.dims, (b + 1) * COLUMNS)
            if pairs is None:
                partial += self._part(b, turned, slice(None))
            else:
                i, j = pairs
                partial = partial + ((block[i] - turned[j, b * COLUMNS : d]) ** 2).sum(axis=1)
            if d < self.dims:  # the hypothesis that a candidate is as near as the limit: abandoned when too unlikely
                most = (limit * (1 + CONFIDENCE / np.sqrt(d)) ** 2 + SLACK) * (d / self.dims)
            else:
                most = limit * (1 + SLACK) + SLACK
            stay = partial <= (most if pairs is None else most[pairs[1]])
            if pairs is not None:
                pairs, partial = (pairs[0][stay], pairs[1][stay]), partial[stay]
            elif d == self.dims or stay.mean() < FEW:
                pairs = np.nonzero(stay)
                partial = partial[pairs]
        order = np.argsort(pairs[1], kind="stable")
        rows, distance = pairs[0][order], partial[order]
        out, ends = [], np.cumsum(np.bincount(pairs[1], minlength=m))
        for begin, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
            near = distance[begin:end]
            if len(near) > keep:
                out.append(rows[begin:end][near <= np.partition(near, keep - 1)[keep - 1] * (1 + SLACK) + SLACK])
            else:
                out.append(rows[begin:end])
        return out

    def _part(self, b: int, turned: np.ndarray, rows: slice) -> np.ndarray:
        """What the b-th block of columns adds to the squared distances of these rows to all queries."""
        q = turned[:, b * COLUMNS : (b + 1) * COLUMNS]
        return self.squares[b][rows, None] + (q * q).sum(axis=1) - 2 * (self.blocks[b][rows] @ q.T)


def op6_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_STEP == 0)
