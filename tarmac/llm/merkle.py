"""A Merkle manifest of a table: a leaf a row, a subroot a source, one root, and for each row the proof that leads to it.

Nodes are lowercase hex SHA-256; every ARITY consecutive nodes become the digest of their concatenated hex, a last run of
fewer (even one) as well, until one is left. A tree is cut into aligned blocks of ``ARITY ** block_levels`` nodes:

1. rows are hashed, sorted by range and ranked within their source (each range's rows are counted, no task sees a source);
2. climbing: blocks give their roots, which are the nodes of the next, much smaller step, until each source has one;
   the subroots, in order of their sources, are one more tree;
3. descending from the top, each block meets the proof of its own root and walks its nodes by fractal traversal: stacked
   subtrees, of which the existing ones hold what the present node's proof needs while the desired ones, the next at each
   height, grow by one leaf a node. Each walk appends the upper proof, so proofs are never shuffled at the bottom.

A block's walk holds its nodes and a few subtrees; what one task holds doesn't depend on the size of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tarmac.llm.common import stash, table
from tarmac.session import ship

ARITY = 3
#: Levels of a block (6,561 nodes) and of a subtree of the traversal.
BLOCK_LEVELS, SUBTREE_LEVELS = 8, 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PROOF = "array<struct<left: string, right: string>>"
BATCH_ROWS = 4000


def digest_of(values: list[Column]) -> Column:
    """SHA-256 of the values as text, each with its count of UTF-8 bytes ahead, or ``-`` if null."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(proof, leaf, lambda node, run: F.sha2(F.concat(run["left"], node, run["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """SHA-256 of a proof's siblings, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(proof, lambda run: F.concat(run["left"], run["right"]))), 256)


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def height_of(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Subtree:
    """The nodes of levels ``low`` to ``high`` (exclusive) under the node ``at`` of level ``high``, grown leaf by leaf."""

    def __init__(self, leaves: list[str], low: int, high: int, at: int):
        self.leaves, self.low, self.high, self.at = leaves, low, high, at
        self.next, self.end = at * ARITY**high, min((at + 1) * ARITY**high, len(leaves))
        self.levels: list[list[str]] = [[] for _ in range(high - low)]
        self.open: list[list[str]] = [[] for _ in range(high)]  # children that wait for their parent
        self.top: str | None = None

    def _put(self, level: int, node: str) -> None:
        if level >= self.high:
            self.top = node
            return
        if level >= self.low:
            self.levels[level - self.low].append(node)
        self.open[level].append(node)
        if len(self.open[level]) == ARITY:
            self._close(level)

    def _close(self, level: int) -> None:
        children, self.open[level] = self.open[level], []
        self._put(level + 1, parent(children))

    def step(self) -> None:
        """Take one leaf; after the last one, runs of fewer are closed."""
        if self.next >= self.end:
            return
        self._put(0, self.leaves[self.next])
        self.next += 1
        if self.next == self.end:
            for level in range(self.high):
                if self.open[level]:
                    self._close(level)

    def whole(self) -> Subtree:
        while self.next < self.end:
            self.step()
        return self

    def run(self, level: int, leaf: int) -> tuple[str, str]:
        """What stands left and right of the leaf's ancestor of a level in its run."""
        nodes, place = self.levels[level - self.low], leaf // ARITY**level
        begin = place - place % ARITY - self.at * ARITY ** (self.high - level)
        mine = begin + place % ARITY
        return "".join(nodes[begin:mine]), "".join(nodes[mine + 1 : begin + ARITY])


def block_root(leaves: list[str], height: int) -> str:
    """The node ``height`` levels above the leaves; open runs are all that is held."""
    return Subtree(leaves, height, height, 0).whole().top


def walk(leaves: list[str], height: int) -> Iterator[list[tuple[str, str]]]:
    """Each leaf's proof up to the node ``height`` levels above, by fractal traversal."""
    cuts = [(low, min(low + SUBTREE_LEVELS, height)) for low in range(0, height, SUBTREE_LEVELS)]
    existing = [Subtree(leaves, low, high, 0).whole() for low, high in cuts]
    desired = [Subtree(leaves, low, high, 1) for low, high in cuts]
    for leaf in range(len(leaves)):
        yield [tree.run(level, leaf) for tree in existing for level in range(tree.low, tree.high)]
        for k, (low, high) in enumerate(cuts):
            desired[k].step()
            if (leaf + 1) % ARITY**high == 0:
                existing[k], desired[k] = desired[k], Subtree(leaves, low, high, desired[k].at + 1)


def _block_height(total: int, levels: int) -> int:
    """Levels of the blocks of a tree: all of a small one's."""
    return min(levels, height_of(total))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one block at a time, of rows sorted by their first two columns."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and row[:2] != held[0][:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _by_block(df: DataFrame) -> DataFrame:
    return df.repartition("g", "block").sortWithinPartitions("g", "block", "rank")


def _block(levels: int) -> Column:
    return F.expr(f"rank div {ARITY**levels}")


def ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` with their rank within ``g`` by the columns ``by`` (nulls first), and the total of ``g``, in the shared folder.

    Ranges are sorted and counted; a group of any size, and rows that agree in all of ``by``, spread over many ranges.
    """
    tied = stash(nodes.withColumn("tie", F.monotonically_increasing_id()), "nodes")
    order = ["g", *by, "tie"]
    sort = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    placed = stash(sort.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), "ranges")
    counts = placed.groupBy("g", "part").agg(F.count(F.lit(1)).alias("rows"), F.min("at").alias("from"))
    group = Window.partitionBy("g")
    before, whole = (F.sum("rows").over(w) for w in (group.orderBy("part"), group))
    counts = counts.select("g", "part", (before - F.col("rows") - F.col("from")).alias("shift"), whole.alias("total"))
    return placed.join(counts, ["g", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """(g, block, total, node): the roots of the blocks of (g, rank, total, node)."""

    def run(batches):
        out: list[tuple] = []
        for rows in _blocks(batches):
            total = rows[0][3]
            out.append((*rows[0][:2], total, block_root([r[4] for r in rows], _block_height(total, levels))))
            if len(out) >= BATCH_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

    schema = T.StructType.fromDDL("g string, block long, total long, node string")
    arrow = to_arrow_schema(schema)
    return _by_block(nodes.select("g", _block(levels).alias("block"), "rank", "total", "node")).mapInArrow(run, schema)


def _walked(nodes: DataFrame, marks: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """The columns ``keep`` of ``nodes`` (g, rank, total, node, ...) with subroot, root and proof.

    ``marks`` has (g, block, subroot, root, proof) of each block's own root.
    """
    lead = nodes.select("g", _block(levels).alias("block"), "rank", "total", "node", *[F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)])
    head = marks.select("g", "block", F.lit(-1).cast("long").alias("rank"), "subroot", "root", "proof")
    both = _by_block(lead.unionByName(head, allowMissingColumns=True))
    schema = T.StructType([*nodes.select(*keep).schema.fields, *head.select("subroot", "root", "proof").schema.fields])
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in schema.fields])
    arrow, n = to_arrow_schema(schema), len(keep)

    def batch(rows: list[tuple], left: list[str], right: list[str], offsets: list[int]) -> pa.RecordBatch:
        proofs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"]))
        plain = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=False)]
        return pa.RecordBatch.from_arrays([*plain, proofs.cast(arrow.field("proof").type)], schema=arrow)

    def run(batches):
        rows, left, right, offsets = [], [], [], [0]
        for (mark, *block) in _blocks(batches):
            subroot, root, upper = mark[5 + n :]
            over_left, over_right = [u["left"] for u in upper], [u["right"] for u in upper]
            for row, proof in zip(block, walk([r[4] for r in block], _block_height(block[0][3], levels)), strict=True):
                rows.append((*row[5 : 5 + n], subroot, root))
                left += [a for a, _ in proof] + over_left
                right += [b for _, b in proof] + over_right
                offsets.append(len(left))
                if len(rows) >= BATCH_ROWS:
                    yield batch(rows, left, right, offsets)
                    rows, left, right, offsets = [], [], [], [0]
        if rows:
            yield batch(rows, left, right, offsets)

    return both.mapInArrow(run, schema)


def _climb(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The steps of the trees: nodes (g, rank, total, node), and the (g, node) of the trees that end at each step."""
    steps, ends = [nodes], []
    while True:
        roots = stash(_roots(steps[-1], levels), "roots")
        small = F.col("total") <= ARITY**levels
        ends.append(roots.where(small).select("g", "node"))
        rest = roots.where(~small)
        if rest.isEmpty():
            return steps, ends
        steps.append(rest.select("g", F.col("block").alias("rank"), F.expr(f"(total + {ARITY**levels - 1}) div {ARITY**levels}").alias("total"), "node"))


def _descend(steps: list[DataFrame], ends: list[DataFrame], tops: DataFrame, keep: list[str], levels: int) -> DataFrame:
    """``keep`` of the lowest step's nodes with subroot, root and proof; ``tops`` has (g, subroot, root, proof) of each tree's own root."""
    below = None
    for depth in reversed(range(len(steps))):
        marks = ends[depth].select("g").join(tops, "g").withColumn("block", F.lit(0).cast("long"))
        if below is not None:
            marks = marks.unionByName(below)
        if not depth:
            return _walked(steps[0], marks, keep, levels)
        below = stash(_walked(steps[depth], marks, ["g", "rank"], levels).withColumnRenamed("rank", "block"), "proofs")


def prove(leaves: DataFrame, by: list[str], keep: list[str], levels: int = BLOCK_LEVELS) -> DataFrame:
    """``keep`` with subroot, root and proof of (g, leaf, ...): g is a group's place in the order of groups."""
    nodes = ranked(leaves.withColumn("node", F.unhex("leaf")).drop("leaf"), by)
    steps, ends = _climb(nodes.withColumn("node", F.lower(F.hex("node"))), levels)
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.unionByName(more)
    named = ranked(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "node"), ["name"])
    top_steps, top_ends = _climb(named, levels)
    root = top_ends[-1].select("g", F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"), F.expr(f"cast(array() AS {PROOF})").alias("proof"))
    tops = _descend(top_steps, top_ends, root, ["name", "node"], levels).select(F.col("name").alias("g"), F.col("node").alias("subroot"), "root", "proof")
    return _descend(steps, ends, stash(tops, "tops"), [c if c != "leaf" else "node" for c in keep], levels)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", carry: dict[str, Column] | None = None, block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """(id, group, leaf, subroot, root, proof) for each row, and the columns of ``carry``.

    A leaf is the digest of the row's ``fields``; within a group leaves ascend by id (null ids first, ties by the leaf, so
    rows that agree in all fields are interchangeable), groups ascend by their UTF-8 bytes (null first, then the empty
    string). ``proof`` lists, level by level, the hex digests left and right of the path; ``folded`` leads it to the root.
    Empty and very long texts are hashed whole; one row alone is its own root; an empty table gives no row; columns that
    aren't fields don't matter.
    """
    ship(docs.sparkSession)
    carry = carry or {}
    clash = {"g", "id", "group", "leaf", "node", "rank", "total", "block", "part", "at", "tie", "subroot", "root", "proof"} & {c.lower() for c in carry}
    if clash:
        raise ValueError(f"carried columns need other names: {sorted(clash)}")
    group = F.col(f"`{group_col}`").cast("string")
    leaves = docs.select(
        F.coalesce(F.concat(F.lit("="), group), F.lit("")).alias("g"), F.col(f"`{id_col}`").alias("id"), group.alias("group"),
        digest_of([F.col(f"`{c}`") for c in fields]).alias("leaf"), *[v.alias(k) for k, v in carry.items()],
    )
    return prove(leaves, ["id", "node"], ["id", "group", "leaf", *carry], block_levels).withColumnRenamed("node", "leaf")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = digest_of([F.col(c) if c != "text" else F.translate("text", "\n", "") for c in FIELDS])
    altered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.unhex(tampered))
    found = manifest(docs, carry={"tampered": altered})
    back = folded(F.coalesce(F.lower(F.hex("tampered")), F.col("leaf")), F.col("proof"))
    found = found.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), back.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
