"""Token counts through a cache of content digests.

A text's digest (SHA-256 of its normalised content: line ends as ``\\n``) and the tokenizer's digest (SHA-256 of its file)
are the key of a stored count. Documents are joined to the cache; of those that miss, one text of each digest is encoded
and its count appended. The count of a normalised text equals the text's own: the tokenizer drops white space, and line
ends hold nothing else.
"""

from __future__ import annotations

import hashlib
import os
import re
from contextlib import contextmanager

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.llm.common import join_hot, map_rows, path_exists, shared_dir, stash, table

LIMIT = 2048
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
MEMO = 150_000
BATCH_ROWS = 500
#: Texts of these characters only are not changed by NFC, and hold neither apostrophes nor the `<` of special strings:
#: the tokenizer's pattern then cuts them into runs of letters, single digits, and runs of other visible characters.
PLAIN = re.compile(r"[\t\n\r\x20-\x26\x28-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]*")
PLAIN_PIECES = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def content_digest(text):
    """The digest of a text column; null counts as empty."""
    same_ends = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "\r\n?", "\n")
    return F.unhex(F.sha2(same_ends.cast("binary"), 256))


class Counter:
    """Counts the tokens of texts, remembering the counts of pieces that the tokenizer encodes on their own."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own would only add to its memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.memo: dict[str, int] = {}

    def count(self, text: str) -> int:
        if PLAIN.fullmatch(text):
            pieces = PLAIN_PIECES.findall(text.lower())
        else:
            pieces = re.split(r"[ \t\n\r]+", text)  # no token spans white space, and NFC joins nothing across it
        missing = set(pieces).difference(self.memo)
        if missing:
            if len(self.memo) > MEMO:
                self.memo.clear()
                missing = set(pieces)
            some = list(missing)
            for piece, found in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.memo[piece] = len(found)
        return sum(map(self.memo.__getitem__, pieces))


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """While texts are encoded, Arrow batches are short: they stand in the executor's memory twice, beside the tokenizer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_counters: dict[str, Counter] = {}


def encode_misses(misses: DataFrame, path: str, version: str) -> DataFrame:
    """The cache's rows for (digest, text): every text is encoded whole."""

    def rows(columns):
        if version not in _counters:
            _counters[version] = Counter(path)
        for digest, text in zip(*columns, strict=True):
            yield digest, version, _counters[version].count(text)

    return map_rows(misses.select("digest", "text"), CACHE_SCHEMA, rows)


def token_counts(docs: DataFrame, cache_path: str, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", copies: bool = False) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit): one row per input row, counted over whole texts; with ``copies``, if wished, how
    many rows have the same normalised text, itself included.

    ``cache_path`` is a Parquet table in a folder that all executors share; it is made if missing, read, and appended to.
    Null texts count as empty (0 tokens), ids may be null, repeated rows are repeated, an empty table gives no row.
    """
    spark, version = docs.sparkSession, tokenizer_version(tokenizer_path)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    keyed = source.withColumn("digest", content_digest(F.col("text")))
    sized = stash(keyed.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "sizes")
    if path_exists(spark, cache_path):
        known = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version).select("digest")
        misses = keyed.select("digest", "text").join(known, "digest", "left_anti")
    else:
        misses = keyed.select("digest", "text")
    first = misses.groupBy("digest").agg(F.first("text").alias("text"))
    with small_batches(spark):
        encode_misses(first, tokenizer_path, version).write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
    stored = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs may have stored the same digest
    counted = stash(sized.groupBy("digest").agg(F.count(F.lit(1)).alias("rows"), F.count(F.lit(1)).alias("copies")).join(stored, "digest", "left"), "digests")
    return join_hot(sized, counted, ["digest"], "rows").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), *["copies"] * copies)


def cache_of(spark: SparkSession, table_path: str) -> str:
    """Where a table's counts are kept: under ``spark.tarmac.tokenCache``, else in the shared folder; both outlive the application."""
    base = spark.conf.get("spark.tarmac.tokenCache", "") or shared_dir(spark)
    return f"{base.rstrip('/')}/token-cache-{hashlib.sha256(table_path.encode()).hexdigest()[:16]}"


def op7_token_counts(spark: SparkSession, sf_dir: str, copies: bool = False) -> DataFrame:
    found = token_counts(table(spark, sf_dir, "documents"), cache_of(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), copies=copies)
    return found.withColumnRenamed("id", "doc_id")
