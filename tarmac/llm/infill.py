"""Fill-in-the-middle: a text's prefix, suffix and middle, cut at places that its id decides and put in training order.

An Arrow-batched pandas UDF collects the end offsets of a text's units (a run of letters, or any other character) in a
compact array; two look-ups give the cuts, and hashlib gives seeds and digests. Work is by row: nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import table
from tarmac.session import ship

UNIT = regex.compile("[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = "1:"
#: Of 100 texts, how many are cut, and of 100 that are, how many begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
RESULT = T.StructType([T.StructField(c, T.LongType() if c in ("n", "prefix_chars", "middle_chars") else T.StringType()) for c in ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")])


def seeds(identity: str | None, seed: str = SEED) -> tuple[int, ...]:
    """Four numbers of 32 bits from the SHA-256 of the seed and an id; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}{identity or ''}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def ends_of(text: str) -> array:
    """The end of each unit, in code points, with 0 ahead of them; four bytes a unit."""
    ends = array("I", [0])
    ends.extend(m.end() for m in UNIT.finditer(text))
    return ends


def transform(identity: str | None, text: str) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output)."""
    h1, h2, h3, h4 = seeds(identity)
    ends = ends_of(text)
    n = len(ends) - 1
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= CUT:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low], ends[high]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def rebuild(output: str, form: str) -> str:
    """The text that an output of ``transform`` was made of."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    one, rest = output.removeprefix(first).split(second, 1)
    two, middle = rest.split(MIDDLE, 1)
    return two + middle + one if form == "spm" else one + middle + two


@F.pandas_udf(RESULT)
def _transformed(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
    rows = []
    for identity, text in zip(ids, texts, strict=True):
        row = transform(identity, text)
        rows.append((*row, hashlib.sha256(row[4].encode()).hexdigest()))
    out = pd.DataFrame(rows, columns=RESULT.names)
    return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})


@F.pandas_udf(T.StringType())
def _rebuilt(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([rebuild(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from a column of outputs and one of forms."""
    return _rebuilt(output, form)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output, output_sha256) for each row, over whole texts.

    Null texts count as empty and stay plain, as do texts that hold a mark. The id alone decides the cuts, so repeated rows
    come out alike; null ids share one seed and stay null. An empty table gives no row; other columns don't matter.
    """
    ship(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    return source.select("id", _transformed(F.col("id").cast("string"), "text").alias("made")).select("id", "made.*")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    back = F.sha2(restored(F.col("output"), F.col("form")), 256)
    return found.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", back.alias("restored_sha256"))
