"""The base columns of the operators against DuckDB's SQL."""

import duckdb
import pytest

from tarmac.llm.queries import ORACLE_SQL, QUERIES
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_base_matches_sql(spark, sf, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    df = QUERIES[name](spark, sf)
    found = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())


def test_copies_of_repeated_and_missing_ids(spark, tmp_path):
    """A row each for documents without id or with the same one; texts that differ by their line ends are copies."""
    docs = [(1, "a\r\nb"), (1, "a\nb"), (None, "a\rb"), (None, None), (2, ""), (3, "c")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    df = QUERIES["base_of_op7"](spark, str(tmp_path))
    found = con.execute(ORACLE_SQL["base_of_op7"])
    columns = [d[0] for d in found.description]
    assert len(docs) == df.count() and rows(df.columns, [tuple(r) for r in df.collect()]) == rows(columns, found.fetchall())
