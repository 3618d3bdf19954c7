"""The operators with a SQL form, against DuckDB."""

import duckdb
import pytest

from rankvane.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = Q.queries()[name](spark, SF).toPandas(), c.sql(Q.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted(map(tuple, df[columns].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)
