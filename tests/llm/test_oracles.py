"""The training-data queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lexispark.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    df = QUERIES[name](spark, data)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)
