"""The SQL twins of the training-data queries."""

import duckdb
import pytest

from hexlore.llm.oracles import ORACLES
from hexlore.llm.queries import QUERIES
from tests.test_queries import TABLES, plain

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = QUERIES[name](spark, D)
    columns = sorted(df.columns)
    told = con.sql(ORACLES[name])
    assert sorted(told.columns) == columns
    at = [told.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in told.fetchall())
