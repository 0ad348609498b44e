"""The registered queries that have SQL, against it, on the smallest tables."""

import os

import duckdb
import pytest

from factloom.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    assert sorted((str([r[c] for c in columns]) for r in df.collect())) == sorted(str(list(r)) for r in want)
