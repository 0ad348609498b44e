"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from factloom import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(rows):
    return sorted(str([x.isoformat() if hasattr(x, "isoformat") else x for x in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r[c] for c in columns) for r in df.collect()]
    if name in Q.ORACLE_SQL:
        cursor = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE_SQL[name]})")
        assert plain(rows) == plain(cursor.fetchall())
    else:
        assert rows


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_anchor_violations_beside_other_letters(spark, tmp_path):
    """A direction or a year that touches a letter beyond ASCII counts as in the SQL."""
    first, second = "The river carries sand slowly toward the sea", "It has losesñes and 1999é of them in the valley"
    text = f"{first}. {'x' * 1200}. {second}. {'y' * 1200}. The wind ñgains force in ٣ places of the wide delta."
    spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = Q.QUERIES["anchor_violations"](spark, str(tmp_path))
    want = c.execute(f"SELECT {', '.join(got.columns)} FROM ({Q.ORACLE_SQL['anchor_violations']})").fetchall()
    assert any(r[-1] for r in want) and plain(map(tuple, got.collect())) == plain(want)
