"""Every query with SQL against DuckDB, and every other one for rows, over the smallest tables."""

import os

import duckdb
import pytest

from lodeseam.plans import queries as core

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(float(v), 6) + 0.0) if isinstance(v, float) or type(v).__name__ == "Decimal" else repr(v)


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, db, name):
    df = core.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in core.ORACLE:
        assert columns
        return
    result = db.execute(core.ORACLE[name])
    names = [d[0] for d in result.description]
    want = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall())
    assert columns == sorted(names) and got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
