"""Every registered query against its SQL on DuckDB at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches(spark, con, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=key)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=key) == want


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")
@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert len(QUERIES[name](spark, SF).take(1)) == 1
