"""Every registered query against its DuckDB oracle at sf0.001."""

import duckdb
import pytest

import __spark_entry__ as entry
from taskgrid.plans import registry
from tests.conftest import SF001
from tools.check_oracle import TABLES, digest

# the optional subpackage has its own tests
QUERIES = {k: f for k, f in entry.queries().items() if k in registry.QUERIES}
ORACLE = {k: q for k, q in entry.oracle_sql().items() if k in registry.QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    sdf = QUERIES[key](spark, SF001)
    srows = [tuple(r) for r in sdf.collect()]
    rel = con.execute(ORACLE[key])
    ocols = [d[0] for d in rel.description]
    orows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(sdf.columns, srows) == digest(ocols, orows)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 1 and "marked_count" in df.columns
