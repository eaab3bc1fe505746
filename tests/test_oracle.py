"""Registered queries against their DuckDB oracle on the smallest scale factor."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from trialgrid.plans.catalog import QUERIES
from trialgrid.sources.tables import TABLES

# Every registered query of the trial engine.
FAST = sorted(QUERIES)


def _norm(rows, cols):
    """Rows with columns in name order, sorted with floats bucketed coarsely;
    floats are then compared with a tolerance of one unit in the 6th place
    (the oracle's compensated sums may be off in the last bit)."""
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    def key(r):
        return tuple("" if r[i] is None else (f"{r[i]:.2f}" if isinstance(r[i], float) else str(r[i])) for i in order)
    return [tuple(r[i] for i in order) for r in sorted(rows, key=key)]


def _same(a, b, abs_tol=2e-6):
    if len(a) != len(b):
        return False
    for ra, rb in zip(a, b):
        for x, y in zip(ra, rb):
            if isinstance(x, float) and isinstance(y, float):
                if not (math.isclose(x, y, rel_tol=1e-6, abs_tol=abs_tol) or (math.isnan(x) and math.isnan(y))):
                    return False
            elif x != y:
                return False
    return True


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql())
    assert len(QUERIES) >= 44


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, sf_dir, con, name):
    df = E.queries()[name](spark, sf_dir)
    rel = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _same(_norm([tuple(r) for r in df.collect()], df.columns), _norm(rel.fetchall(), ocols))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert "pt" in df.columns
