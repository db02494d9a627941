"""Every query with a DuckDB twin gives its rows."""

import math
import os

import duckdb
import pytest

from cellspark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.fixture(scope="module")
def sf_dir():
    return os.environ.get("TEST_ORACLE_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_its_oracle(name, spark, duck, sf_dir):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(relation.columns) == columns
    at = [relation.columns.index(c) for c in columns]
    want = sorted(tuple(plain(float(row[i]) if type(row[i]).__name__ == "Decimal" else row[i]) for i in at) for row in relation.fetchall())
    got = sorted(tuple(plain(row[c]) for c in columns) for row in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_an_oracle_runs(name, spark, sf_dir):
    assert registry.queries()[name](spark, sf_dir).count() >= 0


def test_entry():
    import __spark_entry__ as e

    assert set(registry.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
