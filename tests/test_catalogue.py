"""Every registered query of the engine against its oracle SQL on DuckDB."""

import math
import os

import duckdb
import pytest

from tessella.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def test_every_query_has_an_oracle():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_its_oracle(spark, sf, con, name):
    df = catalogue.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    made = con.sql(catalogue.ORACLE[name])
    assert sorted(made.columns) == cols
    at = [made.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in made.fetchall()), key=repr)
