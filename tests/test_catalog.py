"""Every registered query against its SQL in DuckDB at the smallest scale."""

import os

import duckdb
import pytest

from keyloom.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{D}/{t}.parquet"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.skipif(not os.path.isdir(D), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, D)
    got = sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))
    rel = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in rel.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert sorted(names) == sorted(df.columns)
    assert got == sorted(str(tuple(r[i] for i in order)) for r in rel.fetchall())
