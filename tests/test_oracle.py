"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest

from lumengraph.operators import clusters
from lumengraph.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM read_parquet('{sf}/{t}.parquet')")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, repr(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalog.oracles()))
def test_same_rows_as_sql(spark, duck, sf, name):
    df = catalog.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = duck.execute(catalog.oracles()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    want = [tuple(r[names.index(c)] for c in cols) for r in got.fetchall()]
    assert want
    assert ordered(map(tuple, df.select(*cols).collect())) == ordered(want)


@pytest.mark.parametrize("name", ["a7_meta_edges", "t15_meta_neighbors"])
def test_packed_edges_give_the_same_rows_as_sql(spark, duck, sf, name, monkeypatch):
    """As with more members than may be broadcast."""
    monkeypatch.setattr(clusters, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(clusters, "PART_MEMBERS", 300)
    test_same_rows_as_sql(spark, duck, sf, name)


def test_every_query_has_sql():
    """But the approximate search, which the tests hold against brute force."""
    assert set(catalog.queries()) - set(catalog.oracles()) == {"v8_indexed_search"}


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["id", "in_degree", "impact"]
