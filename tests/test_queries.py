"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from quillstone.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    try:
        return f"{float(value):.6g}"
    except (TypeError, ValueError):
        return str(value)


def rows(df):
    return sorted(tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    out = catalog.QUERIES[name](spark, SF)
    assert len(set(out.columns)) == len(out.columns)
    if name in catalog.ORACLES:
        want = duck.execute(catalog.ORACLES[name]).df()
        got = out.toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert name in BRUTE_FORCE and out.count() > 0


#: Queries without SQL: test_rules holds their operators against brute force.
BRUTE_FORCE = ["fact_clusters", "extraction_groups"]
