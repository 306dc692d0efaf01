"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import os

import duckdb
import pytest

from tidewave.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(df):
    df = df[sorted(df.columns)]
    text = df.apply(lambda c: c.map(lambda v: "" if v is None or v != v else f"{v + 0:.6g}" if isinstance(v, float) else str(v)))
    return sorted(map(tuple, text.values.tolist()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert canonical(registry.queries()[name](spark, DATA).toPandas()) == canonical(duck.execute(registry.oracle_sql()[name]).df())
