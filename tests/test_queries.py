"""Every query against its DuckDB twin, on the smallest tables."""

import decimal

import duckdb
import pytest

from corpusloom.plans import catalogue
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    return repr(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    found = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert got == want


def test_queries_without_sql_run(spark):
    for name in catalogue.queries().keys() - catalogue.oracle_sql().keys():
        catalogue.queries()[name](spark, SF).collect()


def test_every_statement_belongs_to_a_query():
    assert catalogue.oracle_sql().keys() <= catalogue.queries().keys()
