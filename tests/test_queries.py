"""Every query with SQL gives the rows that DuckDB gives for it."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, bool) or not isinstance(x, int):
        return str(x) if isinstance(x, datetime.datetime) else x
    return round(float(x), 5)


def table(rows):
    return sorted((tuple(plain(x) for x in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = duck.execute(SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(df.columns) == sorted(names)
    want, have = table(got.fetchall()), table(tuple(r) for r in df.select(*names).collect())
    assert len(have) == len(want) > 0
    wrong = [(a, b) for a, b in zip(have, want) if a != b and not all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 * max(1, abs(y))) for x, y in zip(a, b))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(SQL) - {n for n in entry.queries() if n.startswith("op") or n == "pipeline"}))
def test_other_queries_give_rows(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
