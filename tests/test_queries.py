"""Every query with SQL gives DuckDB's rows on the small tables; the others run."""

import datetime
import decimal
import math

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = [n for p in __spark_entry__.PLANS for n in p.Q]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, (str, datetime.date)):
        return v
    if isinstance(v, (float, decimal.Decimal, int)):
        return "nan" if math.isnan(v) else round(float(v), 6) + 0.0
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, SF)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=str)
    sql = __spark_entry__.oracle_sql().get(name)
    if sql is None:
        assert got or name in ("fuzzy_gate",)
        return
    r = duck.execute(sql)
    names = [c[0] for c in r.description]
    at = sorted(range(len(names)), key=lambda i: names[i])
    assert [names[i] for i in at] == order
    assert sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str) == got
