"""Every query with SQL gives the SQL's rows; every query runs on empty tables."""

import math

import duckdb
import pytest

from scriptsieve.plans import corpus as queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(x):
    return round(x, 9) if isinstance(x, float) and math.isfinite(x) else x


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(value(r[k]) for k in order) for r in found), key=repr)


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(df.columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows(names, want.fetchall())
    assert got or name == "none"


def test_arithmetic_equals_sql_to_the_last_bit(spark, tmp_path):
    quantities = [None, 0.0, -0.0, -7.5, 0.005, 12.34, 1e6 / 7, *(float(123457 * k) for k in range(1, 60)), *(10.0**k / 3 for k in range(-160, 155, 5)), 1e151, 1e200, float("nan"), float("inf"), -float("inf")]
    rates = [None, 0.0, 0.07, 0.1, float("nan")]
    rows = [(k, 1, q, rates[k % 5], rates[k // 5 % 5]) for k, q in enumerate(quantities)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    want = sorted(con.execute(queries.ORACLE_SQL["mth1_arithmetic"]).fetchall())
    assert repr([tuple(r) for r in sorted(queries.QUERIES["mth1_arithmetic"](spark, str(tmp_path)).collect())]) == repr(want)


def test_arithmetic_on_decimals_equals_sql_to_the_last_bit(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table lineitem as select range as l_orderkey, 1::integer as l_linenumber, (range % 50)::decimal(15, 2) as l_quantity, (range % 11 / 100)::decimal(15, 2) as l_discount, (range % 9 / 100)::decimal(15, 2) as l_tax from range(500)")
    con.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    want = sorted(con.execute(queries.ORACLE_SQL["mth1_arithmetic"]).fetchall())
    assert repr([tuple(r) for r in sorted(queries.QUERIES["mth1_arithmetic"](spark, str(tmp_path)).collect())]) == repr(want)
