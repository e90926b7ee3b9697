"""Every query of the subpackage that has SQL gives the SQL's rows."""

import duckdb
import pytest

from scriptsieve.llm import registry


def rounded(row):
    return tuple(round(x, 9) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    want = con.execute(registry.ORACLE_SQL[name])
    columns = sorted(c[0] for c in want.description)
    got = registry.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == columns
    said = con.execute(f"select {', '.join(columns)} from ({registry.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(rounded, said), key=repr) == sorted((rounded(r) for r in got.select(*columns).collect()), key=repr) and said
