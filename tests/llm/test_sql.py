"""Operators that have SQL give the SQL's rows, on the smallest tables."""

import os

import pytest

DIR = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
@pytest.mark.parametrize("name", ["op1_fingerprints", "op2_licenses", "op4_url_filter", "op11_substrings", "op12_manifest"])
def test_rows_equal_sql(spark, name):
    from causeway.llm import queries

    con = pytest.importorskip("duckdb").connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = queries.queries()[name](spark, DIR)
    names = sorted(df.columns)
    answer = con.execute(queries.oracle_sql()[name])
    order = [d[0] for d in answer.description]
    want = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in answer.fetchall()), key=repr)
    assert sorted(order) == names and sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr) == want
