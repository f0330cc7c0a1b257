"""Every query of the library that has SQL gives the SQL's rows, on the smallest tables."""

import os

import pytest

from causeway import queries

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5) + 0.0
    return float(v) if hasattr(v, "as_tuple") else v


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_sql(spark, duck, name):
    df = queries.queries()[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    answer = duck.execute(queries.oracle_sql()[name])
    order = [d[0] for d in answer.description]
    assert sorted(order) == names
    want = sorted((tuple(plain(r[order.index(c)]) for c in names) for r in answer.fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as entry

    if os.path.isdir(DIR):
        assert entry.entry(spark).columns == ["source_cluster_id", "target_cluster_id", "relation_count", "post_count", "avg_score", "countercausal_count"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
