
import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in entry.oracle_sql() if not n.startswith("op")])
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(want.columns)
    got = entry.queries()[name](spark, SF)
    assert sorted(got.columns) == columns
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
