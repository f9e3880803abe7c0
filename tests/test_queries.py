import duckdb
import pytest

from meshwright.queries import QUERIES, SQL

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{AT}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_as_sql(spark, db, name):
    got = QUERIES[name](spark, AT)
    cols = sorted(got.columns)
    want = db.sql(SQL[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    plain = lambda rows: sorted(map(repr, rows))
    assert plain(tuple(r[c] for c in cols) for r in got.collect()) == plain(tuple(r[i] for i in at) for r in want.fetchall())
