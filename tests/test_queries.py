import pytest

from branchlight.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages labels conversations events".split()


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    own = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    got = db.sql(ORACLES[name])
    names = list(got.columns)
    assert sorted(names) == cols
    assert own == sorted((tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in got.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql()) <= set(e.queries())
