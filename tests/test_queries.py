import duckdb
import pytest

from tidemill.plans import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows_as_sql(spark, db, name):
    found = registry.queries()[name](spark, DIR)
    columns = sorted(found.columns)
    want = db.sql(registry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    key = lambda row: tuple(map(str, row))
    got = sorted(map(key, found.select(columns).toPandas().astype(object).itertuples(index=False)))
    assert got == sorted(map(key, want.project(", ".join(f'"{c}"' for c in columns)).df().astype(object).itertuples(index=False)))


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
