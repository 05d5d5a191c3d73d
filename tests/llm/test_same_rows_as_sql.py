import duckdb
import pytest

from tidemill.llm import registry

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_substring_dedup", "op2_warc"])
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages"):
        con.sql(f"create view {table} as select * from '{DIR}/{table}.parquet'")
    want, found = con.sql(registry.oracle_sql()[name]), registry.queries()[name](spark, DIR)
    assert found.columns == want.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted(want.fetchall(), key=str)
