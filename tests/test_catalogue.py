"""Every query against its SQL, as the driver compares them."""

import duckdb
import pytest

import __spark_entry__ as contract
from tallyline.plans import catalogue, listings

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalogue.QUERIES | listings.QUERIES, catalogue.SQL | listings.SQL
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, tmp_path, name):
    got = QUERIES[name](spark, SF)
    got.write.parquet(f"{tmp_path}/got")
    if name not in SQL:
        assert spark.read.parquet(f"{tmp_path}/got").count() > 0
        return
    cols = ", ".join(f'"{c}"' for c in sorted(got.columns))
    a, b = f"SELECT {cols} FROM '{tmp_path}/got/*.parquet'", f"SELECT {cols} FROM ({SQL[name]})"
    rows = lambda q: tables.sql(q).fetchall()
    assert rows(f"SELECT * FROM (({a}) EXCEPT ALL ({b})) LIMIT 3") == [] and rows(f"SELECT * FROM (({b}) EXCEPT ALL ({a})) LIMIT 3") == []


def test_entry(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) <= set(contract.queries())
