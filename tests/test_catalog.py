"""Every query with SQL against DuckDB; the others run and give the columns they promise."""

import pytest

from edgeloom.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, duck, sf, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df())


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).first()["triangles"] == 7852
    assert set(e.oracle_sql()) <= set(e.queries())
