import pytest

from cellweave.plans import catalog
from oracle import connect, same_rows


@pytest.fixture(scope="module")
def db(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, data, db, name):
    same_rows(catalog.QUERIES[name](spark, data), db, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_entry(spark, data):
    import __spark_entry__

    assert {r["field"] for r in __spark_entry__.entry(spark).collect()} >= {"ALL"}
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
