import pytest

from framewise.plans import catalog
from tests.oracle import connect, same


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, sf, con, name):
    same(catalog.QUERIES[name](spark, sf), catalog.ORACLE[name], con)


def test_report(spark, sf):
    rows = catalog.QUERIES["a9_sk14_report"](spark, sf).collect()
    assert {r["kind"] for r in rows} >= {"near"}


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
