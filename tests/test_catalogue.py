import os

import pytest

from symloom.plans import catalogue, catalogue_code, catalogue_knowledge, catalogue_shapes, catalogue_store  # noqa: F401, they register queries
from tests.sqlcheck import SF_DIR, connect, same

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect()


def test_every_query_has_sql():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, con, name):
    same(spark, con, catalogue.QUERIES[name], catalogue.ORACLE_SQL[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["claim_id", "bm25"] and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
