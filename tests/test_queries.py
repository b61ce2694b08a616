import os

import pytest

from gleanery.plans import problems, reference, store  # noqa: F401
from tests import oracle

QUERIES, SQL = problems.QUERIES | reference.QUERIES, problems.SQL | reference.SQL
pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, con, name):
    if name in SQL:
        assert oracle.differing(spark, con, QUERIES[name], SQL[name]) is None
    else:
        assert QUERIES[name](spark, oracle.SF).columns


def test_every_sql_has_its_query():
    assert set(SQL) <= set(QUERIES)
