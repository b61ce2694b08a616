import os

import pytest

from gleanery.llm import queries
from tests import oracle

pytestmark = pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    assert oracle.differing(spark, oracle.connect(), queries.QUERIES[name], queries.SQL[name]) is None


def test_ids_come_back(spark):
    assert all(r["changed"] == 0 for r in queries.p6_roundtrip(spark, oracle.SF).collect())
    assert queries.p6_ids(spark, oracle.SF).count() == queries.table(spark, oracle.SF, "documents").count()
