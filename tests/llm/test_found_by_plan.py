import os

import pytest

from gleanery.llm import proportions, queries
from tests import oracle


@pytest.mark.skipif(not os.path.isdir(oracle.SF), reason="no test tables")
def test_shortfalls_come_from_the_plan(spark, monkeypatch):
    made, quotas = [], proportions.quotas
    monkeypatch.setattr(proportions, "quotas", lambda available: made.append(quotas(available)) or made[-1])
    found = sorted(r["target_id"] for r in queries.p4_found(spark, oracle.SF).collect())
    assert len(made) == 1  # the allocation was part of it
    plan = queries.p4_targets(spark, oracle.SF).collect()
    assert found == sorted(r["target_id"] for r in plan if r["available"] < r["needed"]) and found
