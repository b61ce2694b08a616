import random

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import history as H
from gleanery.llm import shingles as S
from gleanery.session import materialize, scratch
from tests.llm.test_history import brute, prepared


def jobs(spark):
    return spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()


def test_an_ingest_starts_few_jobs(spark):
    """Each job costs the driver memory and time, and forty ingests of the form before ran out of it."""
    rnd = random.Random(3)
    prompts = [" ".join(rnd.choice("red blue cat dog on mat tin sun".split()) for _ in range(9)) for _ in range(20)]
    rows = [(100 * b + i, b, i, f"h{rnd.randrange(60)}", "A", None, rnd.choice(prompts) + rnd.choice(["", " x"]), 1, "x") for b in (1, 2, 3) for i in range(40)]
    store = H.History.create(spark, scratch(spark, "jobs"), 3)
    got, began = [], 0
    for n in (1, 2, 3):
        batch = materialize(prepared(spark, [r for r in rows if r[1] == n]).drop("batch_no"), "batch")
        began = jobs(spark)
        got += [r["rid"] for r in store.ingest(batch, str(n)).collect()]
    assert store.stats[-1]["repeated"] and store.stats[-1]["pairs"]
    assert jobs(spark) - began <= 24
    assert sorted(got) == brute(rows, [])


@pytest.mark.parametrize("seed", range(6))
def test_rounds_of_votes_are_the_greedy_choice(seed):
    rnd = random.Random(seed)
    records = {rid: rnd.sample(range(25), rnd.randrange(1, 4)) for rid in rnd.sample(range(1000), 40)}
    order = sorted(records)
    taken, want = set(), []
    for rid in order:
        if taken & set(records[rid]):
            want.append(rid)
        else:
            taken |= set(records[rid])
    schema = pa.schema([("rid", pa.int64()), ("ord", pa.int64()), ("kfp", pa.int64()), ("kchk", pa.int64()), ("state", pa.int8())])
    rows = [(rid, rid, k, -k, H.OPEN) for rid in order for k in records[rid]]
    while any(r[4] == H.OPEN for r in rows):
        rows.sort(key=lambda r: (r[2], r[3], r[4], r[1]))
        for step, size in ((H._contended, rnd.randrange(1, 30)), (H._voted, 7)):
            table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
            rows = [tuple(r.values()) for b in step(iter(table.to_batches(size))) for r in b.to_pylist()]
    assert sorted(r[0] for r in rows if r[4] == H.REFUSED) == want
    assert sorted({r[0] for r in rows if r[4] == H.ACCEPTED}) == sorted(set(order) - set(want))


def test_what_the_history_refuses_takes_no_key():
    schema = pa.schema([("rid", pa.int64()), ("ord", pa.int64()), ("kfp", pa.int64()), ("kchk", pa.int64()), ("state", pa.int8())])
    rows = [(1, 1, 7, 7, H.REFUSED), (1, 1, 8, 8, H.OPEN), (2, 2, 8, 8, H.OPEN)]
    table = pa.Table.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
    out = pa.Table.from_batches(H._voted(iter(table.to_batches()))).to_pylist()
    assert [(r["rid"], r["kfp"], r["state"]) for r in out] == [(1, 1, H.REFUSED), (2, 8, H.OPEN)]


def test_only_common_shingles_are_held_exactly(spark):
    df = spark.createDataFrame([([1, 2, 3],), ([2, 3],), ([3],), (None,), ([],)], "s array<long>")
    keys, counts = S.fit_common(df, "s", 1)
    assert (keys.tolist(), counts.tolist()) == ([2, 3], [2, 3])
    assert S.fit_common(df, "s", 1, most=1)[0].tolist() == [3]
    H.P.put_counts(root := scratch(spark, "counts"), "orders/1", keys, counts)
    assert H.P.counts_of(root, "orders/1", np.array([9, 3, 1, 2])).tolist() == [0, 3, 0, 2]
