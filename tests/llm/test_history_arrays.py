import random

import numpy as np
import pyarrow as pa
import pytest

from gleanery.llm import history as H
from gleanery.llm import shingles as S
from gleanery.session import scratch


def triples(text):
    w = (text or "").split()
    return set(zip(w, w[1:], w[2:]))


def made(seed, n):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice("a b c d e f".split()) for _ in range(rnd.randrange(3, 14))) for _ in range(n)]


def test_prints_go_to_their_buckets_many_in_a_row(spark):
    """A row a print cost more than what is in it: conversion, sort and exchange of millions of rows."""
    H.P.put_counts(root := scratch(spark, "packed"), "orders/1", np.zeros(0, np.int64), np.zeros(0, np.uint16))
    texts = [f"{t} {i} {i + 1} {i + 2}" for i, t in enumerate(made(1, 200))]
    keys = [[{"fp": 7 * i - 300, "chk": i}, {"fp": 5, "chk": 5}] for i in range(200)]
    schema = pa.schema([("rid", pa.int64()), ("keys", pa.list_(pa.struct([("fp", pa.int64()), ("chk", pa.int64())]))), ("id", pa.int64()), ("chk", pa.int64()), ("canon", pa.string())])
    batch = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([*range(200)], keys, [*range(200)], [*range(200)], texts), schema)], schema=schema)
    rows = pa.Table.from_batches(H._rows_of(3, root, "orders/1")(iter([batch])))
    assert rows.num_rows <= 200 + 3
    got = []
    for bucket, data in zip(rows.column("bucket").to_pylist(), rows.column("packed").to_pylist()):
        got += [(bucket, *x) for x in np.frombuffer(data or b"", H.PACKED).tolist()]
    exact = {(x[2], x[3], x[4]) for x in got if x[1] == H.EXACT}
    assert exact == {(7 * i - 300, i, i) for i in range(200)} | {(5, 5, 0), (5, 5, 199)}
    flat, sizes = S.set_arrays(batch.column("canon"))
    row, key, form = S._signed(flat, sizes, np.zeros(len(flat), np.uint16), H.RARE, False, 3, 5)
    marks = H.marks(flat, sizes)[row]
    assert sorted(x[1:] for x in got if x[1] != H.EXACT) == sorted(zip(form.tolist(), key.tolist(), marks.tolist(), row.tolist()))
    assert all(x[0] == x[2] % 3 for x in got)


@pytest.mark.parametrize("piece, most", [(4, 1 << 22), (1 << 15, 50)])
def test_large_shares_are_cut_and_whole(spark, monkeypatch, piece, most):
    monkeypatch.setattr(H, "PIECE", piece)
    monkeypatch.setattr(H, "MOST", most)
    H.P.put_counts(root := scratch(spark, "pieces"), "orders/1", np.zeros(0, np.int64), np.zeros(0, np.uint16))
    keys = pa.array([[{"fp": i, "chk": -i}] for i in range(130)], pa.list_(pa.struct([("fp", pa.int64()), ("chk", pa.int64())])))
    nothing = pa.nulls(130, pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(range(130), pa.int64()), keys, nothing, nothing, pa.nulls(130, pa.string())], names=["rid", "keys", "id", "chk", "canon"])
    rows = pa.Table.from_batches(H._rows_of(2, root, "orders/1")(iter([batch])))
    data = [np.frombuffer(x, H.PACKED) for x in rows.column("packed").to_pylist()]
    assert max(len(x) for x in data) <= min(piece, most)
    assert sorted(x for d in data for x in d["fp"].tolist()) == [*range(130)]


def test_sets_and_shares_of_arrays_are_those_of_the_words():
    rnd = random.Random(1)
    texts = [*made(2, 300), None, "x y z", "a a a a"]
    flat, sizes = S.set_arrays(pa.array(texts))
    assert sizes.tolist() == [len(triples(t)) for t in texts]
    assert all((x[1:] > x[:-1]).all() for x in np.split(flat, np.cumsum(sizes)[:-1]))
    a = np.array([rnd.randrange(len(texts)) for _ in range(5000)])
    b = np.array([i if rnd.random() < 0.1 else rnd.randrange(len(texts)) for i in a])
    want = [bool(x := triples(texts[i])) and 5 * len(x & (y := triples(texts[j]))) >= 3 * len(x | y) for i, j in zip(a, b)]
    assert 300 < sum(want) < 4000
    for most in (1 << 21, 17):
        assert S.shares_reached(pa.array(texts, pa.large_string()), a, b, most=most).tolist() == want


def test_a_store_of_another_form_is_not_opened(spark):
    store = H.History.create(spark, scratch(spark, "form"), 2)
    assert H.History.open(spark, store.path).state["form"] == H.FORM
    del store.state["form"]
    store._write_commit()
    with pytest.raises(ValueError, match="form"):
        H.History.open(spark, store.path)
