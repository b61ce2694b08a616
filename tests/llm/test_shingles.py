import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import shingles as S


def py_alike(a, b):
    return bool(a) and bool(b) and 5 * len(a & b) >= 3 * len(a | b)


@pytest.mark.parametrize("rare", [0, 2, 1000])
def test_alike_sets_share_a_signature(rare):
    rnd = random.Random(rare)
    order = np.array([rnd.choice([0, 1, 2, 3, 9, 50]) for _ in range(64)], np.uint16)
    base = [rnd.sample(range(-500, 500), n) for n in [1, 1, 2, 2, 3, 4, 5, 8, 13, 20, 30, 60, 77, 90, 120, 127, 128, 129, 150, 215, 300]]
    sets = []
    for b in base:
        for _ in range(12):
            keep = rnd.sample(b, max(1, int(len(b) * rnd.uniform(0.55, 1))))
            sets.append(sorted(set(keep) | set(rnd.sample(range(-500, 500), int(len(b) * rnd.uniform(0, 0.35))))))
    flat, sizes = np.array([x for s in sets for x in s], np.int64), np.array([len(s) for s in sets])
    row, key = S._keys(flat, sizes, order, rare, False, 3, 5)
    signed = [set() for _ in sets]
    for r, k in zip(row, key):
        signed[r].add(int(k))
    pairs = 0
    for i, a in enumerate(sets):
        for j in range(i):
            if py_alike(set(a), set(sets[j])):
                pairs += 1
                assert signed[i] & signed[j], (a, sets[j])
    assert pairs > 100


def test_words_and_sets(spark):
    texts = [("A b—C, d!",), ("a a a a",), ("a b",), ("",), (None,), ("İx y z",)]
    df = spark.createDataFrame(texts, "t string")
    assert [r[0] for r in df.select(S.canonical(F.col("t"))).collect()] == ["a b c d", "a a a a", None, None, None, "i x y z"]
    sizes = [None if r[0] is None else len(r[0]) for r in df.select(S.canonical_set(S.canonical(F.col("t")))).collect()]
    assert sizes == [2, 1, None, None, None, 2]


def test_order_is_bounded_and_two_sided(spark):
    df = spark.createDataFrame([([1, 2], True, False), ([2, 3], False, True), (None, True, True), ([], True, True)], "s array<long>, e boolean, t boolean")
    assert S.fit_order(df, "s", 8).tolist() == [0, 0, 2, 0, 0, 0, 0, 0]
    assert S.fit_order(df, "s", 8, ("e", "t")).tolist() == [0, 0, 2, 0, 0, 0, 0, 0]
