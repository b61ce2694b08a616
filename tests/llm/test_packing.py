import random
from collections import Counter, defaultdict

import numpy as np

from gleanery.llm import packing as P


def least_bins(sizes, cap):
    """Exact, by trying every place of every item."""
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j, b in enumerate(bins):
            if b + sizes[i] <= cap:
                go(i + 1, bins[:j] + [b + sizes[i]] + bins[j + 1 :])
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bound_and_packing_enclose_the_optimum():
    rnd = random.Random(6)
    for _ in range(150):
        cap = rnd.randrange(4, 40)
        sizes = np.array(sorted((rnd.randrange(0, cap) for _ in range(rnd.randrange(1, 8))), reverse=True))
        opt, bins = least_bins(list(sizes), cap), P.best_fit_decreasing(sizes, cap)
        assert np.bincount(bins, weights=sizes).max() <= cap
        assert P.lower_bound(sizes, cap) <= opt <= bins.max() + 1


def test_pack(spark):
    rnd = random.Random(8)
    sizes = {i: rnd.choice([None, 0, 1, 5, 9, 10, 11, 25, rnd.randrange(40)]) for i in range(400)}
    kinds = [("small", 10), ("large", 64)]
    df = spark.createDataFrame(list(sizes.items()), "doc_id long, kind int").withColumnRenamed("kind", "n")
    for options in ({}, {"per_partition": 40, "fan": 3, "rounds": 3}):
        packed, bounds = P.pack(df, "doc_id", "n", kinds, **options)
        rows = packed.collect()
        for kind, cap in kinds:
            fill, pieces = Counter(), defaultdict(list)
            for r in rows:
                if r["kind"] == kind:
                    fill[r["container"]] += r["size"]
                    pieces[r["doc_id"]].append((r["first"], r["size"]))
            assert max(fill.values()) <= cap and set(pieces) == set(sizes)
            for i, p in pieces.items():
                n, p = sizes[i] or 0, sorted(p)
                assert len(p) == max(1, -(-n // cap)) and sum(s for _, s in p) == n and all(a == k * cap for k, (a, _) in enumerate(p))
        assert all(r["bins"] >= r["bound"] for r in bounds.collect())


def test_empty(spark):
    packed, bounds = P.pack(spark.createDataFrame([], "doc_id long, n int"), "doc_id", "n", [("a", 5)])
    assert packed.count() == 0 and bounds.count() == 0
